"""Registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import POS, Flow
from ..functions import arrays as A
from ..functions import formats as V
from ..functions import scalars as S
from ..operators import graph, segmented, stateful, tags
from ..operators.ndarray import NdArray, fft_arrays, lehmer
from . import query as dsl
from .registry import LINE_ORDER, LINE_SQL, ORACLE, QUERIES, register  # noqa: F401
from .registry import rounded as _round
from .registry import table as _t

def _events(spark: SparkSession, sf_dir: str) -> Flow:
    return Flow(_t(spark, sf_dir, "events"), "user_id", ("ts", "event_id"))


# --- the query language ------------------------------------------------------------------
@register("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")
def fold_groups_sorted(spark, sf_dir):
    """filter, map, then foldGroupsBy over adjacent keys: the flagship."""
    line = _t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast(dict(_t(spark, sf_dir, "lineitem").dtypes)["l_shipdate"]))
    price = F.col("l_extendedprice")
    return segmented.fold_groups_by(
        Flow(line, None, LINE_ORDER), ["l_returnflag", "l_linestatus"], presorted=True,
        sum_qty=_round(F.sum("l_quantity"), 2), sum_base=_round(F.sum(price), 2), sum_disc=_round(F.sum(price * (1 - F.col("l_discount"))), 2),
        avg_disc=_round(F.avg("l_discount"), 6), n=F.count(F.lit(1)),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of the line items of each flag and status."""
    return fold_groups_sorted(spark, sf_dir)


@register(f"SELECT {LINE_SQL}, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def map_elements(spark, sf_dir):
    f = Flow(_t(spark, sf_dir, "lineitem"), None, LINE_ORDER)
    return f.map(charge=F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).df


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
def filter_elements(spark, sf_dir):
    f = Flow(_t(spark, sf_dir, "lineitem"), None, LINE_ORDER).filter((F.col("l_discount") > 0.05) & (F.col("l_quantity") < 24))
    return f.df.select("l_orderkey", "l_linenumber", "l_quantity")


@register("SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 2) AS x FROM lineitem WHERE l_quantity < 24")
def fold_flow(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").filter("l_quantity < 24")
    f = Flow(line.select(*LINE_ORDER, (F.col("l_extendedprice") * F.col("l_discount")).alias("x")), None, LINE_ORDER)
    return dsl.Q.fold(f, F.lit(0.0), aggregate=F.sum).select(_round("x", 2).alias("x"))


@register("""SELECT o._pos AS _pos, o_orderkey, c_name FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, o_orderkey FROM orders) o
    JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _pos, c_name FROM customer) c ON o._pos = c._pos""")
def zip_positional(spark, sf_dir):
    o = Flow(_t(spark, sf_dir, "orders").select("o_orderkey"), None, ("o_orderkey",)).extend(o=F.col("o_orderkey")).indexed().select("o")
    c = Flow(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), None, ("c_custkey",)).indexed().select("c_name")
    return o.zip(c).df.select(POS, F.col("o").alias("o_orderkey"), "c_name")


@register("""SELECT a.p AS _pos, p_partkey + s_suppkey * 10 + c_custkey * 100 AS x FROM
    (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS p, p_partkey FROM part) a
    JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS p, s_suppkey FROM supplier) b ON a.p = b.p
    JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS p, c_custkey FROM customer) c ON a.p = c.p""")
def zip_with3(spark, sf_dir):
    one = lambda t, k: Flow(_t(spark, sf_dir, t).select(k, F.col(k).alias("x")), None, (k,)).indexed().select("x")
    return dsl.Q.map(lambda a, b, c: a + b * 10 + c * 100, one("part", "p_partkey"), one("supplier", "s_suppkey"), one("customer", "c_custkey")).df


RUNS = """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


@register(RUNS + "SELECT user_id, CAST(run - 1 AS BIGINT) AS _pos, min(event_type) AS event_type, count(*) AS len FROM r GROUP BY user_id, run")
def groups_runs(spark, sf_dir):
    return segmented.groups(_events(spark, sf_dir), "event_type").df


@register(RUNS + "SELECT user_id, CAST(run - 1 AS BIGINT) AS _pos, min(event_type) AS event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM r GROUP BY user_id, run")
def fold_groups_runs(spark, sf_dir):
    return segmented.fold_groups_by(_events(spark, sf_dir), ["event_type"], total=_round(F.sum("value")), mean=_round(F.avg("value"), 6))


@register("""WITH RECURSIVE e AS (SELECT user_id, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, i, h AS start, 1 AS run FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.i, CASE WHEN abs(e.h - r.start) <= 6 THEN r.start ELSE e.h END, CASE WHEN abs(e.h - r.start) <= 6 THEN r.run ELSE r.run + 1 END
          FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, CAST(min(start) AS BIGINT) AS h, count(*) AS len FROM r GROUP BY user_id, run""")
def groups_by_start(spark, sf_dir):
    """Runs by a predicate against the first element of the run: hours at most six apart from it."""
    f = _events(spark, sf_dir).extend(h=F.hour("ts").cast("long"))
    return segmented.groups_by(f, "h", lambda new, start: abs(new - start) <= 6, "long")


@register(f"""WITH v AS (SELECT row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS p, l_quantity FROM lineitem),
    s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, o_orderkey % 4 AS n, sum(o_orderkey % 4) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS e FROM orders)
    SELECT _pos, o_orderkey, round(CASE WHEN n = 0 THEN 0 ELSE total END, 2) AS total FROM s LEFT JOIN
    (SELECT o_orderkey AS k, sum(l_quantity) AS total, count(*) AS c FROM s JOIN v ON p >= e - n AND p < e GROUP BY 1) g ON k = o_orderkey WHERE coalesce(c, 0) = n""")
def folds_segments(spark, sf_dir):
    """Segments of length o_orderkey mod 4 over all quantities in order; an incomplete last one is dropped."""
    segs = Flow(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 4).alias("n")), None, ("o_orderkey",))
    vals = Flow(_t(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity"), None, LINE_ORDER).indexed().select("l_quantity")
    out = segmented.folds(segs, vals, "name", "n", total=(F.sum("l_quantity"), F.lit(0.0)))
    return out.select(POS, F.col("name").alias("o_orderkey"), _round("total", 2).alias("total"))


@register("""SELECT s_suppkey, -s_acctbal AS neg, abs(s_acctbal) AS abs_, CAST(sign(s_acctbal) AS DOUBLE) AS sig, s_acctbal + 1 AS add_, s_acctbal - 1 AS sub_,
    s_acctbal * 2 AS mul_, s_acctbal / 4 AS div_, s_nationkey = 3 AS eq, s_nationkey <> 3 AS neq, s_nationkey > 3 AS gt, s_nationkey >= 3 AS ge, s_nationkey < 3 AS lt, s_nationkey <= 3 AS le FROM supplier""")
def scalar_operators(spark, sf_dir):
    a, k, o = F.col("s_acctbal"), F.col("s_nationkey"), S.OPERATORS
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", o["neg"](a).alias("neg"), o["abs"](a).alias("abs_"), o["signum"](a).alias("sig"), o["add"](a, F.lit(1)).alias("add_"), o["sub"](a, F.lit(1)).alias("sub_"),
        o["mul"](a, F.lit(2)).alias("mul_"), o["div"](a, F.lit(4)).alias("div_"), *(o[n](k, F.lit(3)).alias(n) for n in ("eq", "neq", "gt", "ge", "lt", "le")),
    )


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
    strftime(CAST(o_orderdate AS DATE) + 1, '%d.%m.%Y') AS nxt, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
    CAST(year(o_orderdate) * 65536 + month(o_orderdate) * 256 + day(o_orderdate) AS INTEGER) AS packed, true AS back FROM orders""")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", S.string_of_date(d).alias("s"), F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofmonth(d).cast("long").alias("d"), S.show_date(S.next_day(d), ".", True).alias("nxt"),
        S.diff_days(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), S.packed_date32(d).alias("packed"), (S.unpacked_date32(S.packed_date32(d)) == d).alias("back"),
    )


@register("SELECT o_orderkey, strftime(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 2, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM orders")
def date_ranges(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(S.date_range(d, F.date_add(d, 2))).alias("t")).select("o_orderkey", S.string_of_date(F.col("t")).alias("day"))


@register("SELECT n_nationkey, n_name || '/' || n_regionkey AS second, CAST(n_nationkey * 2 AS BIGINT) AS doubled FROM nation WHERE n_regionkey > 0")
def json_plan(spark, sf_dir):
    """A JSON plan: filter, then map to a tuple, then take its fields."""
    q = dsl.Q(spark, sf_dir)
    nation = q.from_frame(_t(spark, sf_dir, "nation"), ["n_nationkey"], S.row(F.col("n_nationkey").cast("long"), F.col("n_name"), F.col("n_regionkey").cast("long")))
    var = {"_type": "var", "var": 0}
    get = lambda k, of=var: {"_type": "sop", "sop": "get", "field": k, "args": [of]}
    lit = lambda v: {"_type": "lit", "lit": "int", "value": v}
    sop = lambda n, *a: {"_type": "sop", "sop": n, "args": list(a)}
    plan = {"out": "f2", "nodes": [
        {"_type": "filteri", "output": "f1", "inputs": ["in"], "fun": {"_type": "lam", "body": sop("gt", get(3), lit(0))}},
        {"_type": "mapi", "output": "f2", "inputs": ["f1"], "fun": {"_type": "lam", "body": sop("row", get(1), get(2), get(3), sop("mul", get(1), lit(2)))}},
    ]}
    x = dsl.load(plan, q, {"in": nation}).df
    return x.select("n_nationkey", F.concat(F.col("x._2"), F.lit("/"), F.col("x._3").cast("string")).alias("second"), F.col("x._4").alias("doubled"))


# --- flow operators ------------------------------------------------------------------------
@register("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS _pos FROM events")
def indexed(spark, sf_dir):
    return _events(spark, sf_dir).indexed().df.select("user_id", "event_id", POS)


@register(f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS _pos FROM lineitem")
def indexed_single_stream(spark, sf_dir):
    """Dense positions of one long stream without a single-task window."""
    line = _t(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return Flow(line, None, LINE_ORDER).indexed().df.select("l_orderkey", "l_linenumber", "l_partkey", POS)


@register("""SELECT user_id, event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS top FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def scan_prefix(spark, sf_dir):
    out = _events(spark, sf_dir).scan(total=F.sum("value"), top=F.max("value")).df
    return out.select("user_id", "event_id", _round("total").alias("total"), "top")


@register("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def head_streams(spark, sf_dir):
    return _events(spark, sf_dir).head(3)[0].df.select("user_id", "event_id")


@register("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3")
def head_rest(spark, sf_dir):
    return _events(spark, sf_dir).head(3)[1].df.select("user_id", "event_id")


@register("SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS _pos, event_id FROM events")
def funnel_streams(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id").funnel().extend(e=F.col("event_id")).indexed().df.select(POS, F.col("e").alias("event_id"))


@register("SELECT event_id, value FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def project_stream(spark, sf_dir):
    first = _t(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return _events(spark, sf_dir).project(first).df.select("event_id", "value")


@register("SELECT count(DISTINCT user_id) AS arity FROM events")
def sources_arity(spark, sf_dir):
    return _events(spark, sf_dir).arity()


@register("SELECT -user_id AS user_id, event_id FROM events")
def map_index(spark, sf_dir):
    return _events(spark, sf_dir).map_index(-F.col("user_id")).df.select("user_id", "event_id")


@register("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS _pos, event_type AS x FROM events
    UNION ALL SELECT DISTINCT user_id, -1, 'start' FROM events""")
def prepend_elements(spark, sf_dir):
    f = _events(spark, sf_dir).map(x=F.col("event_type"))
    return f.prepend(spark.createDataFrame([(0, "start")], f"{POS} long, x string")).df.select("user_id", POS, "x")


@register("SELECT p_partkey, unnest(range(p_size % 4)) AS _copy FROM part")
def replicates_elements(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("n", F.col("p_size") % 4)
    return segmented.replicates(Flow(p.select("p_partkey", "n"), None, ("p_partkey",)), "n").df.select("p_partkey", F.col("_copy").cast("long").alias("_copy"))


@register("SELECT vec_id, CAST(i AS BIGINT) AS at, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(64)) AS r(i)")
def concat_arrays(spark, sf_dir):
    f = Flow(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), None, ("vec_id",))
    return segmented.concat(f, "embedding").df.select("vec_id", F.col("_at").cast("long").alias("at"), F.col("x").cast("double").alias("x"))


@register("""WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events),
    k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1) // 4 AS c FROM e)
    SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM k GROUP BY user_id, g, c""")
def chunk_on(spark, sf_dir):
    out = segmented.chunk_on(_events(spark, sf_dir), "event_id", 4, F.col("event_type") == "purchase").df
    return out.select("user_id", F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@register("""WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events),
    k AS (SELECT *, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o FROM e)
    SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM k WHERE o = 1 GROUP BY user_id, g""")
def segment_by_predicates(spark, sf_dir):
    """From a click to the next purchase, both included."""
    out = segmented.segment(_events(spark, sf_dir), F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id").df
    return out.select("user_id", F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@register("SELECT CAST(i AS INTEGER) AS pass, p_partkey AS seg, CAST(p_size % 7 + i AS BIGINT) AS x FROM part, unnest(range(5)) AS r(i) WHERE i < p_size % 5")
def ratchet_passes(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).cast("long").alias("a"), (F.col("p_size") % 7 + F.col("p_size") % 5).cast("long").alias("b"))
    return segmented.ratchet(p, "a", "b", "p_partkey")[0]


@register("SELECT CAST(i AS INTEGER) AS pass, count(*) AS len FROM part, unnest(range(5)) AS r(i) WHERE i < p_size % 5 GROUP BY i")
def ratchet_lengths(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.lit(0).cast("long").alias("a"), (F.col("p_size") % 5).cast("long").alias("b"))
    return segmented.ratchet(p, "a", "b", "p_partkey")[1]


@register("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.nth, b.nth) AS _nth, CASE WHEN a.k IS NULL THEN 'r' || s_suppkey WHEN b.k IS NULL THEN 'l' || c_custkey ELSE c_custkey || '-' || s_suppkey END AS v
    FROM (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer) a
    FULL JOIN (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier) b ON a.k = b.k AND a.nth = b.nth""")
def merge_pairs(spark, sf_dir):
    """Full outer merge of customers and suppliers by nation; equal keys pair off one to one."""
    c, s = _nation_sides(spark, sf_dir)
    show = lambda side, x: F.col(f"{side}.{x}").cast("string")
    out = stateful.merge(c, s, "k", ["c_custkey"], ["s_suppkey"], F.concat(show("l", "c_custkey"), F.lit("-"), show("r", "s_suppkey")), F.concat(F.lit("l"), show("l", "c_custkey")), F.concat(F.lit("r"), show("r", "s_suppkey")))
    return out.withColumn("_nth", F.col("_nth").cast("long"))


def _nation_sides(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")


@register("""SELECT a.k AS k, c_custkey + s_suppkey AS v FROM (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer) a
    JOIN (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier) b ON a.k = b.k AND a.nth = b.nth""")
def merge_maybe_inner(spark, sf_dir):
    c, s = _nation_sides(spark, sf_dir)
    none = F.lit(None).cast("long")
    return stateful.merge(c, s, "k", ["c_custkey"], ["s_suppkey"], F.col("l.c_custkey") + F.col("r.s_suppkey"), none, none, drop_null=True).select("k", "v")


@register("""SELECT a.k AS k, c_custkey AS v FROM (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer) a
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier) b WHERE a.k = b.k AND a.nth = b.nth)""")
def merge_maybe_left_only(spark, sf_dir):
    c, s = _nation_sides(spark, sf_dir)
    none = F.lit(None).cast("long")
    return stateful.merge(c, s, "k", ["c_custkey"], ["s_suppkey"], none, F.col("l.c_custkey"), none, drop_null=True).select("k", "v")


@register("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS v FROM events GROUP BY ALL),
    s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY user_id)
    SELECT user_id, strftime(s.day, '%Y-%m-%d') AS day, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS v FROM s LEFT JOIN d USING (user_id, day)""")
def pad_forward_days(spark, sf_dir):
    d = _t(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(_round(F.sum("value")).alias("v"))
    out = stateful.pad_forward(d, "day", "v", ["user_id"], "interval 1 day")
    return out.select("user_id", S.string_of_date(F.col("day")).alias("day"), "v")


@register("SELECT user_id, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type")
def decimate_equal(spark, sf_dir):
    return stateful.decimate(_events(spark, sf_dir), lambda before, x: before == x, "event_type").df.select("user_id", "event_id")


@register("SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 0")
def pack_by_flags(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    at = Flow(p.select("p_partkey", "p_name", (F.col("p_size") % 3 == 0).alias("keep"), F.col("p_partkey").alias("k")), None, ("p_partkey",)).indexed()
    return stateful.pack(at.select("keep"), at.select("k", "p_name"), "keep").df.select(F.col("k").alias("p_partkey"), "p_name")


@register("SELECT CAST(l_orderkey % 8 AS INTEGER) AS _to, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_orderkey % 8 < 6 GROUP BY ALL")
def shuffle_by_number(spark, sf_dir):
    """Streams 0 to 5 by order key modulo 8; 6 and 7 are out of range and dropped."""
    kept, _ = stateful.shuffle(Flow(_t(spark, sf_dir, "lineitem"), None, LINE_ORDER), (F.col("l_orderkey") % 8).cast("int"), 6)
    return kept.fold(n=F.count(F.lit(1)), q=_round(F.sum("l_quantity"), 2))


@register("SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 8 >= 6")
def shuffle_spill(spark, sf_dir):
    return stateful.shuffle(Flow(_t(spark, sf_dir, "lineitem"), None, LINE_ORDER), (F.col("l_orderkey") % 8).cast("int"), 6)[1].agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(i AS INTEGER) AS _to, round(sum(embedding[i + 1]), 3) AS s FROM embeddings, unnest(range(16)) AS r(i) GROUP BY i")
def distribute_arrays(spark, sf_dir):
    f = Flow(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), None, ("vec_id",))
    return stateful.distribute(f, "embedding", 16)[0].fold(s=_round(F.sum("x"), 3))


@register("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS _pos, event_id FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i % 3 = 0""")
def compact_every_third(spark, sf_dir):
    """A stateful filter with an opaque step."""
    return stateful.compact(_events(spark, sf_dir), ["event_id"], 0, lambda s, e: (s + 1, e if (s + 1) % 3 == 0 else None), {"event_id": "long"}).df


@register("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i, k) - 1 AS _pos, event_id * 10 + k AS y FROM
    (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), unnest(range(3)) AS r(k) WHERE k < i % 3""")
def process_flat_map(spark, sf_dir):
    """A stateful flat map: the i-th element of a stream gives i mod 3 results."""
    return stateful.process(_events(spark, sf_dir), ["event_id"], 0, lambda s, e: (s + 1, [e * 10 + k for k in range(s % 3)]), {"y": "long"}).df


@register("SELECT row_number() OVER (ORDER BY o_orderkey, k) - 1 AS _pos, o_orderkey * 10 + k AS y FROM orders, unnest(range(4)) AS r(k) WHERE k < o_orderkey % 4")
def unfolds_elements(spark, sf_dir):
    """Give k results of an element, then go on to the next."""
    f = Flow(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("x")), None, ("o_orderkey",))
    step = lambda v, s: ("give", v[0] * 10 + s, s + 1) if s < v[0] % 4 else ("next", 0)
    return stateful.unfolds(f, ["x"], 0, step, {"y": "long"}).df


@register("""WITH f AS (SELECT n_nationkey, n_regionkey % 2 = 0 AS flag, row_number() OVER (PARTITION BY n_regionkey % 2 = 0 ORDER BY n_nationkey) - 1 AS i FROM nation),
    y AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey AS x FROM customer), n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey AS x FROM orders)
    SELECT n_nationkey, y.x AS x FROM f JOIN y USING (i) WHERE flag UNION ALL SELECT n_nationkey, n.x FROM f JOIN n USING (i) WHERE NOT flag""")
def combine_by_flags(spark, sf_dir):
    flags = Flow(_t(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") % 2 == 0).alias("flag")), None, ("n_nationkey",))
    side = lambda t, k: Flow(_t(spark, sf_dir, t).select(k, F.col(k).alias("x")), None, (k,))
    return stateful.combine2(flags, "flag", side("customer", "c_custkey"), side("orders", "o_orderkey"), "x").df.select("n_nationkey", "x")


@register("SELECT user_id, round(list_reduce(list_prepend(0.0, list(value ORDER BY ts, event_id)), lambda a, x: a / 2 + x), 6) AS s FROM events GROUP BY user_id")
def ordered_left_fold(spark, sf_dir):
    """A left fold whose result depends on the order."""
    out = _events(spark, sf_dir).ordered_fold("value", F.lit(0.0), lambda a, x: a / 2 + x, "s")
    return out.select("user_id", _round("s", 6).alias("s"))


# --- array functions -------------------------------------------------------------------------
ARRAYS = "WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v, list(event_type ORDER BY ts, event_id) AS k, list(CAST(hour(ts) AS BIGINT) ORDER BY ts, event_id) AS h FROM events GROUP BY user_id) "


def _user_arrays(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", "value", "event_type", F.hour("ts").cast("long").alias("h")).alias("s"))
    a = e.groupBy("user_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return a.select("user_id", F.col("s.value").alias("v"), F.col("s.event_type").alias("k"), F.col("s.h").alias("h"))


@register(ARRAYS + """SELECT user_id, len(v) AS n, round(list_sum(v), 4) AS total, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, v[1] AS first, v[-1] AS last, h[3] AS third,
    round(list_product(list_transform(v, lambda x: 1 + x / 1000000)), 6) AS prod FROM a""")
def array_reductions(spark, sf_dir):
    return _user_arrays(spark, sf_dir).select(
        "user_id", A.length("v").cast("long").alias("n"), _round(A.total("v")).alias("total"), _round(A.mean("v"), 6).alias("mean"), _round(A.std("v"), 6).alias("std"), A.first("v").alias("first"), A.last("v").alias("last"),
        A.index("h", 2).alias("third"), _round(A.product(F.transform("v", lambda x: 1 + x / 1000000)), 6).alias("prod"),
    )


@register("""WITH e AS (SELECT user_id, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events) SELECT user_id, round((count(*) * sum(x * y) - sum(x) * sum(y)) /
    (sqrt(count(*) * sum(x * x) - sum(x) * sum(x)) * sqrt(count(*) * sum(y * y) - sum(y) * sum(y))), 5) AS r FROM e GROUP BY user_id""")
def array_correlate(spark, sf_dir):
    return _user_arrays(spark, sf_dir).select("user_id", _round(A.correlate("v", "h"), 5).alias("r"))


@register(ARRAYS + """SELECT user_id, array_to_string(h[2:], ',') AS tail, array_to_string(h[:-2], ',') AS init, array_to_string(list_reverse(h), ',') AS rev, array_to_string(list_filter(h, lambda x: x > 12), ',') AS big,
    array_to_string(list_transform(h, lambda x: x * 2), ',') AS doubled, CASE WHEN len(h) >= 5 THEN array_to_string(h[3:5], ',') END AS cut, CAST(list_position(list_transform(h, lambda x: x > 20), true) - 1 AS BIGINT) AS at FROM a""")
def array_parts(spark, sf_dir):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _user_arrays(spark, sf_dir).select(
        "user_id", show(A.tail("h")).alias("tail"), show(A.init("h")).alias("init"), show(F.reverse("h")).alias("rev"), show(A.keep("h", lambda x: x > 12)).alias("big"),
        show(F.transform("h", lambda x: x * 2)).alias("doubled"), show(A.slice_("h", F.lit(2), F.lit(3))).alias("cut"), A.find_index("h", lambda x: x > 20).cast("long").alias("at"),
    )


@register("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m), g AS (SELECT user_id, run, min(event_type) AS x, count(*) AS n FROM r GROUP BY user_id, run)
    SELECT user_id, string_agg(x || n, ' ' ORDER BY run) AS runs, string_agg(x, ' ' ORDER BY run) AS once FROM g GROUP BY user_id""")
def array_groups(spark, sf_dir):
    a = _user_arrays(spark, sf_dir)
    return a.select("user_id", F.array_join(F.transform(A.groups("k"), lambda g: F.concat(g["x"], g["n"].cast("string"))), " ").alias("runs"), F.array_join(A.distinct_sorted("k"), " ").alias("once"))


@register(ARRAYS + """SELECT user_id, array_to_string(list_filter(h, lambda x: x % 3 = 0), ',') AS p0, array_to_string(list_filter(h, lambda x: x % 3 = 1), ',') AS p1 FROM a""")
def array_partition(spark, sf_dir):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    a = _user_arrays(spark, sf_dir).withColumn("p", A.partition("h", lambda x: x % 3, 2))
    return a.select("user_id", show(F.col("p")[0]).alias("p0"), show(F.col("p")[1]).alias("p1"))


@register("""WITH e AS (SELECT user_id, CAST(hour(ts) AS BIGINT) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT user_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS kept FROM (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM e) WHERE s % 2 = 0 GROUP BY user_id""")
def array_compact(spark, sf_dir):
    """Elements at which the running sum is even: a stateful filter inside the JVM."""
    step = lambda s, x: (s + x, F.when((s + x) % 2 == 0, x))
    a = _user_arrays(spark, sf_dir).select("user_id", A.compact("h", F.lit(0).cast("long"), step, "bigint").alias("c")).filter(F.size("c") > 0)
    return a.select("user_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("kept"))


@register("""WITH o AS (SELECT o_custkey, list(CAST(year(o_orderdate) AS BIGINT) ORDER BY o_orderkey) AS y FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(list_transform(y, lambda x, i: x || ';'), '') AS ends, array_to_string(y, ';') AS mids FROM o""")
def array_separators(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").cast("string").alias("y")))), lambda x: F.array(x["y"])).alias("a"))
    sep = F.array(F.lit(";"))
    return o.select("o_custkey", F.array_join(A.concat_with("a", sep), "").alias("ends"), F.array_join(A.intercalate("a", sep), "").alias("mids"))


@register("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS c, l_linenumber AS v FROM lineitem),
    r AS (SELECT l_orderkey // 4 AS g, l_orderkey, c, v FROM l) SELECT g, c AS col, string_agg(CAST(v AS VARCHAR), ',' ORDER BY l_orderkey) AS vs FROM r GROUP BY g, c""")
def ragged_transpose(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))), lambda x: x["l_linenumber"]).alias("r"))
    rows = line.groupBy(F.floor(F.col("l_orderkey") / 4).alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "r"))), lambda x: x["r"]).alias("a"))
    out = rows.select("g", F.posexplode(A.ragspose3("a")).alias("col", "v"))
    return out.select("g", F.col("col").cast("long").alias("col"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("vs"))


@register("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, t, CASE WHEN suffix(t, chr(10)) THEN left(t, length(t) - 1) ELSE t END AS body FROM d)
    SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS BIGINT) AS rows_,
    CAST(CASE WHEN t = '' THEN 0 ELSE list_sum(list_transform(string_split(body, chr(10)), lambda x: len(string_split(x, ' ')))) END AS BIGINT) AS fields FROM b""")
def dice_text(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", A.dice_sep(F.coalesce("text", F.lit("")), " ", "\n").alias("r"))
    return d.select("doc_id", F.size("r").cast("long").alias("rows_"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("fields"))


@register("SELECT doc_id, len(regexp_extract_all(text, '[^.]*[.]|[^.]+')) AS pieces, trim(regexp_extract(text, '[^.]*[.]|[^.]+')) AS head FROM documents")
def segment_text(spark, sf_dir):
    """Pieces that end with a full stop."""
    d = _t(spark, sf_dir, "documents").select("doc_id", A.segment_on("text", ".").alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("pieces"), F.coalesce(F.trim(F.get("p", F.lit(0))), F.lit("")).alias("head"))


@register("SELECT doc_id, trim(text, 'aeiou .') AS t FROM documents")
def trim_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.btrim("text", F.lit("aeiou .")).alias("t"))


# --- dense arrays ----------------------------------------------------------------------------
MATRIX = "WITH m AS (SELECT vec_id AS i, CAST(j AS BIGINT) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) AS r(j)), s AS (SELECT max(vec_id) + 1 AS n FROM embeddings) "


def _matrix(spark, sf_dir) -> NdArray:
    """All embeddings: a row for each vector, a column for each entry."""
    e = _t(spark, sf_dir, "embeddings")
    rows, columns = e.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    cells = e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    return NdArray(cells.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (rows, columns))


def _cells(a: NdArray, places: int = 6) -> DataFrame:
    return a.df.select(*a.ix, _round("v", places).alias("v"))


@register(MATRIX + "SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def matrix_product(spark, sf_dir):
    """The products of all pairs of columns, each over all rows."""
    m = _matrix(spark, sf_dir)
    return _cells(m.transpose().mmult(m), 4)


@register(MATRIX + "SELECT j AS i0, i AS i1, round(v, 6) AS v FROM m")
def matrix_transpose(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).transpose())


@register(MATRIX + "SELECT round(sum(v), 4) AS trace FROM m WHERE i = j")
def matrix_trace(spark, sf_dir):
    return _matrix(spark, sf_dir).trace().select(_round("trace").alias("trace"))


@register(MATRIX + "SELECT i AS i0, round(sum(v), 4) AS v FROM m GROUP BY i")
def array_sum_inner(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).sum(), 4)


@register(MATRIX + "SELECT round(sum(v), 3) AS total, round(max(v), 6) AS top, count(*) AS n FROM m")
def array_fold_all(spark, sf_dir):
    return _matrix(spark, sf_dir).fold_all(total=_round(F.sum("v"), 3), top=_round(F.max("v"), 6), n=F.count(F.lit(1)))


@register(MATRIX + "SELECT (i * 64 + j) // 32 AS i0, (i * 64 + j) % 32 AS i1, round(v, 6) AS v FROM m")
def array_reshape(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _cells(m.reshape((m.shape[0] * m.shape[1] // 32, 32)))


@register(MATRIX + "SELECT i AS i0, j AS i1, round(v, 6) AS v FROM m UNION ALL SELECT i, j + 64, round(2 * v, 6) FROM m")
def array_append(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _cells(m.append(m.map(lambda v: 2 * v)))


@register(MATRIX + "SELECT i - 4 AS i0, j - 8 AS i1, round(v, 6) AS v FROM m WHERE i >= 4 AND i < 14 AND j >= 8 AND j < 20")
def array_extract(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).extract((4, 8), (10, 12)))


@register(MATRIX + "SELECT i AS i0, round(v, 6) AS v FROM m WHERE j = 5")
def array_slice(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).slice(i1=5))


@register(MATRIX + "SELECT i AS i0, j AS i1, CAST(k AS BIGINT) AS i2, round(v, 6) AS v FROM m, unnest(range(3)) AS r(k)")
def array_extend(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).extend(3))


@register(MATRIX + "SELECT n - 1 - i AS i0, (j * 13) % 64 AS i1, round(v, 6) AS v FROM m, s")
def array_backpermute(spark, sf_dir):
    """Gather: the output cell (i, j) comes from (n - 1 - i, 5 j mod 64); 13 is the inverse of five mod 64."""
    m = _matrix(spark, sf_dir)
    return _cells(m.backpermute(m.shape, lambda i, j: (m.shape[0] - 1 - i, F.pmod(j * 5, F.lit(64)))))


@register(MATRIX + ", a AS (SELECT unnest(range(n + 4)) AS a FROM s) SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, round(coalesce(v, -1), 6) AS v FROM a CROSS JOIN unnest(range(64)) AS r(b) LEFT JOIN m ON i = a AND j = b")
def array_gather_default(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    shape = (m.shape[0] + 4, m.shape[1])
    return _cells(m.backpermute(shape, lambda i, j: (i, j), NdArray.generate(spark, shape, lambda i, j: F.lit(-1.0))))


@register(MATRIX + "SELECT i AS i0, 2 * j AS i1, round(v, 6) AS v FROM m UNION ALL SELECT i, 2 * j + 1, round(v * v, 6) FROM m")
def array_interleave(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _cells(m.interleave(m.map(lambda v: v * v)))


@register(MATRIX + "SELECT a.i AS i0, a.j AS i1, round(a.v - b.v, 6) AS v FROM m a JOIN m b ON a.i = b.j AND a.j = b.i")
def array_zip_with(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _cells(m.zip_with(m.transpose(), lambda a, b: a - b))


STENCIL = "(VALUES (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 0, -4.0)) AS k(di, dj, c)"
LAPLACE = {(0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 0): -4.0}


@register(MATRIX + f"SELECT a.i AS i0, a.j AS i1, round(sum(c * coalesce(b.v, 2.0)), 5) AS v FROM m a CROSS JOIN {STENCIL} LEFT JOIN m b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY 1, 2")
def stencil_const(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).stencil(LAPLACE, "const", 2.0), 5)


@register(MATRIX + f"SELECT a.i AS i0, a.j AS i1, round(sum(c * b.v), 5) AS v FROM m a CROSS JOIN s CROSS JOIN {STENCIL} JOIN m b ON b.i = greatest(0, least(n - 1, a.i + di)) AND b.j = greatest(0, least(63, a.j + dj)) GROUP BY 1, 2")
def stencil_clamp(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).stencil(LAPLACE, "clamp"), 5)


@register(MATRIX + f"SELECT a.i AS i0, a.j AS i1, round(CASE WHEN count(b.v) = 5 THEN sum(c * b.v) ELSE 7.0 END, 5) AS v FROM m a CROSS JOIN {STENCIL} LEFT JOIN m b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY 1, 2")
def stencil_fixed(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).stencil(LAPLACE, "fixed", 7.0), 5)


@register(MATRIX + "SELECT i AS i0, CAST(k AS BIGINT) AS k, round(sum(v * cos(-2 * pi() * ((j * k) % 64) / 64)), 4) + 0.0 AS re, round(sum(v * sin(-2 * pi() * ((j * k) % 64) / 64)), 4) + 0.0 AS im FROM m, unnest(range(64)) AS r(k) GROUP BY 1, 2")
def dft_rows(spark, sf_dir):
    out = _matrix(spark, sf_dir).dft()
    return out.select("i0", "k", (_round("re") + 0.0).alias("re"), (_round("im") + 0.0).alias("im"))


@register("WITH m AS (SELECT vec_id AS i, CAST(j AS BIGINT) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) AS r(j)) SELECT i AS vec_id, CAST(k AS BIGINT) AS at, round(sum(v * cos(-2 * pi() * ((j * k) % 64) / 64)), 3) + 0.0 AS re FROM m, unnest(range(64)) AS r(k) GROUP BY 1, 2")
def fft_embeddings(spark, sf_dir):
    """Each array is transformed where it is: no shuffle."""
    out = fft_arrays(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", F.posexplode("re").alias("at", "re"))
    return out.select("vec_id", F.col("at").cast("long").alias("at"), (_round("re", 3) + 0.0).alias("re"))


@register(MATRIX + "SELECT i AS i0, j AS i1, round(CASE WHEN (i + j) % 2 = 1 THEN -v ELSE v END, 6) AS v FROM m")
def array_center(spark, sf_dir):
    return _cells(_matrix(spark, sf_dir).center())


@register("WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(42 AS BIGINT) AS x UNION ALL SELECT i + 1, x * 16807 % 2147483647 FROM g WHERE i < 199) SELECT i, x % 100 + 1 AS v FROM g")
def random_like(spark, sf_dir):
    return lehmer(spark, 200, 1, 100, 42)


@register(MATRIX + "SELECT i AS i0, j AS i1, round(sqrt(v * v + i * i), 6) AS mag, round(atan2(CAST(i AS DOUBLE), v), 6) AS arg FROM m")
def complex_polar(spark, sf_dir):
    m = _matrix(spark, sf_dir).df
    return m.select("i0", "i1", _round(S.mag(F.col("v"), F.col("i0").cast("double")), 6).alias("mag"), _round(S.arg(F.col("v"), F.col("i0").cast("double")), 6).alias("arg"))


@register("SELECT p_partkey, round(sqrt(((p_size / 255) ** 2 + (p_size * 2 / 255) ** 2 + (p_size * 3 / 255) ** 2) / 3), 6) AS rms, round(p_size / 255 * 0.3 + p_size * 2 / 255 * 0.59 + p_size * 3 / 255 * 0.11, 6) AS lum, CAST(floor(least(p_size / 40, 1.0) * 255) AS INTEGER) AS b FROM part")
def pixel_functions(spark, sf_dir):
    s = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", _round(S.rms_of_rgb8(s, s * 2, s * 3), 6).alias("rms"), _round(S.luminance_of_rgb8(s, s * 2, s * 3), 6).alias("lum"), S.byte_of_unit(s / 40).alias("b"))


# --- formats -----------------------------------------------------------------------------------
@register("SELECT o_orderkey, o_orderkey || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%d/%m/%Y') || '|' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS packed, true AS same FROM orders")
def format_separated(spark, sf_dir):
    """Rows packed by field formats and unpacked again."""
    o = _t(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    fields = [V.Field("IntAsc"), V.Field("VarAsc"), V.Field("DDsMMsYYYY", "/"), V.Field("IntAsc0", 8)]
    p = o.withColumn("packed", V.pack_sep("|", fields, [F.col("o_orderkey"), F.col("o_orderstatus"), F.col("d"), F.col("o_custkey")])).withColumn("u", V.unpack_sep("|", fields, F.col("packed")))
    return p.select("o_orderkey", "packed", ((F.col("u._1") == F.col("o_orderkey")) & (F.col("u._3") == F.col("d")) & (F.col("u._4") == F.col("o_custkey"))).alias("same"))


@register("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' ELSE '{"k":' || n_nationkey || ',"n":"' || n_name || '","r":' || n_regionkey || '}' END AS o FROM nation""")
def format_object(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", V.pack_object({"k": F.col("n_nationkey"), "n": F.col("n_name"), "r": F.when(F.col("n_regionkey") != 0, F.col("n_regionkey"))}).alias("o"))


@register("SELECT s_suppkey, printf('%.3f', s_acctbal) AS fixed, CASE WHEN s_nationkey = 0 THEN 'NULL' ELSE CAST(s_nationkey AS VARCHAR) END AS maybe, CASE WHEN s_nationkey = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS back, upper(lpad(hex(s_suppkey), 8, '0')) AS hx FROM supplier")
def format_fields(spark, sf_dir):
    k = F.when(F.col("s_nationkey") != 0, F.col("s_nationkey"))
    m = V.pack_maybe("NULL", k.cast("string"), k)
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", S.show_double_fixed(F.col("s_acctbal"), 3).alias("fixed"), m.alias("maybe"), V.unpack_maybe("NULL", m, V.Field("IntAsc").unpack(m)).alias("back"), F.hex(V.pack_be("Int32be", F.col("s_suppkey"))).alias("hx"),
    )


@register("SELECT doc_id, '\"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"' AS q FROM documents")
def format_quoted(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", V.quoted(F.col("text")).alias("q"))


# --- workloads ----------------------------------------------------------------------------------
RANK_STEPS = 10
_RANK_STEP = """, r{k} AS MATERIALIZED (SELECT p.page, 0.15 / n + 0.85 * (coalesce(m.r, 0) + lost / n) AS rank FROM pages p CROSS JOIN n
    LEFT JOIN (SELECT dst, sum(rank / deg) AS r FROM e JOIN r{j} ON src = page GROUP BY dst) m ON m.dst = p.page CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{j} WHERE page NOT IN (SELECT src FROM e)))"""


@register("""WITH links AS (SELECT l_partkey AS src, -l_suppkey AS dst FROM lineitem UNION ALL SELECT -l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
    pages AS MATERIALIZED (SELECT p_partkey AS page FROM part UNION SELECT -s_suppkey FROM supplier UNION SELECT src FROM links UNION SELECT dst FROM links), n AS MATERIALIZED (SELECT count(*) AS n FROM pages),
    e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM links), r0 AS MATERIALIZED (SELECT page, 1.0 / n AS rank FROM pages, n)"""
    + "".join(_RANK_STEP.format(k=k, j=k - 1) for k in range(1, RANK_STEPS + 1)) + f" SELECT page, round(rank, 9) AS rank FROM r{RANK_STEPS}")
def page_rank(spark, sf_dir):
    """Parts link to their suppliers, and suppliers to the parts that came back; those without links are dangling."""
    line = _t(spark, sf_dir, "lineitem")
    links = line.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).union(line.filter("l_returnflag = 'R'").select(-F.col("l_suppkey"), "l_partkey"))
    named = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("page")).union(_t(spark, sf_dir, "supplier").select(-F.col("s_suppkey")))
    pages = named.union(links.select("src")).union(links.select("dst")).distinct()
    return graph.page_rank(links, pages, steps=RANK_STEPS).select("page", _round("rank", 9).alias("rank"))


@register("SELECT l_orderkey AS row, round(sum(l_quantity * p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def sparse_product(spark, sf_dir):
    cells = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v"))
    out = graph.sparse_times_vector(cells, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("x")))
    return out.select("row", _round("v", 2).alias("v"))


@register(MATRIX + ", k AS (SELECT a.i AS i, a.j AS j, coalesce(CASE WHEN a.i = 0 THEN a.v END, sum(coalesce(b.v, 0)) / 4) AS v FROM m a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(di, dj) LEFT JOIN m b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY a.i, a.j, a.v) SELECT i AS i0, j AS i1, round(v, 6) AS v FROM k")
def relax_grid(spark, sf_dir):
    """One step of relaxation with the first row held."""
    m = _matrix(spark, sf_dir)
    return _cells(graph.relax(m, NdArray(m.df.filter("i0 = 0"), m.shape), 1))


@register()
def convex_hull(spark, sf_dir):
    """Corners of the hull of (quantity, price) of each flag; tested against a brute-force version."""
    line = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return graph.convex_hull(line, "l_returnflag")


@register()
def tag_rows(spark, sf_dir):
    """Elements of all pages with their paths and attributes; tested on small documents."""
    e = tags.elements(_t(spark, sf_dir, "pages"), "page_id", "html")
    return e.select("page_id", "at", "path", F.to_json("attributes").alias("attributes"))


@register("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """The streaming operator over a bounded table."""
    from ..streaming.windows import tumbling

    out = tumbling(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=_round(F.sum("value")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@register("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    from ..streaming.windows import sessions

    out = sessions(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "2 hours", ["user_id"], n=F.count(F.lit(1)))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


from . import further, roundtrips  # noqa: E402,F401  they register their queries
