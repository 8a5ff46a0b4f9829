"""Registered queries of bundles, array functions, dense arrays, formats and expressions that the catalogue has no place for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..flow import BUCKET, POS, Flow
from ..functions import arrays as A
from ..functions import formats as V
from ..functions import scalars as S
from ..operators import bundles, graph, ndarray, segmented, stateful, tags
from ..operators.ndarray import NdArray
from ..streaming import windows
from . import query as dsl
from .registry import LINE_ORDER, LINE_SQL, register
from .registry import rounded as _round
from .registry import table as _t


def _events(spark, sf_dir) -> Flow:
    return Flow(_t(spark, sf_dir, "events"), "user_id", ("ts", "event_id"))


def _show(c, sep=","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


HOURS = "WITH a AS (SELECT user_id, list(CAST(hour(ts) AS BIGINT) ORDER BY ts, event_id) AS h FROM events GROUP BY user_id) "


def _hours(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.hour("ts").cast("long").alias("h")))).alias("s"))
    return e.select("user_id", F.col("s.h").alias("h"))


# --- bundles and flows -------------------------------------------------------------------------
@register("SELECT p_partkey, p_size * 2 AS twice, p_name FROM part WHERE p_size > 10")
def flow_columns(spark, sf_dir):
    """Map, extend, select, discard and mask on the values of a flow."""
    f = Flow(_t(spark, sf_dir, "part"), None, ("p_partkey",)).filter(F.col("p_size") > 10).extend(twice=F.col("p_size") * 2)
    f = f.select("p_name", "p_size", "twice").discard("p_size")
    return f.mask(True, True).df


@register("SELECT sum(value > 100) AS big, count(*) AS n FROM events")
def observed_flow(spark, sf_dir):
    """Metrics that an action reports while it runs (``watch``), and the action itself drops the rows (``drain``)."""
    from pyspark.sql import Observation

    seen = Observation()
    e = _t(spark, sf_dir, "events").observe(seen, F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 100).cast("long")).alias("big"))
    bundles.drain(e)
    return spark.createDataFrame([(seen.get["big"], seen.get["n"])], "big long, n long")


@register("SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def consumed_flow(spark, sf_dir):
    """An effect on every element, run on the executors: accumulators add up what they see."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0.0)

    def see(row):
        n.add(1)
        total.add(row[-1])

    bundles.consume(_events(spark, sf_dir).select("value"), see)
    return spark.createDataFrame([(n.value, round(total.value, 2))], "n long, total double")


@register("SELECT (SELECT count(*) FROM events) AS a, (SELECT count(*) FROM events) AS b, (SELECT count(*) FROM events WHERE value > 50) AS c")
def teed_flow(spark, sf_dir):
    """The same rows to two sinks, and through a tap on to a third (``dup_oo``, ``dup_io``)."""
    a, b, c = (scratch.folder(spark, x) for x in "abc")
    to = lambda path: lambda df: df.write.parquet(path)
    e = _t(spark, sf_dir, "events").select("event_id", "value")
    bundles.tee(e, to(a), to(b))
    bundles.tap(e, to(scratch.folder(spark, "tap"))).filter("value > 50").write.parquet(c)
    count = lambda path, name: spark.read.parquet(path).agg(F.count(F.lit(1)).alias(name))
    return count(a, "a").crossJoin(count(b, "b")).crossJoin(count(c, "c"))  # one row each


@register("SELECT count(*) AS rows_, true AS hooked FROM events")
def finalised_flow(spark, sf_dir):
    """A hook at the end of each partition: the rows that it is told add up to those that pass."""
    seen, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def hook(partition, rows):
        seen.add(rows)
        calls.add(1)

    n = bundles.finalise(_t(spark, sf_dir, "events").select("event_id"), hook).count()
    return spark.createDataFrame([(n, seen.value >= n and calls.value > 0)], "rows_ long, hooked boolean")


@register("SELECT CAST(b AS INTEGER) AS stream, CAST(p AS BIGINT) AS _pos, CAST(b * 10 AS BIGINT) AS x FROM unnest(range(4)) AS r(b), unnest(range(250)) AS q(p)")
def replicated_streams(spark, sf_dir):
    out = bundles.replicate(spark, 4, 250, lambda b: (b * 10).cast("long"))
    return out.df.select(F.col(BUCKET).alias("stream"), POS, "x")


@register("SELECT p_partkey, array_to_string(range(p_size), ',') AS iota, array_to_string(list_transform(range(p_size % 5), lambda i: i * i), ',') AS squares FROM part")
def generated_arrays(spark, sf_dir):
    size = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", _show(A.iota(size)).alias("iota"), _show(A.generate(size % 5, lambda i: i * i)).alias("squares"))


@register("SELECT n_regionkey AS a, n_nationkey AS b, n_name AS v FROM nation")
def flipped_grid(spark, sf_dir):
    """The two indices of a grid of streams change places."""
    f = Flow(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"), F.col("n_name").alias("v")), "a", ("b",))
    return bundles.flip_index(f, "a", "b").df


@register("SELECT vec_id, CAST(i AS INTEGER) AS _to, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(8)) AS r(i)")
def distributed_grid(spark, sf_dir):
    f = Flow(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", ())
    return bundles.distribute_grid(f, "embedding", 8)[0].select("vec_id", "_to", F.col("x").cast("double").alias("x"))


@register("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY x, side) - 1 AS _pos, x FROM
    (SELECT user_id, event_id AS x, 0 AS side FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_type = 'view')""")
def weaved_streams(spark, sf_dir):
    """A stateful merge of two bundles by the lesser head."""
    of = lambda kind: Flow(_t(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "event_id", F.col("event_id").alias("x")), "user_id", ("event_id",))

    def step(state, a, b):
        if b is None or (a is not None and a <= b):
            return state, [a], True, False
        return state, [b], False, True

    return bundles.weave(of("click"), of("view"), ("x", "x"), step, {"x": "long"})


@register("SELECT user_id, max(event_id) AS last, count(*) AS n FROM events GROUP BY user_id")
def machine_of_streams(spark, sf_dir):
    """A machine with two labels: it counts, and tells count and element at the last one of a stream."""
    f = _events(spark, sf_dir)
    f = f.extend(left=F.count(F.lit(1)).over(f.window().rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    f = f.extend(pair=F.concat_ws(":", "left", "event_id"))

    def go(value, memory):
        left, event = (int(x) for x in value.split(":"))
        n, top = (memory or (0, 0))[0] + 1, max((memory or (0, 0))[1], event)
        return ("halt" if left == 1 else "run"), (n, top), [(top, n)] if left == 1 else []

    out = stateful.machine(f, "pair", {"run": go}, "run", {"last": "long", "n": "long"})
    return out.df.select("user_id", "last", "n")


@register("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def catalog_of_compacts(spark, sf_dir):
    """A stateful fold by ``compact_in``: the running state is the last element out."""
    f = Flow(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("x")), "o_custkey", ("o_orderkey",))
    top = stateful.compact_in(f, "x", lambda s, v: (max(s, v), None), "long").df.groupBy("o_custkey").agg(F.max("x").alias("last"))
    return f.df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(top, "o_custkey")


# --- single streams ------------------------------------------------------------------------------
LINES = f"WITH n AS (SELECT *, row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS i FROM lineitem) "


def _lines(spark, sf_dir, *more: str) -> Flow:
    return Flow(_t(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_ORDER, *more])), None, LINE_ORDER)


@register(LINES + f"SELECT {LINE_SQL}, CAST(sum(l_linenumber) OVER (ORDER BY i) AS BIGINT) AS total, max(l_quantity) OVER (ORDER BY i) AS top, min(l_quantity) OVER (ORDER BY i) AS low, count(*) OVER (ORDER BY i) AS n FROM n")
def scan_single_stream(spark, sf_dir):
    """Prefix aggregates of one long stream: key ranges carry what the earlier ones add up to."""
    out = _lines(spark, sf_dir, "l_quantity").scan(total=F.sum("l_linenumber"), top=F.max("l_quantity"), low=F.min("l_quantity"), n=F.count(F.lit(1)))
    return out.df.select(*LINE_ORDER, "total", "top", "low", "n")


@register(LINES + """, m AS (SELECT *, CASE WHEN lag(l_returnflag) OVER (ORDER BY i) IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS s FROM n), r AS (SELECT *, sum(s) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT CAST(run - 1 AS BIGINT) AS _pos, min(l_returnflag) AS l_returnflag, count(*) AS len FROM r GROUP BY run""")
def groups_single_stream(spark, sf_dir):
    return segmented.groups(_lines(spark, sf_dir, "l_returnflag"), "l_returnflag").df


@register(LINES + """, m AS (SELECT *, CASE WHEN lag(l_linestatus) OVER (ORDER BY i) IS DISTINCT FROM l_linestatus THEN 1 ELSE 0 END AS s FROM n), r AS (SELECT *, sum(s) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT CAST(run - 1 AS BIGINT) AS _pos, min(l_linestatus) AS l_linestatus, round(sum(l_quantity), 2) AS q FROM r GROUP BY run""")
def fold_groups_single_stream(spark, sf_dir):
    out = segmented.fold_groups_by(_lines(spark, sf_dir, "l_linestatus", "l_quantity"), ["l_linestatus"], q=F.sum("l_quantity"))
    return out.select(POS, "l_linestatus", _round("q", 2).alias("q"))


@register(LINES + """, g AS (SELECT *, coalesce(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM n),
    k AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY i) - 1) // 4 AS c FROM g) SELECT CAST(g AS BIGINT) AS seg, CAST(c AS BIGINT) AS part, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY i) AS ids FROM k GROUP BY g, c""")
def chunks_single_stream(spark, sf_dir):
    out = segmented.chunk_on(_lines(spark, sf_dir, "l_quantity").extend(x=F.col("l_partkey")), "x", 4, F.col("l_quantity") > 45).df
    return out.select(F.col("__seg").cast("long").alias("seg"), F.col("__k").cast("long").alias("part"), _show(F.col("x")).alias("ids"))


@register(LINES + """, g AS (SELECT *, coalesce(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM n),
    o AS (SELECT *, max(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS o FROM g) SELECT CAST(g AS BIGINT) AS _pos, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY i) AS ids FROM o WHERE o = 1 GROUP BY g""")
def segments_single_stream(spark, sf_dir):
    out = segmented.segment(_lines(spark, sf_dir, "l_quantity").extend(x=F.col("l_partkey")), F.col("l_quantity") < 10, F.col("l_quantity") > 45, "x").df
    return out.select(F.col(POS).cast("long").alias(POS), _show(F.col("x")).alias("ids"))


@register(LINES + f"SELECT {LINE_SQL}, l_returnflag FROM n QUALIFY lag(l_returnflag) OVER (ORDER BY i) IS NULL OR lag(l_returnflag) OVER (ORDER BY i) <> l_returnflag")
def decimate_single_stream(spark, sf_dir):
    return stateful.decimate(_lines(spark, sf_dir, "l_returnflag"), lambda before, x: before == x, "l_returnflag").df


@register(LINES + f"SELECT {LINE_SQL} FROM n WHERE i < 1000")
def head_single_stream(spark, sf_dir):
    """The first thousand elements of one stream."""
    return _lines(spark, sf_dir).extend(x=F.lit(1)).head(1000)[0].df.select(*LINE_ORDER)


# --- array functions -------------------------------------------------------------------------------
@register(HOURS + """SELECT user_id, array_to_string(list_transform(h, lambda x, i: x * 10 + i - 1), ',') AS pairs, len(h) = len(h) AS same, array_to_string(list_transform(h, lambda x: x + 1), ',') AS next_,
    CASE WHEN list_max(h) < 23 THEN array_to_string(h, ',') END AS maybe, array_to_string(h[2:3], ',') || ';' || array_to_string(h[1:1], ',') AS cut, array_to_string(h[4:4], ',') AS view FROM a""")
def array_maps(spark, sf_dir):
    """Zips, maps that may fail, slices, views and ranges of arrays."""
    a = _hours(spark, sf_dir)
    at = A.iota(F.size("h"))
    nested = A.map_elems(F.array("h"), lambda x: x + 1)
    ranges = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("len")), F.struct(F.lit(0).alias("start"), F.lit(1).alias("len")))
    cuts = A.slices("h", F.array(F.lit(1), F.lit(0)), F.array(F.lit(2), F.lit(1)))
    same = F.expr("true") & (_show(A.extract("h", ranges)) == _show(F.flatten(cuts)))
    return a.select(
        "user_id", _show(A.map2("h", at, lambda x, i: x * 10 + i)).alias("pairs"), (same & A.map2("h", F.slice("h", 1, 1), lambda x, y: x).isNull().eqNullSafe(F.size("h") != 1)).alias("same"),
        _show(nested[0]).alias("next_"), _show(A.map_maybe("h", lambda x: F.when(x < 23, x))).alias("maybe"), F.concat_ws(";", _show(cuts[0]), _show(cuts[1])).alias("cut"), _show(A.windowed("h", F.lit(3), F.lit(1))).alias("view"),
    )


@register(HOURS + """SELECT user_id, array_to_string(list_filter(h, lambda x: x >= 12), ',') AS kept, list_sum(list_zip(h, h).list_transform(lambda p: p[1] * p[2])) AS dot,
    CASE WHEN len(h) >= 5 THEN array_to_string([list_sum(h[1:2]), list_sum(h[3:5])], ',') ELSE CASE WHEN len(h) >= 2 THEN CAST(list_sum(h[1:2]) AS VARCHAR) ELSE '' END END AS folded FROM a""")
def array_folds(spark, sf_dir):
    """Zips and unzips, and segmented folds by lengths two and three."""
    a = _hours(spark, sf_dir)
    pairs = F.arrays_zip(F.col("h").alias("a"), F.col("h").alias("b"))
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")
    kept = F.filter(F.transform("h", lambda x: F.when(x >= 12, x)), lambda x: x.isNotNull())
    return a.select(
        "user_id", _show(kept).alias("kept"), F.aggregate(F.transform(pairs, lambda p: p["a"] * p["b"]), zero, add).cast("decimal(38,0)").alias("dot"),
        _show(A.folds(F.array(F.lit(2), F.lit(3)), "h", zero, add)).alias("folded"),
    )


@register(HOURS + """SELECT user_id, array_to_string([100 + list_sum(h[1:2]) , list_sum(h[3:4])], ',') AS under_way, CASE WHEN h[1] = 7 THEN 3 ELSE 2 END AS open_, array_to_string(list_concat([-1], h[1:3]), ',') AS put FROM a WHERE len(h) >= 4""")
def array_continued(spark, sf_dir):
    """Folds and runs after a part that is under way already, and inserted elements."""
    a = _hours(spark, sf_dir).filter(F.size("h") >= 4)
    add = lambda s, x: s + x
    under = A.folds_with(F.lit(2), F.lit(100).cast("long"), F.array(F.lit(2)), F.slice("h", 1, 4), F.lit(0).cast("long"), add)
    runs = A.groups_with(F.lit(7).cast("long"), F.lit(2), F.slice("h", 1, 1))
    put = A.insert(F.slice("h", 1, 3), lambda p: F.when(p == 0, F.lit(-1).cast("long")))
    return a.select("user_id", _show(under).alias("under_way"), runs[0]["n"].cast("int").alias("open_"), _show(put).alias("put"))


@register("""SELECT user_id, array_to_string(list_transform(list_filter(list_transform(h, lambda x, i: CASE WHEN i >= coalesce(list_position(list_transform(h, lambda y: y > 5), true), len(h) + 1) AND
    i <= len(h) - coalesce(list_position(list_transform(list_reverse(h), lambda y: y > 5), true), len(h) + 1) + 1 THEN x END), lambda x: x IS NOT NULL), lambda x: x), ',') AS mid FROM
    (SELECT user_id, list(CAST(hour(ts) AS BIGINT) ORDER BY ts, event_id) AS h FROM events GROUP BY user_id)""")
def array_trims(spark, sf_dir):
    """Elements at both ends for which a predicate holds go."""
    return _hours(spark, sf_dir).select("user_id", _show(A.trims("h", lambda x: x <= 5)).alias("mid"))


# --- dense arrays ------------------------------------------------------------------------------------
CELLS = "WITH m AS (SELECT vec_id AS i, CAST(j AS BIGINT) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) AS r(j)), s AS (SELECT max(vec_id) + 1 AS n FROM embeddings) "


def _cells(spark, sf_dir) -> NdArray:
    e = _t(spark, sf_dir, "embeddings")
    rows, columns = e.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    cells = e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    return NdArray(cells.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (rows, columns))


@register(CELLS + "SELECT a.i AS i0, a.j AS i1, round(a.v - coalesce(b.v, 0), 6) AS v FROM m a LEFT JOIN m b ON b.i = a.i AND b.j = a.j + 1")
def array_traverse(spark, sf_dir):
    """Any function of looked-up cells: the difference from the right neighbour."""
    m = _cells(spark, sf_dir)
    out = m.traverse(m.shape, [lambda i, j: (i, j), lambda i, j: (i, j + 1)], lambda i, j, a, b: a - F.coalesce(b, F.lit(0.0)))
    return out.df.withColumn("v", _round("v", 6))


@register(CELLS + """SELECT a.i AS i0, a.j AS i1, round(sum(c * coalesce(b.v, 0)), 5) AS v FROM m a CROSS JOIN (VALUES (-1, -1, 1.0), (-1, 0, 2.0), (-1, 1, 3.0), (0, -1, 4.0), (0, 0, 5.0), (0, 1, 6.0), (1, -1, 7.0), (1, 0, 8.0), (1, 1, 9.0)) AS k(di, dj, c)
    LEFT JOIN m b ON b.i = a.i + di AND b.j = a.j + dj GROUP BY 1, 2""")
def array_convolve(spark, sf_dir):
    """Convolution with a generated kernel."""
    kernel = NdArray.generate(spark, (3, 3), lambda i, j: (i * 3 + j + 1).cast("double"))
    return _cells(spark, sf_dir).convolve(kernel).df.withColumn("v", _round("v", 5))


@register(CELLS + "SELECT i AS i0, j AS i1, i * 64 + j AS at, i >= 0 AND i < n AND j >= 0 AND j < 64 AS inside, v > 0 AS up, CAST(greatest(0, least(n - 1, i - 3)) AS BIGINT) AS a, CAST(greatest(0, least(63, j + 3)) AS BIGINT) AS b FROM m, s")
def array_indices(spark, sf_dir):
    """Linear positions, shapes that hold an index, borders, and pairs of arrays as columns."""
    m = _cells(spark, sf_dir)
    i, j = F.col("i0"), F.col("i1")
    a, b = ndarray.clamp_to_border(m.shape, i - 3, j + 3)
    return m.df.select("i0", "i1", m.linear().alias("at"), ndarray.is_inside(m.shape, i, j).alias("inside"), (F.col("v") > 0).alias("up"), a.cast("long").alias("a"), b.cast("long").alias("b"))


@register("SELECT CAST(i AS BIGINT) AS i0, CAST(i * i AS BIGINT) AS v FROM unnest(range(5000)) AS r(i) WHERE i * i % 3 = 1")
def array_select(spark, sf_dir):
    """Elements of a generated array for which a predicate holds (``selectP``, ``fromFunction``)."""
    return NdArray.generate(spark, (5000,), lambda i: i * i).df.filter("v % 3 = 1")


@register(CELLS + "SELECT i AS i0, round(list_reduce(list_prepend(0.0, list(v ORDER BY j)), lambda a, x: a / 2 + x), 5) AS v FROM m GROUP BY i")
def array_fold_ordered(spark, sf_dir):
    """The innermost dimension reduced in order by any operator."""
    return _cells(spark, sf_dir).fold_ordered(F.lit(0.0), lambda a, x: a / 2 + x).df.withColumn("v", _round("v", 5))


@register(CELLS + """, b AS (SELECT a.i, a.j, sum(c * d * b.v) / 256 AS v FROM m a CROSS JOIN s CROSS JOIN (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS x(di, c) CROSS JOIN (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS y(dj, d)
    JOIN m b ON b.i = greatest(0, least(n - 1, a.i + di)) AND b.j = greatest(0, least(63, a.j + dj)) GROUP BY 1, 2) SELECT i AS i0, j AS i1, round(v, 5) AS v FROM b""")
def image_blur(spark, sf_dir):
    return graph.blur(_cells(spark, sf_dir)).df.withColumn("v", _round("v", 5))


@register(CELLS + """SELECT a.i AS i0, a.j AS i1, round(sum(c * b.v), 5) AS v FROM m a CROSS JOIN s CROSS JOIN (VALUES (-1, -1, -1.0), (0, -1, -2.0), (1, -1, -1.0), (-1, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)) AS k(di, dj, c)
    JOIN m b ON b.i = greatest(0, least(n - 1, a.i + di)) AND b.j = greatest(0, least(63, a.j + dj)) GROUP BY 1, 2""")
def image_gradient(spark, sf_dir):
    return graph.gradient_x(_cells(spark, sf_dir)).df.withColumn("v", _round("v", 5))


@register("""SELECT vec_id, CAST(k AS BIGINT) AS at, round(sum(embedding[j + 1] * cos(2 * pi() * ((j * k) % 64) / 64)) / 64, 4) + 0.0 AS re, round(sum(embedding[j + 1] * sin(2 * pi() * ((j * k) % 64) / 64)) / 64, 4) + 0.0 AS im
    FROM embeddings, unnest(range(64)) AS r(j), unnest(range(64)) AS q(k) GROUP BY 1, 2""")
def fft_inverse(spark, sf_dir):
    """The inverse transform, real and imaginary parts."""
    out = ndarray.fft_arrays(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", mode="inverse")
    cells = out.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("at", "z"))
    return cells.select("vec_id", F.col("at").cast("long").alias("at"), (_round(F.col("z.re")) + 0.0).alias("re"), (_round(F.col("z.im")) + 0.0).alias("im"))


# --- formats and expressions ---------------------------------------------------------------------------
@register("SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') AS k, true AS same FROM orders")
def binary_fields(spark, sf_dir):
    """Big-endian words and integers of all widths to bytes and back."""
    n = F.col("o_orderkey")
    back = F.lit(True)
    for bits in (8, 16, 32, 64):
        small = F.pmod(n * 7919, F.lit(1 << min(bits - 1, 40))).cast("long")
        signed = small - (1 << min(bits - 2, 39))
        back = back & (V.unpack_be(f"Word{bits}be", V.pack_be(f"Word{bits}be", small)) == small) & (V.unpack_be(f"Int{bits}be", V.pack_be(f"Int{bits}be", signed)) == signed)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.hex(V.pack_be("Int64be", n)).alias("k"), back.alias("same"))


@register("SELECT s_suppkey, s_acctbal AS back FROM supplier")
def float_bits(spark, sf_dir):
    """The bits of a double, and the double of these bits."""
    raw = F.unhex(F.lpad(F.hex(S.bits_of_double(F.col("s_acctbal"))), 16, "0"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", V.unpack_be("Float64be", raw).alias("back"))


@register("""SELECT * FROM (VALUES ('DDsMMsYYYY ''/''', 'date'), ('DoubleAsc', 'double'), ('FixAsc 4', 'string'), ('Float64be', 'double'), ('Int16be', 'smallint'), ('IntAsc', 'bigint'), ('IntAsc0 8', 'bigint'), ('Nil', 'void'),
    ('VarAsc', 'string'), ('Word32be', 'bigint'), ('YYYYsMMsDD ''-''', 'date')) AS t(format, type)""")
def format_names(spark, sf_dir):
    """Formats by name, shown and read again, with the types of their values."""
    names = ["DDsMMsYYYY '/'", "DoubleAsc", "FixAsc 4", "Float64be", "Int16be", "IntAsc", "IntAsc0 8", "Nil", "VarAsc", "Word32be", "YYYYsMMsDD '-'"]
    return spark.createDataFrame([(V.Field.read(V.Field.read(n).show()).show(), V.Field.read(n).type.simpleString()) for n in names], "format string, type string")


@register("SELECT p_partkey, p_size * 3 + 1 AS a, p_name = 'x' AS b, CAST(p_size AS DOUBLE) * 0.5 AS c, true AS t, 'word' AS w, -p_size AS d FROM part")
def plan_expressions(spark, sf_dir):
    """Literals of each kind, variables, lambdas, applications and operators of plans."""
    lit = lambda k, v: {"_type": "lit", "lit": k, "value": v}
    var = lambda v: {"_type": "var", "var": v}
    lam = lambda b, x=None: {"_type": "lam", "body": b} | ({"bind": x} if x else {})
    sop = lambda n, *a: {"_type": "sop", "sop": n, "args": list(a)}
    size, name = F.col("p_size").cast("long"), F.col("p_name")
    a = dsl.evaluate(lam(lam(sop("add", sop("mul", var(1), lit("int", 3)), var(0)))))(size)(F.lit(1).cast("long"))
    b = dsl.evaluate(sop("eq", var("n"), lit("string", "x")), (("n", name),))
    c = dsl.evaluate({"_type": "app", "fun": lam(sop("mul", var("z"), lit("double", 0.5)), "z"), "arg": var(0)}, (size.cast("double"),))
    return _t(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"), dsl.evaluate(lit("bool", True)).alias("t"), dsl.evaluate(lit("string", "word")).alias("w"), dsl.evaluate(sop("neg", var(0)), (size,)).alias("d"))


@register("SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS some, coalesce(CASE WHEN c_nationkey > 5 THEN c_nationkey END, -1) AS value, CASE WHEN c_nationkey > 5 AND c_acctbal > 0 THEN c_nationkey || '/' || c_mktsegment END AS both FROM customer")
def optional_values(spark, sf_dir):
    """Options are nulls: of one column, of several at once, and out of them again."""
    some = F.when(F.col("c_nationkey") > 5, F.col("c_nationkey"))
    both = F.when(some.isNotNull() & (F.col("c_acctbal") > 0), F.concat_ws("/", "c_nationkey", "c_mktsegment"))
    return _t(spark, sf_dir, "customer").select("c_custkey", some.alias("some"), F.coalesce(some, F.lit(-1)).alias("value"), both.alias("both"))


# --- streams ------------------------------------------------------------------------------------------
@register("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows_of_a_stream(spark, sf_dir):
    """The same windows over a stream of files, run to its end."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = scratch.folder(spark, "stream")
    e.repartition(3).write.parquet(f"{at}/in")
    found = windows.tumbling(windows.source(spark, f"{at}/in", e.schema, 3), "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))
    windows.to_files(found, f"{at}/out", f"{at}/state")
    out = spark.read.parquet(f"{at}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", _round("total").alias("total"))


# --- documents ------------------------------------------------------------------------------------------
@register("SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<p[ >]')) AS BIGINT) AS p, CAST(len(regexp_extract_all(lower(html), '<a[ >]')) AS BIGINT) AS a FROM pages")
def tag_counts(spark, sf_dir):
    """Elements of two kinds in each page, from the rows of all its tags."""
    pages = _t(spark, sf_dir, "pages")
    e = tags.elements(pages, "page_id", "html").withColumn("name", F.element_at(F.split("path", "/"), -1)).groupBy("page_id")
    counts = e.agg(F.sum((F.col("name") == "p").cast("long")).alias("p"), F.sum((F.col("name") == "a").cast("long")).alias("a"))
    return pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("a", F.lit(0)).alias("a"))


@register("""WITH p AS (SELECT DISTINCT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT l_returnflag, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1) SELECT * FROM b""")
def hull_bounds(spark, sf_dir):
    """The box around the corners of a hull is that around all points."""
    line = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    of = graph.convex_hull(line, "l_returnflag").groupBy("l_returnflag")
    return of.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
