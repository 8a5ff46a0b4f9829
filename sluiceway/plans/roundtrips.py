"""Registered queries that write through the sinks and read back through the sources, the store and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..flow import BUCKET, POS, Flow
from ..functions import scalars as S
from ..functions.formats import Field
from ..operators import segmented
from ..operators.ndarray import NdArray
from ..sources import files, hashlog, store
from . import query as dsl
from .registry import LINE_ORDER, register
from .registry import rounded as _round
from .registry import table as _t

INT, TEXT, REAL, DAY = Field("IntAsc"), Field("VarAsc"), Field("DoubleAsc"), Field("YYYYsMMsDD", "-")
ORDER_COLUMNS = {"o_orderkey": INT, "o_orderstatus": TEXT, "o_totalprice": REAL, "day": DAY}
ORDER_SQL = "o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))


def _shown(df):
    return df.withColumn("day", S.string_of_date(F.col("day")))


# --- files -----------------------------------------------------------------------------------
@register("SELECT p_partkey || ' ' || p_name AS value FROM part")
def lines_files(spark, sf_dir):
    """Lines to a number of files, and back from all of them."""
    at = scratch.folder(spark, "lines")
    files.write_lines(_t(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", "p_name").alias("v")), "v", at, files=4)
    return files.lines(spark, at).select("value")


@register("SELECT s_name AS value FROM supplier UNION ALL SELECT c_name FROM customer")
def lines_of_several_paths(spark, sf_dir):
    a, b = scratch.folder(spark, "a"), scratch.folder(spark, "b")
    files.write_lines(_t(spark, sf_dir, "supplier"), "s_name", a)
    files.write_lines(_t(spark, sf_dir, "customer"), "c_name", b)
    return files.lines(spark, [a, b]).select("value")


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def lines_in_order(spark, sf_dir):
    """Files of a sorted table, read by splits, one file after another in order."""
    at = scratch.folder(spark, "sorted")
    _t(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(at)
    out = files.ordered_lines(spark, at).funnel().extend(line=F.col("value")).indexed()
    return out.df.select(POS, F.col("line").alias("value"))


@register("SELECT c_custkey || '/' || c_mktsegment AS value FROM customer")
def records_by_separator(spark, sf_dir):
    """Records that end with another character than a newline."""
    at = scratch.folder(spark, "records")
    files.write_lines(_t(spark, sf_dir, "customer").select(F.concat_ws("/", "c_custkey", "c_mktsegment").alias("v")), "v", at, sep=";")
    return files.lines(spark, at, sep=";").select("value")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(n_regionkey AS VARCHAR) AS c, 3 AS n FROM nation")
def values_by_comma(spark, sf_dir):
    return _separated(spark, sf_dir, ",", files.csv)


@register("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CAST(n_regionkey AS VARCHAR) AS c, 3 AS n FROM nation")
def values_by_tab(spark, sf_dir):
    return _separated(spark, sf_dir, "\t", files.tsv)


def _separated(spark, sf_dir, sep, read):
    at = scratch.folder(spark, "separated")
    files.write_separated(_t(spark, sf_dir, "nation"), at, sep, [INT, TEXT, INT], ["n_nationkey", "n_name", "n_regionkey"])
    cut = F.col("fields")
    return read(spark, at).select(cut[0].alias("a"), cut[1].alias("b"), cut[2].alias("c"), F.size(cut).alias("n"))


@register("SELECT " + ORDER_SQL)
def typed_lines_files(spark, sf_dir):
    """Rows packed by field formats to lines, and unpacked again."""
    at = scratch.folder(spark, "typed")
    files.write_separated(_orders(spark, sf_dir), at, "|", list(ORDER_COLUMNS.values()), list(ORDER_COLUMNS), files=3)
    return _shown(files.typed_lines(spark, at, "|", list(ORDER_COLUMNS), list(ORDER_COLUMNS.values())))


@register("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'size ' || p_size || '|' || p_partkey END AS _bad, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def typed_lines_kept(spark, sf_dir):
    """Rows that do not parse are kept beside those that do."""
    at = scratch.folder(spark, "bad")
    bad = F.when(F.col("p_size") % 7 == 0, F.lit("size ")).otherwise(F.lit(""))
    _t(spark, sf_dir, "part").select(F.concat(bad, F.concat_ws("|", "p_size", "p_partkey")).alias("value")).write.text(at)
    rows = files.typed_lines(spark, at, "|", ["size", "p_partkey"], [INT, INT], bad="keep")
    return rows.select(F.coalesce("p_partkey", F.split("_bad", "\\|")[1].cast("long")).alias("p_partkey"), "_bad", "size")


@register("SELECT sum(length(c_name) + 1) AS n, count(*) AS lines FROM customer")
def bytes_files(spark, sf_dir):
    """Whole files as bytes: their lengths, and their newlines among the characters."""
    at = scratch.folder(spark, "bytes")
    files.write_lines(_t(spark, sf_dir, "customer"), "c_name", at, files=2)
    parts = files.bytes_of(spark, at + "/part-*").agg(F.sum(F.length("content")).alias("n"))
    chars = files.chars_of(spark, at + "/part-*").agg(F.sum(F.length("chars") - F.length(F.replace("chars", F.lit("\n"), F.lit("")))).alias("lines"))
    return parts.crossJoin(F.broadcast(chars))  # one row each


@register("SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c FROM orders")
def fixed_records_files(spark, sf_dir):
    """Records of a fixed width, cut from the bytes of files."""
    at = scratch.folder(spark, "fixed")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    files.write_lines(_t(spark, sf_dir, "orders").select(F.concat(pad("o_orderkey"), pad("o_custkey")).alias("v")), "v", at, files=3)
    text = F.decode("record", "UTF-8")
    return files.fixed_records(spark, at + "/part-*", 25).select(F.substring(text, 1, 12).cast("long").alias("k"), F.substring(text, 13, 12).cast("long").alias("c"))


@register("SELECT event_type AS file, CAST(event_id AS VARCHAR) AS value FROM events")
def sieve_files(spark, sf_dir):
    """Rows to a directory for each key, in two goes, and back."""
    at = scratch.folder(spark, "sieve")
    e = _t(spark, sf_dir, "events")
    files.sieve(e.filter("event_id % 2 = 0"), "event_type", "event_id", at)
    files.sieve(e.filter("event_id % 2 <> 0"), "event_type", "event_id", at)
    return spark.read.schema("value string, file string").text(at).select("file", "value")


@register("SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem")
def grid_files(spark, sf_dir):
    """A grid of outputs: a directory for each flag, files in each."""
    at = scratch.folder(spark, "grid")
    files.grid(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", 3, at)
    return spark.read.parquet(at).select(F.col("l_returnflag").cast("string").alias("l_returnflag"), "l_orderkey", "l_linenumber")


@register("SELECT doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS text FROM documents")
def quoted_values_with_header(spark, sf_dir):
    """Texts with quotes and newlines through a file with a header; empty and null are one there."""
    at = scratch.folder(spark, "header")
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    back = files.with_header(spark, at, ",")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.col("text")).alias("text"))


@register("""SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), '"'), lambda p, i: CASE WHEN i % 2 = 0 THEN replace(replace(p, chr(10), '\\n'), chr(9), '\\t') ELSE p END), '"') AS escaped,
    replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS lines FROM documents""")
def escaped_texts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", files.escape_quoted(text).alias("escaped"), files.normalise_newlines(text).alias("lines"))


@register("WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM orders) SELECT i // 100 AS chunk, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) AS ids FROM n GROUP BY 1")
def chunks_of_lines(spark, sf_dir):
    """A file's lines in chunks of a hundred."""
    at = scratch.folder(spark, "chunks")
    _t(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(at)
    rows = files.ordered_lines(spark, at).funnel().extend(line=F.col("value"))
    out = segmented.chunk_on(rows, "line", 100, F.lit(False)).df
    return out.select(F.col("__k").cast("long").alias("chunk"), F.array_join("line", ",").alias("ids"))


# --- arrays in files -----------------------------------------------------------------------------
@register("SELECT vec_id AS i0, CAST(j AS BIGINT) AS i1, round(CAST(embedding[j + 1] AS DOUBLE), 6) AS v FROM embeddings, unnest(range(64)) AS r(j)")
def matrix_files(spark, sf_dir):
    """A matrix to its text form, and back."""
    at = scratch.folder(spark, "matrix")
    e = _t(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).withColumn("v", F.col("v").cast("double"))
    files.write_matrix(cells, (e.count(), 64), at)
    return files.read_written_matrix(spark, at).withColumn("v", _round("v", 6))


@register("SELECT c_custkey AS i0, c_acctbal AS v FROM customer")
def vector_files(spark, sf_dir):
    at = scratch.folder(spark, "vector")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i0"), F.col("c_acctbal").alias("v"))
    files.write_vector(c, c.count(), at)
    return files.read_written_vector(spark, at)


@register("SELECT p_partkey, CAST(p_size AS INTEGER) AS r, CAST(p_size * 2 AS INTEGER) AS g, CAST(p_size * 3 AS INTEGER) AS b FROM part")
def bitmap_files(spark, sf_dir):
    """Pixels as a bitmap of one column for each hundred parts, and back; folders take the bitmaps as bytes."""
    import numpy as np
    import pandas as pd

    from ..shipping import ship

    ship(spark)
    at = scratch.folder(spark, "bitmaps")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p_partkey")
        pixels = np.stack([pdf["p_size"], pdf["p_size"] * 2, pdf["p_size"] * 3], 1).astype(np.uint8).reshape(-1, 1, 3)
        return pd.DataFrame({"k": [pdf["p_partkey"].iloc[0] // 100], "content": [files.bitmap_bytes(pixels)]})

    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    pictures = part.groupBy(F.floor(F.col("p_partkey") / 100)).applyInPandas(pack, "k long, content binary")
    pictures = scratch.keep(pictures, at)
    pixels = files.pixels_of(pictures.select(F.col("k").cast("string").alias("_file"), "content"))
    return pixels.select((F.col("_file").cast("long") * 100 + F.col("i0")).cast("long").alias("p_partkey"), "r", "g", "b")


@register("SELECT vec_id AS k, CAST(i AS BIGINT) AS i0, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(64)) AS r(i)")
def raw_arrays(spark, sf_dir):
    """Numbers as raw little-endian bytes, and back."""
    raw = F.unhex(F.array_join(F.transform("embedding", _little_hex), ""))
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("_file"), raw.alias("content"))
    return files.numbers_of(rows, "<f8").select(F.col("_file").cast("long").alias("k"), "i0", "v")


def _little_hex(x):
    big = F.lpad(F.hex(S.bits_of_double(x.cast("double"))), 16, "0")
    return F.concat(*(F.substring(big, k, 2) for k in range(15, 0, -2)))


# --- the store -------------------------------------------------------------------------------
def _store(spark, sf_dir) -> str:
    """A store with the orders as tables of both kinds of rows and line items as a family of two streams."""
    root = scratch.folder(spark, "store")
    at = f"{root}/shop.dimension"
    store.write_dimension(at)
    store.write_table(_orders(spark, sf_dir), f"{at}/orders.table", ORDER_COLUMNS, sep="|")
    store.write_table(_t(spark, sf_dir, "customer"), f"{at}/names.table", {"c_name": TEXT}, delim="lines")
    line = _t(spark, sf_dir, "lineitem")
    store.write_family(line, f"{at}/lines.family", ("l_orderkey", INT), {"l_linenumber": INT, "l_quantity": REAL, "l_returnflag": TEXT}, list(LINE_ORDER[1:]), 2)
    return root


@register("SELECT " + ORDER_SQL)
def store_table(spark, sf_dir):
    return _shown(dsl.Q(spark, _store(spark, sf_dir)).from_store("shop/orders"))


@register("SELECT o_totalprice FROM orders")
def store_table_column(spark, sf_dir):
    return dsl.Q(spark, _store(spark, sf_dir)).from_store("shop/orders/o_totalprice")


@register("SELECT o_orderkey || ';' || o_totalprice || ';' || strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def store_table_mask(spark, sf_dir):
    """Columns that are asked for in any order come in the table's."""
    q = dsl.Q(spark, _store(spark, sf_dir))
    plan = {"out": "t", "nodes": [{"_type": "table_columns", "output": "t", "path": "shop/orders", "columns": ["day", "o_totalprice", "o_orderkey"]}]}
    out = dsl.load(plan, q)
    return out.select(F.concat_ws(";", *(F.col(c).cast("string") for c in out.columns)).alias("value"))


@register("SELECT c_name FROM customer")
def store_table_of_lines(spark, sf_dir):
    return dsl.Q(spark, _store(spark, sf_dir)).from_store("shop/names")


@register("SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag FROM lineitem")
def store_family_columns(spark, sf_dir):
    """Key and columns of a family side by side; only the files of these columns are read."""
    out = dsl.Q(spark, _store(spark, sf_dir)).from_store_columns("shop/lines", ["l_linenumber", "l_quantity", "l_returnflag"])
    return out.df.select(*(F.col(f"x._{k + 1}").alias(n) for k, n in enumerate(("key", "l_linenumber", "l_quantity", "l_returnflag"))))


@register("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1")
def store_family_key(spark, sf_dir):
    fam = store.resolve(_store(spark, sf_dir), "shop/lines")[-1]
    return store.family_key(spark, fam).df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT l_quantity FROM lineitem")
def store_family_column(spark, sf_dir):
    return dsl.Q(spark, _store(spark, sf_dir)).from_store("shop/lines/l_quantity").select("l_quantity")


@register("""SELECT * FROM (VALUES ('column', 'l_linenumber', 'IntAsc'), ('column', 'l_quantity', 'DoubleAsc'), ('column', 'l_returnflag', 'VarAsc'), ('dimension', 'shop', ''), ('family', 'lines', ''),
    ('table', 'names', ''), ('table', 'orders', 'IntAsc VarAsc DoubleAsc YYYYsMMsDD ''-''')) AS t(kind, name, format)""")
def store_objects(spark, sf_dir):
    """The objects of a store: children, names, kinds, the formats of columns, and look-ups."""
    top = store.objects_in(_store(spark, sf_dir))[0]
    found = [top, *top.children, *(c for o in top.children for c in o.children)]

    def formats(o):
        if o.kind == "column":
            return Field.read(o.meta["format"]["field"]).show()
        return " ".join(o.field_of(c["name"]).show() for c in o.columns) if len(o.columns) > 1 else ""

    return spark.createDataFrame([(o.kind, o.name, formats(o)) for o in found], "kind string, name string, format string")


@register("SELECT CAST(l_returnflag AS VARCHAR) AS k, max(CAST(l_linestatus AS VARCHAR)) AS v, max(l_returnflag) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def dictionary_look_up(spark, sf_dir):
    """A text dictionary with its own separator, forwards, and back from a value of its own."""
    at = scratch.folder(spark, "dictionary")
    pairs = _t(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select("l_returnflag", "l_linestatus").distinct()
    pairs.select(F.concat_ws("=>", "l_returnflag", "l_linestatus").alias("value")).coalesce(1).write.text(at)
    d = store.Dictionary(spark, at, "=>")
    own = spark.createDataFrame([], "k string").union(pairs.select("l_returnflag"))
    whole = d.look_up(own, "k", "v")
    return whole.withColumn("r", F.col("k"))


@register("SELECT n_nationkey AS at, n_name AS payload FROM nation")
def checked_log(spark, sf_dir):
    """Records of a log with check values: bytes to payloads, in the order of their positions."""
    rows = [bytes(r[0], "utf-8") for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 names
    log = b""
    for r in rows:
        log += hashlog.record(r, len(log))
    bytes_ = spark.createDataFrame([("log", bytearray(log))], "_file string, content binary")
    out = hashlog.payloads(bytes_)
    w = Flow(out, "_file", ("at",)).indexed("n")
    return w.df.select(F.col("n").cast("int").alias("at"), F.col("payload").cast("string").alias("payload"))


@register("SELECT CAST(c AS INTEGER) AS \"column\", CASE c WHEN 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS value FROM nation, unnest(range(2)) AS r(c)")
def split_to_columns(spark, sf_dir):
    """Rows of fields to a directory for each column."""
    at = scratch.folder(spark, "columns")
    store.split_columns(_t(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), "n_name").alias("f")), "f", at)
    return spark.read.schema("value string, column int").text(at)


# --- jobs --------------------------------------------------------------------------------------
ROW_SQL = "SELECT n_nationkey || chr(9) || '\"' || n_name || '\"' || chr(9) || n_regionkey AS value FROM nation"


@register(ROW_SQL)
def job_query(spark, sf_dir):
    """A job that gives the rows of a query as text in the default formats of their types."""
    out = dsl.run_jobs([("query", _t(spark, sf_dir, "nation"), None)])[0]
    return spark.createDataFrame([(x,) for x in out], "value string")


@register("SELECT p_partkey || chr(9) || '\"' || p_name || '\"' || chr(9) || p_size AS value FROM part")
def job_extract(spark, sf_dir):
    """A job that writes the rows of a query to text files."""
    at = scratch.folder(spark, "extract")
    dsl.run_jobs([("extract", _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), at)])
    return files.lines(spark, at).select("value")


@register("SELECT event_type AS file, event_id || chr(9) || user_id AS value FROM events")
def job_sieve(spark, sf_dir):
    """A job that appends rows to one directory for each name."""
    at = scratch.folder(spark, "jobs")
    x = S.row(F.col("event_type"), S.row(F.col("event_id"), F.col("user_id")))
    dsl.run_jobs([("sieve", Flow(_t(spark, sf_dir, "events").select("event_id", x.alias(dsl.V)), None, ("event_id",)), at)])
    return spark.read.schema("value string, file string").text(at).select("file", "value")


@register("SELECT * FROM (VALUES ('Filter', true), ('Scan parquet', true), ('PushedFilters', true)) AS t(word, found)")
def job_explain(spark, sf_dir):
    """The plan of a query as text: the filter reaches the scan."""
    text = dsl.explain(_t(spark, sf_dir, "orders").filter("o_totalprice > 1000"))
    return spark.createDataFrame([(w, w in text) for w in ("Filter", "Scan parquet", "PushedFilters")], "word string, found boolean")


@register("SELECT o_orderkey, o_totalprice * 2 + 1 AS v FROM orders WHERE o_totalprice > 1000")
def json_plan_of_a_store(spark, sf_dir):
    """A JSON plan over a file of separated rows: named and numbered variables, a nested lambda, literals."""
    root = scratch.folder(spark, "plan")
    files.write_separated(_orders(spark, sf_dir), f"{root}/orders", "|", list(ORDER_COLUMNS.values()), list(ORDER_COLUMNS))
    var = lambda v: {"_type": "var", "var": v}
    get = lambda k, of: {"_type": "sop", "sop": "get", "field": k, "args": [of]}
    lit = lambda v: {"_type": "lit", "lit": "double", "value": v}
    sop = lambda n, *a: {"_type": "sop", "sop": n, "args": list(a)}
    twice = {"_type": "app", "fun": {"_type": "lam", "bind": "y", "body": sop("add", sop("mul", var("y"), lit(2.0)), lit(1.0))}, "arg": get(3, var("x"))}
    plan = {"out": "m", "nodes": [
        {"_type": "file", "output": "f", "path": "orders", "sep": "|", "fields": [f.show() for f in ORDER_COLUMNS.values()]},
        {"_type": "filteri", "output": "g", "inputs": ["f"], "fun": {"_type": "lam", "body": sop("gt", get(3, var(0)), lit(1000.0))}},
        {"_type": "mapi", "output": "m", "inputs": ["g"], "fun": {"_type": "lam", "bind": "x", "body": sop("row", get(1, var("x")), twice)}},
    ]}
    out = dsl.load(plan, dsl.Q(spark, root)).df
    return out.select(F.col("x._1").alias("o_orderkey"), F.col("x._2").alias("v"))


@register("SELECT l_orderkey AS key, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1")
def json_plan_of_runs(spark, sf_dir):
    """A JSON plan over streams: runs of keys give the segments of a segmented fold."""
    line = _t(spark, sf_dir, "lineitem")
    keys = Flow(line.select(*LINE_ORDER, F.col("l_orderkey").alias(dsl.V)), None, LINE_ORDER)
    values = Flow(line.select(*LINE_ORDER, F.col("l_quantity").alias(dsl.V)), None, LINE_ORDER).indexed()
    add = {"_type": "lam", "body": {"_type": "lam", "body": {"_type": "sop", "sop": "add", "args": [{"_type": "var", "var": 1}, {"_type": "var", "var": 0}]}}}
    plan = {"out": "s", "nodes": [
        {"_type": "groupsi", "output": "g", "inputs": ["k"]},
        {"_type": "foldsi", "output": "s", "inputs": ["g", "v"], "fun": add, "neutral": {"_type": "lit", "lit": "double", "value": 0.0}},
    ]}
    out = dsl.load(plan, dsl.Q(spark, sf_dir), {"k": keys, "v": values})
    return out.select(F.col("x._1").alias("key"), _round(F.col("x._2"), 2).alias("v"))


@register("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS _pos, l_orderkey FROM lineitem WHERE l_quantity > 49")
def bucket_of_files(spark, sf_dir):
    """Sorted streams in several files, funnelled to one stream in order."""
    at = scratch.folder(spark, "streams")
    line = _t(spark, sf_dir, "lineitem").filter("l_quantity > 49").orderBy("l_shipdate", *LINE_ORDER)
    line.select(F.col("l_orderkey").cast("string").alias("value")).write.text(at)
    rows = files.ordered_lines(spark, at)
    out = Flow(rows.df, BUCKET).funnel().extend(line=F.col("value")).indexed()
    return out.df.select(POS, F.col("line").cast("long").alias("l_orderkey"))


@register("SELECT 0 AS differing, true AS same")
def equal_arrays(spark, sf_dir):
    """An array equals itself after a round trip, and differs from its double."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    rows, columns = e.agg(F.max("i0") + 1, F.max("i1") + 1).first()
    a = NdArray(e, (rows, columns))
    b = NdArray(scratch.keep(e, scratch.folder(spark, "array")), a.shape)
    return spark.createDataFrame([(int(a.equals(b.map(lambda v: v * 2))), a.equals(b))], "differing int, same boolean")
