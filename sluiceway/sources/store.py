"""A metadata store of dimensions, families, columns and tables, kept as directories with JSON.

``NAME.table`` holds row files; ``NAME.family`` holds a run-length key (``_shape``) and one
directory a column; ``NAME.dimension`` holds further dimensions and families.  Schemas come
from the metadata and are never inferred.  A stream of a family is a file of each directory,
or a directory ``stream=K`` there, whose files follow one another by the numbers of their parts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..flow import BUCKET, POS, Flow
from ..functions.formats import Field, pack_sep, unpack_sep
from ..scratch import hadoop_path
from . import files

KINDS = ("dimension", "family", "column", "table")
#: Rows of a file (about) when a family is written.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Object:
    """An object of the store: its kind, name, directory and metadata."""

    kind: str
    name: str
    path: str
    meta: dict = field(hash=False, compare=False)

    @property
    def columns(self) -> list[dict]:
        return self.meta.get("columns", [])

    def lookup(self, column: str) -> dict | None:
        return next((c for c in self.columns if c["name"] == column), None)

    def field_of(self, column: str) -> Field:
        found = self.lookup(column)
        if found is None:
            raise KeyError(f"{self.name} has no column {column!r}")
        return Field.read(found["format"]["field"])

    @property
    def children(self) -> list[Object]:
        return objects_in(self.path) if self.kind in ("dimension", "family") else []


# Metadata is read and written through Hadoop's file systems, so a store may lie wherever Spark's readers reach.
def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _folders(path: str) -> list[str]:
    """The names of the directories in a directory, sorted; none if there is no such directory."""
    fs, p = hadoop_path(_spark(), path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def _read(path: str) -> dict:
    fs, p = hadoop_path(_spark(), path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write(path: str, meta: dict) -> None:
    fs, p = hadoop_path(_spark(), path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps(meta).encode()))
    finally:
        stream.close()


def load_object(path: str) -> Object:
    path = path.rstrip("/")
    name, _, kind = path.rsplit("/", 1)[-1].rpartition(".")
    if kind not in KINDS:
        raise ValueError(f"{path} names no store object")
    return Object(kind, name, path, _read(f"{path}/_{kind}.json"))


def objects_in(path: str) -> list[Object]:
    """The objects of a directory, by name."""
    return [load_object(f"{path}/{n}") for n in _folders(path) if n.rpartition(".")[2] in KINDS]


def resolve(root: str, logical: str) -> list[str | Object]:
    """A logical path such as ``sales/orders/price`` to directories, objects and, for a table, the name of a column."""
    parts: list[str | Object] = []
    here = root
    names = [n for n in logical.split("/") if n]
    for k, n in enumerate(names):
        if parts and isinstance(parts[-1], Object) and parts[-1].kind == "table":
            if k != len(names) - 1 or parts[-1].lookup(n) is None:
                raise KeyError(f"{parts[-1].name} has no column {n!r}")
            return [*parts, n]
        there = _folders(here)
        found = [kind for kind in KINDS if f"{n}.{kind}" in there]
        if len(found) > 1:
            raise KeyError(f"{n!r} is ambiguous in {here}")
        if found:
            here = f"{here}/{n}.{found[0]}"
            parts.append(load_object(here))
        elif n in there:
            here = f"{here}/{n}"
            parts.append(n)
        else:
            raise KeyError(f"no {n!r} in {here}")
    return parts


def table_rows(spark: SparkSession, t: Object) -> DataFrame:
    """Rows of a table, of separated lines, plain lines or fixed-length records."""
    fields = [Field.read(c["format"]["field"]) for c in t.columns]
    names = [c["name"] for c in t.columns]
    delim = t.meta["delim"]
    if delim["delim"] == "fixed":
        widths = [int(f.arg) for f in fields]
        rows = files.fixed_records(spark, t.path, sum(widths)).withColumn("value", F.decode("record", "UTF-8"))
        at, columns = 1, []
        for n, f, w in zip(names, fields, widths, strict=True):
            columns.append((F.trim(F.substring("value", at, w)) if f.name.startswith("Int") else F.substring("value", at, w), f, n))
            at += w
        return rows.select(*(f.unpack(c).alias(n) for c, f, n in columns))
    rows = files.lines(spark, t.path, pattern="*.{tsv,txt}")
    if delim["delim"] == "lines":
        return rows.select(fields[0].unpack(F.col("value")).alias(names[0]))
    rows = rows.select(unpack_sep(delim["sep"], fields, F.col("value")).alias("r")).filter("r is not null")
    return rows.select(*(F.col(f"r._{i + 1}").alias(n) for i, n in enumerate(names)))


def _part(file: Column) -> Column:
    return F.regexp_extract(file, r"/part-([0-9]+)[^/]*$", 1)


def _stream(file: Column) -> Column:
    """The stream that a file is of: that of its directory, else the number of its part, or its name without the suffix."""
    folder, part = F.regexp_extract(file, r"/stream=([0-9]+)/[^/]*$", 1), _part(file)
    return F.when(folder != "", folder).when(part != "", part).otherwise(F.regexp_extract(file, r"([^/]*)\.[^./]*$", 1))


def _in_streams(rows: DataFrame, at: Column, size: Column) -> DataFrame:
    """Rows of files, ``at`` being their place in the file, with their stream and their place ``_pos`` in it.

    What the earlier files of a stream come to, by ``size`` of their rows, is one row a file: no window sees more than a file.
    """
    sizes = rows.groupBy(F.col(BUCKET).alias("__file")).agg(F.sum(size).alias("__all")).withColumn("__stream", _stream(F.col("__file")))
    before = Window.partitionBy("__stream").orderBy(_part(F.col("__file")).try_cast("long"), "__file")
    offsets = sizes.select("__file", "__stream", (F.sum("__all").over(before) - F.col("__all")).alias("__off"))
    out = rows.withColumn("__at", at).withColumnRenamed(BUCKET, "__file").join(F.broadcast(offsets), "__file")
    return out.withColumns({BUCKET: F.col("__stream"), POS: F.col("__at") + F.col("__off")}).drop("__file", "__stream", "__at", "__off")


def family_key(spark: SparkSession, fam: Object) -> Flow:
    """The key of each row of a family, from its run lengths."""
    runs = files.ordered_lines(spark, f"{fam.path}/_shape", pattern="*.{tsv,txt}")
    f = Field.read(fam.meta["key"]["field"])
    cut = F.split("value", "\t")
    rows = runs.df.select(BUCKET, POS, f.unpack(cut[0]).alias("key"), cut[1].cast("int").alias("__n"))
    begun = F.sum("__n").over(Window.partitionBy(BUCKET).orderBy(POS)) - F.col("__n")
    rows = _in_streams(rows, begun, F.col("__n"))
    rows = rows.select(BUCKET, POS, "key", F.posexplode(F.array_repeat(F.lit(0), F.col("__n"))).alias("_copy", "__z"))
    return Flow(rows.select(BUCKET, (F.col(POS) + F.col("_copy")).alias(POS), "key"), BUCKET)


def family_column(spark: SparkSession, fam: Object, column: str) -> Flow:
    """One column of a family, a value a line."""
    col = load_object(f"{fam.path}/{column}.column")
    rows = _in_streams(files.ordered_lines(spark, col.path, pattern="*.txt").df, F.col(POS), F.lit(1))
    f = Field.read(col.meta["format"]["field"])
    return Flow(rows.select(BUCKET, POS, f.unpack(F.col("value")).alias(column)), BUCKET)


def family_columns(spark: SparkSession, fam: Object, columns: list[str]) -> Flow:
    """Key and columns of a family, side by side; only the files of those columns are read."""
    return family_key(spark, fam).zip(*(family_column(spark, fam, c) for c in columns))


def scan(spark: SparkSession, root: str, logical: str) -> DataFrame:
    """What a logical path names: a table, one column of a table, or one column of a family."""
    parts = resolve(root, logical)
    last = parts[-1]
    if isinstance(last, str) and len(parts) > 1 and isinstance(parts[-2], Object):
        return table_rows(spark, parts[-2]).select(last)
    if isinstance(last, Object) and last.kind == "table":
        return table_rows(spark, last)
    if isinstance(last, Object) and last.kind == "column":
        fam = next(p for p in reversed(parts[:-1]) if isinstance(p, Object))
        return family_column(spark, fam, last.name).df
    raise KeyError(f"{logical} names no rows")


class Dictionary:
    """A text dictionary in both directions; of repeated keys the last holds."""

    def __init__(self, spark: SparkSession, path: str, sep: str = ","):
        rows = files.ordered_lines(spark, path)
        cut = F.split("value", "\\Q" + sep + "\\E", 2)
        self.rows = rows.df.select(F.struct(BUCKET, POS).alias("o"), cut[0].alias("k"), cut[1].alias("v")).filter("v is not null")

    def forward(self) -> DataFrame:
        return self.rows.groupBy("k").agg(F.max_by("v", "o").alias("v"))

    def reverse(self) -> DataFrame:
        return self.rows.groupBy("v").agg(F.max_by("k", "o").alias("k"))

    def look_up(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """The value of a column's key, null if there is none; Spark broadcasts the dictionary if it is small."""
        return df.join(self.forward().select(F.col("k").alias(column), F.col("v").alias(name)), column, "left")


# --- making a store ----------------------------------------------------------------------
def _column_meta(name: str, f: Field) -> dict:
    return {"_type": "column", "name": name, "format": {"_type": "field", "field": f.show()}, "desc": ""}


def write_dimension(path: str) -> None:
    """A dimension, which holds tables, families and further dimensions."""
    _write(f"{path}/_dimension.json", {"_type": "dimension", "name": path.rsplit("/", 1)[-1].rpartition(".")[0]})


def write_table(df: DataFrame, path: str, columns: dict[str, Field], delim: str = "sep", sep: str = "\t") -> None:
    """A table of the columns, as separated rows, or lines of a single column."""
    rows = df.select(pack_sep(sep, list(columns.values()), [F.col(n) for n in columns]).alias("value"))
    rows.write.mode("overwrite").text(path)
    meta = {"_type": "delim", "delim": delim} | ({"sep": sep} if delim == "sep" else {})
    _write(f"{path}/_table.json", {"_type": "table", "name": path.rsplit("/", 1)[-1].rpartition(".")[0], "delim": meta, "columns": [_column_meta(n, f) for n, f in columns.items()]})


def write_family(df: DataFrame, path: str, key: tuple[str, Field], columns: dict[str, Field], order: list[str], streams: int) -> None:
    """A family: the run lengths of a sorted key, and one directory a column, in as many streams.

    Rows of one key go to one stream, a directory of each directory. Its files are ranges of
    the sorted rows, so no task sorts a whole stream; directories may be cut at other places.
    """
    name, f = key
    parts = max(streams, -(-df.count() // FILE_ROWS))

    def write(rows: DataFrame, by: list[str], value: Column, to: str) -> None:
        cut = rows.withColumn("__stream", F.pmod(F.hash(name), F.lit(streams))).repartitionByRange(parts, "__stream", *by).sortWithinPartitions("__stream", *by)
        cut.select(F.col("__stream").alias("stream"), value.alias("value")).write.mode("overwrite").partitionBy("stream").text(to)

    shape = df.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    write(shape, [name], F.concat_ws("\t", f.pack(F.col(name)), F.col("__n").cast("string")), f"{path}/_shape")
    for c, g in columns.items():
        write(df, [name, *order], g.pack(F.col(c)), f"{path}/{c}.column")
        _write(f"{path}/{c}.column/_column.json", _column_meta(c, g))
    _write(f"{path}/_family.json", {"_type": "family", "name": path.rsplit("/", 1)[-1].rpartition(".")[0], "key": {"_type": "field", "field": f.show()}})


def split_columns(df: DataFrame, fields: str, path: str) -> None:
    """One directory for each column of rows of fields, a value a line."""
    rows = df.select(F.posexplode(fields).alias("column", "value"))
    rows.repartition("column").write.mode("overwrite").partitionBy("column").text(path)
