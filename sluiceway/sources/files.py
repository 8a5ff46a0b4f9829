"""File-level sources and sinks: lines, separated values, typed lines, bytes, matrices, bitmaps, sieves."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import BUCKET, POS, Flow
from ..functions.formats import Field, pack_sep, unpack_sep

#: Files that a task of a grid holds open.
OPEN_FILES = 4


def lines(spark: SparkSession, paths: str | list[str], sep: str | None = None, pattern: str | None = None) -> DataFrame:
    """``value`` and ``_file``: one row a record, the terminator dropped. Order within a file is not kept."""
    reader = spark.read
    if sep:
        reader = reader.option("lineSep", sep)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).withColumn("_file", F.col("_metadata.file_path"))


def ordered_lines(spark: SparkSession, paths: str | list[str], sep: str = "\n", pattern: str | None = None) -> Flow:
    """One stream a file, in file order, with positions from 0.

    Files are read by splits, as any text: the start of a line's split and its number within
    the task that read it give the order, so a file need not fit a task.
    """
    reader = spark.read.option("lineSep", sep)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias(BUCKET), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"), "value")
    at = Flow(rows, BUCKET, ("__block", "__row")).indexed()
    return Flow(at.df.select(BUCKET, POS, "value"), BUCKET)


def separated(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """Rows as arrays of fields by a plain split: no quoting, as the format has none."""
    return lines(spark, paths).select(F.split("value", "\\Q" + sep + "\\E", -1).alias("fields"), "_file")


def csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return separated(spark, paths, ",")


def tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return separated(spark, paths, "\t")


def typed_lines(spark: SparkSession, paths: str | list[str], sep: str, names: list[str], fields: list[Field], bad: str = "drop") -> DataFrame:
    """Rows parsed by field formats. A row that does not parse is dropped, fails the job (``bad="fail"``) or is kept in ``_bad``."""
    rows = lines(spark, paths).select("value", unpack_sep(sep, fields, F.col("value")).alias("r"))
    if bad == "fail":
        rows = rows.withColumn("r", F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("bad row: "), F.col("value")))).otherwise(F.col("r")))
    columns = [F.col(f"r._{i + 1}").alias(n) for i, n in enumerate(names)]
    if bad == "keep":
        return rows.select(*columns, F.when(F.col("r").isNull(), F.col("value")).alias("_bad"))
    return rows.filter(F.col("r").isNotNull()).select(*columns)


def with_header(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """Separated values with a header line and quoted fields that may hold newlines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths, sep=sep)


def bytes_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_file"), "content")


def chars_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bytes as 8-bit characters."""
    return bytes_of(spark, paths).select("_file", F.decode("content", "ISO-8859-1").alias("chars"))


def fixed_records(spark: SparkSession, paths: str | list[str], width: int) -> DataFrame:
    """Records of a fixed number of bytes, with their position in the file."""
    n = F.floor(F.length("content") / width)
    at = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = bytes_of(spark, paths).select("_file", "content", F.explode(at).alias(POS))
    return rows.select("_file", POS, F.expr(f"substring(content, cast({POS} * {width} + 1 as int), {width})").alias("record"))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def escape_quoted(text: Column) -> Column:
    """Newlines and tabs inside double quotes as ``\\n`` and ``\\t``."""
    parts = F.split(text, '"', -1)
    inner = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))).otherwise(p))
    return F.array_join(inner, '"')


# --- sinks ---------------------------------------------------------------------------
def write_lines(df: DataFrame, column: str, path: str, files: int | None = None, sep: str = "\n") -> None:
    out = df.select(F.col(column).cast("string").alias("value"))
    (out.repartition(files) if files else out).write.mode("overwrite").option("lineSep", sep).text(path)


def write_separated(df: DataFrame, path: str, sep: str, fields: list[Field], names: list[str], files: int | None = None) -> None:
    rows = df.select(pack_sep(sep, fields, [F.col(n) for n in names]).alias("value"))
    write_lines(rows.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.lit("a value does not fit its format"))).otherwise(F.col("value"))), "value", path, files)


def sieve(df: DataFrame, key: str, value: str, path: str, mode: str = "append") -> None:
    """Rows to one directory for each key, appended to what is there; null keys are dropped.

    A hot key is spread over tasks: each task writes its own file of the key.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("file"), F.col(value).cast("string").alias("value"))
    rows.write.mode(mode).partitionBy("file").text(path)


def grid(df: DataFrame, folder: str, n: int, path: str) -> None:
    """A grid of outputs: a directory for each value of ``folder``, ``n`` files in each at most.

    All rows of a file go to one task, which writes them as they come: it holds up to
    ``OPEN_FILES`` files open, and only rows of further files are sorted by directory.
    """
    spread = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    rows = df.repartition(folder, F.pmod(F.xxhash64(*spread), F.lit(n)))
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, OPEN_FILES)
    try:
        rows.write.mode("overwrite").partitionBy(folder).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


# --- arrays in files -----------------------------------------------------------------
def _numbers(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), "\\s+"), lambda x: x != "")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i0, i1, v`` of a text matrix: the word MATRIX, two extents, the elements row by row."""
    t = bytes_of(spark, path).select(_numbers(F.decode("content", "UTF-8")).alias("w")).filter("w[0] = 'MATRIX'")
    t = t.select(F.expr("cast(w[2] as bigint)").alias("cols"), F.posexplode(F.expr("slice(w, 4, size(w))")).alias("p", "x"))
    return t.select(F.floor(F.col("p") / F.col("cols")).alias("i0"), F.pmod("p", "cols").alias("i1"), F.col("x").cast("double").alias("v"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``i0, v`` of a text vector: the word VECTOR, its length, the elements."""
    t = bytes_of(spark, path).select(_numbers(F.decode("content", "UTF-8")).alias("w")).filter("w[0] = 'VECTOR'")
    return t.select(F.posexplode(F.expr("slice(w, 3, cast(w[1] as int))")).alias("i0", "x")).select(F.col("i0").cast("long"), F.col("x").cast("double").alias("v"))


def _written_numbers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``at, value``: the lines of the files of a folder, one file after another, numbered from 0 over all."""
    rows = ordered_lines(spark, path, pattern=pattern).funnel().extend(line=F.col("value")).indexed()
    return rows.df.select(F.col(POS).alias("at"), F.trim("line").alias("value"))


def write_matrix(df: DataFrame, shape: tuple[int, int], path: str) -> None:
    """The text form of a matrix, ``i0, i1, v``, as files of a folder in order: two header lines, then an element a line."""
    head = df.sparkSession.createDataFrame([(-2, "MATRIX"), (-1, f"{shape[0]} {shape[1]}")], "__at long, value string")
    cells = df.select((F.col("i0") * shape[1] + F.col("i1")).cast("long").alias("__at"), F.col("v").cast("string").alias("value"))
    head.union(cells).orderBy("__at").select("value").write.mode("overwrite").text(path)


def read_written_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i0, i1, v`` of what ``write_matrix`` wrote; read by splits, with the order of lines from key ranges."""
    rows = _written_numbers(spark, path)
    head = {r["at"]: r["value"] for r in rows.filter("at < 2").collect()}
    if head.get(0) != "MATRIX":
        raise ValueError(f"{path} holds no matrix")
    cols = int(head[1].split()[1])
    at = F.col("at") - 2
    cells = rows.filter("at >= 2").select(F.call_function("div", at, F.lit(cols)).alias("i0"), F.pmod(at, F.lit(cols)).alias("i1"), F.col("value").cast("double").alias("v"))
    return cells.withColumn("i1", F.col("i1").cast("long"))


def write_vector(df: DataFrame, n: int, path: str) -> None:
    """The text form of a vector, ``i0, v``, as files of a folder in order."""
    head = df.sparkSession.createDataFrame([(-2, "VECTOR"), (-1, str(n))], "__at long, value string")
    head.union(df.select(F.col("i0").cast("long").alias("__at"), F.col("v").cast("string").alias("value"))).orderBy("__at").select("value").write.mode("overwrite").text(path)


def read_written_vector(spark: SparkSession, path: str) -> DataFrame:
    """``i0, v`` of what ``write_vector`` wrote."""
    return _written_numbers(spark, path).filter("at >= 2").select((F.col("at") - 2).alias("i0"), F.col("value").cast("double").alias("v"))


def matrix_text(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """One row ``value`` with the text form of a small matrix; ``write_matrix`` is for those that do not fit a row."""
    cells = F.array_sort(F.collect_list(F.struct("i0", "i1", "v")))
    body = F.array_join(F.transform(cells, lambda c: c["v"].cast("string")), "\n")
    return df.agg(F.concat(F.lit(f"MATRIX\n{shape[0]} {shape[1]}\n"), body, F.lit("\n")).alias("value"))


def read_raw_array(spark: SparkSession, path: str, dtype: str = "<f8") -> DataFrame:
    """``_file, i0, v`` of a raw dump of numbers."""
    return numbers_of(bytes_of(spark, path), dtype)


def numbers_of(rows: DataFrame, dtype: str = "<f8") -> DataFrame:
    """``_file, i0, v`` of the numbers in ``_file, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, raw in zip(pdf["_file"], pdf["content"], strict=True):
                v = np.frombuffer(raw, dtype).astype(float)
                yield pd.DataFrame({"_file": f, "i0": np.arange(len(v)), "v": v})

    return rows.select("_file", "content").mapInPandas(run, "_file string, i0 long, v double")


def read_bitmap(spark: SparkSession, path: str) -> DataFrame:
    """``_file, i0, i1, r, g, b`` of uncompressed 24-bit bitmaps, the top row first."""
    return pixels_of(bytes_of(spark, path))


def pixels_of(pictures: DataFrame) -> DataFrame:
    """``_file, i0, i1, r, g, b`` of the bitmaps in ``_file, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, raw in zip(pdf["_file"], pdf["content"], strict=True):
                (start,) = struct.unpack_from("<I", raw, 10)
                w, h = struct.unpack_from("<ii", raw, 18)
                if raw[:2] != b"BM" or struct.unpack_from("<H", raw, 28)[0] != 24:
                    raise ValueError(f"{f} is no 24-bit bitmap")
                stride = (3 * w + 3) // 4 * 4
                rows = np.frombuffer(raw, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : 3 * w].reshape(abs(h), w, 3)
                rows = rows[::-1] if h > 0 else rows
                i, j = np.indices((abs(h), w))
                yield pd.DataFrame({"_file": f, "i0": i.ravel(), "i1": j.ravel(), "r": rows[..., 2].ravel(), "g": rows[..., 1].ravel(), "b": rows[..., 0].ravel()})

    return pictures.select("_file", "content").mapInPandas(run, "_file string, i0 long, i1 long, r int, g int, b int")


def bitmap_bytes(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit bitmap of ``[h, w, 3]`` bytes, red first."""
    h, w, _ = pixels.shape
    stride = (3 * w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 0, 0, 0, 0) + body.tobytes()
