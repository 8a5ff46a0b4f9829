"""The engine's operators on unbounded streams: stateless ones as they are, keyed state, windows, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a directory as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, time: str, late: str, width: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggregates)


def sliding(df: DataFrame, time: str, late: str, width: str, step: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggregates)


def sessions(df: DataFrame, time: str, late: str, gap: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *aggregates)


def scan(df: DataFrame, key: str, columns: list[str], start: tuple, step: Callable, state: str, output: str) -> DataFrame:
    """A stateful flat map by key: ``step(state, *values) -> (state, rows)``; state survives between batches."""

    def run(k, frames: Iterator[pd.DataFrame], held: GroupState):
        now = held.get if held.exists else start
        out = []
        for pdf in frames:
            for values in pdf[columns].itertuples(index=False, name=None):
                now, rows = step(now, *values)
                out += [(k[0], *r) for r in rows]
        held.update(now)
        names = [c.strip().split(" ")[0] for c in output.split(",")]
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Run a stream over what there is, into an in-memory table; for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregation over what there is of a stream, and leave its last result as Parquet; a restart goes on from the checkpoint."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tee(df: DataFrame, sinks: list[Callable[[DataFrame], None]], checkpoint: str):
    """Each batch to several sinks (``dup``)."""

    def both(batch: DataFrame, _: int) -> None:
        batch.persist()
        for s in sinks:
            s(batch)
        batch.unpersist()

    return df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
