"""Connecting and observing flows: taps, tees, hooks, two-input merges, grids of streams, generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import BUCKET, POS, Flow


def drain(df: DataFrame) -> None:
    """Evaluate every row and keep nothing (``drainP`` into ``ignore_o``)."""
    df.write.format("noop").mode("overwrite").save()


def consume(flow: Flow, effect: Callable[[tuple], None]) -> None:
    """Run an effect on every element, on the executors."""
    names = [*flow.keys, *flow.values]

    def each(rows) -> None:
        for r in rows:
            effect(tuple(r))

    flow.df.select(*names).foreachPartition(each)


def tee(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """Push the same rows to several sinks; they are computed once."""
    held = df.persist()
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()


def tap(df: DataFrame, sink: Callable[[DataFrame], None]) -> DataFrame:
    """Push the rows to a sink and hand them on."""
    held = df.persist()
    sink(held)
    return held


def finalise(df: DataFrame, hook: Callable[[int, int], None]) -> DataFrame:
    """Call ``hook(partition, rows)`` on the executor when a partition has been read to its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            n += len(pdf)
            yield pdf
        hook(TaskContext.get().partitionId(), n)

    return df.mapInPandas(run, df.schema)


def time_of(action: Callable[[], object]) -> tuple[object, float]:
    import time

    began = time.perf_counter()
    out = action()
    return out, time.perf_counter() - began


def repeat(spark: SparkSession, value: Column, per_second: int = 1) -> DataFrame:
    """An unbounded stream of a constant."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(value.alias("x"))


def replicate(spark: SparkSession, streams: int, n: int, value: Callable[[Column], Column]) -> Flow:
    """n copies of ``value(stream)`` in each stream."""
    rows = spark.range(streams * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias(BUCKET), F.pmod("id", F.lit(max(n, 1))).alias(POS))
    return Flow(rows.withColumn("x", value(F.col(BUCKET))), BUCKET)


def flip_index(flow: Flow, a: str, b: str) -> Flow:
    """Swap the two indices of a grid of streams."""
    names = {a: b, b: a}
    return Flow(flow.df.select(*(F.col(names.get(c, c)).alias(c) for c in flow.df.columns)), flow.bucket, flow.order)


def distribute_grid(flow: Flow, array: str, n: int, name: str = "x") -> tuple[DataFrame, DataFrame]:
    """The i-th element of an array of stream b to sink (b, i); elements beyond n come back as a second frame."""
    rows = flow.df.select(*flow.keys, *flow.order, F.posexplode(array).alias("_to", name))
    return rows.filter(F.col("_to") < n), rows.filter(F.col("_to") >= n)


def weave(left: Flow, right: Flow, columns: tuple[str, str], step: Callable, outputs: dict[str, str], start=None) -> DataFrame:
    """A stateful merge of two bundles, stream by stream.

    ``step(state, l, r)`` sees the heads of both inputs (None at an end) and returns
    (state, outputs, take left, take right); a stream ends when both inputs have, or when a
    step takes nothing and gives nothing.  The two streams of a bucket meet in one task.
    """
    b = left.bucket
    kind = left.df.schema[b].dataType.simpleString()
    names = [b, POS, *outputs]

    def run(key, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        a, c = (list(p.sort_values("__o")["__v"]) for p in (lp, rp))
        i = j = n = 0
        state, out = start, []
        while i < len(a) or j < len(c):
            state, given, go_left, go_right = step(state, a[i] if i < len(a) else None, c[j] if j < len(c) else None)
            for x in given:
                out.append((key[0], n, *(x if isinstance(x, tuple) else (x,))))
                n += 1
            if not (go_left or go_right or given):
                break
            i, j = min(i + bool(go_left), len(a)), min(j + bool(go_right), len(c))
        return pd.DataFrame(out, columns=names)

    def side(f: Flow, column: str) -> DataFrame:
        return f.indexed().df.select(F.col(f.bucket).alias(b), F.col(POS).alias("__o"), F.col(column).alias("__v"))

    schema = ", ".join([f"{b} {kind}", f"{POS} long", *(f"{k} {t}" for k, t in outputs.items())])
    return side(left, columns[0]).groupBy(b).cogroup(side(right, columns[1]).groupBy(b)).applyInPandas(run, schema)
