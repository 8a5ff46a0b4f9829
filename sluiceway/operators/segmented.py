"""Runs and segments of ordered streams: groups, folds, foldGroupsBy, replicates, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..flow import POS, RANGE_ROWS, Flow, spread


def _islands(flow: Flow, *keys: str) -> DataFrame:
    """The rows with ``__run``, the number from 1 of the run of equal keys that each belongs to.

    In a single stream runs are numbered within key ranges, and a row for each range carries
    the number of runs before it, and whether its first run goes on from them.
    """
    if flow.bucket:
        change = F.col("__first")
        for k in keys:
            change = change | ~F.col(k).eqNullSafe(F.col("__before")[k])
        marked = flow.previous(*keys).withColumn("__start", change.cast("long")).drop("__before", "__first")
        return replace(flow, df=marked).running(__run=F.sum("__start")).drop("__start")
    w = flow._within()
    rows = spread(flow._cut()).withColumn("__before", F.lag(F.struct(F.lit(True).alias("__there"), *keys)).over(w))
    differs = reduce(lambda a, k: a | ~F.col(k).eqNullSafe(F.col("__before")[k]), keys, F.lit(False))
    rows = rows.withColumn("__start", (F.col("__before").isNotNull() & differs).cast("long"))
    now, at = F.struct(F.lit(True).alias("__there"), *keys), F.struct(*flow.order)
    ranges = rows.groupBy("__part").agg(F.sum("__start").alias("__n"), F.min_by(now, at).alias("__a"), F.max_by(now, at).alias("__z"))
    one = Window.partitionBy(F.lit(0)).orderBy("__part")  # a row for each range
    ranges = ranges.withColumn("__l", F.lag("__z").over(one))
    opens = F.col("__l").isNull() | reduce(lambda a, k: a | ~F.col("__a")[k].eqNullSafe(F.col("__l")[k]), keys, F.lit(False))
    ranges = ranges.withColumn("__off", F.sum(F.col("__n") + opens.cast("long")).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
    out = rows.withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(F.broadcast(ranges.select("__part", "__off")), "__part").withColumn("__run", F.col("__run") + F.col("__off"))
    return out.drop("__part", "__before", "__start", "__off")


def groups(flow: Flow, key: str, length: str = "len") -> Flow:
    """Consecutive equal values as ``(value, length)``, in order."""
    runs = _islands(flow, key).groupBy(*flow.keys, "__run", key).agg(F.count(F.lit(1)).alias(length))  # a run has one key
    return Flow(runs.withColumnRenamed("__run", POS).withColumn(POS, F.col(POS) - 1), flow.bucket)


def fold_groups_by(flow: Flow, keys: list[str], presorted: bool = False, **aggregates: Column) -> DataFrame:
    """Aggregates of each run of equal keys.

    If the caller knows that equal keys are adjacent in a single stream, a run is a group and
    no order is needed at all: a plain hash aggregation does it.
    """
    aggs = [c.alias(n) for n, c in aggregates.items()]
    if presorted:
        return flow.df.groupBy(*flow.keys, *keys).agg(*aggs)
    runs = _islands(flow, *keys).groupBy(*flow.keys, "__run", *(k for k in keys if k not in flow.keys)).agg(*aggs)
    return runs.withColumn(POS, F.col("__run") - 1).drop("__run")


def groups_by(flow: Flow, key: str, same: Callable[[object, object], bool], kind: str, length: str = "len") -> DataFrame:
    """Runs under any predicate ``same(new, start)``, which compares with the first element of the run.

    An opaque predicate needs the stream's elements one after another: buckets run in
    parallel, and a bucket streams through its task in batches that are never all held.
    """
    b = flow.bucket
    names = [*([b] if b else []), key, length]
    schema = ", ".join([*([f"{b} {flow.df.schema[b].dataType.simpleString()}"] if b else []), f"{key} {kind}", f"{length} long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            out = []
            stream = pdf[b] if b else [0] * len(pdf)
            for s, v in zip(stream, pdf[key], strict=True):
                if state is not None and state[0] == s and same(v, state[1]):
                    state[2] += 1
                else:
                    if state is not None:
                        out.append(state)
                    state = [s, v, 1]
            if out:
                yield pd.DataFrame([x if b else x[1:] for x in out], columns=names)
        if state is not None:
            yield pd.DataFrame([state if b else state[1:]], columns=names)

    cut = flow.df.repartition(b) if b else flow.df.repartition(1)
    return cut.sortWithinPartitions(*flow.keys, *flow.order).select(*flow.keys, key).mapInPandas(run, schema)


def folds(segments: Flow, values: Flow, name: str, length: str, **aggregates: tuple[Column, Column]) -> DataFrame:
    """Aggregates of the values of each segment, in the order of the segments.

    ``aggregates`` maps a name to (aggregate, result of an empty segment).  Values are laid
    out one segment after another; an incomplete last segment yields nothing, and empty
    segments yield the neutral result.  Beginnings of segments and values are sorted together
    by position, in ranges of positions, and each value takes the last segment begun.  The
    segments with their places are written once; from them also comes which segment goes on
    into which ranges, so the values are read and sorted once.
    """
    val = values.indexed() if values.order != (POS,) else values
    keys = segments.keys
    sized = segments.df.select(*dict.fromkeys([*keys, *segments.order]), F.col(name).alias("__name"), F.col(length).cast("long").alias("__len"))
    spark = sized.sparkSession
    if segments.order == (POS,):
        if not keys:
            sized = scratch.keep(sized, scratch.folder(spark, "segments"))
        s = replace(segments, df=sized).running(__end=F.sum("__len")).withColumn("__seg", F.col(POS))
    else:
        s = replace(segments, df=sized).running(__end=F.sum("__len"), __seg=F.count(F.lit(1))).withColumn("__seg", F.col("__seg") - 1)
    s = scratch.keep(s.select(*keys, F.col("__seg").cast("long").alias("__seg"), "__name", "__len", "__end"), scratch.folder(spark, "segments"))
    v = val.df.withColumnRenamed(val.bucket, keys[0]) if val.bucket and keys and val.bucket != keys[0] else val.df
    v = v.select(*keys, F.col(POS).cast("long").alias("__at"), *(c for c in v.columns if c not in (*keys, POS)))
    begun = F.struct(F.col("__seg").alias("seg"), F.col("__end").alias("end"), F.col("__len").alias("len"), F.col("__name").alias("name"))
    begins = s.filter("__len > 0").select(*keys, (F.col("__end") - F.col("__len")).alias("__at"), begun.alias("__begun"))
    both = v.withColumn("__begun", F.lit(None).cast(begins.schema["__begun"].dataType)).unionByName(begins, allowMissingColumns=True)
    # a segment begins before the value at its place
    both = both.withColumn("__value", F.col("__begun").isNull())
    within = Window.partitionBy(*(keys or ["__part"])).orderBy("__at", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = F.last("__begun", ignorenulls=True).over(within)
    if keys:
        placed = both.withColumn("__of", of)
    else:
        div = lambda x: F.call_function("div", x, F.lit(RANGE_ROWS))
        first, last = div(F.col("__at")), div(F.col("__begun.end") - 1)
        # the segment that is under way where a range begins: one at most
        under = begins.filter(first < last).select(F.explode(F.sequence(first + 1, last)).alias("__part"), F.col("__begun").alias("__c"))
        placed = spread(both.withColumn("__part", div(F.col("__at")))).withColumn("__of", of).join(F.broadcast(under), "__part", "left")
        placed = placed.withColumn("__of", F.coalesce("__of", "__c"))
    placed = placed.filter("__value and __at < __of.end").withColumn(POS, F.col("__at"))
    found = [F.col(f"__of.{x}").alias(f"__{x}") for x in ("seg", "len", "name")]
    got = placed.groupBy(*keys, *found).agg(F.count(F.lit(1)).alias("__got"), *(a.alias(n) for n, (a, _) in aggregates.items()))
    full = got.filter("__got = __len").select(*keys, F.col("__seg").alias(POS), F.col("__name").alias(name), *aggregates)
    empty = s.filter("__len = 0").select(*keys, F.col("__seg").alias(POS), F.col("__name").alias(name), *(z.alias(n) for n, (_, z) in aggregates.items()))
    return full.union(empty)


def replicates(flow: Flow, count: str) -> Flow:
    """Each element as often as ``count`` says."""
    n = F.greatest(F.col(count), F.lit(0)).cast("int")
    at = F.posexplode(F.array_repeat(F.lit(0), n)).alias("_copy", "__z")
    out = flow.df.select("*", at).drop("__z")
    return replace(flow, df=out, order=(*flow.order, "_copy"))


def concat(flow: Flow, array: str, name: str = "x") -> Flow:
    """Elements of array values, one after another; empty arrays vanish (``concat_i``, ``unchunk_i``)."""
    return replace(flow, df=flow.df.select(*flow.keys, *flow.order, F.posexplode(array).alias("_at", name)), order=(*flow.order, "_at"))


def _pieces(flow: Flow, end: Column, **more: Column) -> Flow:
    """The flow with positions, ``__seg``, the number of elements before each for which ``end`` holds, and ``__from``, where that piece begins."""
    at = flow if flow.order == (POS,) else replace(flow.indexed(), order=(POS,))
    marked = replace(at, df=at.df.withColumn("__ends", F.coalesce(end, F.lit(False)).cast("long")))
    begun = replace(at, df=marked.previous("__ends"))
    begins = F.when(F.col("__first") | (F.col("__before")["__ends"] == 1), F.col(POS))
    begun = replace(at, df=begun.df.withColumns({"__begins": begins, "__one": begins.isNotNull().cast("long"), **more}).drop("__before", "__first"))
    out = begun.running(__seg=F.sum("__one"), __from=F.max("__begins"), **{n: F.max(n) for n in more})
    return replace(at, df=out.withColumn("__seg", F.col("__seg") - 1).drop("__ends", "__begins", "__one"))


def _gathered(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The values of each group, in order, as an array."""
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(POS, F.col(value).alias("__v")))).alias("__a"))
    return got.withColumn(value, F.transform("__a", lambda x: x["__v"])).drop("__a")


def chunk_on(flow: Flow, value: str, most: int, end: Column) -> Flow:
    """Chunks that close after an element for which ``end`` holds, or after ``most`` elements."""
    cut = _pieces(flow, end)
    rows = cut.df.withColumn("__k", F.call_function("div", F.col(POS) - F.col("__from"), F.lit(most)))
    return Flow(_gathered(rows, [*flow.keys, "__seg", "__k"], value), flow.bucket, ("__seg", "__k"))


def segment(flow: Flow, starts: Column, ends: Column, value: str) -> Flow:
    """Segments from an element where ``starts`` holds to the next where ``ends`` holds, both inclusive."""
    cut = _pieces(flow, ends, __open=F.when(starts, F.col(POS)))
    rows = cut.df.filter(F.col("__open") >= F.col("__from"))
    return Flow(_gathered(rows, [*flow.keys, "__seg"], value).withColumnRenamed("__seg", POS), flow.bucket)


def ratchet(df: DataFrame, start: str, stop: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Interleaved ``[start, stop)`` of each row: one element of every open row at each pass, and the length of each pass."""
    rows = df.filter(F.col(stop) > F.col(start)).select(F.col(order).alias("seg"), F.posexplode(F.sequence(F.col(start), F.col(stop) - 1)).alias("pass", "x"))
    return rows.select("pass", "seg", "x"), rows.groupBy("pass").agg(F.count(F.lit(1)).alias("len"))
