"""Stateful and keyed operators over streams: process, compact, unfolds, merge, padForward, pack, weave."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..flow import POS, Flow, spread


#: Rows (about) that a task sorts of a single stream under an opaque step; further ones are the next task's.
STEP_ROWS = 1_000_000


def _by_stream(flow: Flow, columns: list[str], start, step: Callable, finish: Callable, schema: str, names: list[str]) -> DataFrame:
    """Run ``step(state, *values) -> (state, rows)`` over each stream in order, in batches; ``finish(state)`` gives the last rows.

    Streams of a bundle run in parallel. A long single stream runs one key range after
    another, and the state, pickled, goes from each to the next.
    """
    b = flow.bucket

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        begun = False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                s, rest = (row[0], row[1:]) if b else (None, row)
                if not begun or s != key:
                    if begun:
                        out += [(key, *x) if b else tuple(x) for x in finish(state)]
                    key, state, begun = s, start, True
                state, rows = step(state, *rest)
                out += [(s, *x) if b else tuple(x) for x in rows]
            if out:
                yield pd.DataFrame(out, columns=names)
        if begun and (last := [(key, *x) if b else tuple(x) for x in finish(state)]):
            yield pd.DataFrame(last, columns=names)

    if b is None and (rows := flow.df.count()) > STEP_ROWS:
        return _in_turn(flow, columns, start, step, finish, schema, names, rows)
    cut = flow.df.repartition(b) if b else flow.df.repartition(1)
    return cut.sortWithinPartitions(*flow.keys, *flow.order).select(*flow.keys, *columns).mapInPandas(run, schema)


def _in_turn(flow: Flow, columns: list[str], start, step: Callable, finish: Callable, schema: str, names: list[str], rows: int) -> DataFrame:
    """A single stream by key ranges, one after another; each leaves its rows and, in a row of its own, the state after them."""
    spark = flow.df.sparkSession
    part = F.call_function("div", F.col(POS), F.lit(STEP_ROWS)) if flow.order == (POS,) else flow._range(STEP_ROWS, rows)
    cut = flow.df.select(*dict.fromkeys([*flow.order, *columns])).withColumn("__part", part.cast("long"))
    at, to = scratch.folder(spark, "ranges"), scratch.folder(spark, "steps")
    spread(cut).write.partitionBy("__part").parquet(at)
    parts = sorted(r[0] for r in spark.read.schema(cut.schema).parquet(at).select("__part").distinct().collect())
    kind = cut.drop("__part").schema
    state = cloudpickle.dumps(start)
    for k, p in enumerate(parts):
        final = k == len(parts) - 1

        def run(batches: Iterator[pd.DataFrame], before=state, final=final) -> Iterator[pd.DataFrame]:
            now = cloudpickle.loads(before)
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False, name=None):
                    now, new = step(now, *row)
                    out += map(tuple, new)
                if out:
                    yield pd.DataFrame(out, columns=names).assign(__state=None)
            if final:
                if out := [tuple(x) for x in finish(now)]:
                    yield pd.DataFrame(out, columns=names).assign(__state=None)
            else:
                yield pd.DataFrame({n: [None] for n in names} | {"__state": [cloudpickle.dumps(now)]})

        one = spark.read.schema(kind).parquet(f"{at}/__part={p}").repartition(1).sortWithinPartitions(*flow.order).select(*columns)
        one.mapInPandas(run, f"{schema}, __state binary").write.parquet(f"{to}/{k:06d}")
        if not final:
            state = bytes(spark.read.parquet(f"{to}/{k:06d}").filter("__state is not null").first()["__state"])
    done = spark.read.schema(f"{schema}, __state binary").parquet(*(f"{to}/{k:06d}" for k in range(len(parts))))
    return done.filter("__state is null").drop("__state")


def _schema(flow: Flow, outputs: dict[str, str]) -> tuple[str, list[str]]:
    b = flow.bucket
    head = [f"{b} {flow.df.schema[b].dataType.simpleString()}"] if b else []
    return ", ".join([*head, f"{POS} long", *(f"{n} {t}" for n, t in outputs.items())]), [*flow.keys, POS, *outputs]


def process(flow: Flow, columns: list[str], start, step: Callable, outputs: dict[str, str], finish: Callable | None = None) -> Flow:
    """Stateful flat map: ``step(state, *values) -> (state, rows)``, state carried along each stream."""
    schema, names = _schema(flow, outputs)

    def number(at, rows):
        return [(at + i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]

    def go(held, *values):
        state, at = held
        state, rows = step(state, *values)
        out = number(at, rows)
        return (state, at + len(out)), out

    def last(held):
        return number(held[1], finish(held[0])) if finish else []

    return Flow(_by_stream(flow, columns, (start, 0), go, last, schema, names), flow.bucket)


def compact(flow: Flow, columns: list[str], start, step: Callable, outputs: dict[str, str]) -> Flow:
    """Stateful filter and map: ``step(state, *values) -> (state, value or None)``."""

    def one(state, *values):
        state, x = step(state, *values)
        return state, [] if x is None else [x]

    return process(flow, columns, start, one, outputs)


def compact_in(flow: Flow, column: str, step: Callable, kind: str) -> Flow:
    """As ``compact``, the state being the first element; the final state is the last element out."""

    def one(state, value):
        if state is None:
            return (value,), []
        state, x = step(state[0], value)
        return (state,), [] if x is None else [x]

    return process(flow, [column], None, one, {column: kind}, lambda s: [] if s is None else [s[0]])


def unfolds(flow: Flow, columns: list[str], start, step: Callable, outputs: dict[str, str]) -> Flow:
    """Segmented unfold: ``step(values, state)`` returns ("give", x, state), ("next", state), ("bump", state) or ("finish", state).

    Give emits and stays at the element, Next goes on to the next one, Bump stays without
    emitting, Finish ends the stream.
    """

    def one(state, *values):
        if state is None:
            return None, []
        state, out = state[0], []
        while True:
            told = step(values, state)
            if told[0] == "give":
                out.append(told[1])
                state = told[2]
            elif told[0] == "bump":
                state = told[1]
            elif told[0] == "next":
                return (told[1],), out
            else:
                return None, out

    return process(flow, columns, (start,), one, outputs)


def dedup_sorted(flow: Flow, column: str) -> Flow:
    """Drop elements equal to the one before (``decimate`` by equality), in built-in expressions."""
    kept = F.col("__first") | ~F.col(column).eqNullSafe(F.col("__before")[column])
    return replace(flow, df=flow.previous(column).filter(kept).drop("__before", "__first"))


def decimate(flow: Flow, drop: Callable[[Column, Column], Column], column: str) -> Flow:
    """Drop the second of each adjacent pair of the source for which ``drop(before, element)`` holds."""
    kept = F.col("__first") | ~F.coalesce(drop(F.col("__before")[column], F.col(column)), F.lit(False))
    return replace(flow, df=flow.previous(column).filter(kept).drop("__before", "__first"))


def merge(left: DataFrame, right: DataFrame, key: str, order_left: list[str], order_right: list[str], both: Column, only_left: Column, only_right: Column, name: str = "v", drop_null: bool = False) -> DataFrame:
    """Sorted merge of two keyed streams; equal keys pair off one to one, in order.

    Combiners see ``l`` and ``r``, structs of the two sides' other columns.  With
    ``drop_null`` a null result drops the row, which expresses inner, left, right, semi and
    anti joins by the choice of combiners.
    """

    def side(df: DataFrame, order: list[str], as_: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.select(key, nth.alias("_nth"), F.struct(*rest).alias(as_))

    met = side(left, order_left, "l").join(side(right, order_right, "r"), [key, "_nth"], "full")
    v = F.when(F.col("l").isNull(), only_right).when(F.col("r").isNull(), only_left).otherwise(both)
    out = met.select(key, "_nth", v.alias(name))
    return out.filter(F.col(name).isNotNull()) if drop_null else out


def pad_forward(df: DataFrame, key: str, value: str, by: list[str], step: str) -> DataFrame:
    """Rows for all keys between the first and the last of each group, the last value carried forward.

    ``step`` is a literal that ``sequence`` takes, such as ``1`` or ``interval 1 day``.
    """
    span = df.groupBy(*by).agg(F.min(key).alias("__a"), F.max(key).alias("__b"))
    full = span.select(*by, F.explode(F.expr(f"sequence(__a, __b, {step})")).alias(key))
    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.join(df.select(*by, key, value), [*by, key], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def pack(flags: Flow, values: Flow, flag: str) -> Flow:
    """Values whose parallel flag is true."""
    z = values.zip(flags)
    return replace(z, df=z.df.filter(flag).drop(flag))


def combine2(flags: Flow, flag: str, yes: Flow, no: Flow, value: str) -> Flow:
    """For each flag the next element of one of two streams."""
    counted = replace(flags, df=flags.df.withColumn("__f", F.col(flag).cast("long")))
    f = counted.running(__n=F.sum("__f"), __m=F.count(F.lit(1))).withColumn("__m", F.col("__m") - F.col("__n")).drop("__f")
    f = f.withColumn("__at", F.when(F.col(flag), F.col("__n") - 1).otherwise(F.col("__m") - 1))
    keys = flags.keys
    y = yes.indexed().df.select(*keys, F.lit(True).alias(flag), F.col(POS).alias("__at"), value)
    n = no.indexed().df.select(*keys, F.lit(False).alias(flag), F.col(POS).alias("__at"), value)
    out = f.join(y.unionByName(n), [*keys, flag, "__at"])
    return replace(flags, df=out.drop("__n", "__m", "__at"))


def shuffle(flow: Flow, number: Column, n: int) -> tuple[Flow, DataFrame]:
    """Elements by explicit stream number; those out of range come back as a second frame."""
    rows = flow.df.withColumn("__to", number)
    inside = F.col("__to").between(0, n - 1)
    order = tuple(dict.fromkeys([*flow.keys, *flow.order]))
    kept = rows.filter(inside).withColumnRenamed("__to", "_to")
    return Flow(kept, "_to", order), rows.filter(~inside | F.col("__to").isNull()).drop("__to")


def distribute(flow: Flow, array: str, n: int, name: str = "x") -> tuple[Flow, DataFrame]:
    """The i-th element of each array to stream i; elements beyond the n streams come back as a second frame."""
    rows = flow.df.select(*flow.keys, *flow.order, F.posexplode(array).alias("_to", name))
    order = tuple(dict.fromkeys([*flow.keys, *flow.order]))
    return Flow(rows.filter(F.col("_to") < n), "_to", order), rows.filter(F.col("_to") >= n)


def machine(flow: Flow, column: str, states: dict, start: str, outputs: dict[str, str]) -> Flow:
    """Interpret a state machine over a stream.

    ``states`` maps a label to a function of (element, memory) that returns
    (next label, memory, outputs); the label ``halt`` ends the stream.
    """

    def one(state, value):
        label, memory = state
        if label == "halt":
            return state, []
        label, memory, out = states[label](value, memory)
        return (label, memory), out

    return process(flow, [column], (start, None), one, outputs)
