"""Bundles of ordered streams as DataFrames.

A ``Flow`` is a DataFrame with a bucket (which stream) and an order within it.  The order
is a declared key and costs nothing; dense positions are made only for operators that
need them, by a window that is partitioned by bucket, or by counts and offsets of key
ranges where there is one stream.  Neighbours, prefix aggregates and all operators made of
them work alike: a single stream is cut into key ranges, and a row for each range carries
what the ranges before it come to.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET, POS = "_bucket", "_pos"
#: Rows of a key range (about) when positions of one long stream are made, and sampled keys for each range.
RANGE_ROWS, SAMPLED = 100_000, 100


@dataclass(frozen=True)
class Flow:
    """``df`` with streams told apart by ``bucket`` and ordered by ``order`` (unique within a bucket)."""

    df: DataFrame
    bucket: str | None = None
    order: tuple[str, ...] = (POS,)

    # --- making -------------------------------------------------------------------
    @staticmethod
    def from_lists(spark: SparkSession, lists: Sequence[Sequence], value: str = "x", kind: str = "long") -> Flow:
        """One stream for each list."""
        rows = [(b, p, v) for b, one in enumerate(lists) for p, v in enumerate(one)]
        return Flow(spark.createDataFrame(rows, f"{BUCKET} int, {POS} long, {value} {kind}"), BUCKET)

    @staticmethod
    def from_list(spark: SparkSession, n: int, values: Sequence, value: str = "x", kind: str = "long") -> Flow:
        """n streams, each a full copy of the values."""
        one = spark.createDataFrame(list(enumerate(values)), f"{POS} long, {value} {kind}")
        return Flow(spark.range(n).select(F.col("id").cast("int").alias(BUCKET)).crossJoin(F.broadcast(one)), BUCKET)

    # --- order --------------------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return [self.bucket] if self.bucket else []

    def window(self):
        by = Window.partitionBy(*self.keys) if self.bucket else Window.partitionBy(F.lit(0))
        return by.orderBy(*self.order)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c != self.bucket and c not in self.order and c != POS]

    def indexed(self, name: str = POS) -> Flow:
        """Dense positions from 0 in each stream.

        With buckets it is one window by bucket.  A single stream is cut into key ranges at
        bounds taken from a sample of its keys, and the sizes of the ranges give each its
        offset, so no task sorts everything.  A range is a function of the key alone:
        however often or however partitioned the plan runs, rows keep their range.
        """
        if self.bucket:
            out = self.df.withColumn(name, (F.row_number().over(self.window()) - 1).cast("long"))
            return replace(self, df=out, order=(name,))
        cut = self._cut()
        sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        offsets = sizes.select("__part", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).alias("__off"))
        out = spread(cut).withColumn("__row", F.row_number().over(self._within())).join(F.broadcast(offsets), "__part")  # a row for each range
        out = out.withColumn(name, (F.col("__row") - 1 + F.col("__off")).cast("long"))
        return replace(self, df=out.drop("__part", "__row", "__off"), order=(name,))

    def _cut(self) -> DataFrame:
        """The rows of a single stream with ``__part``, their key range; of dense positions it follows without a look at the data."""
        part = F.call_function("div", F.col(POS), F.lit(RANGE_ROWS)) if self.order == (POS,) else self._range()
        return self.df.withColumn("__part", part)

    def _within(self):
        return Window.partitionBy("__part").orderBy(*self.order)

    def previous(self, *columns: str) -> DataFrame:
        """The rows with ``__first``, whether each is the first of its stream, and ``__before``, a struct of the columns of the one before."""
        now = F.struct(F.lit(True).alias("__there"), *columns)
        if self.bucket:
            out = self.df.withColumn("__before", F.lag(now).over(self.window()))
        else:
            cut = self._cut()
            # of each range the last row; there are as many as ranges
            last = cut.groupBy("__part").agg(F.max_by(now, F.struct(*self.order)).alias("__l"))
            carried = last.select("__part", F.lag("__l").over(Window.partitionBy(F.lit(0)).orderBy("__part")).alias("__c"))
            out = spread(cut).withColumn("__before", F.lag(now).over(self._within())).join(F.broadcast(carried), "__part")
            out = out.withColumn("__before", F.coalesce("__before", "__c")).drop("__part", "__c")
        return out.withColumn("__first", F.col("__before").isNull())

    def running(self, inclusive: bool = True, part: Column | None = None, **aggregates: Column) -> DataFrame:
        """The rows with prefix aggregates, up to each row or before it.

        In a single stream ``sum``, ``count``, ``min`` and ``max`` of a column or expression are
        carried over key ranges, which may be given as ``part``; any other aggregate needs the
        whole stream in one task.
        """
        end = Window.currentRow if inclusive else -1
        kinds = {n: _kind_of(c) for n, c in aggregates.items()}
        if self.bucket or not all(kinds.values()):
            w = self.window().rowsBetween(Window.unboundedPreceding, end)
            return self.df.withColumns({n: c.over(w) for n, c in aggregates.items()})
        cut = self._cut() if part is None else self.df.withColumn("__part", part)
        totals = cut.groupBy("__part").agg(*(c.alias(f"__t_{n}") for n, c in aggregates.items()))
        before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carry = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        carried = totals.select("__part", *(carry[kinds[n]](f"__t_{n}").over(before).alias(f"__c_{n}") for n in aggregates))  # a row for each range
        w = self._within().rowsBetween(Window.unboundedPreceding, end)
        out = spread(cut).withColumns({n: c.over(w) for n, c in aggregates.items()}).join(F.broadcast(carried), "__part")

        def both(n: str) -> Column:
            local, c = F.col(n), F.col(f"__c_{n}")
            if kinds[n] == "count":
                return local + F.coalesce(c, F.lit(0))
            if kinds[n] == "sum":
                return F.when(local.isNull(), c).when(c.isNull(), local).otherwise(local + c)
            return F.least(local, c) if kinds[n] == "min" else F.greatest(local, c)

        return out.withColumns({n: both(n) for n in aggregates}).drop("__part", *(f"__c_{n}" for n in aggregates))

    def _range(self, rows_each: int | None = None, rows: int | None = None) -> Column:
        """The number of the key range of a row: a balanced tree of comparisons with sampled bounds.

        Bounds are of the leading columns only, as many as cut the sample finely enough: rows
        that agree in them share a range.
        """
        rows = self.df.count() if rows is None else rows
        n = min(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (rows_each or RANGE_ROWS)))
        if n <= 1:
            return F.lit(0)
        keys = self.df.select(*self.order)
        kinds = [f.dataType for f in keys.schema.fields]
        # about SAMPLED rows for each range
        found = sorted(tuple(r) for r in keys.dropna().sample(min(1.0, SAMPLED * n / rows), seed=1).collect())
        used = 1
        while used < len(self.order) and found and Counter(x[:used] for x in found).most_common(1)[0][1] > max(1, len(found) // (4 * n)):
            used += 1
        bounds = sorted({found[len(found) * k // n][:used] for k in range(1, n)}) if found else []
        if not bounds:
            return F.lit(0)
        names = self.order[:used]
        key = F.struct(*names) if used > 1 else F.col(names[0])

        def pick(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            cells = [F.lit(v).cast(t) for v, t in zip(bounds[mid], kinds, strict=False)]
            bound = F.struct(*(c.alias(m) for c, m in zip(cells, names, strict=True))) if used > 1 else cells[0]
            return F.when(key < bound, pick(low, mid)).otherwise(pick(mid + 1, high))

        tree = pick(0, len(bounds))
        # a struct with nulls compares, a null alone does not; nulls come first
        return tree if used > 1 else F.when(key.isNull(), F.lit(0)).otherwise(tree)

    # --- elementwise --------------------------------------------------------------
    def map(self, **columns: Column) -> Flow:
        """New value columns; the old ones go, the order stays."""
        keep = [*self.keys, *self.order]
        return replace(self, df=self.df.select(*keep, *(c.alias(n) for n, c in columns.items() if n not in keep)))

    def extend(self, **columns: Column) -> Flow:
        return replace(self, df=self.df.withColumns(columns))

    def filter(self, predicate: Column) -> Flow:
        return replace(self, df=self.df.filter(predicate))

    def select(self, *names: str) -> Flow:
        return replace(self, df=self.df.select(*dict.fromkeys([*self.keys, *self.order, *names])))

    def discard(self, *names: str) -> Flow:
        return replace(self, df=self.df.drop(*names))

    def mask(self, *keep: bool) -> Flow:
        """Keep or drop value columns by position."""
        return self.select(*(n for n, k in zip(self.values, keep, strict=True) if k))

    def zip(self, *others: Flow) -> Flow:
        """Positional zip of streams; the shortest decides. Flows over one DataFrame must be mapped instead."""
        parts = [f.indexed() if f.order != (POS,) else f for f in (self, *others)]
        on = [BUCKET, POS] if self.bucket else [POS]
        frames = [p.df.withColumnRenamed(p.bucket, BUCKET) if p.bucket else p.df for p in parts]
        frames = [f.select(*on, *p.values) for f, p in zip(frames, parts, strict=True)]
        return Flow(reduce(lambda a, b: a.join(b, on), frames), BUCKET if self.bucket else None)

    # --- streams ------------------------------------------------------------------
    def map_index(self, bucket: Column) -> Flow:
        """Rename the streams through a bijection."""
        return replace(self, df=self.df.withColumn(self.bucket or BUCKET, bucket), bucket=self.bucket or BUCKET)

    def project(self, bucket) -> Flow:
        """One stream of the bundle."""
        return Flow(self.df.filter(F.col(self.bucket) == bucket).drop(self.bucket), None, self.order)

    def arity(self) -> DataFrame:
        return self.df.agg(F.countDistinct(self.bucket).alias("arity"))

    def funnel(self) -> Flow:
        """All streams in the order of their buckets, as one."""
        return Flow(self.df, None, (self.bucket, *self.order)) if self.bucket else self

    def head(self, n: int) -> tuple[Flow, Flow]:
        """The first n elements of each stream, and the rest.

        Tasks keep the first n of each stream that they see before anything is shuffled.
        """
        if self.bucket:
            first = self.df.withColumn("__r", F.row_number().over(self.window())).filter(F.col("__r") <= n)
            first = first.withColumn(POS, (F.col("__r") - 1).cast("long")).drop("__r")
        else:
            first = replace(self, df=self.df.orderBy(*self.order).limit(n))
            first = first.df.withColumn(POS, (F.row_number().over(first.window()) - 1).cast("long"))  # n rows
        return replace(self, df=first, order=(POS,)), self.indexed().filter(F.col(POS) >= n)

    def prepend(self, values: DataFrame) -> Flow:
        """Elements before those of each stream; ``values`` has the value columns and a position column ``_pos``."""
        at = self.indexed()
        n = values.count()
        if self.bucket:
            first = at.df.select(self.bucket).distinct().crossJoin(F.broadcast(values.withColumn(POS, F.col(POS) - n)))
        else:
            first = values.withColumn(POS, F.col(POS) - n)
        return replace(at, df=first.unionByName(at.df.select(*first.columns)))

    def collect(self, bucket=None) -> list:
        """The elements of one stream, in order, on the driver (``toList1``)."""
        one = self if bucket is None else self.project(bucket)
        names = one.values
        rows = one.df.orderBy(*one.keys, *one.order).select(*names).collect()
        return [r[0] for r in rows] if len(names) == 1 else [tuple(r) for r in rows]

    def observe(self, name: str, **metrics: Column) -> Flow:
        """Named metrics that Spark reports when an action runs the flow (``watch``)."""
        return replace(self, df=self.df.observe(name, *(c.alias(n) for n, c in metrics.items())))

    def fold(self, **aggregates: Column) -> DataFrame:
        """One row for each stream."""
        return self.df.groupBy(*self.keys).agg(*(c.alias(n) for n, c in aggregates.items()))

    def ordered_fold(self, value: str, start: Column, step: Callable[[Column, Column], Column], name: str = "acc") -> DataFrame:
        """Left fold of each stream in order. Streams meet in one row each, so this is for streams that fit."""
        rows = self.df.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct(*self.order, F.col(value).alias("__v")))).alias("__a"))
        return rows.select(*self.keys, F.aggregate(F.transform("__a", lambda x: x["__v"]), start, step).alias(name))

    def scan(self, **running: Column) -> Flow:
        """Inclusive prefix aggregates."""
        return replace(self, df=self.running(**running))


def spread(cut: DataFrame) -> DataFrame:
    """Key ranges over as many tasks as the session shuffles to; small shuffles are not put together, since sorted rows take far more room than shuffled ones."""
    return cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__part")


def _kind_of(c: Column) -> str | None:
    """The aggregate that a column is a plain call of, if partial results of it can be carried."""
    found = re.fullmatch(r"Column<'(sum|count|min|max)\((.*)\)'>", str(c), re.DOTALL)
    if not found:
        return None
    depth = 0
    for x in found[2]:
        depth += (x == "(") - (x == ")")
        if depth < 0:
            return None
    return found[1]
