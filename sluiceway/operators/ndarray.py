"""Dense arrays of any rank as rows ``(i0 .. in-1, v)``, row-major; absent cells are not stored."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NdArray:
    df: DataFrame
    shape: tuple[int, ...]

    @property
    def ix(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    # --- making ---------------------------------------------------------------------
    @staticmethod
    def generate(spark: SparkSession, shape: tuple[int, ...], f: Callable[..., Column]) -> NdArray:
        """An array from a function of its indices."""
        n, cols, rest = math.prod(shape), [], F.col("id")
        for size in reversed(shape):
            cols.append(F.pmod(rest, F.lit(size)))
            rest = F.floor(rest / size)
        cols = cols[::-1]
        ix = [c.cast("long").alias(f"i{k}") for k, c in enumerate(cols)]
        base = spark.range(n).select(*ix)
        names = [F.col(f"i{k}") for k in range(len(shape))]
        return NdArray(base.withColumn("v", f(*names)), tuple(shape))

    def _with(self, df: DataFrame, shape: tuple[int, ...] | None = None) -> NdArray:
        out = replace(self, df=df, shape=self.shape if shape is None else shape)
        return replace(out, df=df.select(*out.ix, "v"))

    # --- elementwise and index space --------------------------------------------------
    def map(self, f: Callable[[Column], Column]) -> NdArray:
        return self._with(self.df.withColumn("v", f(F.col("v"))))

    def zip_with(self, other: NdArray, f: Callable[[Column, Column], Column]) -> NdArray:
        """Elementwise on the intersection of the extents."""
        met = self.df.join(other.df.withColumnRenamed("v", "w"), self.ix)
        return self._with(met.withColumn("v", f(F.col("v"), F.col("w"))), tuple(map(min, self.shape, other.shape)))

    def linear(self) -> Column:
        at = F.lit(0).cast("long")
        for name, size in zip(self.ix, self.shape, strict=True):
            at = at * size + F.col(name)
        return at

    def reshape(self, shape: tuple[int, ...]) -> NdArray:
        if math.prod(shape) != math.prod(self.shape):
            raise ValueError("the sizes differ")
        rows, at, cols = self.df.withColumn("__at", self.linear()), F.col("__at"), []
        for size in reversed(shape):
            cols.append(F.pmod(at, F.lit(size)))
            at = F.floor(at / size)
        out = rows.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(reversed(cols))), "v")
        return NdArray(out, tuple(shape))

    def transpose(self) -> NdArray:
        """Swap the two innermost dimensions."""
        a, b = self.ix[-2:]
        names = {a: b, b: a}
        out = self.df.select(*(F.col(names.get(c, c)).alias(c) for c in self.ix), "v")
        return NdArray(out, (*self.shape[:-2], self.shape[-1], self.shape[-2]))

    def append(self, other: NdArray) -> NdArray:
        """Side by side along the innermost dimension; the outer extents are intersected."""
        outer = tuple(map(min, self.shape[:-1], other.shape[:-1]))
        last = self.ix[-1]
        both = self.df.unionByName(other.df.withColumn(last, F.col(last) + self.shape[-1]))
        for name, size in zip(self.ix[:-1], outer, strict=True):
            both = both.filter(F.col(name) < size)
        return NdArray(both, (*outer, self.shape[-1] + other.shape[-1]))

    def extract(self, start: tuple[int, ...], size: tuple[int, ...]) -> NdArray:
        out = self.df
        for name, s, n in zip(self.ix, start, size, strict=True):
            out = out.filter((F.col(name) >= s) & (F.col(name) < s + n)).withColumn(name, F.col(name) - s)
        return NdArray(out, tuple(size))

    def slice(self, **fixed: int) -> NdArray:
        """Fix some indices and drop them."""
        out, rest = self.df, [k for k, c in enumerate(self.ix) if c not in fixed]
        for name, at in fixed.items():
            out = out.filter(F.col(name) == at)
        return NdArray(out.select(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(rest)), "v"), tuple(self.shape[k] for k in rest))

    def extend(self, size: int) -> NdArray:
        """Repeat along a new innermost dimension."""
        last = f"i{len(self.shape)}"
        out = self.df.withColumn(last, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
        return NdArray(out.select(*self.ix, last, "v"), (*self.shape, size))

    def backpermute(self, shape: tuple[int, ...], source: Callable[..., tuple[Column, ...]], default: NdArray | None = None) -> NdArray:
        """Gather: the cell at an output index comes from the input cell that ``source`` names, or from ``default``."""
        spark = self.df.sparkSession
        out = NdArray.generate(spark, shape, lambda *i: F.lit(0)).df.drop("v")
        names = [f"i{k}" for k in range(len(shape))]
        at = source(*(F.col(n) for n in names))
        out = out.select(*names, *(c.cast("long").alias(f"__s{k}") for k, c in enumerate(at)))
        inner = self.df.select(*(F.col(c).alias(f"__s{k}") for k, c in enumerate(self.ix)), "v")
        met = out.join(inner, [f"__s{k}" for k in range(len(self.shape))], "inner" if default is None else "left")
        if default is not None:
            met = met.join(default.df.withColumnRenamed("v", "__d"), names, "left").withColumn("v", F.coalesce("v", "__d"))
        return NdArray(met.select(*names, "v"), tuple(shape))

    def interleave(self, *others: NdArray) -> NdArray:
        """Round robin along the innermost dimension; the extents must be equal."""
        parts = (self, *others)
        if any(p.shape != self.shape for p in parts):
            raise ValueError("the extents differ")
        last, n = self.ix[-1], len(parts)
        out = None
        for k, p in enumerate(parts):
            one = p.df.withColumn(last, F.col(last) * n + k)
            out = one if out is None else out.unionByName(one)
        return NdArray(out, (*self.shape[:-1], self.shape[-1] * n))

    # --- reductions -------------------------------------------------------------------
    def fold(self, aggregate: Column) -> NdArray:
        """Reduce the innermost dimension."""
        return NdArray(self.df.groupBy(*self.ix[:-1]).agg(aggregate.alias("v")), self.shape[:-1])

    def sum(self) -> NdArray:
        return self.fold(F.sum("v"))

    def fold_ordered(self, start: Column, step: Callable[[Column, Column], Column]) -> NdArray:
        """Reduce the innermost dimension in order, with any operator; a row of cells meets in one array."""
        cells = F.sort_array(F.collect_list(F.struct(self.ix[-1], "v")))
        return self.fold(F.aggregate(F.transform(cells, lambda x: x["v"]), start, step))

    def fold_all(self, **aggregates: Column) -> DataFrame:
        return self.df.agg(*(a.alias(n) for n, a in aggregates.items()))

    def equals(self, other: NdArray) -> bool:
        """Same shape and same cells."""
        if self.shape != other.shape:
            return False
        b = other.df.select(*other.ix, F.col("v").alias("w"), F.lit(1).alias("r"))
        met = self.df.withColumn("l", F.lit(1)).join(b, self.ix, "full")
        return met.filter(F.col("l").isNull() | F.col("r").isNull() | ~F.col("v").eqNullSafe(F.col("w"))).limit(1).count() == 0

    # --- linear algebra ---------------------------------------------------------------
    def mmult(self, other: NdArray) -> NdArray:
        """Matrix product: a join on the inner index and a partial-then-final sum."""
        b = other.df.select(F.col("i0").alias("i1"), F.col("i1").alias("j"), F.col("v").alias("w"))
        out = self.df.join(b, "i1").groupBy("i0", F.col("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return NdArray(out.select("i0", F.col("j").alias("i1"), "v"), (self.shape[0], other.shape[1]))

    def trace(self) -> DataFrame:
        return self.df.filter("i0 = i1").agg(F.sum("v").alias("trace"))

    # --- stencils ---------------------------------------------------------------------
    def stencil(self, weights: dict[tuple[int, int], float], boundary: str = "const", value: float = 0.0) -> NdArray:
        """Weighted sum over neighbours ``(di, dj)`` of each cell of a matrix.

        ``boundary`` is ``const`` (cells outside have ``value``), ``clamp`` (they have the
        nearest cell's) or ``fixed`` (a result that needs a cell outside is ``value``).  Each
        cell is sent to the results that it feeds by one explode, then summed by
        one aggregation with map-side partial sums: no self-join.
        """
        h, w = self.shape
        reach = [F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(float(c)).alias("c")) for (di, dj), c in weights.items()]
        spread = self.df.withColumn("__s", F.explode(F.array(*reach)))
        to = spread.select((F.col("i0") - F.col("__s.di")).alias("i0"), (F.col("i1") - F.col("__s.dj")).alias("i1"), (F.col("v") * F.col("__s.c")).alias("t"))
        inside = to.filter(F.col("i0").between(0, h - 1) & F.col("i1").between(0, w - 1))
        if boundary == "clamp":
            cells = self.df.select("i0", "i1", F.explode(F.array(*reach)).alias("__s"))
            out_of = cells.select("i0", "i1", (F.col("i0") + F.col("__s.di")).alias("a"), (F.col("i1") + F.col("__s.dj")).alias("b"), F.col("__s.c").alias("c"))
            out_of = out_of.filter((F.col("a") < 0) | (F.col("a") >= h) | (F.col("b") < 0) | (F.col("b") >= w))
            near = out_of.select("i0", "i1", "c", F.greatest(F.lit(0), F.least(F.col("a"), F.lit(h - 1))).alias("a"), F.greatest(F.lit(0), F.least(F.col("b"), F.lit(w - 1))).alias("b"))
            edge = self.df.select(F.col("i0").alias("a"), F.col("i1").alias("b"), "v")
            inside = inside.unionByName(near.join(edge, ["a", "b"]).select("i0", "i1", (F.col("v") * F.col("c")).alias("t")))
            return NdArray(inside.groupBy("i0", "i1").agg(F.sum("t").alias("v")), self.shape)
        sums = inside.groupBy("i0", "i1").agg(F.sum("t").alias("v"))
        missing = sum((F.when((F.col("i0") + di < 0) | (F.col("i0") + di >= h) | (F.col("i1") + dj < 0) | (F.col("i1") + dj >= w), F.lit(float(c))).otherwise(F.lit(0.0)) for (di, dj), c in weights.items()), F.lit(0.0))
        if boundary == "const":
            return NdArray(sums.withColumn("v", F.col("v") + missing * value), self.shape)
        lo = [min(d[k] for d in weights) for k in (0, 1)]
        hi = [max(d[k] for d in weights) for k in (0, 1)]
        whole = (F.col("i0") + lo[0] >= 0) & (F.col("i0") + hi[0] < h) & (F.col("i1") + lo[1] >= 0) & (F.col("i1") + hi[1] < w)
        return NdArray(sums.withColumn("v", F.when(whole, F.col("v")).otherwise(F.lit(value))), self.shape)

    def convolve(self, kernel: NdArray, boundary: str = "const", value: float = 0.0) -> NdArray:
        """Convolution with a small matrix whose centre is its middle cell; the kernel is read to the driver."""
        if kernel.shape[0] * kernel.shape[1] > 4096:
            raise ValueError("a kernel has 4096 cells at most")
        h, w = kernel.shape
        weights = {(r["i0"] - h // 2, r["i1"] - w // 2): r["v"] for r in kernel.df.collect()}
        return self.stencil(weights, boundary, value)

    def traverse(self, shape: tuple[int, ...], reads: list[Callable[..., tuple[Column, ...]]], f: Callable[..., Column]) -> NdArray:
        """Any element function of a fixed number of looked-up cells: ``f(indices.., cells..)``.

        Each lookup names an input cell for an output index and is one join; a cell that is
        not there is null.
        """
        names = [f"i{k}" for k in range(len(shape))]
        out = NdArray.generate(self.df.sparkSession, shape, lambda *i: F.lit(0)).df.drop("v")
        for n, read in enumerate(reads):
            at = read(*(F.col(c) for c in names))
            out = out.select("*", *(c.cast("long").alias(f"__s{k}") for k, c in enumerate(at)))
            cells = self.df.select(*(F.col(c).alias(f"__s{k}") for k, c in enumerate(self.ix)), F.col("v").alias(f"__v{n}"))
            keys = [f"__s{k}" for k in range(len(self.shape))]
            out = out.join(cells, keys, "left").drop(*keys)
        v = f(*(F.col(c) for c in names), *(F.col(f"__v{n}") for n in range(len(reads))))
        return NdArray(out.select(*names, v.alias("v")), tuple(shape))

    # --- spectra ----------------------------------------------------------------------
    def dft(self, inverse: bool = False) -> DataFrame:
        """Discrete Fourier transform of the innermost dimension: rows ``(.., k, re, im)``.

        The cells ``v`` are real, or have an imaginary part in a column ``w`` beside it.  Each cell
        goes to the n results of its row by an explode; sums are partial before the shuffle.
        """
        n, last = self.shape[-1], self.ix[-1]
        turn = (2 if inverse else -2) * math.pi / n
        ks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        angle = F.pmod(F.col(last) * F.col("k"), F.lit(n)) * turn
        v, w = F.col("v"), F.col("w") if "w" in self.df.columns else F.lit(0.0)
        out = self.df.withColumn("k", ks).groupBy(*self.ix[:-1], "k").agg(F.sum(v * F.cos(angle) - w * F.sin(angle)).alias("re"), F.sum(v * F.sin(angle) + w * F.cos(angle)).alias("im"))
        return out.withColumns({"re": F.col("re") / n, "im": F.col("im") / n}) if inverse else out

    def center(self) -> NdArray:
        """Alternate signs, which centres the spectrum."""
        parity = F.pmod(sum((F.col(c) for c in self.ix), F.lit(0)), F.lit(2))
        return self._with(self.df.withColumn("v", F.when(parity == 1, -F.col("v")).otherwise(F.col("v"))))


def fft_rows(df: DataFrame, by: list[str], at: str, re: str, im: str, mode: str = "forward") -> DataFrame:
    """Fast transform of each row of cells; a row's length must be a power of two (1 included).

    ``reverse`` has the other sign, ``inverse`` also divides by the length.  A row meets in
    one array and is transformed there; rows run in parallel.
    """
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{at} long, re double, im double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        n = len(pdf)
        if n & (n - 1):
            raise ValueError(f"length {n} is no power of two")
        x = pdf[re].to_numpy(float) + 1j * (pdf[im].to_numpy(float) if im else 0)
        y = np.fft.fft(x) if mode == "forward" else np.fft.ifft(x) * (1 if mode == "inverse" else n)
        out = {c: [pdf[c].iloc[0]] * n for c in by} | {at: np.arange(n), "re": y.real, "im": y.imag}
        return pd.DataFrame(out)

    return df.groupBy(*by).applyInPandas(run, schema)


def fft_arrays(df: DataFrame, re: str, im: str | None = None, mode: str = "forward") -> DataFrame:
    """Fast transform of array columns, in place: the columns ``re`` and ``im``, beside the others of ``df``.

    All arrays of a batch of one length are transformed at once; nothing is shuffled.  Lengths
    must be powers of two (0 and 1 included); a null array stays null.
    """
    import numpy as np
    import pyarrow as pa

    others = [f for f in df.schema.fields if f.name not in ("re", "im") and f.name not in (re, im)]
    names = [f.name for f in others]
    kind = pa.list_(pa.float64())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "re array<double>, im array<double>"])

    def run(batches):
        for batch in batches:
            x = batch.column("__re").to_pylist()
            y = batch.column("__im").to_pylist() if im else [None] * len(x)
            out_re, out_im = [None] * len(x), [None] * len(x)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(x):
                if v is not None:
                    by.setdefault(len(v), []).append(i)
            for n, rows in by.items():
                if n & (n - 1):
                    raise ValueError(f"length {n} is no power of two")
                z = np.array([x[i] for i in rows], float).reshape(len(rows), n)
                z = z + 1j * np.array([y[i] if y[i] is not None else [0.0] * n for i in rows], float).reshape(len(rows), n)
                if n:
                    z = np.fft.fft(z) if mode == "forward" else np.fft.ifft(z) * (1 if mode == "inverse" else n)
                for k, i in enumerate(rows):
                    out_re[i], out_im[i] = z[k].real, z[k].imag
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out_re, kind), pa.array(out_im, kind)], [*names, "re", "im"])

    given = [F.col(re).cast("array<double>").alias("__re"), *([F.col(im).cast("array<double>").alias("__im")] if im else [])]
    return df.select(*names, *given).mapInArrow(run, schema)


def fft_grid(df: DataFrame, axes: list[str], re: str, im: str | None, mode: str = "forward") -> DataFrame:
    """Fast transform of a grid along each of its axes in turn; every extent is a power of two."""
    out = df.select(*axes, F.col(re).cast("double").alias("re"), (F.col(im).cast("double") if im else F.lit(0.0)).alias("im"))
    for axis in reversed(axes):
        out = fft_rows(out, [a for a in axes if a != axis], axis, "re", "im", mode)
    return out


def is_inside(shape: tuple[int, int], i: Column, j: Column) -> Column:
    return i.between(0, shape[0] - 1) & j.between(0, shape[1] - 1)


def clamp_to_border(shape: tuple[int, int], i: Column, j: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), F.least(i, F.lit(shape[0] - 1))), F.greatest(F.lit(0), F.least(j, F.lit(shape[1] - 1)))


def lehmer(spark: SparkSession, n: int, low: int, high: int, seed: int) -> DataFrame:
    """``i, v``: the multiplicative generator 16807 mod 2^31-1, reduced to [low, high].

    Any element follows from its index by modular exponentiation, so ranges of indices are independent.
    """
    # The minimal standard generator.
    a, m = 16807, 2147483647
    powers = [pow(a, 1 << k, m) for k in range(40)]
    start = F.lit(seed % m or 1).cast("decimal(38,0)")
    value = start
    for k, p in enumerate(powers[: max(1, n.bit_length())]):
        bit = F.shiftright(F.col("id"), k).bitwiseAND(F.lit(1).cast("long"))
        value = F.when(bit == 1, F.pmod(value * F.lit(p).cast("decimal(10,0)"), F.lit(m).cast("decimal(10,0)")).cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)"))
    v = value.cast("long")
    return spark.range(n).select(F.col("id").alias("i"), (F.pmod(v, F.lit(high - low + 1)) + low).alias("v"))
