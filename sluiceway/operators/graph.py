"""Sample workloads: page ranks, sparse products, hulls, grids that relax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..shipping import ship
from .ndarray import NdArray


def page_rank(links: DataFrame, pages: DataFrame, steps: int = 10, damping: float = 0.85) -> DataFrame:
    """``page, rank`` after some steps; the rank of pages without links is spread over all.

    ``links`` has ``src, dst``; ``pages`` has distinct ``page``.  Out-degrees are joined once, and pages
    without links get one to nowhere, so a step is one join and one partial-then-final sum.
    Its sums are written and reread: the plan of a step does not grow with their number.
    """
    spark = links.sparkSession
    base = scratch.folder(spark, "rank")
    n = pages.count()
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    none = pages.join(degree, pages["page"] == degree["src"], "left_anti")
    nowhere = F.lit(None).cast(links.schema["dst"].dataType)
    edges = links.join(degree, "src").select("src", "dst", "deg").union(none.select(F.col("page").alias("src"), nowhere.alias("dst"), F.lit(1).cast("long").alias("deg")))
    edges = scratch.keep(edges.groupBy("src", "dst", "deg").agg((F.count(F.lit(1)) / F.col("deg")).alias("share")).select("src", "dst", "share"), f"{base}/edges")
    pages = scratch.keep(pages.select("page"), f"{base}/pages")
    ranks = pages.withColumn("rank", F.lit(1.0 / n))
    for k in range(steps):
        moved = edges.join(ranks, edges["src"] == ranks["page"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("r"))
        moved = scratch.keep(moved, f"{base}/step{k}")
        if k:
            scratch.delete(spark, f"{base}/step{k - 1}")
        lost = moved.filter("dst is null").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        ranks = pages.join(moved, pages["page"] == moved["dst"], "left")
        ranks = ranks.select("page", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("r", F.lit(0.0))).alias("rank"))
    return ranks


def sparse_times_vector(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """``row, v`` of a sparse matrix ``row, col, v`` times a vector ``col, x``."""
    return cells.join(vector, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the convex hull, by repeated splitting at the farthest point."""

    def beyond(a: int, b: int, idx: np.ndarray) -> list[int]:
        side = (x[b] - x[a]) * (y[idx] - y[a]) - (y[b] - y[a]) * (x[idx] - x[a])
        out = idx[side > 0]
        if not len(out):
            return [a]
        far = int(out[side[side > 0].argmax()])
        return beyond(a, far, out) + beyond(far, b, out)

    if len(x) < 2:
        return list(range(len(x)))
    order = np.lexsort((y, x))
    lo, hi, idx = int(order[0]), int(order[-1]), np.arange(len(x))
    return [lo] if x[lo] == x[hi] and y[lo] == y[hi] else beyond(lo, hi, idx) + beyond(hi, lo, idx)


def convex_hull(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """``by, x, y`` of the hull's corners of each group of points.

    Tasks first reduce their own points to hull corners, so what meets for a group is a few
    corners from each task and not the group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"{by} {kinds[by]}, {x} double, {y} double"

    def local(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(by):
                both = pd.concat([held[key], part]) if key in held else part
                both = both.drop_duplicates([x, y])
                held[key] = both.iloc[_hull(both[x].to_numpy(float), both[y].to_numpy(float))]
        if held:
            yield pd.concat(held.values()).astype({x: float, y: float})[[by, x, y]]

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates([x, y])
        return pdf.iloc[_hull(pdf[x].to_numpy(float), pdf[y].to_numpy(float))][[by, x, y]]

    ship(points.sparkSession)
    few = points.select(by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).mapInPandas(local, schema)
    return few.groupBy(by).applyInPandas(final, schema)


def relax(grid: NdArray, fixed: NdArray, steps: int) -> NdArray:
    """Each step replaces a cell by the mean of its four neighbours, except where ``fixed`` has a value."""
    around = {(0, 1): 0.25, (0, -1): 0.25, (1, 0): 0.25, (-1, 0): 0.25}
    for _ in range(steps):
        moved = grid.stencil(around, "const", 0.0)
        met = moved.df.join(fixed.df.withColumnRenamed("v", "f"), grid.ix, "left")
        grid = NdArray(met.select(*grid.ix, F.coalesce("f", "v").alias("v")), grid.shape)
    return grid


def blur(image: NdArray) -> NdArray:
    """A five by five binomial blur; borders are clamped."""
    w = (1, 4, 6, 4, 1)
    return image.stencil({(i - 2, j - 2): w[i] * w[j] / 256 for i in range(5) for j in range(5)}, "clamp")


def gradient_x(image: NdArray) -> NdArray:
    return image.stencil({(-1, -1): -1.0, (0, -1): -2.0, (1, -1): -1.0, (-1, 1): 1.0, (0, 1): 2.0, (1, 1): 1.0}, "clamp")
