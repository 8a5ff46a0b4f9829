"""Taps, merges and the array operators that have no SQL."""

import numpy as np
from pyspark.sql import functions as F

from sluiceway.flow import BUCKET, POS, Flow
from sluiceway.functions import arrays as A
from sluiceway.operators import bundles
from sluiceway.operators.ndarray import NdArray, fft_grid


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_taps_and_hooks(spark, tmp_path):
    df = spark.range(10)
    bundles.tee(df, lambda d: d.write.parquet(str(tmp_path / "a")), lambda d: d.write.parquet(str(tmp_path / "b")))
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 10
    assert bundles.tap(df, bundles.drain).count() == 10
    seen = spark.sparkContext.accumulator(0)
    bundles.drain(bundles.finalise(df, lambda part, rows: seen.add(rows)))
    assert seen.value == 10
    total = spark.sparkContext.accumulator(0)
    bundles.consume(Flow.from_lists(spark, [[1, 2], [3]]), lambda r: total.add(r[-1]))
    assert total.value == 6
    assert bundles.time_of(lambda: 5)[0] == 5


def test_generators_and_grids(spark):
    f = bundles.replicate(spark, 2, 3, lambda b: b * 10)
    assert f.project(1).collect() == [10, 10, 10]
    g = Flow(spark.createDataFrame([(0, 1, 0, [7, 8, 9])], f"a int, b int, {POS} long, x array<int>"), "a", ("b", POS))
    assert tuple(bundles.flip_index(g, "a", "b").df.first())[:2] == (1, 0)
    kept, rest = bundles.distribute_grid(g, "x", 2)
    assert [r.x for r in kept.orderBy("_to").collect()] == [7, 8] and [r.x for r in rest.collect()] == [9]


def test_weave_merges_sorted_streams(spark):
    def step(_, a, b):
        left = b is None or (a is not None and a <= b)
        return None, [a if left else b], left, not left

    left, right = Flow.from_lists(spark, [[1, 4, 6], [1]]), Flow.from_lists(spark, [[2, 5, 9], [0]])
    out = bundles.weave(left, right, ("x", "x"), step, {"y": "long"})
    assert [r.y for r in out.orderBy(BUCKET, POS).collect()] == [1, 2, 4, 5, 6, 9, 0, 1]


def test_resumed_segments(spark):
    ints = lambda *x: F.array(*map(F.lit, x))
    add = lambda a, x: a + x
    assert one(spark, A.folds_with(F.lit(1), F.lit(100), ints(2, 5), ints(1, 2, 3, 4), F.lit(0), add)) == [101, 5]
    assert one(spark, A.folds_with(F.lit(9), F.lit(100), ints(2), ints(1, 2), F.lit(0), add)) == []
    assert [tuple(g) for g in one(spark, A.groups_with(F.lit(4), F.lit(2), ints(4, 3)))] == [(4, 3), (3, 1)]
    assert [tuple(g) for g in one(spark, A.groups_with(F.lit(7), F.lit(2), ints(4, 3)))] == [(7, 2), (4, 1), (3, 1)]
    assert one(spark, A.extract(ints(1, 2, 3, 4), F.array(F.struct(F.lit(2).alias("start"), F.lit(2).alias("len")), F.struct(F.lit(0).alias("start"), F.lit(1).alias("len"))))) == [3, 4, 1]
    assert one(spark, A.windowed(ints(1, 2, 3), F.lit(1), F.lit(9))) == [2, 3]


def test_grids(spark):
    v = np.arange(16.0).reshape(4, 4)
    a = NdArray(spark.createDataFrame([(i, j, float(v[i, j])) for i in range(4) for j in range(4)], "i0 long, i1 long, v double"), (4, 4))
    k = NdArray.generate(spark, (3, 3), lambda i, j: F.when((i == 1) & (j == 2), 1.0).otherwise(0.0))
    assert {(r.i0, r.i1): r.v for r in a.convolve(k).df.collect()} == {(i, j): (v[i, j + 1] if j < 3 else 0) for i in range(4) for j in range(4)}
    t = a.traverse((4, 4), [lambda i, j: (i, j), lambda i, j: (i - 1, j)], lambda i, j, x, up: x - F.coalesce(up, F.lit(0.0)))
    assert {(r.i0, r.i1): r.v for r in t.df.collect()} == {(i, j): v[i, j] - (v[i - 1, j] if i else 0) for i in range(4) for j in range(4)}
    got = {(r.i0, r.i1): complex(r.re, r.im) for r in fft_grid(a.df, ["i0", "i1"], "v", None).collect()}
    assert np.allclose([[got[i, j] for j in range(4)] for i in range(4)], np.fft.fft2(v))


def test_tags_of_any_length(spark):
    """Ten thousand attributes in a tag, a very long page, and keys that repeat."""
    from sluiceway.operators import tags

    wide = "<a " + " ".join(f'k{i}="{i}"' for i in range(10_000)) + ' k5="again"/>'
    docs = spark.createDataFrame([(1, wide), (2, "<p>x</p>" * 3000), (3, None), (4, ""), (5, "<b><i>"), (5, "<u>")], "id long, html string")
    out = tags.elements(docs, "id", "html").collect()
    assert len(next(r for r in out if r.id == 1).attributes) == 10_000 and next(r for r in out if r.id == 1).attributes["k5"] == "5"
    assert sum(r.id == 2 for r in out) == 3000
    assert sorted(r.path for r in out if r.id == 5) == ["b", "b/i", "u"]
