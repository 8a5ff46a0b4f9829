"""Worked examples of flow and array operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.flow import BUCKET, POS, Flow
from sluiceway.functions import arrays as A
from sluiceway.functions import formats as V
from sluiceway.functions import scalars as S
from sluiceway.operators import graph, segmented, stateful, tags
from sluiceway.operators.ndarray import NdArray, fft_rows
from sluiceway.plans import query as dsl


def flow(spark, values, kind="string"):
    return Flow.from_lists(spark, [values], kind=kind)


def ordered(df, *names):
    return [tuple(r) for r in df.orderBy(BUCKET, POS).select(*names).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_groups(spark):
    out = segmented.groups(flow(spark, list("waabbbblle")), "x")
    assert ordered(out.df, "x", "len") == [("w", 1), ("a", 2), ("b", 4), ("l", 2), ("e", 1)]
    out = segmented.groups(flow(spark, [4, 4, 4, 3, 3, 1, 1, 1, 4], "long"), "x")
    assert [n for _, n in ordered(out.df, "x", "len")] == [3, 2, 3, 1]


def test_groups_of_nulls_and_nothing(spark):
    out = segmented.groups(flow(spark, [None, None, "a", None]), "x")
    assert ordered(out.df, "x", "len") == [(None, 2), ("a", 1), (None, 1)]
    empty = Flow(spark.createDataFrame([], f"{BUCKET} int, {POS} long, x string"), BUCKET)
    assert segmented.groups(empty, "x").df.count() == 0


def test_groups_by_compares_with_the_start(spark):
    out = segmented.groups_by(flow(spark, [1, 2, 3, 4, 9, 10], "long"), "x", lambda new, start: new - start < 3, "long")
    assert sorted((r.x, r.len) for r in out.collect()) == [(1, 3), (4, 1), (9, 2)]


def folds_of(spark, segs, values, agg, neutral):
    s = Flow(spark.createDataFrame([(i, *x) for i, x in enumerate(segs)], f"{POS} long, name string, n long"))
    v = Flow(spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], f"{POS} long, x double"))
    out = segmented.folds(s, v, "name", "n", acc=(agg, F.lit(float(neutral))))
    return [(r.name, r.acc) for r in out.orderBy(POS).collect()]


def test_folds(spark):
    segs = [("a", 1), ("b", 2), ("c", 4), ("d", 0), ("e", 1), ("f", 5)]
    assert folds_of(spark, segs, range(10, 100, 10), F.sum("x"), 0) == [("a", 10), ("b", 50), ("c", 220), ("d", 0), ("e", 80)]
    segs = [("a", 1), ("b", 2), ("c", 0), ("d", 0), ("e", 0)]
    assert folds_of(spark, segs, [10, 20, 30], F.product("x"), 1) == [("a", 10), ("b", 600), ("c", 1), ("d", 1), ("e", 1)]


def test_folds_with_no_values_keeps_empty_segments(spark):
    assert folds_of(spark, [("a", 0), ("b", 0), ("c", 2)], [], F.sum("x"), 0) == [("a", 0), ("b", 0)]


def test_fold_groups(spark):
    rows = [(0, i, k, float(v)) for i, (k, v) in enumerate(zip("waaaabllle", range(10, 110, 10), strict=True))]
    f = Flow(spark.createDataFrame(rows, f"{BUCKET} int, {POS} long, k string, v double"), BUCKET)
    assert ordered(segmented.fold_groups_by(f, ["k"], m=F.avg("v")), "k", "m") == [("w", 10), ("a", 35), ("b", 60), ("l", 80), ("e", 100)]
    rows = [(0, i, k, i + 1) for i, k in enumerate([0, 0, 1, 1, 0, 0, 0, 1])]
    f = Flow(spark.createDataFrame(rows, f"{BUCKET} int, {POS} long, k int, v int"), BUCKET)
    assert [s for (s,) in ordered(segmented.fold_groups_by(f, ["k"], s=F.sum("v")), "s")] == [3, 7, 18, 8]


def test_funnel(spark):
    f = Flow.from_list(spark, 3, [11, 22, 33]).funnel()
    assert f.collect() == [11, 22, 33] * 3
    assert Flow.from_list(spark, 3, [1]).arity().first()[0] == 3


def test_shuffle(spark):
    rows = [(0, i, b, v) for i, (b, v) in enumerate([(0, "a"), (1, "b"), (2, "c"), (0, "d"), (0, "c"), (0, "A"), (3, "B"), (3, "C"), (7, "x")])]
    f = Flow(spark.createDataFrame(rows, f"{BUCKET} int, {POS} long, b int, v string"), BUCKET).select("b", "v")
    kept, spill = stateful.shuffle(f, F.col("b"), 4)
    got = {k: "".join(x for (x,) in kept.project(k).df.orderBy(POS).select("v").collect()) for k in range(4)}
    assert got == {0: "adcA", 1: "b", 2: "c", 3: "BC"}
    assert [r.v for r in spill.collect()] == ["x"]


def test_ratchet(spark):
    df = spark.createDataFrame([(0, 10, 15), (1, 20, 26), (2, 30, 33), (3, 40, 47)], "s int, a int, b int")
    x, n = segmented.ratchet(df, "a", "b", "s")
    assert [r.x for r in x.orderBy("pass", "seg").collect()] == [10, 20, 30, 40, 11, 21, 31, 41, 12, 22, 32, 42, 13, 23, 43, 14, 24, 44, 25, 45, 46]
    assert [r.len for r in n.orderBy("pass").collect()] == [4, 4, 4, 3, 3, 2, 1]


def test_stateful_operators(spark):
    f = flow(spark, [1, 2, 3, 4], "long")
    assert ordered(stateful.process(f, ["x"], 0, lambda s, x: (s + x, [s, x]), {"y": "long"}).df, "y") == [(0,), (1,), (1,), (2,), (3,), (3,), (6,), (4,)]
    assert ordered(stateful.compact(f, ["x"], 0, lambda s, x: (s + x, s if x % 2 else None), {"y": "long"}).df, "y") == [(0,), (3,)]
    assert ordered(stateful.compact_in(f, "x", lambda s, x: (x, s * x), "long").df, "x") == [(2,), (6,), (12,), (4,)]
    step = lambda v, s: ("give", s, s + 1) if s < v[0] else ("next", 0) if v[0] < 3 else ("finish", 0)
    assert ordered(stateful.unfolds(f, ["x"], 0, step, {"y": "long"}).df, "y") == [(0,), (0,), (1,), (0,), (1,), (2,)]
    toggle = {"a": lambda x, m: ("b", m, [x]), "b": lambda x, m: ("a", m, [])}
    assert ordered(stateful.machine(f, "x", toggle, "a", {"y": "long"}).df, "y") == [(1,), (3,)]


def test_head_prepend_zip_pack(spark):
    f = flow(spark, [5, 6, 7], "long")
    first, rest = f.head(2)
    assert (first.collect(0), rest.collect(0)) == ([5, 6], [7])
    more = f.prepend(spark.createDataFrame([(0, 1), (1, 2)], f"{POS} long, x long"))
    assert more.collect(0) == [1, 2, 5, 6, 7]
    z = f.zip(Flow.from_lists(spark, [[True, False]], "keep", "boolean"))
    assert ordered(z.df, "x", "keep") == [(5, True), (6, False)]
    assert stateful.pack(Flow.from_lists(spark, [[True, False, True]], "keep", "boolean"), f, "keep").collect(0) == [5, 7]
    assert f.extend(y=F.col("x") * 2, z=F.lit(1)).mask(True, False, True).values == ["x", "z"]


def test_indexed_single_stream_is_dense(spark, monkeypatch):
    monkeypatch.setattr("sluiceway.flow.RANGE_ROWS", 60)
    monkeypatch.setattr("sluiceway.flow.SAMPLED", 20)
    rng = random.Random(3)
    keys = [(7 if i < 200 else rng.randrange(50), i, f"v{i}") for i in range(500)] + [(None, i, "n") for i in range(20)]
    df = spark.createDataFrame(keys, "a int, b int, v string").repartition(7)
    f = Flow(df, None, ("a", "b"))
    assert "CASE WHEN" in str(f._range())
    out = f.extend(p=F.col("a"), q=F.col("b")).indexed().df.select("p", "q", "v", POS).collect()
    got = [(p, q) for p, q, _, _ in sorted(out, key=lambda r: r[3])]
    assert got == sorted(((a, b) for a, b, _ in keys), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert sorted(r[3] for r in out) == list(range(520))


def test_array_functions(spark):
    words = F.lit("fresh   fried fish  ")
    assert one(spark, A.segment_on(words, " ")) == ["fresh ", " ", " ", "fried ", "fish ", " "]
    ints = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, A.intercalate(F.array(ints(1, 2, 3), ints(5, 6, 7)), ints(0, 0, 0))) == [1, 2, 3, 0, 0, 0, 5, 6, 7]
    assert one(spark, A.concat_with(F.array(ints(1), ints(2)), ints(0))) == [1, 0, 2, 0]
    assert one(spark, A.unlines(F.array(F.lit("a"), F.lit("b")))) == "a\nb\n"
    assert one(spark, A.trims(ints(0, 0, 1, 0, 2, 0), lambda x: x == 0)) == [1, 0, 2]
    assert one(spark, A.trim_starts(ints(0, 0), lambda x: x == 0)) == []
    assert one(spark, A.ragspose3(F.array(ints(1, 2, 3), ints(4), ints(5, 6)))) == [[1, 4, 5], [2, 6], [3]]
    assert one(spark, A.slice_(ints(1, 2, 3), F.lit(1), F.lit(3))) is None
    assert one(spark, A.tail(F.array().cast("array<int>"))) is None
    assert one(spark, A.map2(ints(1, 2), ints(1), lambda a, b: a + b)) is None
    assert one(spark, A.generate_maybe(F.lit(3), lambda i: F.when(i < 2, i))) is None
    assert one(spark, A.insert(ints(1, 2, 3), lambda i: F.when(i % 2 == 0, F.lit(9)))) == [9, 1, 9, 2, 9, 3, 9]
    assert one(spark, A.folds(ints(1, 2, 0, 9), ints(10, 20, 30), F.lit(0), lambda a, x: a + x)) == [10, 50, 0]
    assert math.isnan(one(spark, A.mean(F.array().cast("array<double>"))))
    assert one(spark, A.slices(ints(1, 2, 3, 4), ints(0, 2), ints(1, 2))) == [[1], [3, 4]]
    assert one(spark, A.dice_sep(F.lit("a\tb\nc\n"), "\t", "\n")) == [["a", "b"], ["c"]]
    assert [tuple(x) for x in one(spark, A.groups(ints(4, 4, 3)))] == [(4, 2), (3, 1)]
    assert one(spark, A.groups(F.array().cast("array<int>"))) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), max_size=30))
def test_array_reductions_match_numpy(spark, values):
    df = spark.createDataFrame([(values,)], "a array<long>")
    total, std, runs = df.select(A.total("a"), A.std("a"), A.groups("a")).first()
    assert total == sum(values)
    assert (std is None) if not values else math.isclose(std, float(np.std(values)), abs_tol=1e-9)
    assert [x for g in runs for x in [g["x"]] * g["n"]] == values


def test_formats(spark):
    fields = [V.Field("VarAsc"), V.Field("IntAsc"), V.Field("DoubleAsc")]
    packed = V.pack_sep("|", fields, [F.lit("foo"), F.lit(66), F.lit(93.42)])
    assert one(spark, packed) == "foo|66|93.42"
    assert tuple(one(spark, V.unpack_sep("|", fields, packed))) == ("foo", 66, 93.42)
    assert one(spark, V.unpack_sep("|", fields, F.lit("foo|x|1"))) is None
    assert one(spark, V.pack_object({"index": F.lit(27), "message": F.lit("foo"), "value": F.lit(None).cast("double")})) == '{"index":27,"message":"foo"}'
    assert V.Field.read("IntAsc0 5").show() == "IntAsc0 5" and V.Field.read("YYYYsMMsDD '/'").arg == "/"
    assert one(spark, V.Field("IntAsc0", 4).pack(F.lit(-7))) == "-0007"
    for kind, value in (("Int32be", -5), ("Word16be", 65535), ("Int64be", -(2**62)), ("Word8be", 200)):
        assert int(one(spark, V.unpack_be(kind, V.pack_be(kind, F.lit(value))))) == value
    raw = F.lit(bytearray(np.array([-2.75], ">f8").tobytes()))
    assert one(spark, V.unpack_be("Float64be", raw)) == -2.75
    assert one(spark, S.bits_of_double(F.lit(-2.75))) == int(np.array([-2.75]).view(np.int64)[0])
    assert one(spark, S.parse_date(F.lit("31.02.2020"), ".", True)) is None
    assert one(spark, S.date_range(F.lit("2020-01-02").cast("date"), F.lit("2020-01-01").cast("date"))) == []


def test_arrays_of_any_rank(spark):
    a = NdArray.generate(spark, (2, 2), lambda i, j: (i * 2 + j + 1).cast("double"))
    last = a.fold_ordered(F.lit(0.0), lambda acc, x: F.when(x != 0, x).otherwise(acc))
    assert [r.v for r in last.df.orderBy("i0").collect()] == [2, 4]
    assert a.equals(a.transpose().transpose()) and not a.equals(a.transpose())
    cube = NdArray.generate(spark, (2, 3, 4), lambda i, j, k: i * 100 + j * 10 + k)
    assert cube.sum().shape == (2, 3)
    assert cube.reshape((4, 6)).reshape((2, 3, 4)).equals(cube)
    with pytest.raises(ValueError):
        cube.reshape((5, 5))
    x = np.array([1.0, 2.0, 0.0, -1.0])
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "r int, at long, re double")
    got = fft_rows(df, ["r"], "at", "re", None).orderBy("at").collect()
    assert np.allclose([complex(r.re, r.im) for r in got], np.fft.fft(x))
    single = fft_rows(df.filter("at = 0"), ["r"], "at", "re", None).collect()
    assert single[0].re == 1.0


def test_graph(spark):
    rng = random.Random(5)
    pts = [(0, rng.random(), rng.random()) for _ in range(300)]
    hull = {(r.x, r.y) for r in graph.convex_hull(spark.createDataFrame(pts, "g int, x double, y double").repartition(5), "g").collect()}
    inside = lambda p: all((b[0] - a[0]) * (p[2] - a[1]) - (b[1] - a[1]) * (p[1] - a[0]) <= 1e-12 for a, b in ring)
    c = np.mean(list(hull), 0)
    corners = sorted(hull, key=lambda q: -math.atan2(q[1] - c[1], q[0] - c[0]))
    ring = list(zip(corners, corners[1:] + corners[:1], strict=True))
    assert all(inside(p) for p in pts)
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    ranks = graph.page_rank(links, spark.createDataFrame([(1,), (2,), (3,), (4,)], "page long"), 5)
    assert math.isclose(ranks.agg(F.sum("rank")).first()[0], 1.0)
    grid = NdArray.generate(spark, (4, 4), lambda i, j: F.lit(2.0))
    assert {round(r.v, 9) for r in graph.blur(grid).df.collect()} == {2.0}
    assert {round(r.v, 9) for r in graph.gradient_x(grid).df.collect()} == {0.0}


def test_tags(spark):
    html = '<html lang="en"><body class=\'a b\'><p>x<br/><img src=u.png></p><p id="2">y</p></body></html>'
    out = tags.elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, html string"), "k", "html").orderBy("at").collect()
    assert [(r.path, r.attributes) for r in out] == [
        ("html", {"lang": "en"}), ("html/body", {"class": "a b"}), ("html/body/p", {}), ("html/body/p/br", {}), ("html/body/p/img", {"src": "u.png"}), ("html/body/p", {"id": "2"}),
    ]


def test_query_text_output(spark):
    f = flow(spark, ["a\tb", "c"]).extend(n=F.lit(1))
    assert dsl.run_query(f) == ['"a\\tb"\t1', '"c"\t1']


def test_json_plan_folds(spark):
    lam2 = lambda body: {"_type": "lam", "bind": "acc", "body": {"_type": "lam", "bind": "x", "body": body}}
    add = {"_type": "sop", "sop": "add", "args": [{"_type": "var", "var": "acc"}, {"_type": "var", "var": "x"}]}
    plan = {"out": "o", "nodes": [{"_type": "foldi", "output": "o", "inputs": ["in"], "fun": lam2(add), "neutral": {"_type": "lit", "lit": "int", "value": 0}}]}
    out = dsl.load(plan, dsl.Q(spark), {"in": flow(spark, [1, 2, 3], "long")})
    assert out.select("x").first()[0] == 6
    segs = Flow(spark.createDataFrame([(0, ("a", 2)), (1, ("b", 0)), (2, ("c", 1))], f"{POS} long, x struct<_1:string,_2:long>"))
    plan = {"out": "o", "nodes": [{"_type": "foldsi", "output": "o", "inputs": ["s", "v"], "fun": lam2(add), "neutral": {"_type": "lit", "lit": "int", "value": 0}}]}
    vals = Flow(spark.createDataFrame([(0, 5), (1, 6), (2, 7)], f"{POS} long, x long"))
    out = dsl.load(plan, dsl.Q(spark), {"s": segs, "v": vals})
    assert [tuple(r.x) for r in out.orderBy(POS).collect()] == [("a", 11), ("b", 0), ("c", 7)]
