"""Single streams in several key ranges: results and plans."""

import pytest
from pyspark.sql import functions as F

from sluiceway import flow as flows
from sluiceway.flow import POS, Flow
from sluiceway.operators import segmented, stateful
from sluiceway.plans import catalogue
from tests.compare import same

SINGLE = ["scan_single_stream", "groups_single_stream", "fold_groups_single_stream", "chunks_single_stream", "segments_single_stream", "decimate_single_stream", "head_single_stream", "indexed_single_stream", "folds_segments", "combine_by_flags", "funnel_streams"]


@pytest.fixture
def ranges(monkeypatch):
    monkeypatch.setattr(flows, "RANGE_ROWS", 700)
    monkeypatch.setattr(segmented, "RANGE_ROWS", 700)


@pytest.mark.parametrize("name", SINGLE)
def test_many_ranges_agree_with_sql(spark, data, ranges, name):
    same(catalogue.QUERIES[name](spark, data), catalogue.ORACLE[name], data)


@pytest.mark.parametrize("name", ["scan_single_stream", "groups_single_stream", "chunks_single_stream", "decimate_single_stream", "folds_segments"])
def test_no_task_sees_the_whole_stream(spark, data, ranges, name):
    """Rows of data are never exchanged to one partition; only rows that stand for ranges are."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert any("HashAggregate" in x or "SortAggregate" in x or "ObjectHashAggregate" in x for x in lines[k + 1 : k + 4]), "\n".join(lines[k : k + 6])


def test_heads_are_kept_before_the_shuffle(spark, data):
    plan = catalogue.QUERIES["head_streams"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ranges_with_nulls_and_ties(spark, monkeypatch):
    """Null values, aggregates that no range has a value of, and empty streams."""
    monkeypatch.setattr(flows, "RANGE_ROWS", 3)
    values = [None, None, None, None, 5, None, 2, 9, None, None, 1, None]
    f = Flow.from_list(spark, 1, values).project(0)
    out = f.scan(s=F.sum("x"), m=F.min("x"), n=F.count("x")).df.orderBy(POS).collect()
    for i, r in enumerate(out):
        seen = [v for v in values[: i + 1] if v is not None]
        assert (r.s, r.m, r.n) == ((sum(seen), min(seen), len(seen)) if seen else (None, None, 0))
    runs = segmented.groups(f, "x").df.orderBy(POS).collect()
    assert [(r.x, r.len) for r in runs] == [(None, 4), (5, 1), (None, 1), (2, 1), (9, 1), (None, 2), (1, 1), (None, 1)]
    none = Flow(f.df.filter("false"), None, (POS,))
    assert none.scan(s=F.sum("x")).df.count() == segmented.groups(none, "x").df.count() == stateful.decimate(none, lambda a, b: a == b, "x").df.count() == 0


@pytest.mark.parametrize("name", ["unfolds_elements"])
def test_opaque_steps_go_on_over_ranges(spark, data, monkeypatch, name):
    """A stream under an opaque step runs range after range, with the state carried, and none sorts all of it."""
    monkeypatch.setattr(stateful, "STEP_ROWS", 400)
    out = catalogue.QUERIES[name](spark, data)
    assert "steps-" in "".join(out.inputFiles())
    same(out, catalogue.ORACLE[name], data)


def test_states_of_opaque_steps(spark, monkeypatch):
    """State, positions, the last rows and an end of the stream, each over several ranges and with a key of two columns."""
    monkeypatch.setattr(stateful, "STEP_ROWS", 20)
    rows = [(i // 7, i, (i * 37) % 101) for i in range(150)]
    f = Flow(spark.createDataFrame(rows, "a long, b long, x long").repartition(6), None, ("a", "b"))

    def values(flow):
        return [(r[POS], r.x) for r in flow.df.orderBy(POS).collect()]

    top, tops = None, []
    for _, _, x in rows:
        tops += [] if top is None else [max(top, x)]
        top = x if top is None else max(top, x)
    assert values(stateful.compact_in(f, "x", lambda s, v: (max(s, v), max(s, v)), "long")) == list(enumerate([*tops, top]))
    total = stateful.process(f, ["x"], 0, lambda s, v: (s + v, []), {"x": "long"}, lambda s: [s])
    assert values(total) == [(0, sum(r[2] for r in rows))]
    ended = stateful.unfolds(f, ["b"], 0, lambda v, s: ("finish", s) if v[0] == 90 else ("give", v[0], 1) if s == 0 else ("next", 0), {"x": "long"})
    assert values(ended) == [(i, i) for i in range(90)]


def test_segments_that_go_on_over_ranges(spark, monkeypatch):
    """Segments longer than a range, empty ones, an incomplete last one, and runs over the ends of ranges with nulls."""
    monkeypatch.setattr(flows, "RANGE_ROWS", 3)
    monkeypatch.setattr(segmented, "RANGE_ROWS", 3)
    lengths = [2, 0, 11, 1, 0, 5, 9]
    segs = Flow(spark.createDataFrame([(i, f"s{i}", n) for i, n in enumerate(lengths)], f"{POS} long, name string, n long"), None)
    vals = Flow.from_list(spark, 1, list(range(22))).project(0)
    out = segmented.folds(segs, vals, "name", "n", total=(F.sum("x"), F.lit(-1)), low=(F.min("x"), F.lit(None)))
    expected, at = [], 0
    for i, n in enumerate(lengths):
        if at + n <= 22:
            expected.append((i, f"s{i}", sum(range(at, at + n)) if n else -1, at if n else None))
        at += n
    assert [(r[POS], r["name"], r.total, r.low) for r in out.orderBy(POS).collect()] == expected
    runs = [None] * 4 + ["a"] * 7 + ["b"] + [None] * 2 + ["b"] * 3
    got = segmented.groups(Flow.from_list(spark, 1, runs, "x", "string").project(0), "x").df.orderBy(POS).collect()
    assert [(r[POS], r.x, r.len) for r in got] == [(0, None, 4), (1, "a", 7), (2, "b", 1), (3, None, 2), (4, "b", 3)]


def test_range_by_leading_columns(spark, monkeypatch):
    """Bounds compare one column where it tells enough rows apart; rows are read and sorted once for values of segments."""
    monkeypatch.setattr(flows, "RANGE_ROWS", 50)
    many = Flow(spark.range(400).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), F.lit(1).alias("x")), None, ("a", "b"))
    assert "struct" not in str(many._range())
    few = Flow(spark.range(400).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"), F.lit(1).alias("x")), None, ("a", "b"))
    assert "struct" in str(few._range())
    assert [r[0] for r in few.indexed().df.orderBy(POS).select(POS).collect()] == list(range(400))
