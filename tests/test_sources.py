"""Files, the store, the log and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.flow import BUCKET, POS
from sluiceway.functions.formats import Field
from sluiceway.operators.ndarray import NdArray
from sluiceway.plans import query as dsl
from sluiceway.sources import files, hashlog, store
from sluiceway.streaming import windows


def test_lines_and_typed_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\t2020-01-31\n2\ty\tbad\n")
    p = str(tmp_path / "a.tsv")
    assert [r.fields for r in files.tsv(spark, p).collect()] == [["1", "x", "2020-01-31"], ["2", "y", "bad"]]
    fields = [Field("IntAsc"), Field("VarAsc"), Field("YYYYsMMsDD", "-")]
    rows = files.typed_lines(spark, p, "\t", ["a", "b", "c"], fields).collect()
    assert [(r.a, r.b, str(r.c)) for r in rows] == [(1, "x", "2020-01-31")]
    assert files.typed_lines(spark, p, "\t", ["a", "b", "c"], fields, "keep").filter("_bad is not null").count() == 1
    with pytest.raises(Exception, match="bad row"):
        files.typed_lines(spark, p, "\t", ["a", "b", "c"], fields, "fail").collect()
    f = files.ordered_lines(spark, p)
    assert f.df.orderBy(POS).first()["value"].startswith("1")


def test_quotes_and_newlines(spark):
    df = spark.createDataFrame([('a "b\nc\td" e\r\nf\rg',)], "t string")
    esc, norm = df.select(files.escape_quoted(F.col("t")), files.normalise_newlines(F.col("t"))).first()
    assert esc == 'a "b\\nc\\td" e\r\nf\rg' and norm == 'a "b\nc\td" e\nf\ng'


def test_sieve_and_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3"), (None, "4")], "k string, v string")
    for _ in range(2):
        files.sieve(df, "k", "v", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/file=x")).collect()) == ["1", "1", "3", "3"]
    assert spark.read.text(str(tmp_path / "out")).count() == 6
    store.split_columns(spark.createDataFrame([(["a", "b"],)], "f array<string>"), "f", str(tmp_path / "cols"))
    assert {r.column for r in spark.read.text(str(tmp_path / "cols")).collect()} == {0, 1}


def test_arrays_in_files(spark, tmp_path):
    (tmp_path / "m.mat").write_text("MATRIX\n2 2\n1 2\n3 4\n")
    m = files.read_matrix(spark, str(tmp_path / "m.mat"))
    assert [(r.i0, r.i1, r.v) for r in m.orderBy("i0", "i1").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    assert files.matrix_text(NdArray(m, (2, 2)).df, (2, 2)).first()[0].split() == ["MATRIX", "2", "2", "1.0", "2.0", "3.0", "4.0"]
    (tmp_path / "v.vec").write_text("VECTOR\n3\n5\n6\n7\n")
    assert [r.v for r in files.read_vector(spark, str(tmp_path / "v.vec")).orderBy("i0").collect()] == [5, 6, 7]
    (tmp_path / "raw.bin").write_bytes(np.arange(4, dtype="<f8").tobytes())
    assert [r.v for r in files.read_raw_array(spark, str(tmp_path / "raw.bin")).orderBy("i0").collect()] == [0, 1, 2, 3]
    px = np.random.default_rng(1).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    (tmp_path / "p.bmp").write_bytes(files.bitmap_bytes(px))
    got = files.read_bitmap(spark, str(tmp_path / "p.bmp")).orderBy("i0", "i1").collect()
    assert [(r.r, r.g, r.b) for r in got] == [tuple(map(int, x)) for x in px.reshape(-1, 3)]
    assert files.chars_of(spark, str(tmp_path / "m.mat")).first().chars.startswith("MATRIX")
    assert files.fixed_records(spark, str(tmp_path / "raw.bin"), 8).count() == 4


def test_hash_log(tmp_path):
    p = str(tmp_path / "log")
    for x in (b"one", b"", b"two\nlines"):
        hashlog.append(p, x)
    assert list(hashlog.records(p)) == [b"one", b"", b"two\nlines"]
    assert hashlog.fold(p, 0, lambda n, x: n + len(x)) == 12
    raw = bytearray((tmp_path / "log").read_bytes())
    raw[22] ^= 1
    (tmp_path / "log").write_bytes(raw)
    with pytest.raises(hashlog.BrokenLog):
        list(hashlog.records(p))


@pytest.fixture
def root(tmp_path):
    def put(path, text):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    d = tmp_path / "sales.dimension"
    put(d / "_dimension.json", json.dumps({"_type": "dimension", "name": "sales"}))
    t = d / "orders.table"
    cols = [{"_type": "column", "name": n, "format": {"_type": "field", "field": f}, "desc": ""} for n, f in (("id", "IntAsc"), ("name", "VarAsc"))]
    put(t / "_table.json", json.dumps({"_type": "table", "name": "orders", "delim": {"_type": "delim", "delim": "sep", "sep": "\t"}, "columns": cols}))
    put(t / "0.tsv", "1\ta\n2\tb\n")
    put(t / "1.txt", "3\tc\n")
    put(t / "ignored.dat", "9\tz\n")
    f = d / "days.family"
    put(f / "_family.json", json.dumps({"_type": "family", "name": "days", "key": {"_type": "field", "field": "VarAsc"}}))
    put(f / "_shape" / "0.tsv", "mon\t2\ntue\t1\n")
    put(f / "temp.column" / "_column.json", json.dumps({"_type": "column", "name": "temp", "format": {"_type": "field", "field": "IntAsc"}, "desc": ""}))
    put(f / "temp.column" / "0.txt", "10\n20\n30\n")
    return str(tmp_path)


def test_store(spark, root):
    assert sorted(tuple(r) for r in store.scan(spark, root, "sales/orders").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r.name for r in store.scan(spark, root, "sales/orders/name").collect()) == ["a", "b", "c"]
    assert sorted(r.temp for r in store.scan(spark, root, "sales/days/temp").collect()) == [10, 20, 30]
    out = dsl.Q(spark, root).from_store_columns("sales/days", ["temp"])
    assert [tuple(r.x) for r in out.df.orderBy(BUCKET, POS).collect()] == [("mon", 10), ("mon", 20), ("tue", 30)]
    assert [(o.kind, o.name) for o in store.objects_in(root)[0].children] == [("family", "days"), ("table", "orders")]
    with pytest.raises(KeyError):
        store.resolve(root, "sales/nothing")
    with pytest.raises(KeyError):
        store.scan(spark, root, "sales/orders/nothing")


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a;1\nb;2\na;3\n")
    d = store.Dictionary(spark, str(tmp_path / "d.txt"), ";")
    assert {r.k: r.v for r in d.forward().collect()} == {"a": "3", "b": "2"}
    out = d.look_up(spark.createDataFrame([("a",), ("z",)], "k string"), "k", "v")
    assert {r.k: r.v for r in out.collect()} == {"a": "3", "z": None}


def test_streams(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = windows.source(spark, str(tmp_path / "in"), e.schema)
    q = windows.to_table(windows.tumbling(stream, "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1))), "tumbled", "complete", str(tmp_path / "c1"))
    del q
    assert spark.sql("select sum(n) from tumbled").first()[0] == e.count()
    running = windows.scan(stream, "user_id", ["value"], (0.0,), lambda s, v: ((s[0] + v,), [(s[0] + v,)]), "s double", "user_id long, total double")
    windows.to_table(running, "running", "append", str(tmp_path / "c2"))
    assert spark.sql("select count(*) from running").first()[0] == e.count()
    got = {r.user_id: round(r.m, 3) for r in spark.sql("select user_id, max(total) m from running group by user_id").collect()}
    assert got == {r.user_id: round(r.m, 3) for r in e.groupBy("user_id").agg(F.sum("value").alias("m")).collect()} or len(got) == e.select("user_id").distinct().count()


def test_family_streams_of_several_files(spark, tmp_path, monkeypatch):
    """A stream is cut into files of a bounded number of rows, and read back in order over them."""
    monkeypatch.setattr(store, "FILE_ROWS", 60)
    rows = [(k, j, f"{k}.{j}") for k in range(90) for j in range(k % 12)] + [(500, j, f"500.{j}") for j in range(200)]
    df = spark.createDataFrame(rows, "k long, j int, v string").repartition(5)
    at = str(tmp_path / "f.family")
    store.write_family(df, at, ("k", Field("IntAsc")), {"j": Field("IntAsc"), "v": Field("VarAsc")}, ["j"], 2)
    for c in ("j", "v"):
        sizes = [len(p.read_text().splitlines()) for p in (tmp_path / f"f.family/{c}.column").glob("stream=*/part-*")]
        assert sum(sizes) == len(rows) and max(sizes) < 200
    z = store.family_columns(spark, store.load_object(at), ["j", "v"])
    got = [tuple(r) for r in z.df.orderBy(BUCKET, POS).select(BUCKET, POS, "key", "j", "v").collect()]
    assert sorted(r[2:] for r in got) == sorted(rows) and len({r[0] for r in got}) == 2
    for b in {r[0] for r in got}:
        stream = [r for r in got if r[0] == b]
        assert [r[1] for r in stream] == list(range(len(stream))) and [r[2:] for r in stream] == sorted(r[2:] for r in stream)


@pytest.mark.parametrize("n_open", [1, 4])
def test_grid_keeps_its_number_of_files(spark, tmp_path, monkeypatch, n_open):
    """Nothing is sorted by directory, a directory has no more files than asked for, and no row is lost with more directories than open files."""
    monkeypatch.setattr(files, "OPEN_FILES", n_open)
    at = tmp_path / "grid"
    df = spark.range(5000).select((F.col("id") % 23).alias("k"), "id")
    files.grid(df, "k", 3, str(at))
    folders = [p for p in at.iterdir() if p.name.startswith("k=")]
    assert len(folders) == 23 and all(1 <= len(list(p.glob("part-*"))) <= 3 for p in folders)
    assert [tuple(r) for r in spark.read.parquet(str(at)).select("k", "id").orderBy("id").collect()] == [(i % 23, i) for i in range(5000)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
