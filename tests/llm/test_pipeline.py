"""The pipeline's stages against plain Python."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluiceway.llm.queries import tokenizer_path
from tests.llm.test_small import plain_components, plain_groups, plain_overlaps


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got.append(docs)
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert all(d.columns == columns for d in got[:-1])
    text = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in got[:-1]]
    labels = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    good = [r.doc_id for r in labels.select("doc_id").collect()]
    assert sum(d in text[0] for d in good) >= 0.95 * len(good)
    assert set(text[1]) == {keep for _, keep, _, _ in plain_groups(list(text[0].items()))}
    near = plain_components(list(text[1].items()), 5, 80)
    assert set(text[2]) == {d for d, (_, c) in near.items() if c == d}
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(text[3]) == set(text[2]) - {d for d, _ in plain_overlaps(list(text[2].items()), tests)}
    tok = Tokenizer.from_file(tokenizer_path())
    for r in got[4].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(text[3][r.doc_id], add_special_tokens=False).ids
    assert got[4].count() == len(text[3])


def test_last_stage_decodes(spark, data):
    texts = ["plain words", "é \u4e16\n\t x", "", "  a  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_run_on_empty_documents(spark, data, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        t = spark.read.parquet(f"{data}/{name}.parquet")
        (t.filter(F.lit(False)) if name == "documents" else t).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
