"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters find the digests that fill a large share of the rows; their
exact sizes and winners are then verified and broadcast, so rows of the large groups
are settled map-side.  All other rows meet in one ordinary shuffle by digest.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import tidy
from .runtime import Scratch, ship

#: Counters kept; it bounds what is sent to the driver and broadcast.
COUNTERS = 1024
#: Ids up to this count are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


_BLANKS = b" \t\n\x0b\x0c\r"


def _digests(batches):
    """``doc_id, text, rid`` to ``doc_id, n, digest, rid``; n counts code points of the original text."""
    for batch in batches:
        text = pc.fill_null(batch.column(1), "")
        raw = text.cast(pa.binary() if text.type == pa.string() else pa.large_binary())
        found = [hashlib.sha256(x.as_buffer().to_pybytes().translate(None, _BLANKS)).digest() for x in raw]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.utf8_length(text).cast(pa.int64()), pa.array(found, pa.binary()), batch.column(2)],
            ["doc_id", "n", "digest", "rid"],
        )


def _summaries(counters: int):
    """Misra-Gries over the batches of one partition; emits at most ``counters`` rows."""

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                d = pair["values"].as_py()
                held[d] = held.get(d, 0) + pair["counts"].as_py()
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {d: n - cut for d, n in held.items() if n > cut}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """At most ``counters`` digests, among them each that fills more than 2/(counters+1) of the rows."""
    low = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, low long")
    top = low.groupBy("digest").agg(F.sum("low").alias("low")).filter("low > 1").orderBy(F.desc("low"), "digest").limit(counters)
    return [bytes(r[0]) for r in top.collect()]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after white space is deleted.  Of equal texts the
    longest original (in code points) stays, then the smallest id.  Null text is an
    empty text; null ids sort last; of rows that repeat the winner's id and length
    one stays.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = scratch.keep(rows.mapInArrow(tidy(_digests), f"doc_id {kind}, n long, digest binary, rid long"), "digests")
    best = F.min_by(F.struct("doc_id", "rid"), F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("rid")))
    hot = frequent_digests(digests, counters)
    wanted = spark.createDataFrame([(bytearray(d),) for d in hot], "digest binary")
    verified = digests.join(F.broadcast(wanted), "digest", "left_semi").groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("size"))
    # at most `counters` rows
    rows = [(bytearray(r["digest"]), r["w"]["doc_id"], r["w"]["rid"], r["size"]) for r in verified.collect()] if hot else []
    winners = spark.createDataFrame(rows, f"digest binary, keep_id {kind}, keep_rid long, group_size long")
    heavy = digests.join(F.broadcast(winners), "digest").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "digest")
    by = Window.partitionBy("digest")
    order = by.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), "rid")
    light = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumns({"r": F.row_number().over(order), "keep_id": F.first("doc_id").over(order)})
        .withColumn("group_size", F.count(F.lit(1)).over(by))
        .select("doc_id", "keep_id", "group_size", (F.col("r") == 1).alias("kept"), "digest")
    )
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Those that go are joined by their ids, so texts stay where they are.  Rows that repeat an id,
    a null one too, are settled by their texts as well: one of each text stays.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    settled = scratch.keep(exact_groups(docs, id_col, text_col, counters).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")))
    own = f"__{uuid.uuid4().hex[:12]}"  # no column of the documents is named so
    repeated = scratch.keep(settled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(own)))
    gone = scratch.keep(settled.filter("not kept").select(F.col("doc_id").alias(own)))
    n = repeated.count()
    if n == 0:
        side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return docs.join(side, docs[id_col].eqNullSafe(F.col(own)), "left_anti")
    digest = F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", ""), 256))
    kept = settled.filter("kept").select(F.col("doc_id").alias(own), F.col("digest").alias(f"{own}d")).distinct()
    found = docs.withColumn(f"{own}t", digest)
    found = found.join(kept, found[id_col].eqNullSafe(F.col(own)) & (F.col(f"{own}t") == F.col(f"{own}d")), "left_semi")
    w = Window.partitionBy(id_col, f"{own}t").orderBy(F.desc(F.length(text_col)))
    return found.withColumn(f"{own}r", F.row_number().over(w)).filter(F.col(f"{own}r") == 1).drop(f"{own}r", f"{own}t")
