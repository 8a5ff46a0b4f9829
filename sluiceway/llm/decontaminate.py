"""Benchmark decontamination with spaced-seed hashing, in DataFrame operations only.

Fixed masks over word positions are hashed at every position of tests and documents;
equal hashes name an alignment of a test with a document.  Each alignment is verified
word by word, so substituted words inside and between seeds are tolerated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

#: Positions that count (1) and that are ignored (0): five words each.
MASKS = ("1101011", "11100101")
#: Tests of fewer words than this have one more mask: with a fifth of their words changed three in a row are left.
FEW_WORDS, FEW_MASK = 12, "111"
#: Share of a test's words that must be found on its alignments.
SHARE = 0.8
#: Words of a window of a test, and how many of them at their place make an excerpt.
WINDOW, WINDOW_EQUAL = 13, 11
#: Ids and tests up to these counts are broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_TESTS = 200_000, 20_000


def words(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``, A-Z as a-z; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def _masks(n: int) -> dict[int, str]:
    """Masks of a test of n words, by their numbers; tests shorter than the longest mask have one that takes all words."""
    if n < max(len(m) for m in MASKS):
        return {len(MASKS) + 1 + n: "1" * n}
    return dict(enumerate((*MASKS, FEW_MASK) if n < FEW_WORDS else MASKS))


def _seeds(w: str, masks: dict[int, str], n: str | None = None) -> Column:
    """Position and hash of masks everywhere in the array of word hashes ``w``, as an array of structs; ``n`` keeps a test's own masks."""
    parts = []
    for k, mask in sorted(masks.items()):
        at = [i for i, c in enumerate(mask) if c == "1"]
        hashed = ", ".join(f"get({w}, i + {j})" for j in at)
        own = "" if n is None else f" and {n} in ({', '.join(str(x) for x in range(1, FEW_WORDS + 1) if k in _masks(x))})"
        parts.append(f"if(size({w}) >= {len(mask)}{own}, transform(sequence(0, size({w}) - {len(mask)}), i -> named_struct('at', i, 'h', xxhash64({k}, {hashed}))), array())")
    return F.expr(f"concat({', '.join(parts)})") if parts else F.expr("cast(array() as array<struct<at:int,h:bigint>>)")


def _seed_rows(rows: DataFrame, key: str, masks: dict[int, str], own: bool = False) -> DataFrame:
    hashed = rows.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("w"), F.least(F.size("w"), F.lit(FEW_WORDS)).alias("n"))
    return hashed.select(key, F.inline(_seeds("w", masks, "n" if own else None)))


def overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, excerpts: bool = False, short: bool = False) -> DataFrame:
    """``doc_id, item_id, matched, item_words, share``: the documents that hold a test and the tests that each holds.

    A document holds a test if at least ``share`` of the test's words stand at their place
    on alignments that a seed found.  Null or empty texts and null ids hold nothing and are held
    by nothing, nor are tests shorter than the longest mask; with ``short`` these are held where
    all their words stand in a row.  Repeated rows give one pair; other columns are not read.

    With ``excerpts`` a document also holds a test if ``WINDOW_EQUAL`` of ``WINDOW`` words in a row
    stand at their place on one such alignment, and a column ``excerpt`` has the most equal words
    of a window.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tests")
    span = max(len(m) for m in MASKS)
    least = F.lit(1 if short else span)
    items = scratch.keep(tests.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).filter(F.col("item_id").isNotNull() & (F.size("w") >= least)).distinct())
    sizes = items.groupBy(F.least(F.size("w"), F.lit(FEW_WORDS)).alias("n")).count().collect()  # at most FEW_WORDS rows
    n_items = sum(r["count"] for r in sizes)
    masks = {k: m for r in sizes for k, m in _masks(r["n"]).items()}
    small = (lambda df: F.broadcast(df)) if n_items <= BROADCAST_TESTS else (lambda df: df)
    wanted = _seed_rows(items, "item_id", masks, True).select("item_id", F.col("at").alias("item_at"), "h")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    found = _seed_rows(texts.select("doc_id", words(F.col("text")).alias("w")), "doc_id", masks).join(small(wanted), "h")
    lines = scratch.keep(found.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("line")).agg(F.count(F.lit(1)).alias("seeds")))
    ids = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select("doc_id")
    held = texts.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("dw"))
    by = lines.groupBy("doc_id", "item_id").agg(F.collect_set("line").alias("at"))
    pairs = by.join(small(items), "item_id").join(held, "doc_id")
    same = F.expr("size(filter(sequence(0, size(w) - 1), k -> exists(at, d -> d + k >= 0 and get(dw, d + k) = w[k])))")
    size = F.size("w").cast("long")
    enough = (F.col("share") >= share) & ((F.col("item_words") >= span) | (F.col("matched") == F.col("item_words")))
    if not excerpts:
        out = pairs.select("doc_id", "item_id", same.cast("long").alias("matched"), size.alias("item_words"))
        out = out.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))
        return out.withColumn("share", F.col("matched") / F.col("item_words")).filter(enough)
    window = f"size(filter(sequence(s, least(s + {WINDOW}, size(w)) - 1), k -> d + k >= 0 and get(dw, d + k) = w[k]))"
    most = F.expr(f"array_max(transform(at, d -> array_max(transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), s -> {window}))))")
    out = pairs.select("doc_id", "item_id", same.cast("long").alias("matched"), size.alias("item_words"), most.cast("long").alias("excerpt"))
    out = out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("matched", "item_words", "excerpt")))
    return out.withColumn("share", F.col("matched") / F.col("item_words")).filter(enough | (F.col("excerpt") >= WINDOW_EQUAL))


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no test and no excerpt of one, with all their columns.

    Short tests count where all their words stand in a row.  A row without an id is told by its text.
    """
    spark = docs.sparkSession
    key = f"__key_{uuid.uuid4().hex[:12]}"
    by_text = F.concat(F.lit("t"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.withColumn(key, F.when(F.col(id_col).isNull(), by_text).otherwise(F.concat(F.lit("i"), F.col(id_col).cast("string"))))
    hit = overlaps(keyed, tests, key, text_col, excerpts=True, short=True, **options).select(F.col("doc_id").alias(key))
    hit = Scratch(spark, "held").keep(hit.distinct())
    side = F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit
    return keyed.join(side, key, "left_anti").drop(key)
