"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = fit(docs.filter(_fold(4) != 2), "doc_id", "text", "lang")
    found = identify(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    model = fit(docs, labels.filter(_fold(5) != 0))
    found = score(docs, model, "doc_id", "text", held_out.alias("held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import passages

    return passages(table(spark, sf_dir, "documents"), holders=True)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_loss, read_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    out = format_conversations(rows.unionByName(extra))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key="a key of the run")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import fit, scan

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    found = encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_chat": op4_chat,
    "op5_secrets": op5_secrets,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
}

ORACLE: dict[str, str] = {
    "op4_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS head,
                   replace(replace(text, '\', '\\'), '<|', '<\|') AS e, replace(replace(role, '\', '\\'), '<|', '<\|') AS r
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(length(e) + CASE WHEN head THEN length(r) + 24 ELSE 8 END) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op6_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM r WHERE r.a = n.doc_id) AS component_id FROM n
    """,
    "op9_decontamination": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        d AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM t),
        i AS (SELECT item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM b WHERE len(w) >= 1),
        ds AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 5) OVER o AS x5, lead(x, 6) OVER o AS x6, lead(x, 7) OVER o AS x7
               FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        js AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 5) OVER o AS x5, lead(x, 6) OVER o AS x6, lead(x, 7) OVER o AS x7
               FROM i WINDOW o AS (PARTITION BY item_id ORDER BY p)),
        l AS (SELECT doc_id, item_id, ds.p - js.p AS line FROM ds JOIN js ON n >= 8 AND ds.x = js.x AND ds.x1 = js.x1 AND ds.x3 = js.x3 AND ds.x5 = js.x5 AND ds.x6 = js.x6
              UNION SELECT doc_id, item_id, ds.p - js.p FROM ds JOIN js ON n >= 8 AND ds.x = js.x AND ds.x1 = js.x1 AND ds.x2 = js.x2 AND ds.x5 = js.x5 AND ds.x7 = js.x7
              UNION SELECT doc_id, item_id, ds.p - js.p FROM ds JOIN js ON n >= 8 AND n < 12 AND ds.x = js.x AND ds.x1 = js.x1 AND ds.x2 = js.x2
              UNION SELECT doc_id, item_id, d.p - i.p FROM d JOIN i ON n < 8 AND d.x = i.x GROUP BY doc_id, item_id, d.p - i.p HAVING count(*) = max(n)),
        m AS (SELECT l.doc_id, l.item_id, count(DISTINCT i.p) AS matched, max(n) AS item_words FROM l JOIN i ON i.item_id = l.item_id
              JOIN d ON d.doc_id = l.doc_id AND d.p = l.line + i.p AND d.x = i.x GROUP BY ALL)
        SELECT doc_id, item_id, matched, item_words, matched / item_words AS share FROM m WHERE matched / item_words >= 0.8
    """,
}
