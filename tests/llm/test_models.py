"""Fitted models against plain Python: n-grams and votes, text statistics, the field's paths, derivatives and held-out results."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from sluiceway.llm import kernel, language, quality, secrets


def one_slice(texts):
    return next(kernel.slices(pa.array(texts, pa.string())))


# --- 1 language -----------------------------------------------------------------------------
def plain_counts(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = np.zeros(language.SLOTS)
    for n in (2, 3):
        for i in range(len(raw) - n + 1):
            gram = n
            for b in raw[i : i + n]:
                gram = (gram << 8 | b) & 0xFFFFFFFF
            out[(gram * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    return out


def test_ngrams_and_votes_equal_plain_python(spark, data):
    texts = ["Der die und NICHT", "a", "", "é x", "the and of", "ab" * 50]
    assert np.array_equal(language.ngram_counts(one_slice(texts)), np.array([plain_counts(t) for t in texts]))
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    model = language.fit(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", "lang")
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.read.parquet(f"{data}/documents.parquet"), model).collect()}
    sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
    for d, t, _ in docs:
        if not t or not any(c.isalpha() for c in t):
            assert got[d] == "und"
            continue
        c = plain_counts(t)
        margin = (c / max(c.sum(), 1)).astype(np.float32) @ model.w + model.b
        k = len(model.families) if len(model.families) > 1 else 0
        family = max(range(k), key=lambda f: margin[f]) if k else 0
        votes = dict.fromkeys(model.members[family], 0.0)
        for j, (a, b) in enumerate(model.pairs):
            if a in votes:
                votes[a] += sure(margin[k + j])
                votes[b] += 1 - sure(margin[k + j])
        top = max(votes.values())
        assert top - votes[model.langs.index(got[d])] < 1e-4


def test_ties_of_languages_are_settled_alike(spark):
    """The same texts under two languages: every text gets the same one of them, whatever its row."""
    train = spark.createDataFrame([(i, "same words here " * 5, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = language.fit(train, "doc_id", "text", "lang")
    assert len({(r.lang_pred, r.score) for r in language.identify(train, model).collect()}) == 1


def test_many_short_texts_in_bounded_memory():
    """Counts of ten thousand short texts are made a few hundred rows at a time."""
    import tracemalloc

    texts = pa.array([f"text {i} of few words, no more" for i in range(10_000)])
    tracemalloc.start()
    rows = sum(len(language.ngram_counts(s)) for s in kernel.slices(texts, rows=language.ROWS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 100e6


# --- 2 quality ------------------------------------------------------------------------------
def plain_statistics(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    alpha = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    symbol = lambda b: 33 <= b < 127 and not alpha(b) and not digit(b)
    share = lambda a, b: a / max(b, 1)
    n, triples = len(words), list(zip(words, words[1:], words[2:], strict=False))
    return [
        n, len(raw), share(sum(map(len, words)), n), share(sum(65 <= b <= 90 for b in raw), sum(map(alpha, raw))), share(sum(map(symbol, raw)), len(raw)), share(sum(map(digit, raw)), len(raw)),
        share(sum(not any(alpha(b) or digit(b) for b in w) for w in words), n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(len(set(words)), n), share(n, raw.count(b"\n") + 1),
        share(len(triples) - len(set(triples)), len(triples)), share(sum(a == b and symbol(b) for a, b in zip(raw, raw[1:], strict=False)), len(raw)),
    ]


def test_statistics_equal_plain_python(spark, data):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["", " \n\t", "a", "A!! b?? 12 12 12", "é é é é\né é", "==== ----\n" * 5, "x " * 3000]
    got = np.concatenate([quality.statistics(s) for s in kernel.slices(pa.array(texts, pa.string()))])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


# --- 5 secrets ------------------------------------------------------------------------------
def small_field(seed, windows=3, length=4):
    rng = np.random.default_rng(seed)
    weight, move = rng.normal(0, 1, (secrets.FEATURES, 3)), rng.normal(0, 1, (3, 3))
    x = np.stack([rng.integers(0, n, (windows, length)) + a for n, a in zip(secrets.GROUPS, secrets.STARTS, strict=True)], 2).astype(np.int16)
    return weight, move, x, rng.integers(0, 3, (windows, length)).astype(np.int8)


def path_score(weight, move, x, path):
    return sum(weight[x[k], t].sum() for k, t in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))


def test_viterbi_equals_all_paths():
    for seed in range(20):
        weight, move, x, _ = small_field(seed, 1, 6)
        field = secrets.Field(weight, move)
        best = max(itertools.product(range(3), repeat=6), key=lambda p: path_score(weight, move, x[0], p))
        assert tuple(field.viterbi(weight[x].sum(2), False, False)[0]) == best


def test_gradient_equals_differences_of_all_paths():
    def loss(weight, move, x, y):
        out = 0.0
        for wx, wy in zip(x, y, strict=True):
            scores = [path_score(weight, move, wx, p) for p in itertools.product(range(3), repeat=len(wy))]
            out += np.logaddexp.reduce(scores) - path_score(weight, move, wx, wy)
        return out

    weight, move, x, y = small_field(1)
    found, g, gm = secrets.gradient(weight, move, x, y)
    assert abs(found - loss(weight, move, x, y)) < 1e-8
    for k, t in [(int(x[0, 0, 0]), 0), (int(x[1, 2, 5]), 1), (int(x[2, 3, 9]), 2)]:
        w = weight.copy()
        w[k, t] += 1e-5
        assert abs((loss(w, move, x, y) - found) / 1e-5 - g[k, t]) < 1e-3
    for a, b in itertools.product(range(3), repeat=2):
        m = move.copy()
        m[a, b] += 1e-5
        assert abs((loss(weight, m, x, y) - found) / 1e-5 - gm[a, b]) < 1e-3


def test_field_on_held_out_texts(spark, data):
    """Secrets that no base pattern finds, put into texts that the field has not seen, beside things that are none."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").filter("text is not null")
    field = secrets.fit(docs.filter("doc_id % 2 = 0"))
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(secrets._MIXED) for _ in range(n))
    told, rows = {}, []
    for r in docs.filter("doc_id % 2 = 1").collect():
        words = r.text.split(" ")
        secret = rng.choice([f"ghp_{some(36)}", f"sk_live_{some(24)}", some(40), some(24)])
        lead = "" if "_" in secret[:8] else "Authorization: Bearer " if len(secret) == 40 else "credentials "
        for k, x in enumerate([lead + secret, *(secrets._innocent(rng) for _ in range(4))]):
            words.insert(rng.randrange(len(words) + 1), x)
        rows.append((r.doc_id, " ".join(words)))
        told[r.doc_id] = secret
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    texts = dict(rows)
    added = [(d, texts[d][s.start : s.end]) for d, spans in out.items() for s in spans if s.kind == "crf"]
    right = sum(x in told[d] or told[d] in x for d, x in added)
    covered = sum(any(texts[d][s.start : s.end] in t or t in texts[d][s.start : s.end] for s in out[d]) for d, t in told.items())
    print(f"precision {right / max(len(added), 1):.3f} of {len(added)}, recall {covered / len(told):.3f} of {len(told)}")
    assert right >= 0.9 * len(added) and covered >= 0.9 * len(told)
