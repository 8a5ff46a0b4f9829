"""Repeated passages against a brute-force search over all diagonals of all pairs."""

import random

import numpy as np
import pytest

from sluiceway.llm import substrings as S


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shares_passage(a, b):
    """Whether 50 or more words of ``a`` lie on one diagonal with ``b`` with a share of 0.8 of them equal."""
    for shift in range(-len(b) + S.LEAST, len(a) - S.LEAST + 1):
        x, y = max(0, shift), max(0, -shift)
        n = min(len(a) - x, len(b) - y)
        same = np.concatenate([[0], np.cumsum([a[x + i] == b[y + i] for i in range(n)])])
        if same[-1] >= S.SHARE * S.LEAST and any((same[w:] - same[:-w] >= S.SHARE * w).any() for w in range(S.LEAST, n + 1)):
            return True
    return False


def found_pairs(spark, texts, **how):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r.doc_id, o) for r in S.passages(docs, **how).collect() for o in r.other_ids}


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_recall_by_rate_of_substitutions(spark, rate):
    """Of 150 pairs with a passage of 50 to 100 words, those that brute force finds are found; clean texts are left."""
    rng = random.Random(int(rate * 100))
    texts, pairs = [], 150
    for _ in range(pairs):
        shared = prose(rng, rng.randrange(50, 101))
        part = [f"x{rng.random()}" if rng.random() < rate else w for w in shared]
        texts += [prose(rng, 40) + shared + prose(rng, 40), prose(rng, 30) + part + prose(rng, 30)]
    clean = [prose(rng, 150) for _ in range(100)]
    found = found_pairs(spark, texts + clean)
    want = {(2 * i + 1, 2 * i) for i in range(pairs) if shares_passage(texts[2 * i + 1], texts[2 * i])}
    recall = len(found & want) / len(want)
    print(f"rate {rate}: {len(want)} by brute force, recall {recall:.3f}, beside them {len(found - want)}")
    assert recall >= 0.9 and all(a == b + 1 and b % 2 == 0 and a < 2 * pairs for a, b in found)


def test_groups_and_holders(spark):
    """Copies of passages in several documents: each holder has a row, the first one too, and the rest none."""
    rng = random.Random(5)
    passages = [prose(rng, 60) for _ in range(6)]
    texts, holds = [], {}
    for i in range(60):
        words = prose(rng, 80)
        if i % 2:
            k = rng.randrange(6)
            words[30:30] = [f"y{i}" if rng.random() < 0.05 else w for w in passages[k]]
            holds.setdefault(k, []).append(i)
        texts.append(words)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = S.passages(docs, holders=True).collect()
    want = {i for i, t in enumerate(texts) if any(j != i and shares_passage(t, u) for j, u in enumerate(texts))}
    assert {r.doc_id for r in out} == want == {i for of in holds.values() if len(of) > 1 for i in of}
    same = {frozenset(of) for of in holds.values()}
    assert all(any({r.doc_id, *r.other_ids} <= of for of in same) and abs(r.begin - 30) < 6 and abs(r.end - 90) < 6 for r in out)


def test_levels_and_packs_do_not_change_results(spark, monkeypatch):
    """Finer buckets, and packs of one text, give the same passages."""
    rng = random.Random(6)
    shared = prose(rng, 70)
    docs = spark.createDataFrame([(i, " ".join(prose(rng, 50) + (shared if i % 3 == 0 else []) + prose(rng, 20))) for i in range(30)], "doc_id long, text string").repartition(3)
    rows = lambda: sorted((r.doc_id, r.begin, r.end) for r in S.passages(docs, holders=True).collect())
    want = rows()
    assert len(want) == 10
    monkeypatch.setattr(S, "BUCKET", 1)
    monkeypatch.setattr(S, "LEVEL_BITS", 4)
    assert rows() == want


def test_chain_rows_equal_chains():
    """Pairs that are cut over batches, and the shortcut of one diagonal, give the chains of the Fenwick tree."""
    import pyarrow as pa

    rng = random.Random(7)
    pairs = {}
    for p in range(30):
        a = sorted(rng.sample(range(300), rng.randrange(2, 40)))
        pairs[(p, 0)] = [(x, x + 5) for x in a] if p % 2 else sorted({(x, rng.randrange(300)) for x in a})
    flat = [(d, o, x, y) for (d, o), pts in pairs.items() for x, y in pts]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat[i : i + 17]], t) for k, t in enumerate(kinds)], ["doc_id", "other_id", "at", "other_at"]) for i in range(0, len(flat), 17)]
    got = {(r["doc_id"], r["other_id"]): [(tuple(p["at"]), tuple(p["other_at"])) for p in r["paths"]] for b in S._chain_rows(iter(batches)) for r in b.to_pylist()}
    for key, pts in pairs.items():
        a, b = [x for x, _ in pts], [y for _, y in pts]
        want = {(tuple(a[i] for i in c), tuple(b[i] for i in c)) for c in S.chains(a, b) if len(c) >= S.LINKS}
        assert set(got.get(key, [])) == want
