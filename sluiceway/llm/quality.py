"""A sparse rule ensemble for text quality.

Boosted shallow trees over text statistics give conjunctive rules, one for each path
from a root; lasso logistic regression weighs them, and the rules that keep a weight
are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import Words, distinct, shingles, slices, sums, tidy
from .runtime import ship

#: Statistics of a text; shares are of its bytes, letters, words or word triples.
STATS = ("words", "bytes", "word_bytes", "upper", "symbols", "digits", "wordless", "repeats", "variety", "line_words", "again", "runs")
#: Labelled rows used for fitting (about).
SAMPLE = 8000

_UPPER, _ALPHA, _DIGIT, _SYMBOL, _WORDISH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_ALPHA | _DIGIT)
_WORDISH |= _ALPHA | _DIGIT


def statistics(s) -> np.ndarray:
    """One row of STATS for each document of a slice; all zero for an empty text."""
    w = Words(s)
    h = w.hashes(fold=False)
    data, off, n = s.data, s.offsets, np.diff(w.bounds)
    size = np.diff(off)
    inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    share = lambda a, b: a / np.maximum(b, 1)
    wordish = np.concatenate([[0], np.cumsum(_WORDISH[data])])
    wordless = wordish[w.end] == wordish[w.start]
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    _, own = distinct(h, w.doc)
    triples, of, _ = shingles(w, h, 3, False)
    _, once = distinct(triples, of)
    all3, few3 = np.bincount(of, minlength=len(s)), np.bincount(once, minlength=len(s))
    twice = np.zeros(len(data), bool)
    if len(data) > 1:
        twice[1:] = (data[1:] == data[:-1]) & _SYMBOL[data[1:]]
    return np.column_stack([
        n, size, share(sums(w.end - w.start, w.bounds), n), share(inside(_UPPER[data]), inside(_ALPHA[data])), share(inside(_SYMBOL[data]), size),
        share(inside(_DIGIT[data]), size), share(sums(wordless.astype(np.int64), w.bounds), n), share(sums(same.astype(np.int64), w.bounds), n),
        share(np.bincount(own, minlength=len(s)), n), share(n, inside(data == 10) + 1), share(all3 - few3, all3), share(inside(twice), size),
    ]).astype(float)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """``doc_id``, ``extra`` columns and STATS (as ``stat_<name>``), one row per input row; null text counts as empty."""
    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *extra)
    return _add_statistics(rows, rows.columns[1:])


def _add_statistics(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of rows whose first column is the text, and STATS."""
    ship(rows.sparkSession)
    places = [rows.columns.index(c) for c in kept]
    names = [*kept, *(f"stat_{x}" for x in STATS)]

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(0)):
                found = statistics(s)
                rest = [batch.column(i).slice(s.first, len(s)) for i in places]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(STATS)))], names)

    fields = [rows.schema.fields[i] for i in places]
    return rows.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"stat_{x} double" for x in STATS]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold), all of which hold


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one regression tree; leaf means go to ``out``, each node's path to ``rules``."""
    if path:
        rules.append(path)
    y = target[rows]
    best = (1e-9, 0, 0)
    if depth and len(rows) >= 40:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = bins[rows, f]
            count, total = np.bincount(b, minlength=len(cut) + 1), np.bincount(b, y, len(cut) + 1)
            nl, sl = np.cumsum(count)[:-1], np.cumsum(total)[:-1]
            nr, sr = len(rows) - nl, y.sum() - sl
            gain = np.where((nl >= 15) & (nr >= 15), sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - y.sum() ** 2 / len(rows), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[0] <= 1e-9:
        out[rows] = y.mean() if len(y) else 0
        return
    _, f, k = best
    low = bins[rows, f] <= k
    for part, above in ((rows[low], False), (rows[~low], True)):
        _tree(bins, cuts, target, part, depth - 1, (*path, (f, above, float(cuts[f][k]))), rules, out)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, t in rule:
        ok &= (x[:, f] > t) == above
    return ok


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3, rounds: int = 250, seed: int = 7) -> tuple[float, list[tuple[float, Rule]]]:
    """Bias and weighted rules of a lasso logistic regression on tree paths."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = math.log(mean / (1 - mean))
    if len(y) < 50 or y.min() == y.max():
        return bias, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rng = np.random.default_rng(seed)
    score, rules = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(50, len(y) // 2), replace=False))
        grown: list[Rule] = []
        out = np.zeros(len(y))
        _tree(bins, cuts, (y - p) / max(float((p * (1 - p)).mean()), 1e-3), rows, depth, (), grown, out)
        leaves = [r for r in grown if not any(len(q) > len(r) and q[: len(r)] == r for q in grown)]
        for r in leaves:
            ok = _holds(x, r)
            used = ok[rows]
            if used.any():
                score[ok] += 0.2 * out[rows][used].mean()
        rules += grown
    rules = list(dict.fromkeys(rules))
    a = np.column_stack([_holds(x, r) for r in rules]).astype(np.float32)
    spread = a.std(0)
    keep = spread > 0.02
    rules, a, spread = [r for r, k in zip(rules, keep, strict=True) if k], a[:, keep], spread[keep]
    center = a.mean(0)
    a -= center
    a /= spread
    n, y = len(y), y.astype(np.float32)
    power = np.ones(a.shape[1], np.float32)
    for _ in range(30):
        power = a.T @ (a @ power)
        power /= np.linalg.norm(power) or 1
    step = 1 / (0.25 * max(float(power @ (a.T @ (a @ power))) / n, 1e-6) + 0.25)
    w = z = np.zeros(a.shape[1], np.float32)
    b = bz = bias
    t = 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(a @ z + np.float32(bz)))) - y
        w2 = z - np.float32(step / n) * (a.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - np.float32(step * penalty), 0)
        b2 = bz - step * float(r.mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, bz = w2 + np.float32((t - 1) / t2) * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    real = w / spread
    return float(b - (real * center).sum()), [(float(v), r) for v, r in zip(real, rules, strict=True) if abs(v) > 1e-6]


def compile_rules(bias: float, rules: list[tuple[float, Rule]]) -> Column:
    """The score as a column over ``stat_*`` columns: 0 to 1, higher if label 1 is likelier."""
    terms = [F.lit(bias)]
    for weight, rule in rules:
        holds = None
        for f, above, t in rule:
            c = F.col(f"stat_{STATS[f]}")
            one = c > F.lit(t) if above else c <= F.lit(t)
            holds = one if holds is None else holds & one
        terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return 1 / (1 + F.exp(-terms[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[float, list[tuple[float, Rule]]]:
    """Rules learnt from about ``sample`` labelled documents; which ones depends on a hash of the id alone.

    Labels that are null or contradict each other for an id are left out.  Without
    labels the score is 0.5 everywhere.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("doc_id", "y")
    there = marks.count()
    if not there:
        return 0.0, []
    u = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = marks.filter(u < sample / there)  # about `sample` rows
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")
    got = with_statistics(chosen, "doc_id", "text", F.col("y")).toArrow()
    if not len(got):
        return 0.0, []
    x = np.column_stack([got.column(f"stat_{n}").to_numpy() for n in STATS])
    return fit_rules(x, got.column("y").to_numpy())


def score(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]], id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """``doc_id, score`` and ``extra`` columns, one row per input row; null text counts as empty."""
    found = with_statistics(docs, id_col, text_col, *extra)
    kept = [c for c in found.columns if not c.startswith("stat_")]
    return found.select(*kept, compile_rules(*model).alias("score"))


def keep_good(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]], least: float, text_col: str = "text") -> DataFrame:
    """The rows that score ``least`` or more, with all their columns; the text passes through the statistics once."""
    inner = [f"__{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    first = [at, *(i for i in range(len(inner)) if i != at)]
    rows = docs.toDF(*inner).select(*(inner[i] for i in first))
    found = _add_statistics(rows, rows.columns).filter(compile_rules(*model) >= least)
    return found.select(*(F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True)))
