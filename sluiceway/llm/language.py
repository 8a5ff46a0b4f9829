"""Language identification by hierarchical discrimination.

A linear classifier over hashed byte n-grams picks the language family; within it,
one-versus-one linear support vector machines separate the languages.  Models are
fitted on the driver from a bounded sample of n-gram counts; whole texts are scored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import slices
from .runtime import ship

# Families of languages, by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
#: Hash slots of the n-grams, and labelled rows used for fitting (about; spread evenly over languages).
SLOTS, SAMPLE = 4096, 2000
UNKNOWN = "und"
#: Texts whose counts are held at once: SLOTS numbers each.
ROWS = 256

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def ngram_counts(s) -> np.ndarray:
    """Counts of hashed byte pairs and triples, A-Z as a-z: one row of SLOTS for each document of a slice."""
    d = _LOWER[s.data]
    out = np.zeros(len(s) * SLOTS)
    doc = np.repeat(np.arange(len(s)), np.diff(s.offsets))
    for n in (2, 3):
        if len(d) < n:
            continue
        gram = np.full(len(d) - n + 1, n, np.uint32)
        for k in range(n):
            gram = gram << np.uint32(8) | d[k : len(d) - n + 1 + k]
        slot = (gram * np.uint32(2654435761)) >> np.uint32(20)
        own = doc[: len(d) - n + 1]
        whole = own == doc[n - 1 :]
        out += np.bincount(own[whole] * SLOTS + slot[whole], minlength=len(out))
    return out.reshape(len(s), SLOTS)


def _letters(s) -> np.ndarray:
    """Whether each document of a slice has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[s.data])])
    found = np.diff(total[s.offsets]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in bytes(s.data[s.offsets[i] : s.offsets[i + 1]]).decode("utf-8", "replace"))
    return found


def _frequencies(counts: np.ndarray) -> np.ndarray:
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared-hinge machine; y is -1 or 1. Classes weigh the same."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    weight = weight.astype(x.dtype)
    step = 1 / (1 + 2 * c * float(weight.max()) * n * float((xb**2).sum(1).mean()))
    w = z = np.zeros(d + 1, x.dtype)
    y = y.astype(x.dtype)
    t = 1.0
    for _ in range(rounds):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (xb @ z))
        g = z - 2 * c * xb.T @ (weight * y * slack)
        g[-1] -= z[-1]
        w2 = z - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w2 + (t - 1) / t2 * (w2 - w)
        w, t = w2, t2
    return w[:-1], float(w[-1])


class LanguageModel:
    """Family machines (one versus the rest) and, within families, one-versus-one machines."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        of = {code: name for name, codes in FAMILIES.items() for code in codes}
        self.families = sorted({of.get(x, x) for x in self.langs})
        self.members = [[i for i, x in enumerate(self.langs) if of.get(x, x) == f] for f in self.families]
        x = _frequencies(counts)
        scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
        x = x * scale
        norm = np.sqrt((x**2).sum(1).mean()) or 1.0
        x = x / norm
        y = np.array([self.langs.index(v) for v in langs])
        family = np.array([next(k for k, m in enumerate(self.members) if v in m) for v in range(len(self.langs))])
        models = [linear_svm(x, np.where(family[y] == k, 1.0, -1.0)) for k in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = []
        for m in self.members:
            for a, b in combinations(m, 2):
                rows = (y == a) | (y == b)
                models.append(linear_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0)))
                self.pairs.append((a, b))
        self.w = np.array([w * scale / norm for w, _ in models]).T.astype(np.float32) if models else np.zeros((x.shape[1], 0), np.float32)
        self.b = np.array([b for _, b in models], np.float32)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1 for each row."""
        margin = _frequencies(counts).astype(np.float32) @ self.w + self.b
        sure = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
        n = len(counts)
        k = len(self.families) if len(self.families) > 1 else 0
        if k:
            p = sure[:, :k] / np.maximum(sure[:, :k].sum(1, keepdims=True), 1e-9)
            family = p.argmax(1)
            score = p[np.arange(n), family].astype(float)
        else:
            family, score = np.zeros(n, int), np.ones(n)
        best = np.zeros(n, int)
        for f, m in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(self.langs)))
            for j, (a, b) in enumerate(self.pairs):
                if a in m:
                    votes[:, a] += sure[rows, k + j]
                    votes[:, b] += 1 - sure[rows, k + j]
            inner = votes[:, m]
            pick = inner.argmax(1)
            best[rows] = np.array(m)[pick]
            if len(m) > 1:
                score[rows] *= inner[np.arange(len(rows)), pick] / (len(m) - 1)
        return best, score


def _encode(batches):
    for batch in batches:
        for s in slices(batch.column(1), rows=ROWS):
            counts = ngram_counts(s)
            raw = []
            for row in counts:
                at = np.flatnonzero(row)
                raw.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array(raw, pa.binary())], ["lang", "counts"])


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> LanguageModel | None:
    """A model of rows with a text and a language.

    It learns from about ``sample`` rows, as many of each language; which rows depends
    on a hash of the id alone.  None if there is no such row.
    """
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    there = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not there:
        return None
    each = max(1, sample // len(there))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(each / n)) for x, n in there.items()])
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.filter(u < share).select("lang", "text").mapInArrow(_encode, "lang string, counts binary").toArrow()
    x = np.zeros((len(got), SLOTS), np.float32)
    for i, raw in enumerate(got.column("counts").to_pylist()):
        n = len(raw) // 6
        x[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return LanguageModel(x, got.column("lang").to_pylist()) if len(got) else None


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``extra`` columns, one row per input row.

    ``und`` with score 0 for a text that is null, empty or has no letter, and for all
    texts if the model is None.  Ids may repeat or be null.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS floats a machine

    def run(batches):
        m = shared.value
        for batch in batches:
            for s in slices(batch.column(1), rows=ROWS):
                langs, score = np.full(len(s), UNKNOWN, object), np.zeros(len(s))
                known = np.flatnonzero(_letters(s)) if m is not None else []
                if len(known):
                    best, sure = m.predict(ngram_counts(s)[known])
                    langs[known] = np.array(m.langs, object)[best]
                    score[known] = sure
                rest = [batch.column(i).slice(s.first, len(s)) for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(score)], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [*(f.name for f in kept), "lang_pred", "score"]
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double")
