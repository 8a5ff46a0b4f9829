"""Fuzzy repeated passages by collinear chaining.

Words under a spaced mask at every position are seeds.  Seeds of a pack of texts meet there
first; those of each seed's first holder go on to buckets of equal hash prefixes, where
holders of all packs meet, so a passage shared by many documents costs one or two matches a
holder, and a seed that most documents hold takes one row a pack.  Matches of a pair of
documents are chained in order, with gap costs, through a Fenwick tree of prefix maxima;
chains are aligned word by word, and aligned stretches that touch are merged into the
passages of a document that also stand elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, mix, slices, tidy, varlen
from .runtime import Scratch, ship

#: Positions of a seed that count (1) and that are ignored (0): every fifth word may differ anywhere.
MASK = "1101011"
#: Score of a match, and words on either side of a chain that are aligned first.
K, PAD = 6, 62
#: Seeds of the shortest chain.  Passages of 50 words with 80 % of them equal share about 14.
LINKS = 2
#: Bits of a hash that name the buckets of one level, bytes of text whose seeds are packed together, and bytes of text (about) for a bucket.
LEVEL_BITS, PACK, BUCKET = 12, 1 << 22, 1 << 22
#: Matches within a pack that make one row: about a kilobyte, as rows of seeds, which bounds the batches that workers get.
ROW_MATCHES = 128
#: Words of the shortest passage, of the shortest stretch that may be part of one, and between stretches that touch.
LEAST, PIECE, TOUCH = 50, 17, 2
#: Cost of a word skipped on either side of a chain, and matching share of an aligned stretch.
GAP, SHARE = 0.1, 0.8
#: Ids up to this count are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _narrow(x: np.ndarray) -> tuple[int, bytes, int]:
    """The least of some integers, their distances from it in the fewest bytes, and that width."""
    low = int(x.min())
    x = x - low
    kind = np.min_scalar_type(int(x.max()))
    return low, x.astype(kind).tobytes(), kind.itemsize


def _wide(low: int, raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype(np.int64) + low


SEED_ROW = "bucket long, h binary, doc_low long, doc binary, doc_width int, at_low long, at binary, at_width int"
_SEED_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
_SEED_NAMES = [x.split()[0] for x in SEED_ROW.split(", ")]
MATCH_ROW = "doc_id long, other_id long, at int, other_at int"


def _seed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_SEED_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEED_KINDS, strict=True)], _SEED_NAMES)


def _by_bucket(bucket: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple]:
    """One packed row for each bucket: the last 48 bits of the hashes, documents and places."""
    order = np.argsort(bucket, kind="stable")
    bucket, raw, doc, at = bucket[order], np.ascontiguousarray(h[order]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], doc[order], at[order]
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    begin, rows = 0, []
    for end in ends.tolist() if len(bucket) else []:
        rows.append((int(bucket[begin]), raw[begin:end].tobytes(), *_narrow(doc[begin:end]), *_narrow(at[begin:end])))
        begin = end
    return rows


def _open(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and places of packed rows."""
    raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 6)
    h = np.zeros((len(raw), 8), np.uint8)
    h[:, :6] = raw
    return h.view("<u8").ravel(), np.concatenate([_wide(*r[1:4]) for r in rows]), np.concatenate([_wide(*r[4:7]) for r in rows])


def _sorted(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((at, doc)) if len(doc) and (np.diff(doc) < 0).any() else None
    if order is not None:
        h, doc, at = h[order], doc[order], at[order]
    order = np.argsort(h, kind="stable")
    return h[order], doc[order], at[order]


def _meet(h: np.ndarray, doc: np.ndarray, at: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches, as indices (here, there), of seeds sorted by hash, document and place; and which are of their first holder.

    Each place of a seed meets its first place in the first document that holds it.  With
    ``own``, a place also meets the first one in its own document, unless the seed stood less
    than a passage before it: there a short period goes on, which is no repeat.
    """
    n = len(h)
    new_h = np.ones(n, bool)
    new_h[1:] = h[1:] != h[:-1]
    holder = np.maximum.accumulate(np.where(new_h, np.arange(n), 0))
    new_doc = new_h.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = new_doc[1:] | (at[1:] != at[:-1])
    held = doc == doc[holder]
    here, there = np.flatnonzero(fresh & ~held), holder[fresh & ~held]
    if own:
        first = np.maximum.accumulate(np.where(new_doc, np.arange(n), 0))
        again = np.zeros(n, bool)
        again[1:] = ~new_doc[1:] & (at[1:] - at[:-1] >= LEAST)
        here, there = np.append(here, np.flatnonzero(again)), np.append(there, first[again])
    return here, there, held & fresh


def _pack(parts: list[tuple]) -> pa.RecordBatch:
    """Seeds of some texts: those of first holders by bucket, and matches among them under negative buckets."""
    h, doc, at = _sorted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    here, there, held = _meet(h, doc, at, True)
    rows = _by_bucket((h[held] >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), h[held], doc[held], at[held])
    for k in range(0, len(here), ROW_MATCHES):
        x = np.append(here[k : k + ROW_MATCHES], there[k : k + ROW_MATCHES])
        rows.append((-1 - int(doc[x[0]] & 0xFFFF), b"", *_narrow(doc[x]), *_narrow(at[x])))
    return _seed_batch(rows)


def _seeds(batches):
    """Texts to packed seeds, a pack of about ``PACK`` bytes of text at a time."""
    marks = [i for i, c in enumerate(MASK) if c == "1"]
    parts, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for s in slices(batch.column(1)):
            w = Words(s)
            words, n = w.hashes(), len(w.doc) - len(MASK) + 1
            first = np.flatnonzero(w.doc[:n] == w.doc[len(MASK) - 1 :]) if n > 0 else []
            if not len(first):
                continue
            h = np.zeros(len(first), np.uint64)
            for j in marks:
                h = h * np.uint64(0xD6E8FEB86659FD93) + words[first + j]
            parts.append((mix(h + np.uint64(len(MASK))), ids[s.first + w.doc[first]].astype(np.int64), first - w.bounds[w.doc[first]]))
            size += len(s.data)
            if size >= PACK:
                yield _pack(parts)
                parts, size = [], 0
    if parts:
        yield _pack(parts)


def _groups(batches, most: int | None = None):
    """Packed rows, sorted by bucket, as (bucket, rows): all of a bucket, or portions of about ``most`` bytes of hashes."""
    key, rows, size = None, [], 0
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            bucket, *row = (c[k].as_py() for c in columns)
            if rows and (bucket != key or bucket < 0 or (most is not None and size >= most)):
                yield key, rows
                rows, size = [], 0
            key = bucket
            rows.append(row)
            size += len(row[0])
    if rows:
        yield key, rows


def _finer(batches):
    """Seeds of buckets to buckets of the next bits of their hashes."""
    for bucket, rows in _groups(batches, PACK):
        if bucket < 0:
            yield _seed_batch([(bucket, *r) for r in rows])
            continue
        h, doc, at = _open(rows)
        yield _seed_batch(_by_bucket((bucket << LEVEL_BITS) + (h >> np.uint64(48 - LEVEL_BITS)).astype(np.int64), h, doc, at))


def _matches(batches):
    """Packed rows, sorted by bucket, to matches ``doc_id, other_id, at, other_at``."""
    for bucket, rows in _groups(batches):
        h, doc, at = _open(rows)
        if bucket < 0:
            here, there = np.split(np.arange(len(doc)), 2)
        else:
            order = np.argsort(h, kind="stable")
            twin = np.zeros(len(h) + 1, bool)
            twin[1:-1] = h[order][1:] == h[order][:-1]
            keep = order[twin[1:] | twin[:-1]]
            h, doc, at = h[keep], doc[keep], at[keep]
            order = np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            here, there, _ = _meet(h, doc, at, False)
        if len(here):
            yield pa.RecordBatch.from_arrays([pa.array(doc[here]), pa.array(doc[there]), pa.array(at[here].astype(np.int32)), pa.array(at[there].astype(np.int32))], ["doc_id", "other_id", "at", "other_at"])


class PrefixMax:
    """A Fenwick tree of maxima over the prefixes of n places."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        best, i, n = self.best, i + 1, len(self.best)
        while i < n:
            if best[i][0] < value:
                best[i] = (value, who)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """The largest value at a place below i, and whose it is."""
        best, found = self.best, (float("-inf"), -1)
        while i > 0:
            if best[i][0] > found[0]:
                found = best[i]
            i -= i & -i
        return found


def chains(a: list[int], b: list[int], gap: float = GAP) -> list[list[int]]:
    """Disjoint chains of matches (a[i], b[i]) that rise in both, best first, as lists of indices.

    A match scores K; a step costs ``gap`` for each word that it moves beyond a seed's
    own on either side; a chain starts anew where that beats going on.
    """
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    places = {y: r for r, y in enumerate(sorted(set(b)))}
    tree = PrefixMax(len(places))
    score, back = [0.0] * len(a), [-1] * len(a)
    waiting: list[int] = []
    for n, i in enumerate(order):
        while waiting and a[waiting[0]] < a[i]:
            j = waiting.pop(0)
            tree.put(places[b[j]], score[j] + gap * (a[j] + b[j]), j)
        value, j = tree.upto(places[b[i]])
        value -= gap * (a[i] + b[i])
        if j >= 0 and value > 0:
            score[i], back[i] = K + value, j
        else:
            score[i] = K
        waiting.append(i)
    taken, out = [False] * len(a), []
    for i in sorted(range(len(a)), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matches that stand for a run of one word, whose only seed meets only one place: every ``PIECE``-th of each run."""
    order = np.lexsort((a, b))
    x, y = a[order], b[order]
    on = np.zeros(len(x) + 1, bool)
    on[1:-1] = (y[1:] == y[:-1]) & (x[1:] - x[:-1] == 1)
    begin = np.maximum.accumulate(np.where(on[:-1], 0, np.arange(len(x))))
    out = np.zeros(len(x), bool)
    out[order] = (on[:-1] | on[1:]) & ((np.arange(len(x)) - begin) % PIECE == 0)
    return out


PATHS = "paths array<struct<at:array<int>,other_at:array<int>>>"


def _chain_rows(batches):
    """Matches, sorted by pair and place, to one row a pair with its chains of at least ``LINKS`` matches, longest first."""
    key, held = None, []

    def paths(a: np.ndarray, b: np.ndarray) -> list[dict]:
        if len(a) < LINKS:
            return []
        if (a - b == a[0] - b[0]).all() and (np.diff(a) > 0).all() and (np.diff(a) * 2 * GAP < K).all():
            return [{"at": a.tolist(), "other_at": b.tolist()}]  # on one diagonal, where each match pays for its step: one chain of all
        x, y = a.tolist(), b.tolist()
        run = _runs(a, b)
        found = [path for path in chains(x, y) if len(path) >= LINKS or run[path[0]]]
        return [{"at": [x[i] for i in path], "other_at": [y[i] for i in path]} for path in sorted(found, key=lambda p: (-len(p), x[p[0]], y[p[0]]))]

    def flush(out: list[tuple]) -> None:
        if got := paths(*(np.concatenate(c) for c in zip(*held, strict=True))):
            out.append((*key, got))
        held.clear()

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        lists = pa.list_(pa.int32())
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("at", lists), ("other_at", lists)])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "other_id", "paths"])

    for batch in batches:
        if not batch.num_rows:
            continue
        d, o, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        ends = np.append(np.flatnonzero((d[1:] != d[:-1]) | (o[1:] != o[:-1])) + 1, len(d)).tolist()
        begin, out = 0, []
        for end in ends:
            if held and (int(d[begin]), int(o[begin])) != key:
                flush(out)
            key = int(d[begin]), int(o[begin])
            held.append((a[begin:end].astype(np.int64), b[begin:end].astype(np.int64)))
            begin = end
        if out:
            yield batch_of(out)
    if held:
        flush(out := [])
        if out:
            yield batch_of(out)


def align(own: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, drop: int = 8) -> tuple[int, int, int, bool, bool]:
    """Begin, end and equal words of ``own`` along a chain of matches against ``other``, and whether it may go on at either side.

    Between matches on one diagonal words are compared in place; where the diagonal shifts,
    the words before the best switching point are compared on the old one and the rest on the
    new one.  Both ends are extended until mismatches cost more than ``drop``; where that is
    too short for a passage, or has too few equal words, the longest passage around it counts.
    """
    flags = []
    for x, y, x2, y2 in zip(a[:-1], b[:-1], a[1:], b[1:], strict=True):
        n = x2 - x
        old = own[x:x2] == _cut(other, y, n)
        if y2 - y != n:
            new = own[x:x2] == _cut(other, y2 - n, n)
            before = np.concatenate([[0], np.cumsum(old)])
            behind = np.concatenate([[0], np.cumsum(new[::-1])])[::-1]
            k = int((before + behind).argmax())
            old = np.concatenate([old[:k], new[k:]])
        flags.append(old)
    n = min(len(own) - a[-1], len(other) - b[-1])
    after = own[a[-1] : a[-1] + n] == other[b[-1] : b[-1] + n]
    right, more_right = _extend(after, drop)
    n = min(a[0], b[0])
    before = own[a[0] - n : a[0]] == other[b[0] - n : b[0]]
    left, more_left = _extend(before[::-1], drop)
    total = np.concatenate([[0], np.cumsum(np.concatenate([before, *flags, after]))])
    lo, hi = int(n - left), int(n + a[-1] - a[0] + right)
    if hi - lo < LEAST or total[hi] - total[lo] < SHARE * (hi - lo):
        lo, hi = _window(total, max(0, lo - LEAST), min(len(total) - 1, hi + LEAST)) or (lo, hi)
    return lo + int(a[0] - n), hi + int(a[0] - n), int(total[hi] - total[lo]), more_left, more_right


def _window(total: np.ndarray, lo: int, hi: int) -> tuple[int, int] | None:
    """The longest range of ``LEAST`` words or more within ``[lo, hi)`` of which ``SHARE`` are equal, from counts of equal words before each place."""
    worth = total[lo : hi + 1] * 100 - round(SHARE * 100) * np.arange(hi + 1 - lo)
    best = np.maximum.accumulate(worth[::-1])[::-1]  # falls, so the last place that is worth as much as a beginning is found by bisection
    ends = len(best) - 1 - np.searchsorted(best[::-1], worth, "left")
    i = int((ends - np.arange(len(ends))).argmax())
    i, j = lo + i, lo + int(ends[i])
    if j - i < LEAST:
        return None
    equal = np.flatnonzero(np.diff(total[i : j + 1])) + i
    return (int(equal[0]), int(equal[-1]) + 1) if equal[-1] + 1 - equal[0] >= LEAST else (i, j)


def _cut(x: np.ndarray, start: int, n: int) -> np.ndarray:
    """``x[start:start+n]``, with zeros where x has nothing."""
    out = np.zeros(n, x.dtype)
    lo, hi = max(start, 0), min(start + n, len(x))
    if lo < hi:
        out[lo - start : hi - start] = x[lo:hi]
    return out


def _extend(same: np.ndarray, drop: int) -> tuple[int, bool]:
    """How far equal words go, and whether more words might have been reached."""
    if not len(same):
        return 0, True
    score = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(top - score > drop)
    score = score[: stop[0]] if len(stop) else score
    if not len(score) or score.max() <= 0:
        return 0, not len(stop)
    return int(score.argmax()) + 1, not len(stop)


def _word_rows(batches):
    """32-bit hashes of the words of each text."""
    for batch in batches:
        for s in slices(batch.column(1)):
            w = Words(s)
            h = (w.hashes() & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), varlen(h, w.bounds)], ["doc_id", "words"])


STRETCH_ROW = "doc_id long, other_id long, begin long, end long, equal long, other_begin long"
_STRETCH_NAMES = [x.split()[0] for x in STRETCH_ROW.split(", ")]


def _aligned(paths: list[dict], own: np.ndarray, other: np.ndarray, base: int, obase: int, n: int, m: int):
    """Stretches ``(begin, end, equal, other_begin)`` of a pair, and the chains for which these words do not suffice.

    ``own`` and ``other`` are words from ``base`` and ``obase`` on, of texts of ``n`` and ``m``
    words.  A chain well inside an earlier, longer one's stretch adds nothing.
    """
    known, rows, longer = [], [], []
    for path in paths:
        a, b = np.array(path["at"]) - base, np.array(path["other_at"]) - obase
        if a[-1] >= len(own) or b[-1] >= len(other) or any(lo <= a[0] and a[-1] + PIECE <= hi for lo, hi in known):
            continue
        begin, end, equal, left, right = align(own, other, a, b)
        u, v = len(own) - a[-1], len(other) - b[-1]
        left &= base > 0 if a[0] < b[0] else obase > 0 if b[0] < a[0] else base > 0 and obase > 0
        right &= base + len(own) < n if u < v else obase + len(other) < m if v < u else base + len(own) < n and obase + len(other) < m
        if left or right:
            longer.append(path)
        elif end - begin >= PIECE and equal >= SHARE * (end - begin):
            known.append((begin, end))
            rows.append((base + begin, base + end, equal, obase + int(b[0] - a[0]) + begin))
    return rows, longer


def _stretches(batches):
    """Pairs with the words around their chains, to aligned stretches, and chains left for whole texts, to themselves."""
    names = ("doc_id", "other_id", "paths", "base", "other_base", "own", "other", "own_words", "other_words")
    lists = pa.list_(pa.int32())
    for batch in batches:
        rows = []
        columns = [batch.column(x) for x in names]
        for k in range(batch.num_rows):
            d, o, paths, base, obase, own, other, n, m = (c[k].as_py() for c in columns)
            found, longer = _aligned(paths, np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4"), base, obase, n, m)
            rows += [(d, o, *r, None) for r in found]
            if longer:
                rows.append((d, o, None, None, None, None, longer))
        kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("at", lists), ("other_at", lists)]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*_STRETCH_NAMES, "paths"])


def _whole_stretches(batches):
    """Pairs of whole texts with their chains, to aligned stretches."""
    names = ("doc_id", "other_id", "paths", "own", "other")
    for batch in batches:
        rows = []
        columns = [batch.column(x) for x in names]
        for k in range(batch.num_rows):
            d, o, paths, own, other = (c[k].as_py() for c in columns)
            own, other = np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4")
            rows += [(d, o, *r) for r in _aligned(paths, own, other, 0, 0, len(own), len(other))[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], _STRETCH_NAMES)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, holders: bool = False) -> DataFrame:
    """``doc_id, begin, end, n_words, equal, other_ids``: passages of at least ``least`` words that stand elsewhere too.

    Positions count words (runs outside ``[\\x20\\x09-\\x0D]``, A-Z as a-z), ends are exclusive;
    ``other_ids`` are earlier documents (by id) that hold it or parts of it, ``equal`` the words
    found there; a passage that stands earlier in its own document has that id too.  The first
    holder's first place is in ``other_ids`` only; with ``holders`` it has rows too, whose
    ``other_ids`` are the least of the later documents that begin a stretch at each place.
    Words that go on with a period under 50 words are no repeat of themselves within a document.
    Null and empty texts and null ids have none; an id that repeats counts as one document, of
    which any text may match.  Ids are integers; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "chain")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = rows.mapInArrow(tidy(_seeds), SEED_ROW)
    for level in range(1, 4):
        packed = packed.repartition("bucket").sortWithinPartitions("bucket")
        if size <= BUCKET << (LEVEL_BITS * level):
            break
        packed = packed.mapInArrow(_finer, SEED_ROW)
    met = packed.mapInArrow(tidy(_matches), MATCH_ROW)
    met = met.repartition("doc_id", "other_id").sortWithinPartitions("doc_id", "other_id", "at", "other_at")
    linked = scratch.keep(met.mapInArrow(tidy(_chain_rows), "doc_id long, other_id long, " + PATHS), "chains")

    ids = scratch.keep(linked.select("doc_id").union(linked.select("other_id")).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        held = rows.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_word_rows, "doc_id long, words binary")
    else:
        held = rows.mapInArrow(_word_rows, "doc_id long, words binary").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    held = scratch.keep(held, "words")
    first = lambda name: F.greatest(F.lit(0), F.array_min(F.transform("paths", lambda p: p[name][0])) - PAD)
    last = lambda name: F.array_max(F.transform("paths", lambda p: F.element_at(p[name], -1))) + K + PAD
    cuts = linked.withColumns({"base": first("at"), "other_base": first("other_at"), "to": last("at"), "other_to": last("other_at")})
    cut = lambda words, base, to: F.substring(F.col(words), F.col(base) * 4 + 1, (F.col(to) - F.col(base)) * 4)
    both = cuts.join(held, "doc_id").withColumns({"own": cut("words", "base", "to"), "own_words": (F.octet_length("words") / 4).cast("int")}).drop("words", "to")
    right = held.select(F.col("doc_id").alias("other_id"), "words")
    both = both.join(right, "other_id").withColumns({"other": cut("words", "other_base", "other_to"), "other_words": (F.octet_length("words") / 4).cast("int")}).drop("words", "other_to")
    pieces = scratch.keep(both.mapInArrow(tidy(_stretches), STRETCH_ROW + ", " + PATHS), "stretches")
    # chains that go on beyond the words beside them, such as those of periodic passages, are aligned over whole texts
    long = pieces.filter("paths is not null").select("doc_id", "other_id", "paths")
    long = long.join(held.withColumnRenamed("words", "own"), "doc_id").join(right.withColumnRenamed("words", "other"), "other_id")
    aligned = pieces.filter("paths is null").drop("paths").unionByName(long.mapInArrow(_whole_stretches, STRETCH_ROW))
    aligned = scratch.keep(aligned, "aligned")
    scratch.drop(linked, ids, held, pieces)
    found = aligned.drop("other_begin")
    if holders:
        # of the stretches that begin at one place of a holder the longest stays, however many documents hold it
        longest = F.struct((F.col("other_begin") + F.col("end") - F.col("begin")).alias("end"), "equal")
        of = aligned.filter("doc_id <> other_id").groupBy(F.col("other_id").alias("doc_id"), F.col("other_begin").alias("begin")).agg(F.max(longest).alias("m"), F.min("doc_id").alias("other_id"))
        found = found.unionByName(of.select("doc_id", "other_id", "begin", "m.end", "m.equal"))
    # stretches of a document that touch or overlap make one passage; their number is bounded by its length
    of = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "other_id", "equal"))).alias("p"))
    start = "cast(array() as array<struct<begin:bigint,end:bigint,equal:bigint,ids:array<bigint>>>)"
    touch = f"size(acc) > 0 and x.begin <= element_at(acc, -1).end + {TOUCH}"
    grown = (
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, x.end),"
        " 'equal', greatest(element_at(acc, -1).equal, least(element_at(acc, -1).equal + x.equal, element_at(acc, -1).equal + greatest(x.end - element_at(acc, -1).end, 0))),"
        " 'ids', array_union(element_at(acc, -1).ids, array(x.other_id)))))"
    )
    fresh = "concat(acc, array(named_struct('begin', x.begin, 'end', x.end, 'equal', x.equal, 'ids', array(x.other_id))))"
    merged = of.select("doc_id", F.inline(F.expr(f"aggregate(p, {start}, (acc, x) -> if({touch}, {grown}, {fresh}))")))
    return merged.filter(F.col("end") - F.col("begin") >= least).select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "equal", F.sort_array("ids").alias("other_ids"))
