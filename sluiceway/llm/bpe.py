"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a block of texts are laid out as one symbol sequence, and every
mergeable pair is mapped to all its positions there.  Ranks that have positions are
applied in ascending order, each to its whole list; a merge puts the pairs that it
creates on the lists of their ranks.  This equals merging piece by piece because a
merge only ever creates pairs of higher rank, which is verified when a vocabulary loads.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import tidy, varlen
from .runtime import ship

#: How byte-level vocabularies split text before merging.
PIECES = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts whose code points are below 256, for Python's own matcher.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NARROW_PIECES = f" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pieces that a worker remembers, and code points of text whose pieces are indexed together.
REMEMBERED, BLOCK = 1 << 19, 1 << 20
#: Positions of a pair from which they are merged with array operations.
MANY = 24


class _Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, raw: bytes):
        import regex

        spec = json.loads(raw)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        stand_in, vocab = _alphabet(), spec["model"]["vocab"]
        self.first = np.zeros(256, np.int64)
        for ch, b in stand_in.items():
            self.first[b] = vocab[ch]
        self.ranks: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        born = {int(i): -1 for i in self.first}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if born.get(x, rank) >= rank or born.get(y, rank) >= rank:
                raise ValueError(f"merge {rank} uses a token that a later merge makes")
            born.setdefault(z, rank)
            self.ranks.setdefault(x << 20 | y, rank)
            self.left.append(x)
            self.right.append(y)
            self.made.append(z)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ranks = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order]
        tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            tokens[i] = bytes(stand_in[c] for c in token)
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens with options are not supported")
            tokens[t["id"]] = t["content"].encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.wide, self.narrow = regex.compile(PIECES).findall, re.compile(NARROW_PIECES).findall
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers({a: i for i, a in enumerate(self.added)})
        self.ids = np.array(list(self.added.values()), np.uint32)
        self.ends = np.arange(len(self.added) + 1)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces together and remember them under the next numbers."""
        if not pieces:
            return
        raw = [p.encode("utf-8", "replace") for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int32)
        n = len(sym)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[last] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[1:][last[:-1]] = -1
        lists: dict[int, list[int]] = {}
        active: list[int] = []
        index = self._index(lists, active)
        at = np.flatnonzero(~last)
        index(sym[at], sym[at + 1] if len(at) else sym[:0], at)
        one, two, three = memoryview(sym), memoryview(nxt), memoryview(prv)
        ranks, left, right, made = self.ranks, self.left, self.right, self.made
        while active:
            r = heapq.heappop(active)
            a, b, c = left[r], right[r], made[r]
            found = lists.pop(r)
            if len(found) >= MANY and a != b:
                i = np.unique(np.array(found, np.int32))
                j = nxt[i]
                ok = (sym[i] == a) & (j >= 0) & (sym[j] == b)
                i, j = i[ok], j[ok]
                sym[i], sym[j] = c, -1
                k = nxt[j]
                nxt[i] = k
                has = k >= 0
                k, after = k[has], i[has]
                prv[k] = after
                p = prv[i]
                p = p[p >= 0]
                index(np.concatenate([np.full(len(k), c), sym[p]]), np.concatenate([sym[k], np.full(len(p), c)]), np.concatenate([after, p]))
                continue
            found.sort()
            for i in found:
                j = two[i]
                if one[i] != a or j < 0 or one[j] != b:
                    continue
                one[i], one[j] = c, -1
                k, p = two[j], three[i]
                two[i] = k
                if k >= 0:
                    three[k] = i
                    q = ranks.get(c << 20 | one[k])
                    if q is not None:
                        if q in lists:
                            lists[q].append(i)
                        else:
                            lists[q] = [i]
                            heapq.heappush(active, q)
                if p >= 0:
                    q = ranks.get(one[p] << 20 | c)
                    if q is not None:
                        if q in lists:
                            lists[q].append(p)
                        else:
                            lists[q] = [p]
                            heapq.heappush(active, q)
        alive = sym >= 0
        upto = np.cumsum(alive)[ends - 1]
        self.ends = np.concatenate([self.ends, upto + self.ends[-1]])
        self.ids = np.concatenate([self.ids, sym[alive].astype(np.uint32)])

    def _index(self, lists: dict[int, list[int]], active: list[int]):
        """Puts positions on the lists of their pairs' ranks; a pair without a rank has no list."""

        def put(a, b, at):
            key = a.astype(np.int64) << 20 | b
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[where] == key
            at, rank = at[hit], self.key_ranks[where[hit]]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1, [len(rank)]])
            at, cut = at.tolist(), cuts.tolist()
            for q, x, y in zip(rank[cuts[:-1]].tolist(), cut, cut[1:]):
                if q in lists:
                    lists[q] += at[x:y]
                else:
                    lists[q] = at[x:y]
                    heapq.heappush(active, q)

        return put

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        number, added = self.numbers.__getitem__, self.added
        used = []
        for t in texts:
            if added and any(a in t for a in added):
                parts: list[str] = []
                for k, x in enumerate(self.split_added.split(t)):
                    parts += [x] if k % 2 else self.split(x)
            else:
                parts = self.split(t)
            used.append(np.fromiter(map(number, parts), np.int32, len(parts)))
        self.learn(list(itertools.islice(self.numbers, len(self.ends) - 1, None)))
        counts = np.array([len(x) for x in used], np.int64)
        flat = np.concatenate(used) if used else np.zeros(0, np.int32)
        ids, ends = _gather(self.ids, self.ends, flat)
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of id runs as UTF-8; byte runs that are no UTF-8 become U+FFFD."""
        raw, upto = _gather(self.token_bytes, self.token_ends, ids)
        upto = upto[ends].astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), len(upto) - 1, [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(raw.tobytes())])
        try:
            text.validate(full=True)
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in text.cast(pa.binary()).to_pylist()], pa.string())
        return text


def _gather(values: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[ends[i]:ends[i+1]]`` of all wanted i, one after another, and their ends."""
    start = ends[wanted]
    sizes = ends[wanted + 1] - start
    out = np.zeros(len(wanted) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return values[np.repeat(start - out[:-1], sizes) + np.arange(out[-1])], out


_LOADED: dict[str, ByteBpe] = {}


def _model(shared) -> ByteBpe:
    key, raw = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(raw)
    return _LOADED[key]


def _blocks(column: pa.Array, most: int = BLOCK):
    """Runs of rows of about ``most`` code points."""
    sizes = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = sizes[first - 1] if first else 0
        last = max(int(np.searchsorted(sizes, base + most, "right")), first + 1)
        yield first, last
        first = last


def _load(spark, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.md5(raw).hexdigest(), raw))  # a vocabulary file, a few MB


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens`` and, if asked for, ``decoded``, one row per input row.

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``decoded`` is the text
    decoded from them.  Null text counts as empty; an empty text has no ids.  Repeated
    rows and null ids pass through; other columns are not read.  ``path`` names a
    byte-level vocabulary in the JSON format of the tokenizers library; strings of its
    added tokens that occur in a text become those tokens, as that library has it.
    """
    ship(docs.sparkSession)
    shared = _load(docs.sparkSession, path)

    def run(batches):
        model = _model(shared)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in _blocks(texts):
                ids, ends = model.encode(texts.slice(a, b - a).to_pylist())
                for c, d in _blocks(texts.slice(a, b - a), BLOCK // 4):  # smaller batches go back
                    columns = [batch.column(0).slice(a + c, d - c), varlen(ids[ends[c] : ends[d]].astype("<u4"), ends[c : d + 1] - ends[c]), pa.array(np.diff(ends[c : d + 1]), pa.int64())]
                    if with_decoded:
                        columns.append(model.decode(ids[ends[c] : ends[d]], ends[c : d + 1] - ends[c]))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids binary, n_tokens long" + ", decoded string" * with_decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows that ``encode`` made; null ids give an empty text."""
    ship(encoded.sparkSession)
    shared = _load(encoded.sparkSession, path)

    def run(batches):
        model = _model(shared)
        for batch in batches:
            runs = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
            text = model.decode(np.concatenate(runs) if runs else np.zeros(0, np.uint32), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
