"""Secret scanning with a linear-chain conditional random field.

Fixed patterns give the base spans.  A conditional random field over white-space tokens
tags each as begin, inside or outside of a secret, from its shape, the words around it and
features of the file; Viterbi decoding adds the spans that the patterns miss.  It is fitted
on windows of a bounded sample of documents: base spans are its examples, and so are
made-up secrets of public formats that are put into the sampled texts.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Slice, Words, slices
from .runtime import ship

# The base patterns.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]+")
KINDS = ("assign", "access", "hex", "crf")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Documents sampled for fitting (about), windows taken from each at most, tokens in a window.
SAMPLE, WINDOWS, SPAN = 1500, 8, 15
OUT, BEGIN, INSIDE = 0, 1, 2
#: Shortest value that the field may add.
SHORTEST = 12


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """``start, kind, end, value start`` of the base spans of a UTF-8 text, in byte positions, sorted."""
    found = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(raw)]
    return sorted(found)


# --- features ------------------------------------------------------------------------
_CLASS = {n: np.zeros(256, bool) for n in ("digit", "lower", "upper", "hex", "quote", "equal", "colon", "at", "slash", "value", "high")}
_CLASS["digit"][48:58] = _CLASS["lower"][97:123] = _CLASS["upper"][65:91] = True
_CLASS["hex"][48:58] = _CLASS["hex"][97:103] = True
_CLASS["high"][128:] = True
for _name, _chars in (("quote", b"\"'`"), ("equal", b"="), ("colon", b":"), ("at", b"@"), ("slash", b"/"), ("value", b"+/_.=-")):
    _CLASS[_name][list(_chars)] = True
_CLASS["value"] |= _CLASS["digit"] | _CLASS["lower"] | _CLASS["upper"]
HASHED = 128
#: Sizes of the feature groups, in order; a token has one feature of each.
GROUPS = (9, 6, 5, 6, 3, 2, 2, 2, 2, 3, HASHED, HASHED, HASHED, HASHED, 4, 3)
STARTS = np.concatenate([[0], np.cumsum(GROUPS)])[:-1]
FEATURES = int(sum(GROUPS)) + 1  # the last one marks padding


def features(s: Slice, w: Words) -> np.ndarray:
    """Feature numbers of all words of a slice: one row a word, one column a group."""
    data = s.data
    count = {n: np.concatenate([[0], np.cumsum(flags[data])]) for n, flags in _CLASS.items()}
    own = {n: c[w.end] - c[w.start] for n, c in count.items()}
    n = w.end - w.start
    letters = own["lower"] + own["upper"] + own["high"]
    digit = _CLASS["digit"][data]
    turn = np.zeros(len(data) + 1, np.int64)
    if len(data) > 1:
        alnum = digit | _CLASS["lower"][data] | _CLASS["upper"][data]
        turn[2:] = np.cumsum((digit[1:] != digit[:-1]) & alnum[1:] & alnum[:-1])
    turns = turn[w.end] - turn[np.minimum(w.start + 1, w.end)]
    words = (w.hashes() >> np.uint64(40)).astype(np.int64) % (HASHED - 2) + 2
    edge = np.ones(len(n), np.int64)

    def beside(k: int) -> np.ndarray:
        """The hash of the word k places on in the same document; 1 if there is none."""
        out = edge.copy()
        if k < 0 and len(n) > -k:
            out[-k:] = np.where(w.doc[-k:] == w.doc[:k], words[:k], 1)
        elif k > 0 and len(n) > k:
            out[:-k] = np.where(w.doc[k:] == w.doc[:-k], words[k:], 1)
        return out

    digits = own["digit"]
    share = digits * 4 // np.maximum(n, 1)
    core = own["value"]
    sizes = np.diff(s.offsets)
    file_digits = np.minimum(np.diff(count["digit"][s.offsets]) * 100 // np.maximum(sizes, 1), 3)
    file_size = np.digitize(sizes, [500, 5000])
    columns = [
        np.digitize(core, [4, 8, 12, 16, 20, 32, 40, 48]),
        np.where(digits == 0, 0, 1 + np.minimum(share, 4)),
        np.where(letters == 0, 0, np.where(own["upper"] == 0, 1, np.where(own["lower"] == 0, 2, np.where(own["upper"] == 1, 3, 4)))),
        np.digitize(turns, [1, 2, 4, 8, 12]),
        np.where(own["hex"] + 3 >= core, np.where(core >= 12, 2, 1), 0),
        (own["equal"] + own["colon"] > 0).astype(int), (own["quote"] > 0).astype(int), (own["at"] > 0).astype(int), (own["slash"] > 0).astype(int),
        np.where(own["high"] > 0, 2, (core == n).astype(int)),
        beside(-1), beside(-2), beside(-3), beside(1),
        file_digits[w.doc], file_size[w.doc],
    ]
    return np.column_stack([c + a for c, a in zip(columns, STARTS, strict=True)]).astype(np.int16)


# --- the field -----------------------------------------------------------------------
class Field:
    """Weights of features and of transitions between the tags O, B and I."""

    def __init__(self, weight: np.ndarray, move: np.ndarray):
        self.weight, self.move = weight, move
        t = move
        bound = [max(t[p, y] - t[p, OUT] for p in range(3)) + max(t[y, q] - t[OUT, q] for q in range(3)) for y in (BEGIN, INSIDE)]
        #: How far B and I may lie below O, per token, before no context can make them best.
        self.bound = np.maximum(np.array(bound), 0)
        self.margin = np.ascontiguousarray((weight[:, [OUT]] - weight[:, 1:]).astype(np.float32))

    def viterbi(self, emit: np.ndarray, before: bool, after: bool) -> np.ndarray:
        """Best tags of equally long runs, ``emit`` [runs, length, 3]; an O stands before or after if so said."""
        runs, length, _ = emit.shape
        best = emit[:, 0] + (self.move[OUT] if before else 0)
        back = np.zeros((runs, length, 3), np.int8)
        for k in range(1, length):
            options = best[:, :, None] + self.move[None]
            back[:, k] = options.argmax(1)
            best = options.max(1) + emit[:, k]
        tags = np.zeros((runs, length), np.int8)
        tags[:, -1] = (best + (self.move[:, OUT] if after else 0)).argmax(1)
        for k in range(length - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(runs), k, tags[:, k]]
        return tags

    def decode(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens.

        Where O leads by more than any context can make up, the best path has O, so
        only the runs between such tokens are decoded; the result is the same.
        """
        tags = np.zeros(len(x), np.int8)
        if not len(x):
            return tags
        lead = self.margin[x[:, 0]]
        for k in range(1, x.shape[1]):
            lead = lead + self.margin[x[:, k]]
        open_ = np.flatnonzero((lead <= self.bound).any(1))
        if not len(open_):
            return tags
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])
        first = open_[new]
        length = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        before = np.zeros(len(first), bool)
        before[first > 0] = doc[first[first > 0] - 1] == doc[first[first > 0]]
        last = first + length
        after = np.zeros(len(first), bool)
        inside = last < len(x)
        after[inside] = doc[last[inside]] == doc[first[inside]]
        for n in np.unique(length):
            for b in (False, True):
                for a in (False, True):
                    chosen = first[(length == n) & (before == b) & (after == a)]
                    if len(chosen):
                        at = chosen[:, None] + np.arange(n)
                        tags[at] = self.viterbi(self.weight[x[at]].sum(2), b, a)
        return tags


def gradient(weight: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log-likelihood of tags ``y`` [windows, tokens], and its derivatives, by forward and backward sums."""
    n, length, groups = x.shape
    flat = x.reshape(-1)
    gold = np.eye(3)[y]
    gold_move = np.zeros((3, 3))
    np.add.at(gold_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    emit = weight[flat].reshape(n, length, groups, 3).sum(2)
    up = np.exp(move)
    fwd, scale = np.zeros((n, length, 3)), np.zeros((n, length))
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    for k in range(length):
        a = e[:, k] if k == 0 else (fwd[:, k - 1] @ up) * e[:, k]
        scale[:, k] = a.sum(1)
        fwd[:, k] = a / scale[:, k, None]
    bwd = np.ones((n, length, 3))
    expected = np.zeros((3, 3))
    for k in range(length - 2, -1, -1):
        m = e[:, k + 1] * bwd[:, k + 1]
        expected += (fwd[:, k].T @ (m / scale[:, k + 1, None])) * up
        bwd[:, k] = (m @ up.T) / scale[:, k + 1, None]
    post = fwd * bwd
    post /= post.sum(2, keepdims=True)
    each = np.repeat((post - gold).reshape(-1, 3), groups, 0)
    loss = float(np.log(scale).sum() + top.sum() - (emit * gold).sum() - (move * gold_move).sum())
    return loss, np.column_stack([np.bincount(flat, each[:, t], FEATURES) for t in range(3)]), expected - gold_move


def fit_field(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps; ``x`` [windows, tokens, groups], ``y`` [windows, tokens]."""
    weight, move = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    move[OUT, INSIDE] = -2.0
    if not len(x):
        weight[:, OUT] = 2.0
        return Field(weight, move)
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
    for it in range(1, rounds + 1):
        _, g, gm = gradient(weight, move, x, y)
        for p, grad, a, b in ((weight, g / len(x) + ridge * weight, 0, 1), (move, gm / len(x) + ridge * move, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * grad
            state[b] = 0.99 * state[b] + 0.01 * grad * grad
            p -= 0.15 * (state[a] / (1 - 0.9**it)) / (np.sqrt(state[b] / (1 - 0.99**it)) + 1e-8)
    return Field(weight, move)


# --- examples ------------------------------------------------------------------------
_HEX, _UP, _MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _made_up(rng: random.Random) -> tuple[str, str]:
    """Words that introduce a secret, and the secret."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return rng.choice([
        lambda: ('token = "', some(_HEX, 40)), lambda: ("password=", some(_HEX, 18)), lambda: ("", "AKIA" + some(_UP, 16)),
        lambda: ("api_key: ", some(_MIXED, 32)), lambda: ('secret: "', some(_MIXED + "+/", 40)), lambda: ("passwd = ", some(_MIXED, 16)),
        lambda: ("Authorization: Bearer ", some(_MIXED, 40)), lambda: ("", "ghp_" + some(_MIXED, 36)), lambda: ("", "sk_live_" + some(_MIXED, 24)),
        lambda: ("client_key ", some(_HEX, 32)), lambda: ("credentials ", some(_MIXED, 24)),
    ])()


def _innocent(rng: random.Random) -> str:
    """Something with digits or marks that is no secret: an address, a number, a date, a name in code, a path."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: some(_MIXED[26:52], rng.randrange(3, 9))
    digit = lambda n: some(_HEX[:10], n)
    return rng.choice([
        lambda: f"{word()}.{digit(2)}@mail{digit(1)}.example.com", lambda: f"{word()}_{word()}@{word()}.org", lambda: f"https://www.{word()}.example.org/{word()}/{digit(4)}/{word()}-{word()}.html",
        lambda: f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", lambda: digit(16), lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}", lambda: f"20{digit(2)}-0{digit(1)}-1{digit(1)}T0{digit(1)}:3{digit(1)}:00Z",
        lambda: f"{digit(3)}.{digit(3)}.{digit(2)}.{digit(3)}", lambda: f"{word()}_{word()}_{word()}", lambda: f"/{word()}/{word()}/{word()}.{word()}", lambda: f"v{digit(1)}.{digit(2)}.{digit(1)}-{word()}",
        lambda: f"{word().upper()}-{digit(8)}-{digit(4)}", lambda: f"{digit(3)},{digit(3)},{digit(3)}.{digit(2)}", lambda: word().title() + word().title() + word().title(), lambda: "=" * rng.randrange(12, 40), lambda: word() * 4,
    ])()


def _examples(batches):
    """Windows of feature numbers and tags of sampled texts."""
    for batch in batches:
        out_x, out_y = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rng = random.Random(str(key))
            parts = re.split(r"(\s+)", text or "")
            told: list[tuple[int, int]] = []
            for _ in range(2):
                at = rng.randrange(0, len(parts) // 2 + 1) * 2
                lead, secret = _made_up(rng)
                parts[at] = f"{parts[at]} {lead}\0{secret}\0{rng.choice(['', '', chr(34), ',', '.'])} "
            for _ in range(4):
                at = rng.randrange(0, len(parts) // 2 + 1) * 2
                parts[at] = f"{parts[at]} {_innocent(rng)} "
            pieces = "".join(parts).encode("utf-8", "replace").split(b"\0")
            place = 0
            for k, p in enumerate(pieces):
                if k % 2:
                    told.append((place, place + len(p)))
                place += len(p)
            raw = b"".join(pieces)
            told += [(v, end) for _, _, end, v in base_spans(raw)]
            s = Slice(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            w = Words(s)
            if not len(w.start):
                continue
            x, y = features(s, w), np.zeros(len(w.start), np.int8)
            hits = []
            for a, b in sorted(told):
                own = np.flatnonzero((w.end > a) & (w.start < b))
                if len(own):
                    y[own[0]] = BEGIN
                    y[own[1:]] = np.where(y[own[1:]] == BEGIN, BEGIN, INSIDE)
                    hits.append(int(own[0]))
            odd = np.flatnonzero((x[:, 1] > STARTS[1]) & (y == OUT))  # tokens with digits that are no secrets
            centers = hits[: WINDOWS // 2] + [int(odd[rng.randrange(len(odd))]) for _ in range(2 if len(odd) else 0)]
            centers += [rng.randrange(len(y)) for _ in range(WINDOWS - len(centers))]
            for c in centers:
                a = c - rng.randrange(SPAN)
                at = np.arange(a, a + SPAN)
                ok = (at >= 0) & (at < len(y))
                wx, wy = np.full((SPAN, len(GROUPS)), FEATURES - 1, np.int16), np.zeros(SPAN, np.int8)
                wx[ok], wy[ok] = x[at[ok]], y[at[ok]]
                out_x.append(wx.tobytes())
                out_y.append(wy.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_x, pa.binary()), pa.array(out_y, pa.binary())], ["x", "y"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field fitted on windows of about ``sample`` documents; which ones depends on a hash of the id alone."""
    ship(docs.sparkSession)
    there = docs.count()
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = docs.filter(F.col(id_col).isNotNull() & (u < sample / max(there, 1))).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    got = chosen.mapInArrow(_examples, "x binary, y binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.int16).reshape(-1, SPAN, len(GROUPS))
    y = np.frombuffer(b"".join(got.column("y").to_pylist()), np.int8).reshape(-1, SPAN)
    return fit_field(x, y)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``, one row per input row; ``spans`` is an array of ``kind, start, end``.

    Positions count code points, ends are exclusive; spans are sorted by start, then by kind.
    Kind ``crf`` marks what the field adds: values that overlap no base span.
    Null text counts as empty; ids may repeat or be null; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for s in slices(batch.column(1)):
                w = Words(s)
                x = features(s, w)
                tags = model.decode(x, w.doc)
                added: dict[int, list[tuple[int, int]]] = {}
                at = np.flatnonzero(tags)
                k = 0
                while k < len(at):
                    i = j = at[k]
                    while k + 1 < len(at) and at[k + 1] == j + 1 and tags[at[k + 1]] == INSIDE and w.doc[j] == w.doc[j + 1]:
                        k += 1
                        j = at[k]
                    added.setdefault(int(w.doc[i]), []).append((int(w.start[i]), int(w.end[j])))
                    k += 1
                out = []
                raw = s.data.tobytes()
                lead = (s.data & 0xC0) != 0x80
                for d in range(len(s)):
                    a, b = int(s.offsets[d]), int(s.offsets[d + 1])
                    own = raw[a:b]
                    found = [(x0, kind, x1) for x0, kind, x1, _ in base_spans(own)]
                    for p, q in added.get(d, ()):
                        values = [m for m in VALUE.finditer(own, p - a, q - a) if m.end() - m.start() >= SHORTEST]
                        if values and not any(x0 < q - a and p - a < x1 for x0, _, x1 in found):
                            m = max(values, key=lambda v: v.end() - v.start())
                            found.append((m.start(), 3, m.end()))
                    if found:
                        upto = np.concatenate([[0], np.cumsum(lead[a:b])])
                        out.append([{"kind": KINDS[kind], "start": int(upto[x0]), "end": int(upto[x1])} for x0, kind, x1 in sorted(found)])
                    else:
                        out.append([])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
