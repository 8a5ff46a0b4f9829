"""Array operators as column expressions over ``array`` columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn1 = Callable[[Column], Column]
Fn2 = Callable[[Column, Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def index(a, i) -> Column:
    """Element i from 0; null out of range."""
    return F.get(_c(a), i)


def length(a) -> Column:
    return F.size(_c(a))


def first(a) -> Column:
    return F.get(_c(a), F.lit(0))


def last(a) -> Column:
    return F.try_element_at(_c(a), F.lit(-1))


def tail(a) -> Column:
    """All but the first; null for an empty array."""
    a = _c(a)
    return F.when(F.size(a) > 0, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))


def init(a) -> Column:
    """All but the last; null for an empty array."""
    a = _c(a)
    return F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def iota(n) -> Column:
    """0 to n-1; empty for n <= 0 (a bare ``sequence`` would count down)."""
    n = _c(n)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def generate(n, f: Fn1) -> Column:
    return F.transform(iota(n), f)


def all_or_none(a: Column) -> Column:
    """The array, or null if any element is null."""
    return F.when(~F.exists(a, lambda x: x.isNull()), a)


def generate_maybe(n, f: Fn1) -> Column:
    return all_or_none(generate(n, f))


def map_maybe(a, f: Fn1) -> Column:
    return all_or_none(F.transform(_c(a), f))


def map2(a, b, f: Fn2) -> Column:
    """Elementwise combination; null if the lengths differ."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def map_elems(a, f: Fn1) -> Column:
    """Apply ``f`` to the inner elements of a nested array."""
    return F.transform(_c(a), lambda x: F.transform(x, f))


def replicates(a, count: Fn1, value: Fn1) -> Column:
    return F.flatten(F.transform(_c(a), lambda x: F.array_repeat(value(x), F.greatest(count(x), F.lit(0)).cast("int"))))


def foldl(a, start: Column, step: Fn2) -> Column:
    return F.aggregate(_c(a), start, step)


def total(a, kind: str = "double") -> Column:
    return F.aggregate(_c(a), F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def product(a, kind: str = "double") -> Column:
    return F.aggregate(_c(a), F.lit(1).cast(kind), lambda acc, x: acc * x.cast(kind))


def mean(a) -> Column:
    """Sum over length; NaN for an empty array."""
    a = _c(a)
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(float("nan")))


def std(a) -> Column:
    """Population standard deviation, in two passes."""
    a = _c(a)
    m = mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.when(F.size(a) > 0, F.size(a)))


def correlate(a, b) -> Column:
    """Pearson correlation over the common prefix, from sums of one pass."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy")))
    s = F.aggregate(pairs, zero, lambda t, p: F.struct((t["x"] + p["x"]).alias("x"), (t["y"] + p["y"]).alias("y"), (t["xx"] + p["x"] * p["x"]).alias("xx"), (t["yy"] + p["y"] * p["y"]).alias("yy"), (t["xy"] + p["x"] * p["y"]).alias("xy")))
    below = F.sqrt(n * s["xx"] - s["x"] * s["x"]) * F.sqrt(n * s["yy"] - s["y"] * s["y"])
    return (n * s["xy"] - s["x"] * s["y"]) / F.when(below != 0, below)


def keep(a, p: Fn1) -> Column:
    return F.filter(_c(a), p)


def slices(a, starts, lengths) -> Column:
    """A nested array from starts (from 0) and lengths."""
    a = _c(a)
    return F.zip_with(_c(starts), _c(lengths), lambda s, n: F.slice(a, (s + 1).cast("int"), n.cast("int")))


def slice_(a, start, n) -> Column:
    """Elements ``[start, start+n)``, or null if they are not all there."""
    a, start, n = _c(a), _c(start), _c(n)
    ok = (start >= 0) & (n >= 0) & (start + n <= F.size(a))
    return F.when(ok, F.slice(a, F.when(ok, start + 1).otherwise(1).cast("int"), F.greatest(n, F.lit(0)).cast("int")))


def trim_starts(a, p: Fn1) -> Column:
    """Without the elements at the start for which p holds."""
    a = _c(a)
    n = F.size(a)
    at = F.array_position(F.transform(a, p), F.lit(False))
    return F.when(at > 0, F.slice(a, at.cast("int"), n)).otherwise(F.slice(a, F.lit(1), F.lit(0)))


def trim_ends(a, p: Fn1) -> Column:
    return F.reverse(trim_starts(F.reverse(_c(a)), p))


def trims(a, p: Fn1) -> Column:
    return trim_ends(trim_starts(a, p), p)


def concat_with(a, sep) -> Column:
    """Flattened, the separator after every element."""
    return F.flatten(F.transform(_c(a), lambda x: F.concat(x, sep)))


def intercalate(a, sep) -> Column:
    """Flattened, the separator between elements."""
    return F.flatten(F.transform(_c(a), lambda x, i: F.when(i == 0, x).otherwise(F.concat(sep, x))))


def unlines(a) -> Column:
    """Strings, each followed by a newline."""
    return F.array_join(F.transform(_c(a), lambda x: F.concat(x, F.lit("\n"))), "")


def ragspose3(a) -> Column:
    """Rows to columns of a ragged array: column k has the k-th element of each row that is long enough."""
    a = _c(a)
    width = F.array_max(F.transform(a, F.size))
    return F.transform(iota(F.coalesce(width, F.lit(0))), lambda k: F.transform(F.filter(a, lambda r: F.size(r) > k), lambda r: F.get(r, k.cast("int"))))


def insert(a, places: Callable[[Column], Column]) -> Column:
    """Values at output positions where ``places(position)`` is not null; the array fills the others.

    Positions are looked at in order, up to the first one behind the last element.
    """
    a = _c(a)
    kind = F.array_append(F.slice(a, F.lit(1), F.lit(0)), places(F.lit(0).cast("long")))
    start = F.struct(F.slice(kind, F.lit(1), F.lit(0)).alias("out"), F.lit(0).cast("long").alias("at"))

    def fill(acc: Column) -> Column:
        # at most one inserted value stands before each element
        v = places(acc["at"])
        return F.when(v.isNull(), acc).otherwise(F.struct(F.array_append(acc["out"], v).alias("out"), (acc["at"] + 1).alias("at")))

    def step(acc: Column, x: Column) -> Column:
        acc = fill(acc)
        return F.struct(F.array_append(acc["out"], x).alias("out"), (acc["at"] + 1).alias("at"))

    return F.aggregate(a, start, step, lambda acc: fill(acc)["out"])


def find_index(a, p: Fn1) -> Column:
    """Position from 0 of the first element for which p holds; null if none."""
    at = F.array_position(F.transform(_c(a), lambda x: F.coalesce(p(x), F.lit(False))), F.lit(True))
    return F.when(at > 0, at - 1)


def segment_on(text, stop: str) -> Column:
    """Pieces of a string that end with (and include) one of the characters; what is left is a piece too."""
    return F.filter(F.regexp_extract_all(_c(text), F.lit(f"[^{stop}]*[{stop}]|[^{stop}]+"), F.lit(0)), lambda x: x != "")


def dice_sep(text, field: str, row: str) -> Column:
    """Rows of fields; a terminator at the end starts no further row."""
    text = _c(text)
    body = F.when(text.endswith(row), F.substring(text, F.lit(1), F.length(text) - len(row))).otherwise(text)
    split = lambda s, sep: F.split(s, "\\Q" + sep + "\\E", -1)
    return F.when(text == "", F.array().cast("array<array<string>>")).otherwise(F.transform(split(body, row), lambda r: split(r, field)))


def dice(text, row_break: str, field_break: str) -> Column:
    """Two-level cut by regular expressions."""
    return F.transform(F.split(_c(text), row_break, -1), lambda r: F.split(r, field_break, -1))


def groups(a) -> Column:
    """Runs of equal neighbours as ``array<struct<x, n>>``."""
    a = _c(a)
    heads = F.filter(iota(F.size(a)), lambda i: (i == 0) | ~F.get(a, i.cast("int")).eqNullSafe(F.get(a, (i - 1).cast("int"))))
    return F.transform(heads, lambda h, k: F.struct(F.get(a, h.cast("int")).alias("x"), (F.coalesce(F.get(heads, k + 1), F.size(a).cast("long")) - h).alias("n")))


def partition(a, number: Fn1, n: int) -> Column:
    """n arrays of the elements by their number, in order; other numbers are dropped."""
    a = _c(a)
    return F.transform(iota(F.lit(n)), lambda k: F.filter(a, lambda x: number(x) == k))


def distinct_sorted(a) -> Column:
    """A sorted array without elements equal to the one before."""
    a = _c(a)
    return F.transform(groups(a), lambda g: g["x"])


def compact(a, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Stateful filter and map: ``step(state, x) -> (state, value)``; null values vanish."""
    zero = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("o"))

    def go(acc: Column, x: Column) -> Column:
        s, v = step(acc["s"], x)
        v = v.cast(kind)
        return F.struct(s.alias("s"), F.when(v.isNull(), acc["o"]).otherwise(F.array_append(acc["o"], v)).alias("o"))

    return F.aggregate(_c(a), zero, go, lambda acc: acc["o"])


def process(a, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Stateful flat map: ``step(state, x) -> (state, array)``; gives ``struct<s, o>``."""
    zero = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("o"))

    def go(acc: Column, x: Column) -> Column:
        s, v = step(acc["s"], x)
        return F.struct(s.alias("s"), F.concat(acc["o"], v.cast(f"array<{kind}>")).alias("o"))

    return F.aggregate(_c(a), zero, go)


def folds(lengths, values, start: Column, step: Fn2) -> Column:
    """Segmented fold of ``values`` by ``lengths``; an incomplete last segment yields nothing."""
    lengths, values = _c(lengths), _c(values)
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    whole = F.filter(F.zip_with(lengths, ends, lambda n, e: F.struct(n.alias("n"), e.alias("e"))), lambda z: z["e"] <= F.size(values))
    return F.transform(whole, lambda z: F.aggregate(F.slice(values, (z["e"] - z["n"] + 1).cast("int"), z["n"].cast("int")), start, step))


def folds_with(first_length: Column, first_acc: Column, lengths, values, start: Column, step: Fn2) -> Column:
    """As ``folds``, after a segment that is already under way: what it lacks, and its accumulator."""
    values = _c(values)
    rest = F.when(F.size(values) > first_length, F.slice(values, (first_length + 1).cast("int"), F.size(values))).otherwise(F.slice(values, F.lit(1), F.lit(0)))
    head = F.aggregate(F.slice(values, F.lit(1), first_length.cast("int")), first_acc, step)
    return F.when(F.size(values) < first_length, F.slice(F.array(head), F.lit(1), F.lit(0))).otherwise(F.concat(F.array(head), folds(lengths, rest, start, step)))


def groups_with(open_value: Column, open_length: Column, a) -> Column:
    """As ``groups``, after a run that is already under way."""
    a = _c(a)
    g = groups(a)
    own = F.struct(open_value.alias("x"), open_length.cast("long").alias("n"))
    joined = F.struct(open_value.alias("x"), (open_length.cast("long") + F.get(g, F.lit(0))["n"]).alias("n"))
    same = F.get(a, F.lit(0)).eqNullSafe(open_value) & (F.size(a) > 0)
    return F.when(same, F.concat(F.array(joined), F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))))).otherwise(F.concat(F.array(own), g))


def windowed(a, start, n) -> Column:
    """The view ``[start, start+n)``, cut at the ends."""
    return F.slice(_c(a), (_c(start) + 1).cast("int"), _c(n).cast("int"))


def extract(a, ranges) -> Column:
    """All elements of the ranges ``struct<start, len>``, one range after another."""
    a = _c(a)
    return F.flatten(F.transform(_c(ranges), lambda r: F.slice(a, (r["start"] + 1).cast("int"), r["len"].cast("int"))))
