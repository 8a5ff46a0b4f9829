"""Format-preserving pseudonyms against a plain matcher and Feistel network."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sluiceway.llm import pseudonyms as P

EPOCH = dt.date(1900, 1, 1)


def noise(key, kind, rnd, value, most):
    return int(hashlib.sha256(f"{key}|{kind}|{rnd}|{value}".encode()).hexdigest()[:15], 16) % most


def permute(key, kind, left, right, left_size, right_size):
    for rnd in range(1, P.ROUNDS + 1):
        left = (left + noise(key, kind, rnd * 2, right, left_size)) % left_size
        right = (right + noise(key, kind, rnd * 2 + 1, left, right_size)) % right_size
    return left, right


def spell(value, like):
    out = ""
    for c in reversed(like):
        base, radix = ("0", 10) if c.isdigit() else ("A" if c.isupper() else "a", 26)
        value, r = divmod(value, radix)
        out = chr(ord(base) + r) + out
    return out


def number(text):
    v, n = 0, 1
    for c in text:
        base, radix = ("0", 10) if c.isdigit() else ("A" if c.isupper() else "a", 26)
        v, n = v * radix + ord(c) - ord(base), n * radix
    return v, n


def permute_text(key, kind, text):
    out = ""
    for k in range(0, len(text), P.BLOCK):
        block = text[k : k + P.BLOCK]
        left, right = block[: len(block) // 2], block[len(block) // 2 :]
        (lv, ln), (rv, rn) = number(left), number(right)
        a, b = permute(key, kind, lv, rv, ln, rn)
        out += spell(a, left) + spell(b, right)
    return out


def refill(shape, pattern, text):
    chars = iter(text)
    return re.sub(pattern, lambda _: next(chars), shape)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10


def remainder(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def day_of(text, form):
    try:
        return (dt.datetime.strptime(text, form).date() - EPOCH).days
    except ValueError:
        return None


def replaced(key, m):
    """The pseudonym and kind of a match."""
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        name, rest = m.split("@", 1)
        return refill(name, "[A-Za-z0-9]", permute_text(key, "mail", re.sub("[^A-Za-z0-9]", "", name))) + "@" + rest, "mail"
    if m[0].isalpha():
        c = m.replace(" ", "")
        if not 2 <= int(c[2:4]) <= 98 or remainder(c) != 1:
            return m, None
        tail = refill(c[4:], "[0-9]", permute_text(key, "account", re.sub("[^0-9]", "", c[4:])))
        return refill(m, "[A-Z0-9]", c[:2] + f"{98 - remainder(c[:2] + '00' + tail):02d}" + tail), "account"
    shape = re.sub("[0-9]", "9", m)
    if shape in ("9999-99-99", "99/99/9999", "99.99.9999"):
        forms = {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%m/%d/%Y", "%d/%m/%Y"]}[re.search("[-./]", m)[0]]
        form = next((f for f in forms if day_of(m, f) is not None), None)
        if form is None or not 0 <= day_of(m, form) < P.DAYS:
            return m, None
        n = day_of(m, form)
        while True:
            a, b = permute(key, "date", n // P.DAY_PARTS[1], n % P.DAY_PARTS[1], *P.DAY_PARTS)
            n = a * P.DAY_PARTS[1] + b
            then = EPOCH + dt.timedelta(n)
            if form != "%d/%m/%Y" or then.day > 12:
                return then.strftime(form), "date"
    if re.fullmatch(r"9{1,3}(\.9{1,3}){3}", shape):
        parts = m.split(".")
        if any(int(p) > 255 for p in parts):
            return m, None
        span = [(0, 10) if len(p) == 1 else (0, 10 ** (len(p) - 1)) if p[0] == "0" else (10, 90) if len(p) == 2 else (100, 156) for p in parts]
        v = [int(p) - low for p, (low, _) in zip(parts, span, strict=True)]
        n = [size for _, size in span]
        a, b = permute(key, "address", v[0] * n[1] + v[1], v[2] * n[3] + v[3], n[0] * n[1], n[2] * n[3])
        new = [a // n[1], a % n[1], b // n[3], b % n[3]]
        return ".".join(str(x + low).zfill(len(p)) for x, (low, _), p in zip(new, span, parts, strict=True)), "address"
    if shape == "999-99-9999":
        area, group, serial = (int(x) for x in m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return m, None
        a, b = permute(key, "national", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}", "national"
    if len(digits) >= 13 and m[0] != "+":
        if luhn(digits):
            return m, None
        body = permute_text(key, "card", digits[:-1])
        return refill(m, "[0-9]", body + str(-luhn(body + "0") % 10)), "card"
    if not 7 <= len(digits) <= 15:
        return m, None
    code = re.match(r"(\+[0-9]{1,3})[ .(-]", m)
    code = code[1] if code else ""
    own = m[len(code) :]
    return code + refill(own, "[0-9]", permute_text(key, "phone", re.sub("[^0-9]", "", own))), "phone"


def plain(key, text):
    kinds = []

    def put(m):
        v, k = replaced(key, m[0])
        kinds.extend([k] if k else [])
        return v

    return re.sub(P.ANY, put, text or ""), kinds


def test_every_row_equals_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_changed, r.kinds) for r in P.pseudonymise(docs, "key").collect()}
    want = {}
    for d, t in docs.collect():
        new, kinds = plain("key", t)
        want[d] = (new, len(kinds), kinds)
    assert got == want and any(k for _, _, k in got.values())


VALUES = [
    "Jo.Doe@x.org", "jo.doe@x.org", "A1b2C3d4E5f6G7h8I9j0K1l2M3n4@y.example.com", "123-45-6789", "899-01-0001", "667-99-9999", "665-10-1000", "666-10-1000", "000-10-1000",
    "4111 1111 1111 1111", "4111111111111112", "0000000000000", "10.1.200.3", "010.001.1.255", "1.2.3.256", "2020-02-29", "2021-02-29", "25/12/2020", "12/25/2020", "31.12.1999", "2100-01-01",
    "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB99 WEST 1234 5698 7654 32", "+1 (724) 555-7058", "+44 20 7946 0958", "(555) 123-4567", "555-123-4567", "\x01", "\x01\x02", "\x01\x03 +1 (724) 555-7058 \x01",
]


def test_values_and_their_pseudonyms(spark):
    """As plain Python has it; a pseudonym keeps its form and is found and valid again."""
    docs = spark.createDataFrame([(k, f"see {v} so") for k, v in enumerate(VALUES)], "doc_id long, text string")
    once = P.pseudonymise(docs, "k")
    first = {r.doc_id: r for r in once.collect()}
    for k, v in enumerate(VALUES):
        assert (first[k].text, first[k].kinds) == plain("k", f"see {v} so"), v
        form = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
        assert form(first[k].text) == form(f"see {v} so")
    for r in P.pseudonymise(once.select("doc_id", "text"), "k").collect():
        assert r.kinds == first[r.doc_id].kinds
    assert first[0].text != first[1].text and first[0].text.lower() == first[1].text  # case is kept, and variants of case stay linked


@pytest.mark.parametrize("make", [lambda c: F.lpad(c.cast("string"), 3, "0"), lambda c: F.concat(F.char(c % 26 + 65), F.char(F.floor(c / 26) % 26 + 97))])
def test_text_is_permuted(spark, make):
    n = 676
    v = spark.range(n).select(make(F.col("id")).alias("t")).select("t", P.permute_text("k", "t", F.col("t")).alias("v"))
    assert v.select("v").distinct().count() == n


def test_days_and_national_numbers_are_permuted(spark):
    days = spark.range(P.DAYS).select(P.permute("k", "d", F.floor(F.col("id") / 4297), F.col("id") % 4297, F.lit(17), F.lit(4297)).alias("v"))
    assert days.distinct().count() == P.DAYS
    ids = spark.range(3000).select("id", F.format_string("%03d-%02d-%04d", F.col("id") % 898 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("text")).filter("text not like '666%'")
    out = P.pseudonymise(ids, "k", "id")
    assert out.filter("n_changed = 1").count() == ids.count() == out.select("text").distinct().count()
    day_first = spark.range(3000).select("id", F.date_format(F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), "dd/MM/yyyy").alias("text")).filter("substring(text, 1, 2) > '12'")
    out = P.pseudonymise(day_first, "k", "id")
    assert out.select("text").distinct().count() == day_first.count() and out.filter("substring(text, 1, 2) <= '12'").count() == 0


@pytest.mark.parametrize("unit", ["a.", "7", "+1 ", "a@", "AB12 ", "1.2.", "x@y.", "\x01"])
def test_very_long_texts(spark, unit):
    text = "mail x@" + unit * (1_000_000 // len(unit))
    got = P.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert len(got.text) == len(text)
    if unit not in ("a@", "x@y."):
        assert (got.text, got.kinds) == plain("k", text)
