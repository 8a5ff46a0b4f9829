"""Format-preserving pseudonyms by a keyed Feistel network, in Spark expressions only.

Card numbers, phone numbers, national ids, account numbers, network addresses and dates
that pass their validation are permuted within their own format under a key; so are the
names in mail addresses.  Equal values get equal pseudonyms in all documents, and a
pseudonym passes the validation of its kind again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# What is looked for, tried in this order at each position.  Repeats without a
# bound are possessive, so the matcher loops over them and needs no stack for long texts.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
}
_DIGITS = "|".join(p for k, p in PATTERNS.items() if k not in ("mail", "account"))
#: One look ahead spares letters the look-behinds of the patterns that begin with a digit, a plus or a bracket.
ANY = "|".join([PATTERNS["mail"], PATTERNS["account"], f"(?=[0-9+(])(?:{_DIGITS})"])
#: Days from 1900-01-01 that dates are permuted among: to 2099-12-31.
DAYS, DAY_PARTS = 73049, (17, 4297)
#: Valid areas, groups and serials of a national id: 001 to 899 without 666, 01 to 99, 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999
#: Characters that are permuted as one pair of numbers; both fit 64 bits.
BLOCK = 24
#: Most walks of a date's cycle until it is back among those of its format; 12 of about 30 days are outside.
WALKS = 64
# A mark is this character and one more; the character itself gets an escape of its own first.
_MARK, _ESCAPED, _CUT = "\x01", "\x01\x02", "\x01\x03"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, exact for all 64-bit integers."""
    return F.call_function("div", a, b)


def _noise(key: str, kind: str, rnd: Column, value: Column, most: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), rnd.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), most)


def permute(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of pairs below the two sizes, as ``struct<l, r>``: an alternating Feistel network."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, rnd: Column) -> Column:
        moved = F.pmod(acc["l"] + _noise(key, kind, rnd * 2, acc["r"], left_size), left_size)
        return _let(moved, lambda l2: F.struct(l2.alias("l"), F.pmod(acc["r"] + _noise(key, kind, rnd * 2 + 1, l2, right_size), right_size).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _class(c: Column) -> tuple[Column, Column]:
    """The first character code and the number of characters of the class of a digit or letter."""
    return F.when(c <= "9", 48).when(c <= "Z", 65).otherwise(97), F.when(c <= "9", 10).otherwise(26)


def _number(chars: Column) -> Column:
    """Value and number of values, as ``struct<v, n>``, of characters within their classes."""
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("n"))
    return F.aggregate(chars, start, lambda a, c: F.struct((a["v"] * _class(c)[1] + F.ascii(c) - _class(c)[0]).cast("long").alias("v"), (a["n"] * _class(c)[1]).cast("long").alias("n")))


def _spell(value: Column, chars: Column) -> Column:
    """The string of a value in the classes of ``chars``."""
    start = F.struct(value.alias("v"), F.lit("").alias("s"))
    step = lambda a, c: F.struct(_div(a["v"], _class(c)[1]).alias("v"), F.concat(F.char(F.pmod(a["v"], _class(c)[1]) + _class(c)[0]), a["s"]).alias("s"))
    return F.aggregate(F.reverse(chars), start, step)["s"]


def permute_text(key: str, kind: str, text: Column) -> Column:
    """Digits and letters permuted among those of the same classes: digits stay digits, and letters keep their case.

    A block of up to 24 characters is one permutation; further blocks have one each.
    """

    def block(chars: Column) -> Column:
        half = _div(F.size(chars), F.lit(2)).cast("int")
        left, right = F.slice(chars, F.lit(1), half), F.slice(chars, half + 1, F.size(chars))
        one = F.struct(left.alias("lc"), right.alias("rc"), _number(left).alias("l"), _number(right).alias("r"))
        moved = lambda x: permute(key, kind, x["l"]["v"], x["r"]["v"], x["l"]["n"], x["r"]["n"])
        return _let(one, lambda x: _let(moved(x), lambda y: F.concat(_spell(y["l"], x["lc"]), _spell(y["r"], x["rc"]))))

    def blocks(chars: Column) -> Column:
        n = _div(F.size(chars) - 1, F.lit(BLOCK)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: _let(F.slice(chars, k * BLOCK + 1, F.lit(BLOCK)), block)), "")

    return F.when(F.length(text) > 0, _let(_chars(text), blocks)).otherwise(F.lit(""))


def _refill(shape: Column, pattern: str, text: Column) -> Column:
    """Put the characters of ``text``, in order, where ``shape`` has characters of the class ``pattern``."""
    return F.array_join(F.zip_with(F.split(shape, pattern, -1), _chars(text), lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")


def _luhn(digits: Column) -> Column:
    """The sum whose remainder by ten is zero for a valid number."""
    double = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, double(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _remainder97(account: Column) -> Column:
    """The remainder by 97 of an account number's digits, letters counting from 10; 1 if valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c <= "9", F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(_chars(moved), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


_EPOCH = "1900-01-01"
#: Formats of dates, told by their separator; the fourth is taken where the third names no day.
_FORMS = {1: "yyyy-MM-dd", 2: "dd.MM.yyyy", 3: "MM/dd/yyyy", 4: "dd/MM/yyyy"}


def _date(value: Column) -> Column:
    """``struct<form, day>``: the format of a date, and its day from 1900-01-01 (null if it names none)."""
    read = lambda k: F.datediff(F.try_to_timestamp(value, F.lit(_FORMS[k])).cast("date"), F.lit(_EPOCH)).cast("long")
    pair = lambda k, day: F.struct(F.lit(k).alias("form"), day.alias("day"))
    slashes = _let(read(3), lambda day: F.when(day.isNotNull(), pair(3, day)).otherwise(pair(4, read(4))))
    return F.when(value.contains("-"), pair(1, read(1))).when(value.contains("."), pair(2, read(2))).otherwise(slashes)


def _moved_date(key: str, date: Column) -> Column:
    """Another day in the same format.  One with the day first and slashes stays one that can't be read month first."""
    split = lambda n: permute(key, "date", _div(n, F.lit(DAY_PARTS[1])), F.pmod(n, F.lit(DAY_PARTS[1])), F.lit(DAY_PARTS[0]), F.lit(DAY_PARTS[1]))
    once = lambda n: _let(split(n), lambda m: m["l"] * DAY_PARTS[1] + m["r"])
    then = lambda n: F.date_add(F.lit(_EPOCH).cast("date"), n.cast("int"))
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(n), lambda a, _: F.when(F.dayofmonth(then(a)) > 12, a).otherwise(once(a)))
    shown = lambda n, k: F.date_format(then(n), _FORMS[k])
    free = _let(once(date["day"]), lambda n: F.when(date["form"] == 1, shown(n, 1)).when(date["form"] == 2, shown(n, 2)).otherwise(shown(n, 3)))
    return F.when(date["form"] == 4, shown(walked(date["day"]), 4)).otherwise(free)


def _octet(part: Column) -> tuple[Column, Column]:
    """The least value and the number of values of an address part with as many digits and a leading zero alike."""
    n, zero = F.length(part), part.startswith("0")
    return F.when((n == 1) | zero, 0).when(n == 2, 10).otherwise(100), F.when(n == 1, 10).when(zero, F.when(n == 2, 10).otherwise(100)).when(n == 2, 90).otherwise(156)


def _moved_address(key: str, value: Column) -> Column:
    """Another address with as many digits in each part."""

    def moved(p: Column) -> Column:
        low, size = (lambda i: _octet(p[i])[0].cast("long")), (lambda i: _octet(p[i])[1].cast("long"))
        at = lambda i: p[i].cast("long") - low(i)
        pairs = permute(key, "address", at(0) * size(1) + at(1), at(2) * size(3) + at(3), size(0) * size(1), size(2) * size(3))
        show = lambda i, v: F.lpad((v + low(i)).cast("string"), F.length(p[i]), F.lit("0"))
        high = lambda v, i: _div(v, size(i))
        return _let(pairs, lambda m: F.concat_ws(".", show(0, high(m["l"], 1)), show(1, F.pmod(m["l"], size(1))), show(2, high(m["r"], 3)), show(3, F.pmod(m["r"], size(3)))))

    return _let(F.split(value, "\\."), moved)


def _moved_national(key: str, digits: Column) -> Column:
    """Another valid number: ranks of valid areas, and of valid groups and serials, are permuted."""
    area, group, serial = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 2).cast("long"), F.substring(digits, 6, 4).cast("long")
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permute(key, "national", rank, (group - 1) * SERIALS + serial - 1, F.lit(AREAS), F.lit(GROUPS * SERIALS))
    pad = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return _let(moved, lambda m: F.concat_ws("-", pad(m["l"] + 1 + F.when(m["l"] >= 665, 1).otherwise(0), 3), pad(_div(m["r"], F.lit(SERIALS)) + 1, 2), pad(F.pmod(m["r"], F.lit(SERIALS)) + 1, 4)))


def _moved_account(key: str, value: Column) -> Column:
    """Other digits; country, letters and blanks stay, and the check digits follow."""

    def moved(compact: Column) -> Column:
        country, tail = F.substring(compact, 1, 2), F.substring(compact, F.lit(5), F.length(compact))
        proof = lambda t: F.lpad((98 - _remainder97(F.concat(country, F.lit("00"), t))).cast("string"), 2, "0")
        new = _refill(tail, "[0-9]", permute_text(key, "account", F.regexp_replace(tail, "[^0-9]", "")))
        return _let(new, lambda t: _refill(value, "[A-Z0-9]", F.concat(country, proof(t), t)))

    return _let(F.replace(value, F.lit(" "), F.lit("")), moved)


def _moved_card(key: str, value: Column, digits: Column) -> Column:
    """Other digits; the check digit follows."""
    body = permute_text(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    check = lambda b: F.pmod(10 - F.pmod(_luhn(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _let(body, lambda b: _refill(value, "[0-9]", F.concat(b, check(b))))


def _moved_phone(key: str, value: Column) -> Column:
    """Other digits after the country code, which stays."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3})[ .(-]", 1)
    own = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _refill(own, "[0-9]", permute_text(key, "phone", F.regexp_replace(own, "[^0-9]", ""))))


def _moved_mail(key: str, value: Column) -> Column:
    """Another name of the same classes of characters; marks and the domain stay."""
    name = F.substring_index(value, "@", 1)
    return _let(name, lambda n: F.concat(_refill(n, "[A-Za-z0-9]", permute_text(key, "mail", F.regexp_replace(n, "[^A-Za-z0-9]", ""))), F.substring(value, F.length(n) + 1, F.length(value))))


def _pseudonym(key: str, value: Column) -> Column:
    """``struct<v, k>`` of a match: its pseudonym and kind, or itself and null if it fails the validation of its kind."""
    made = lambda v, k: F.struct(v.alias("v"), F.lit(k).alias("k"))
    same = F.struct(value.alias("v"), F.lit(None).cast("string").alias("k"))
    shape = F.translate(value, "012345678", "999999999")
    date = _let(_date(value), lambda d: F.when(d["day"].between(0, DAYS - 1), made(_moved_date(key, d), "date")).otherwise(same))
    octets = F.forall(F.split(value, "\\."), lambda x: x.cast("int") <= 255)
    compact = F.replace(value, F.lit(" "), F.lit(""))
    account = F.substring(compact, 3, 2).cast("int").between(2, 98) & (_remainder97(compact) == 1)

    def numbers(digits: Column) -> Column:
        n = F.length(digits)
        # a number as long as a card's and without a plus or bracket was matched as one
        card = (n >= 13) & ~value.startswith("+")
        return (
            F.when(card, F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, made(_moved_card(key, value, digits), "card")).otherwise(same))
            .when(n.between(7, 15), made(_moved_phone(key, value), "phone")).otherwise(same)
        )

    return (
        F.when(value.contains("@"), made(_moved_mail(key, value), "mail"))
        .when(F.ascii(value).between(65, 90), F.when(account, made(_moved_account(key, value), "account")).otherwise(same))
        .when(shape.isin("9999-99-99", "99/99/9999", "99.99.9999"), date)
        .when(shape.rlike(r"^9{1,3}\.9{1,3}\.9{1,3}\.9{1,3}$"), F.when(octets, made(_moved_address(key, value), "address")).otherwise(same))
        .when(shape == "999-99-9999", F.when(value.rlike("^(000|666|9)|-00-|-0000$"), same).otherwise(made(_moved_national(key, F.replace(value, F.lit("-"), F.lit(""))), "national")))
        .otherwise(_let(F.regexp_replace(value, "[^0-9]", ""), numbers))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_changed, kinds``, one row per input row.

    ``kinds`` lists what was replaced, in order.  Null text counts as empty; matches that
    fail validation stay; ids may repeat or be null; other columns are not read.  One pass
    of the matcher marks the matches, of any text of any length.  A mail address keeps its
    domain, an account its country and letters, a phone number its country code; an address
    keeps the number of digits of each part.  Names that differ in case only differ in case only
    afterwards.  The key stands in the plan: keep plans as secret as it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    marked = F.regexp_replace(F.replace("text", F.lit(_MARK), F.lit(_ESCAPED)), ANY, _CUT + "$0" + _CUT)
    # every second piece is a match
    rows = rows.withColumn("__p", F.when(F.col("text").rlike("[0-9@]"), F.split(marked, _CUT, -1)))
    plain = lambda x: F.struct(F.replace(x, F.lit(_ESCAPED), F.lit(_MARK)).alias("v"), F.lit(None).cast("string").alias("k"))
    rows = rows.withColumn("__c", F.when(F.size("__p") > 1, F.transform("__p", lambda x, i: F.when(F.pmod(i, F.lit(2)) == 1, _pseudonym(key, x)).otherwise(plain(x)))))
    kinds = F.coalesce(F.filter(F.transform("__c", lambda c: c["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    whole = F.coalesce(F.array_join(F.transform("__c", lambda c: c["v"]), ""), F.col("text"))
    return rows.select("doc_id", whole.alias("text"), F.size(kinds).cast("long").alias("n_changed"), kinds.alias("kinds"))
