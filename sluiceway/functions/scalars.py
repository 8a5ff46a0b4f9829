"""Scalar functions by the names that plans use, dates, numbers as text, pixels and complex numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def signum(x: Column, kind: str | None = None) -> Column:
    out = F.signum(x)
    return out.cast(kind) if kind else out


def string_of_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def row(*xs: Column) -> Column:
    """A tuple with fields ``_1`` to ``_n``."""
    return F.struct(*(x.alias(f"_{i + 1}") for i, x in enumerate(xs)))


def get(k: int, x: Column) -> Column:
    return x.getField(f"_{k}")


#: Scalar operators by the names they have in JSON plans.
OPERATORS: dict[str, Callable[..., Column]] = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "signum": signum,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "row": row,
    "string_of_date": string_of_date,
    "year_of_date": F.year,
    "month_of_date": F.month,
    "day_of_date": F.dayofmonth,
}


# --- dates ---------------------------------------------------------------------------
def next_day(d: Column) -> Column:
    return F.date_add(d, 1)


def diff_days(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)


def pack_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def packed_date32(d: Column) -> Column:
    """Year, month and day in 16, 8 and 8 bits."""
    return F.shiftleft(F.year(d), 16).bitwiseOR(F.shiftleft(F.month(d), 8)).bitwiseOR(F.dayofmonth(d))


def unpacked_date32(n: Column) -> Column:
    return F.make_date(F.shiftright(n, 16), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255))


def date_range(a: Column, b: Column) -> Column:
    """All dates from a to b, both included; empty if b is before a."""
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))


def parse_date(text: Column, sep: str, day_first: bool = False) -> Column:
    """A date from ``YYYYsMMsDD`` or ``DDsMMsYYYY``; null if it is none."""
    quoted = f"'{sep}'" if sep.isalpha() else sep
    pattern = quoted.join(("dd", "MM", "yyyy") if day_first else ("yyyy", "MM", "dd"))
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def show_date(d: Column, sep: str, day_first: bool = False) -> Column:
    quoted = f"'{sep}'" if sep.isalpha() else sep
    return F.date_format(d, quoted.join(("dd", "MM", "yyyy") if day_first else ("yyyy", "MM", "dd")))


# --- numbers as text -----------------------------------------------------------------
def read_int(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def show_int_pad(n: Column, width: int) -> Column:
    """Decimal digits, padded with zeros to the width, never cut."""
    digits = F.abs(n).cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return F.when(n < 0, F.concat(F.lit("-"), padded)).otherwise(padded)


def read_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def show_double_fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def bits_of_double(x: Column) -> Column:
    """The 64 bits of a double as a long, from its sign, exponent and fraction; normal numbers and zero."""
    mag = F.abs(x)
    e = F.floor(F.log2(mag)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e) > mag, e - 1).when(F.pow(F.lit(2.0), e + 1) <= mag, e + 1).otherwise(e)
    fraction = ((mag / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("long")
    whole = F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(fraction)
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.when(x < 0, whole.bitwiseOR(F.lit(-(1 << 63)).cast("long"))).otherwise(whole))


# --- complex numbers and pixels --------------------------------------------------------
def mag(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def arg(re: Column, im: Column) -> Column:
    """Phase in [-pi, pi]."""
    return F.atan2(im, re)


def ramp_hot_to_cold(low: Column, high: Column, x: Column) -> Column:
    """A colour (r, g, b) from cold (blue) at ``low`` to hot (red) at ``high``."""
    x = F.least(F.greatest(x, low), high)
    span, quarter = high - low, (high - low) / 4
    one, zero = F.lit(1.0), F.lit(0.0)
    rgb = lambda r, g, b: F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))
    return (
        F.when(x < low + quarter, rgb(zero, 4 * (x - low) / span, one))
        .when(x < low + 2 * quarter, rgb(zero, one, 1 + 4 * (low + quarter - x) / span))
        .when(x < low + 3 * quarter, rgb(4 * (x - low - 2 * quarter) / span, one, zero))
        .otherwise(rgb(one, 1 + 4 * (low + 3 * quarter - x) / span, zero))
    )


def rms_of_rgb8(r: Column, g: Column, b: Column) -> Column:
    s = lambda c: (c / 255) * (c / 255)
    return F.sqrt((s(r) + s(g) + s(b)) / 3)


def luminance_of_rgb8(r: Column, g: Column, b: Column) -> Column:
    return r / 255 * 0.3 + g / 255 * 0.59 + b / 255 * 0.11


def byte_of_unit(x: Column) -> Column:
    """A value of 0 to 1 as a byte, truncated."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
