"""Row and field formats: how values are packed to text or bytes and unpacked again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S


@dataclass(frozen=True)
class Field:
    """A field format: its name, its argument (width, separator, or none), and the Spark type of its values."""

    name: str
    arg: str | int | None = None

    # --- names ----------------------------------------------------------------------
    @staticmethod
    def read(text: str) -> Field:
        """Parse a format name such as ``IntAsc``, ``IntAsc0 5`` or ``YYYYsMMsDD '-'``."""
        name, _, rest = text.strip().partition(" ")
        if name not in TYPES:
            raise ValueError(f"no field format {name!r}")
        rest = rest.strip()
        if name in ("IntAsc0", "FixAsc"):
            return Field(name, int(rest))
        if name in ("YYYYsMMsDD", "DDsMMsYYYY"):
            return Field(name, rest.strip("'\"") or "-")
        return Field(name)

    def show(self) -> str:
        return self.name if self.arg is None else f"{self.name} {self.arg!r}" if isinstance(self.arg, str) else f"{self.name} {self.arg}"

    @property
    def type(self) -> T.DataType:
        return TYPES[self.name]

    # --- text -----------------------------------------------------------------------
    def unpack(self, text: Column) -> Column:
        """The value of a text field; null if it does not parse."""
        n = self.name
        if n in ("IntAsc", "IntAsc0"):
            return S.read_int(text)
        if n == "DoubleAsc":
            return S.read_double(text)
        if n == "YYYYsMMsDD":
            return S.parse_date(text, self.arg)
        if n == "DDsMMsYYYY":
            return S.parse_date(text, self.arg, day_first=True)
        if n == "FixAsc":
            return F.when(F.length(text) == self.arg, text)
        if n == "VarAsc":
            return text
        if n == "Nil":
            return F.lit(None).cast("void")
        raise ValueError(f"{n} is a binary format")

    def pack(self, value: Column) -> Column:
        """The text of a value; null if it does not fit the format."""
        n = self.name
        if n == "IntAsc0":
            return S.show_int_pad(value, self.arg)
        if n == "YYYYsMMsDD":
            return S.show_date(value, self.arg)
        if n == "DDsMMsYYYY":
            return S.show_date(value, self.arg, day_first=True)
        if n == "FixAsc":
            return F.when(F.length(value) == self.arg, value)
        if n == "Nil":
            return F.lit("")
        return value.cast("string")


# The field formats and the types that hold their values.
TYPES: dict[str, T.DataType] = {
    "Nil": T.NullType(),
    "Word8be": T.ShortType(), "Word16be": T.IntegerType(), "Word32be": T.LongType(), "Word64be": T.DecimalType(20, 0),
    "Int8be": T.ByteType(), "Int16be": T.ShortType(), "Int32be": T.IntegerType(), "Int64be": T.LongType(),
    "Float32be": T.FloatType(), "Float64be": T.DoubleType(),
    "IntAsc": T.LongType(), "IntAsc0": T.LongType(), "DoubleAsc": T.DoubleType(),
    "YYYYsMMsDD": T.DateType(), "DDsMMsYYYY": T.DateType(), "FixAsc": T.StringType(), "VarAsc": T.StringType(),
}
WIDTHS = {"Word8be": 1, "Int8be": 1, "Word16be": 2, "Int16be": 2, "Word32be": 4, "Int32be": 4, "Float32be": 4, "Word64be": 8, "Int64be": 8, "Float64be": 8}


def unpack_be(field: str, raw: Column) -> Column:
    """The value of a big-endian binary field."""
    bits = 8 * WIDTHS[field]
    if field.startswith("Float"):
        return _float_of_bits(_unsigned(raw), 32 if bits == 32 else 64)
    value = _unsigned(raw)
    if field.startswith("Word"):
        return value.cast(TYPES[field])
    half, full = _wide(1 << (bits - 1)), _wide(1 << bits)
    return F.when(value >= half, value - full).otherwise(value).cast(TYPES[field])


def pack_be(field: str, value: Column) -> Column:
    """The big-endian bytes of an integer."""
    bits = 8 * WIDTHS[field]
    wide = value.cast("decimal(20,0)")
    wide = F.when(wide < 0, wide + _wide(1 << bits)).otherwise(wide)
    return F.unhex(F.lpad(F.conv(wide.cast("string"), 10, 16), bits // 4, "0"))


def _wide(n: int) -> Column:
    """A literal that may need more than 63 bits."""
    return F.lit(str(n)).cast("decimal(20,0)")


def _unsigned(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")


def _float_of_bits(n: Column, bits: int) -> Column:
    """A binary floating-point number from its bits: sign, exponent, fraction."""
    e_bits, f_bits = (8, 23) if bits == 32 else (11, 52)
    dec = _wide
    sign = F.when(n >= dec(1 << (bits - 1)), -1.0).otherwise(1.0)
    rest = F.pmod(n, dec(1 << (bits - 1)))
    e = F.floor(rest / dec(1 << f_bits)).cast("int")
    f = F.pmod(rest, dec(1 << f_bits)).cast("double") / float(1 << f_bits)
    bias, top = (1 << (e_bits - 1)) - 1, (1 << e_bits) - 1
    normal = (1 + f) * F.pow(F.lit(2.0), e - bias)
    return sign * F.when(e == 0, f * F.pow(F.lit(2.0), F.lit(1 - bias))).when((e == top) & (f == 0), F.lit(float("inf"))).when(e == top, F.lit(float("nan"))).otherwise(normal)


# --- compound ------------------------------------------------------------------------
def pack_sep(sep: str, fields: list[Field], values: list[Column]) -> Column:
    """Fields joined by a separator, which cannot be escaped; null if one does not fit."""
    parts = [f.pack(v) for f, v in zip(fields, values, strict=True)]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.concat_ws(sep, *parts))


def unpack_sep(sep: str, fields: list[Field], text: Column) -> Column:
    """A struct ``_1 .. _n`` of separated fields; null if their number or one of them is wrong."""
    parts = F.split(text, "\\Q" + sep + "\\E", -1)
    values = [f.unpack(F.get(parts, F.lit(i))) for i, f in enumerate(fields)]
    ok = F.size(parts) == len(fields)
    for v, f in zip(values, fields, strict=True):
        if f.name != "Nil":
            ok = ok & v.isNotNull()
    return F.when(ok, F.struct(*(v.alias(f"_{i + 1}") for i, v in enumerate(values))))


def pack_app(fields: list[Field], values: list[Column]) -> Column:
    """Fields with nothing between."""
    return F.concat(*(f.pack(v) for f, v in zip(fields, values, strict=True)))


def pack_maybe(sentinel: str, packed: Column, value: Column) -> Column:
    return F.when(value.isNull(), F.lit(sentinel)).otherwise(packed)


def unpack_maybe(sentinel: str, text: Column, unpacked: Column) -> Column:
    return F.when(text == sentinel, F.lit(None)).otherwise(unpacked)


def pack_object(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields that have a value."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def quoted(text: Column) -> Column:
    """A string in double quotes, with quotes, backslashes and control characters escaped."""
    out = text
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), out, F.lit('"'))


def ascii_default(value: Column, kind: T.DataType) -> Column:
    """The default text of a value: numbers in decimal, strings quoted, dates as YYYY-MM-DD."""
    if isinstance(kind, T.StringType):
        return quoted(value)
    if isinstance(kind, T.DateType):
        return S.string_of_date(value)
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")
