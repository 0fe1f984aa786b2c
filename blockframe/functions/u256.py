"""Unsigned and signed 256-bit integers as three decimals: value = hi * 10^52 + mid * 10^26 + lo.

Spark's decimals end at 38 digits; amounts need 78. A limb is decimal(26,0). Sums are taken limb by limb and normalised
once, so an aggregate of 10^10 rows stays exact; order and equality are those of the struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_DIGITS = 26
TYPE = "struct<hi:decimal(26,0),mid:decimal(26,0),lo:decimal(26,0)>"
_LIMB, _WIDE = "decimal(26,0)", "decimal(38,0)"
_BASE = 10**BASE_DIGITS
#: Where amounts are cut off: 78 decimal digits.
LIMIT = 10**78 - 1


def _number(value: int, kind: str = _WIDE) -> Column:
    return F.expr(f"cast('{value}' as {kind})")


def _pack(hi: Column, mid: Column, lo: Column) -> Column:
    return F.struct(hi.cast(_LIMB).alias("hi"), mid.cast(_LIMB).alias("mid"), lo.cast(_LIMB).alias("lo"))


def literal(value: int) -> Column:
    """A constant; a negative one has negative limbs."""
    sign, rest = (-1, -value) if value < 0 else (1, value)
    lo, mid, hi = rest % _BASE, rest // _BASE % _BASE, rest // _BASE**2
    return _pack(*(_number(sign * x, _LIMB) for x in (hi, mid, lo)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; expressions that repeat it would grow with every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _carry(hi: Column, mid: Column, lo: Column) -> Column:
    """Limbs of which the lower two are 0 or more; the highest has the sign of the whole."""
    base = _number(_BASE)

    def over(x: Column) -> Column:  # floor division; what is left is a multiple of the base
        return ((x - F.pmod(x, base)).cast(_WIDE) / base).cast(_WIDE)

    def upper(x: Column) -> Column:
        h = (x["hi"] + over(x["mid"])).cast(_WIDE)
        return F.struct(h.alias("hi"), F.pmod(x["mid"], base).cast(_WIDE).alias("mid"), x["lo"].alias("lo"))

    def lower(x: Column) -> Column:
        m = (x["mid"] + over(x["lo"])).cast(_WIDE)
        return _let(F.struct(x["hi"].alias("hi"), m.alias("mid"), F.pmod(x["lo"], base).cast(_WIDE).alias("lo")), upper)

    wide = F.struct(hi.cast(_WIDE).alias("hi"), mid.cast(_WIDE).alias("mid"), lo.cast(_WIDE).alias("lo"))
    return _let(wide, lower)


def normalise(hi: Column, mid: Column, lo: Column) -> Column:
    """Limbs of any size and sign, carried so that all have the sign of the whole and at most 26 digits.

    What needs more than 78 digits is cut off at `LIMIT`.
    """
    base = _number(_BASE)

    def signed(x: Column) -> Column:
        opposite = _carry(-x["hi"], -x["mid"], -x["lo"])
        flipped = _let(opposite, lambda y: F.when(y["hi"] >= base, literal(-LIMIT)).otherwise(_pack(-y["hi"], -y["mid"], -y["lo"])))
        return F.when(x["hi"] >= base, literal(LIMIT)).when(x["hi"] < 0, flipped).otherwise(_pack(x["hi"], x["mid"], x["lo"]))

    return _let(_carry(hi, mid, lo), signed)


def from_hex(text: Column) -> Column:
    """0x-prefixed or bare hex of at most 64 digits; empty is zero, null stays null."""
    digits = F.lpad(F.regexp_replace(text, "^0[xX]", ""), 64, "0")
    hi = mid = lo = _number(0)
    for i in range(8):  # eight 32-bit words from the left
        word = F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")
        power = 1 << (32 * (7 - i))
        hi = hi + (word * _number(power // _BASE**2, _LIMB)).cast(_WIDE)
        mid = mid + (word * _number(power // _BASE % _BASE, _LIMB)).cast(_WIDE)
        lo = lo + (word * _number(power % _BASE, _LIMB)).cast(_WIDE)
    # most amounts are the last two words, which are one limb as they are
    small = F.left(digits, F.lit(48)) == "0" * 48
    low = [F.conv(F.substring(digits, at, 8), 16, 10).cast("decimal(10,0)") for at in (49, 57)]
    short = _pack(_number(0), _number(0), low[0] * _number(1 << 32, "decimal(10,0)") + low[1])
    return F.when(text.isNull(), None).when(small, short).otherwise(normalise(hi, mid, lo))


def from_decimal(text: Column) -> Column:
    """A string of at most 78 decimal digits without a sign; null, or an empty one (unknown), is null."""
    digits = F.lpad(text, 78, "0")
    parts = (F.substring(digits, 1 + BASE_DIGITS * i, BASE_DIGITS).cast(_LIMB) for i in range(3))
    return F.when(text.isNotNull() & (text != ""), _pack(*parts))


def from_number(value: Column) -> Column:
    """A decimal(38,0) or long."""
    return normalise(_number(0), _number(0), value)


def to_decimal(value: Column) -> Column:
    """Decimal digits without leading zeros, with a minus sign where negative; null is empty (unknown)."""
    part = lambda f: F.lpad(F.abs(value[f]).cast("string"), BASE_DIGITS, "0")
    digits = F.regexp_replace(F.concat(part("hi"), part("mid"), part("lo")), "^0+(?=.)", "")
    negative = (value["hi"] < 0) | (value["mid"] < 0) | (value["lo"] < 0)
    return F.when(value.isNull(), "").otherwise(F.concat(F.when(negative, "-").otherwise(""), digits))


def total(value: Column) -> Column:
    """SUM of a column, exact up to `LIMIT`, where it is cut off; null over no values."""
    return F.when(F.count(value) > 0, normalise(*(F.sum(value[f]) for f in ("hi", "mid", "lo"))))


def add(a: Column, b: Column) -> Column:
    return normalise(*((a[f] + b[f]).cast(_WIDE) for f in ("hi", "mid", "lo")))


def negate(a: Column) -> Column:
    return _pack(*(-a[f] for f in ("hi", "mid", "lo")))


def saturate(value: Column) -> Column:
    """At most LIMIT in size."""
    return F.least(F.greatest(value, literal(-LIMIT)), literal(LIMIT))


# --- amounts of either type ----------------------------------------------------------------------------------------
# Aggregates take decimal(38,0) columns, whose sums must stay within 38 digits, or the structs of this module.

NARROW = "decimal(38,0)"


def is_wide(df: DataFrame, name: str) -> bool:
    """Whether a column holds the structs of this module rather than decimals."""
    return isinstance(df.schema[name].dataType, T.StructType)


def zero(wide: bool) -> Column:
    return literal(0) if wide else F.lit(0).cast(NARROW)


def sum_of(value: Column, wide: bool, less: Column | None = None) -> Column:
    """The sum of value, less that of another column; null over no values. Wide sums are cut off at `LIMIT`."""
    if not wide:
        return F.sum((value if less is None else F.coalesce(value, zero(False)) - F.coalesce(less, zero(False))).cast(NARROW)).cast(NARROW)
    if less is None:
        return total(value)
    none = F.lit(0).cast(_LIMB)
    limbs = (F.sum(F.coalesce(value[f], none)) - F.sum(F.coalesce(less[f], none)) for f in ("hi", "mid", "lo"))
    return F.when(F.count("*") > 0, normalise(*limbs))


def plus(a: Column, b: Column, wide: bool) -> Column:
    return add(a, b) if wide else (a + b).cast(NARROW)


def minus(a: Column, wide: bool) -> Column:
    return negate(a) if wide else (-a).cast(NARROW)


def as_double(value: Column) -> Column:
    """The nearest double, or one beside it."""
    hi, mid, lo = (value[f].cast("double") for f in ("hi", "mid", "lo"))
    return hi * float(_BASE) * float(_BASE) + mid * float(_BASE) + lo
