"""Exact media time: integer ticks of rational timebases, never floats.

Products are taken in DECIMAL(38,0), so no 64-bit tick overflows on the way; a
result that does not fit a BIGINT is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _wide(x) -> Column:
    return _c(x).cast("decimal(38,0)")


def _long(x: Column) -> Column:
    return F.when(x.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), x.cast("long"))


def idiv(a, b) -> Column:
    """Integer division truncating toward zero."""
    return F.try_divide(_wide(a) - _wide(a) % _wide(b), _wide(b)).cast("decimal(38,0)")


def _div(a: Column, b: int) -> Column:
    """A long divided by a constant, toward zero."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def floor_div(a, b: int) -> Column:
    """Floor of a long by a positive constant, exact for all longs."""
    a = _c(a)
    return _div(a - F.pmod(a, F.lit(b).cast("long")), b)


def rescale(ticks, num, den, out_num, out_den) -> Column:
    """Ticks of num/den seconds in ticks of out_num/out_den: nearest, halves away from zero."""
    top, bottom = _wide(ticks) * _wide(num) * _wide(out_den), _wide(den) * _wide(out_num)
    size = idiv(F.abs(top) * 2 + bottom, bottom * 2)
    return _long(F.when(top < 0, -size).otherwise(size))


def rescale_floor(ticks, num, den, out_num, out_den) -> Column:
    top, bottom = _wide(ticks) * _wide(num) * _wide(out_den), _wide(den) * _wide(out_num)
    return _long(idiv(top - F.pmod(top, bottom), bottom))


def rescale_ceil(ticks, num, den, out_num, out_den) -> Column:
    top, bottom = _wide(ticks) * _wide(num) * _wide(out_den), _wide(den) * _wide(out_num)
    return _long(idiv(top + F.pmod(-top, bottom), bottom))


def ticks_to_nanos(ticks, num, den) -> Column:
    """Nearest nanosecond, halves up."""
    top, bottom = _wide(ticks) * _wide(num) * NANOS, _wide(den)
    twice = top * 2 + bottom
    return _long(idiv(twice - F.pmod(twice, bottom * 2), bottom * 2))


def telemetry_nanos(ticks, num, den) -> Column:
    """Nanoseconds truncated toward zero."""
    return _long(idiv(_wide(ticks) * _wide(num) * NANOS, _wide(den)))


def target_seconds(nanos) -> Column:
    """Whole seconds, halves up, at least 1."""
    return F.greatest(F.lit(1).cast("long"), _div(_c(nanos).cast("long") + NANOS // 2, NANOS))


def quantum(in_num, in_den, out_num, out_den) -> Column:
    """Output ticks that one input tick can be off by: ceiling, at least 1."""
    top, bottom = _wide(in_num) * _wide(out_den), _wide(in_den) * _wide(out_num)
    return F.greatest(F.lit(1).cast("long"), _long(idiv(top + bottom - 1, bottom)))


def decimal_seconds(nanos) -> Column:
    """Seconds as text: whole, or up to nine digits without trailing zeros."""
    n = _c(nanos).cast("long")
    part = n % NANOS
    whole = _div(n, NANOS).cast("string")
    digits = F.regexp_replace(F.lpad(part.cast("string"), 9, "0"), "0+$", "")
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), digits))


def clock(millis) -> Column:
    """HH:MM:SS.mmm of milliseconds; hours may have more than two digits."""
    m = _c(millis)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    hours, minutes, seconds = (floor_div(m, 3_600_000), floor_div(m, 60_000) % 60, floor_div(m, 1000) % 60)
    return F.concat(two(hours), F.lit(":"), two(minutes), F.lit(":"), two(seconds), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))


def program_date(ns) -> Column:
    """Nanoseconds since 1970 as a program date, in milliseconds."""
    ms = floor_div(ns, 1_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ms, 86_400_000).cast("int")), "yyyy-MM-dd")
    s = F.pmod(ms, F.lit(86_400_000))
    clock = F.concat_ws(":", two(floor_div(s, 3_600_000)), two(floor_div(s, 60_000) % 60), two(floor_div(s, 1000) % 60))
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad((s % 1000).cast("string"), 3, "0"), F.lit("Z"))
