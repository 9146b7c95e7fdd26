"""Policy predicates as boolean columns, compiled from bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def admits(c: Column, exact=None, one_of=None, low=None, high=None) -> Column:
    """Any value, one value, one of some, or an inclusive range with open ends."""
    if exact is not None:
        return c == exact
    if one_of is not None:
        return c.isin(*one_of)
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    return out & (c <= high) if high is not None else out


def fits_box(w: Column, h: Column, long: int, short: int) -> Column:
    """Orientation does not matter."""
    return (F.greatest(w, h) <= long) & (F.least(w, h) <= short)


def rate_at_most(num: Column, den: Column, limit_num: int, limit_den: int) -> Column:
    """num/den <= limit, by cross products."""
    return num.cast("long") * limit_den <= F.lit(limit_num).cast("long") * den


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose column is true, or null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def origin_matches(origin: Column, pattern: str) -> Column:
    """An exact origin, or ``*.`` one label and ``**.`` any labels below a host; default ports are left out."""
    scheme, _, host = pattern.partition("://")
    plain = F.regexp_replace(F.regexp_replace(F.lower(origin), "^(https://[^:]*):443$", "$1"), "^(http://[^:]*):80$", "$1")
    if host.startswith("**."):
        return plain.startswith(scheme + "://") & plain.endswith(host[2:]) & (F.length(plain) > len(scheme) + 3 + len(host[2:]))
    if host.startswith("*."):
        label = F.substring(plain, len(scheme) + 4, 10_000)
        return plain.startswith(scheme + "://") & label.endswith(host[1:]) & label.rlike(r"^[^.]+\.") & (F.size(F.split(label, r"\.")) == host.count(".") + 1)
    return plain == pattern.lower()


def policy_valid(segment: Column, part: Column, cap: Column, early: Column, late: Column) -> Column:
    """Caps are not below targets, parts not above segments, tolerances below the cap."""
    return (cap >= segment) & (part <= segment) & (early + late < cap)


def health(idle_source: Column, idle_media: Column, stall) -> Column:
    """running, stalled:source or stalled:media."""
    return F.when(idle_media <= stall, "running").when(idle_source > stall, "stalled:source").otherwise("stalled:media")
