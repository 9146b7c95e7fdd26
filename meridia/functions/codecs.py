"""Codec strings of RFC 6381 from decoder configurations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(c: Column, i: int) -> Column:
    """The byte at a place, 0 to 255; null beyond the end."""
    return F.when(F.length(c) > i, F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10).cast("int"))


def h264(config: Column) -> Column:
    """``avc1.`` and profile, constraints and level of an avcC record, else of the first parameter set behind a start code."""
    record = F.when((F.length(config) >= 4) & (byte(config, 0) == 1), F.substring(F.hex(config), 3, 6))
    stream = F.regexp_extract(F.hex(config), "^(?:..)*?000001[02468ACE]7(......)", 1)
    return F.concat(F.lit("avc1"), F.coalesce(F.concat(F.lit("."), F.lower(F.coalesce(record, F.nullif(stream, F.lit(""))))), F.lit("")))


def hevc(config: Column) -> Column:
    """``hvc1.``, profile space and profile, compatibility bits reversed, tier and level, and the constraint
    bytes up to the last that is not zero; the bare name for a record that is too short."""
    first, digits = byte(config, 1), F.hex(config)
    space = F.element_at(F.array(*[F.lit(x) for x in ("", "A", "B", "C")]), F.shiftright(first, 6) + 1)
    bits = F.reverse(F.lpad(F.conv(F.substring(digits, 5, 8), 16, 2), 32, "0"))
    tier = F.when(first.bitwiseAND(32) == 0, "L").otherwise("H")
    constraints = F.regexp_replace(F.regexp_extract(F.substring(digits, 13, 12), "^((?:..)*?)(?:00)*$", 1), "(..)", ".$1")
    whole = F.concat(F.lit("hvc1."), space, first.bitwiseAND(31).cast("string"), F.lit("."), F.conv(bits, 2, 16), F.lit("."), tier, byte(config, 12).cast("string"), constraints)
    return F.when(F.length(config) >= 23, whole).otherwise("hvc1")


def av1(config: Column) -> Column:
    """``av01.`` and profile, level, tier and depth of an av1C record; null where it is none."""
    second, third = byte(config, 1), byte(config, 2)
    profile, high, twelve = F.shiftright(second, 5), third.bitwiseAND(64) != 0, third.bitwiseAND(32) != 0
    fine = (F.length(config) >= 4) & (byte(config, 0) == 0x81) & (profile <= 2) & (~twelve | ((profile == 2) & high))
    depth = F.when(twelve, "12").when(high, "10").otherwise("08")
    tier = F.when(third.bitwiseAND(128) == 0, "M").otherwise("H")
    return F.when(fine, F.concat(F.lit("av01."), profile.cast("string"), F.lit("."), F.lpad(second.bitwiseAND(31).cast("string"), 2, "0"), tier, F.lit("."), depth))


def aac(config: Column) -> Column:
    """``mp4a.40.`` and the object type that the configuration begins with; 2 for none."""
    kind = F.shiftright(byte(config, 0), 3)
    longer = 32 + F.shiftleft(byte(config, 0).bitwiseAND(7), 3) + F.shiftright(byte(config, 1), 5)
    kind = F.when((kind == 31) & longer.isNotNull(), longer).otherwise(kind)
    return F.concat(F.lit("mp4a.40."), F.coalesce(F.nullif(kind, F.lit(0)), F.lit(2)).cast("string"))


def codec_string(codec: Column, config: Column) -> Column:
    """The codec string of a track; null for codecs that have none."""
    plain = {"flac": "fLaC", "opus": "opus", "webvtt": "wvtt", "mov_text": "tx3g"}
    out = F.when(codec == "h264", h264(config)).when(codec == "hevc", hevc(config)).when(codec == "av1", av1(config)).when(codec == "aac", aac(config))
    for name, value in plain.items():
        out = out.when(codec == name, F.lit(value))
    return out
