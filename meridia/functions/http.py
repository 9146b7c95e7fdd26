"""Validators and signatures of HTTP messages, as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_tag(body: Column, encoded: Column) -> Column:
    """Quoted CRC-32 and length of the plain body in hex; compressed forms say so."""
    raw = body.cast("binary")
    crc = F.lpad(F.lower(F.hex(F.crc32(raw))), 8, "0")
    size = F.lower(F.hex(F.octet_length(raw).cast("long")))
    return F.concat(F.lit('"'), crc, F.lit("-"), size, F.when(encoded, "-gz").otherwise(""), F.lit('"'))


def not_modified(if_none_match: Column, tag: Column) -> Column:
    """Weak comparison of a list of tags with one; an absent header matches nothing, ``*`` everything."""
    def opaque(x):
        return F.regexp_replace(F.trim(x), "^W/", "")
    hit = F.exists(F.split(if_none_match, ","), lambda x: (F.trim(x) == "*") | (opaque(x) == opaque(tag)))
    return F.coalesce(hit, F.lit(False))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """RFC 2104 with built-in functions. The padded key is a literal, so the plan's text holds it."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")

    def keyed(pad: int, x: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.unhex(F.lit(bytes(b ^ pad for b in block).hex())), x), 256))

    return keyed(0x5C, keyed(0x36, message.cast("binary")))


def webhook_signature(key: bytes, event_id: Column, seconds: Column, body: Column) -> Column:
    """``v1,`` and the base64 signature of id, time and body joined by dots."""
    return F.concat(F.lit("v1,"), F.base64(hmac_sha256(key, F.concat_ws(".", event_id, seconds.cast("string"), body))))
