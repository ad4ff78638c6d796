"""Stable identifiers and buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 from built-in sha1."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hash_bucket(value: Column) -> Column:
    """First three hex digits of sha256: 4096 buckets."""
    return F.substring(F.sha2(value, 256), 1, 3)


def fingerprint64(value: Column) -> Column:
    """The first 64 bits of sha256 as a signed long."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, -10).cast("long")


def percent_bucket(value: Column, salt: str = "", buckets: int = 10_000) -> Column:
    """Even buckets from sha256, alike in every engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 12), 16, 10).cast("long") % buckets
