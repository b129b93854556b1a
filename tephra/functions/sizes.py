"""Sizes as column expressions; all count bytes of UTF-8."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ENTRY_OVERHEAD, RECORD_OVERHEAD


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entry_size(key: Column | str = "key", value: Column | str = "value", overhead: int = ENTRY_OVERHEAD) -> Column:
    """Bytes of an entry in memory; a null value counts as an empty one."""
    return (F.octet_length(_col(key)) + F.octet_length(F.coalesce(_col(value), F.lit(""))) + overhead).cast("long")


def record_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a log record."""
    return entry_size(key, value, RECORD_OVERHEAD)


def _bits_per_key(rate: Column) -> Column:
    return -F.log(F.greatest(F.lit(1e-6), F.least(F.lit(0.5), rate))) / (math.log(2) * math.log(2))


def bloom_bits(n: Column, rate: Column) -> Column:
    """Bits of a filter for n keys: at least 64, whole bytes."""
    bits = F.greatest(F.lit(64), F.ceil(F.greatest(n, F.lit(1)) * _bits_per_key(rate)).cast("long"))
    return (F.floor((bits + 7) / 8) * 8).cast("long")


def bloom_hashes(rate: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(1), F.round(math.log(2) * _bits_per_key(rate)))).cast("int")
