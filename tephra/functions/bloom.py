"""Bloom filters over keys, built and probed in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seeds and constants of the hash (fixed values: stored filters must be readable).
SEED_1, SEED_2 = 0x123456789ABCDEF0, 0x0FEDCBA987654321
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(keys: list[bytes], seed: int) -> np.ndarray:
    """Seeded FNV-1a of many keys: one step a byte position, over all keys that are so long."""
    h = np.full(len(keys), seed ^ FNV_BASIS, np.uint64)
    size = np.array([len(k) for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > i)
            h[rows] = (h[rows] ^ flat[start[rows] + i]) * np.uint64(FNV_PRIME)
    return h


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Bit positions, keys x hashes."""
    one, two = fnv1a(keys, SEED_1), np.maximum(fnv1a(keys, SEED_2), np.uint64(1))
    with np.errstate(over="ignore"):
        return (one[:, None] + np.arange(hashes, dtype=np.uint64) * two[:, None]) % np.uint64(bits)


def build(keys: list[bytes], bits: int, hashes: int) -> bytes:
    out = np.zeros(bits, np.uint8)
    out[positions(keys, bits, hashes).ravel().astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_contain(filter_bytes: bytes, keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    at = positions(keys, bits, hashes).astype(np.int64)
    body = np.frombuffer(filter_bytes, np.uint8)
    return ((body[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build_filters(entries: DataFrame, params: DataFrame) -> DataFrame:
    """run_id, num_bits, num_hashes and bits of each run.

    Every task hashes its own keys into a partial filter of each of its runs, and the partial filters of a run are
    or-ed: no task sees all keys of a run. ``params``: run_id, num_bits, num_hashes, one row a run.
    """
    keyed = entries.select("run_id", "key").join(params.select("run_id", "num_bits", "num_hashes"), "run_id")

    def partial(batches):
        for pdf in batches:
            for (run, bits, hashes), own in pdf.groupby(["run_id", "num_bits", "num_hashes"]):
                # Only bytes in which a bit is set, whatever the filter's size.
                at = np.unique(positions([k.encode() for k in own["key"]], int(bits), int(hashes))).astype(np.int64)
                byte_no, first = np.unique(at >> 3, return_index=True)
                out = pd.DataFrame({"byte_no": byte_no, "byte": np.add.reduceat(np.int64(1) << (at & 7), first)})
                yield out.assign(run_id=run, num_bits=bits, num_hashes=np.int32(hashes))[["run_id", "num_bits", "num_hashes", "byte_no", "byte"]]

    parts = keyed.mapInPandas(partial, "run_id long, num_bits long, num_hashes int, byte_no long, byte long")
    return parts.groupBy("run_id", "num_bits", "num_hashes", "byte_no").agg(F.bit_or("byte").cast("long").alias("byte"))


def probe(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """keys: run_id, key. Adds ``may_contain``: a key's bits are looked up in the filters' bytes, which are rows."""

    @F.pandas_udf("array<long>")
    def bits_of(key: pd.Series, bits: pd.Series, hashes: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(key), index=key.index, dtype=object)
        for (b, h), own in key.groupby([bits, hashes]):
            for i, at in zip(own.index, positions([k.encode() for k in own], int(b), int(h)).astype(np.int64)):
                out[i] = at
        return out

    sizes = filters.select("run_id", "num_bits", "num_hashes").distinct()
    asked = keys.select("run_id", "key").distinct().join(sizes, "run_id").withColumn("bit", F.explode(bits_of("key", "num_bits", "num_hashes")))
    asked = asked.withColumn("byte_no", F.shiftright("bit", 3))
    hit = F.expr("shiftright(coalesce(byte, 0), cast(bit % 8 as int)) & 1")
    return asked.join(filters.select("run_id", "byte_no", "byte"), ["run_id", "byte_no"], "left").groupBy("run_id", "key").agg((F.min(hit) == 1).alias("may_contain"))
