"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits are cut into two segments of 32 bits; in one segment they
differ in at most one bit. So each segment is indexed under 32 keys, each with one bit taken out, and fingerprints
that share a key are compared. Only distinct fingerprints are indexed: copies are one row there. A key under which
very many distinct fingerprints lie is indexed a second time by the halves of the other segment, and a third time by the
halves of the rest, which is exact for the same reason. Fingerprints under a key of the third index agree in 53 bits, so
at most 2,048 lie there, however many rows there are.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_merge, discard, map_texts, written

#: Words in a shingle, and most differing bits of a link. The index finds all pairs of up to MAX_DISTANCE differing bits:
#: of two segments one then differs in at most one bit.
SHINGLE = 3
DISTANCE = 2
MAX_DISTANCE = 3
SEED = 42
#: Distinct fingerprints under one key from which the key is indexed a second or third time.
HOT_KEY = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between white space, A-Z lower-cased."""
    return text.encode().translate(_LOWER).split() if text else []


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles in order, repeats included; of fewer words one hash of them all, of none an empty array."""
    h = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) < shingle:
        return np.array([h(flat, SEED)] if words else [], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    return np.array([h(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        set_in += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words (or null)."""
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (signed long with the fingerprint's bits) of every row; a null text counts as one without words."""
    kind = dict(docs.dtypes)[key]

    def make():
        def run(batch: pa.RecordBatch):
            return {"key": batch.column(0), "fp": np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)}

        return run

    return map_texts(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"key {kind}, fp long").withColumnRenamed("key", key)


def _segment_keys(df: DataFrame, value: str, lows: list[int], bits: int, names: list[str]) -> DataFrame:
    """A row for each segment (its lowest bit in ``lows``) and each of its ``bits`` bits taken out: segment, bit, what is left."""
    segment, bit, left = names
    part = lambda low: F.shiftrightunsigned(F.col(value), low).bitwiseAND(F.lit((1 << bits) - 1))
    rows = df.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(low).alias("low"), part(low).alias("v")) for low in lows])))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    return rows.select(*df.columns, F.col("_s.low").alias(segment), F.col("_b").alias(bit), F.col("_s.v").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, _b)"))).alias(left))


def links(distinct: DataFrame, hot_key: int = HOT_KEY, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, of distinct fingerprints (column fp) that differ in at most ``distance`` bits; each pair once.

    Each pair is emitted under the first key that it shares, so none comes twice from the plain index. Pairs from the
    second index are made distinct.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the index finds pairs of at most {MAX_DISTANCE} differing bits")
    # Each fingerprint becomes 64 rows: they are dealt out before, as the table itself lies in few files. They are dealt
    # by a hash, not by fp: after a grouping by fp Spark would leave that out, and its own exchange shrinks to few tasks.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = ["seg", "bit", "rest"]
    shared = written(_hot_counted(_segment_keys(distinct.repartition(tasks, F.xxhash64("fp")), "fp", [0, 32], 32, on), on), "simhash-keys")
    near = lambda: F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance

    def pairs(rows: DataFrame, by: list[str], first) -> DataFrame:
        x, y = rows.withColumnRenamed("fp", "a").alias("x"), rows.withColumnRenamed("fp", "b").alias("y")
        cond = F.col("a") < F.col("b")
        for c in by:
            cond = cond & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        return x.join(by_merge(y), cond & near() & first).select("a", "b")

    diff = F.col("a").bitwiseXOR(F.col("b"))
    low, high = diff.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(diff, 32)
    seg, bit = F.col("x.seg"), F.col("x.bit")
    here = F.when(seg == 0, low).otherwise(high)
    # The first key of a pair: the low segment if it differs in at most one bit there; that bit, or bit 0 if none differs.
    first = ((seg == 0) | (F.bit_count(low) > 1)) & F.when(here == 0, bit == 0).otherwise(F.expr("shiftleft(1L, x.bit)") == here)
    plain = pairs(shared.where(F.col("n") <= hot_key).drop("n"), on, first)
    hot = shared.where(F.col("n") > hot_key).drop("n")
    if hot.isEmpty():
        return plain
    # The halves of the other segment, then of the half that isn't shared: one of two halves again differs in at most one bit.
    by2, by3 = [*on, "quarter", "bit2", "rest2"], [*on, "quarter", "bit2", "rest2", "eighth", "bit3", "rest3"]
    second = _all([_segment_keys(hot.where(F.col("seg") == s), "fp", [32 - s, 48 - s], 16, by2[3:]) for s in (0, 32)])
    second = written(_hot_counted(second, by2), "simhash-second")
    deep = second.where(F.col("n") > hot_key).drop("n")
    third = _all([_segment_keys(deep.where(F.col("quarter") == q), "fp", [o, o + 8], 8, by3[6:]) for q, o in ((0, 16), (16, 0), (32, 48), (48, 32))])
    again = pairs(second.where(F.col("n") <= hot_key).drop("n"), by2, first).unionByName(pairs(third, by3, first))
    return plain.unionByName(again.distinct())


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _hot_counted(keyed: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``keyed`` with the number n of rows under their key; rows under keys that one fingerprint alone has are gone."""
    return keyed.join(by_merge(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)), on)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches, as a signed long) of every node of ``edges`` (a, b).

    Rounds of large-star and small-star: each links a node's neighbours to the least of them, until no edge changes.
    Every round is written to the shared folder, so a lost executor costs a round at most.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        # both: (u, v) directed. Each v that is larger (large) or not larger (small) than u is linked to the least of u and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = both.where(F.col("v") > F.col("u")) if large else both.where(F.col("v") < F.col("u"))
        out = kept.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.where(F.col("m") < F.col("u")).select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def stamp(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = stamp(current)
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True)
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        last, current = current, written(small, "edges")
        now = stamp(current)
        discard(last)  # the new round stands in the shared folder
        if now == before:
            break
        before = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY, distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (least key reachable over links of at most ``distance`` differing bits) of every row.

    A null or wordless text has fingerprint zero and is linked like any other. Rows with equal fingerprints are one
    class; classes are linked, not rows. A null key is never a component's least key unless all of its keys are null.
    Repeated rows stay. An empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, key, text), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = components(links(classes.select("fp"), hot_key, distance))
    of_class = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "root").select(F.col("fp").alias("class"), "component_id")
    # A class with a third of all rows: its one row here is copied under 16 salts and the rows are dealt out over them.
    salts = 16
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = fps.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return rows.join(by_merge(named), (rows.fp == named["class"]) & (rows.salt == named.salt)).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with the least key of their component; of rows that repeat that key one stays. Columns stay.

    Rows with a null key can't be named by a component: they are left out of the comparison, and one of each text stays.
    """
    named = docs.where(F.col(key).isNotNull())
    keep = near_duplicates(named, key, text, distance=distance).select(F.col("component_id").alias("_keep")).distinct()
    rows = named.join(by_merge(keep), F.col(key) == F.col("_keep"), "left_semi").dropDuplicates([key])
    return rows.unionByName(docs.where(F.col(key).isNull()).dropDuplicates([text]))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
