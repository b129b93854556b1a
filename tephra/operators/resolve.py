"""Reads: the latest version of keys, over logs, layers and runs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import last_value
from ..model import Status

#: Runs of a manifest that are broadcast at once; a longer manifest is taken in parts of about so many.
RUNS_AT_ONCE = 100_000

_LAST = ["seq_no", "is_tombstone", "value"]


def entries_of(log: DataFrame) -> DataFrame:
    """Log records as entries: key, value (null for a tombstone), seq_no, is_tombstone."""
    dead = F.col("op") == "DEL"
    return log.select("key", F.when(~dead, F.col("value")).alias("value"), "seq_no", dead.alias("is_tombstone"))


def latest(entries: DataFrame) -> DataFrame:
    """One entry for each key, that with the highest seq_no; tombstones stay. Aggregates in each task before the shuffle."""
    return entries.groupBy("key").agg(F.max(F.struct(*_LAST)).alias("e")).select("key", "e.value", "e.seq_no", "e.is_tombstone")


def live(entries: DataFrame) -> DataFrame:
    """The latest entries without tombstones: they are hidden after, never before, versions are resolved."""
    return latest(entries).where(~F.col("is_tombstone")).select("key", "value", "seq_no")


def with_status(found: DataFrame) -> DataFrame:
    """key, status, value: FOUND, TOMBSTONE or NOT_FOUND; ``found`` has nulls in seq_no where there is no entry."""
    status = F.when(F.col("seq_no").isNull(), Status.NOT_FOUND.value).when(F.col("is_tombstone"), Status.TOMBSTONE.value).otherwise(Status.FOUND.value)
    return found.select("key", status.alias("status"), F.when(~F.col("is_tombstone"), F.col("value")).alias("value"))


def get(entries: DataFrame, key: str) -> DataFrame:
    """One row for one key. The filter goes below the aggregate into the scan."""
    spark = entries.sparkSession
    asked = spark.range(1).select(F.lit(key).alias("key"))
    return with_status(asked.join(latest(entries.where(F.col("key") == key)), "key", "left"))


def multi_get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each different key of ``keys``. Only entries of asked keys are resolved; Spark broadcasts the keys where they are few."""
    asked = keys.select("key").distinct()
    return with_status(asked.join(latest(entries.join(asked, "key", "left_semi")), "key", "left"))


def layered_get(layers: DataFrame, keys: DataFrame) -> DataFrame:
    """The answer of the first layer (least ``position``) that holds the key, even if a later layer has a higher seq_no. Adds that position."""
    asked = keys.select("key").distinct()
    hits = layers.join(asked, "key", "left_semi").groupBy("key").agg(F.min(F.struct("position", *_LAST)).alias("e"))
    found = asked.join(hits.select("key", "e.position", "e.value", "e.seq_no", "e.is_tombstone"), "key", "left")
    return with_status(found).join(found.select("key", "position"), "key")


def _met_runs(keys: DataFrame, manifest: DataFrame, cond, how: str, at_once: int) -> DataFrame:
    """``keys`` joined with the manifest's rows by a condition on ranges. Its number of rows is read first: what is broadcast never exceeds about ``at_once`` of them."""
    parts = max(1, -(-manifest.count() // at_once))
    part = F.pmod(F.xxhash64("min_key", "max_key"), F.lit(parts)) if parts > 1 else F.lit(0)
    joined = [keys.join(F.broadcast(manifest.where(part == i)), cond, how) for i in range(parts)]
    return functools.reduce(DataFrame.unionByName, joined)


def prune_runs(manifest: DataFrame, keys: DataFrame, at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """key and id of the runs whose key range holds the key. A manifest has a row a run, which every reader holds anyway: it is broadcast, in parts if it is long."""
    inside = (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))
    return _met_runs(keys.select("key").distinct(), manifest.select("id", "min_key", "max_key"), inside, "inner", at_once).select("key", "id")


def block_lookup(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """run_id, key and block_no for asked pairs (run_id, key): the run's block with the greatest first key that isn't above the key; no row if all are above.

    Blocks and keys are sorted once, and the last block seen before a key is the answer: no key meets all blocks, and a
    large run's index is looked through in ranges.
    """
    asked = keys.select("run_id", "key").distinct()
    both = blocks.select("run_id", F.col("first_key").alias("key"), "block_no", F.lit(0).alias("_asked")).unionByName(asked.select("run_id", "key", F.lit(None).cast("int").alias("block_no"), F.lit(1).alias("_asked")))
    found = last_value(both, "run_id", ["key", "_asked"], F.col("block_no"), "_found", current=True)
    return found.where("_asked = 1 AND _found IS NOT NULL").select("run_id", "key", F.col("_found").alias("block_no"))


def lookup_trace(memory: DataFrame, runs: DataFrame, manifest: DataFrame, keys: DataFrame, at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """key, checked_memtable, sstables_consulted, range_skipped, hit_position (null: not found; -1: in memory).

    Runs are asked newest first up to the first that holds the key; a run whose range can't hold it is skipped.
    """
    asked = keys.select("key").distinct()
    in_memory = memory.select("key", F.lit(-1).alias("_m")).distinct()
    held = runs.join(manifest.select(F.col("id").alias("run_id"), "position"), "run_id").join(asked, "key", "left_semi").groupBy("key").agg(F.min("position").alias("_p"))
    hit = asked.join(in_memory, "key", "left").join(held, "key", "left").select("key", F.coalesce("_m", "_p").cast("int").alias("hit_position"))
    asked_runs = F.col("position") <= F.coalesce("hit_position", F.lit(2**31 - 1))
    seen = _met_runs(hit, manifest.select("position", "min_key", "max_key"), asked_runs, "left", at_once)  # a key without runs in a part has a row of nulls there, which counts as none
    inside = (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))
    return seen.groupBy("key", "hit_position").agg(F.count_if(inside).alias("sstables_consulted"), F.count_if(~inside).alias("range_skipped")).select("key", F.lit(True).alias("checked_memtable"), "sstables_consulted", "range_skipped", "hit_position")
