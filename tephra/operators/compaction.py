"""Compaction: which runs are merged, what the merge keeps, and what a job cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bloom_bits, bloom_hashes, entry_size
from ..model import EngineError, Status
from .resolve import latest


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Newest version of each key of all runs; tombstones stay."""
    return latest(reduce(DataFrame.unionByName, [r.select("key", "value", "seq_no", "is_tombstone") for r in runs]))


def run_metadata(entries: DataFrame, rate: float = 0.01) -> DataFrame:
    """A manifest row for each run_id: id, key and sequence bounds, entries, size and filter sizes; position 0 is the newest."""
    meta = entries.groupBy("run_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq_no").alias("min_seq_no"), F.max("seq_no").alias("max_seq_no"),
        F.count(F.lit(1)).alias("num_entries"), F.sum(entry_size()).alias("file_size"), F.count_if("is_tombstone").alias("tombstones"),
    )
    newest_first = Window.orderBy(F.col("id").desc())  # one row a run
    placed = meta.withColumnRenamed("run_id", "id").withColumn("position", (F.row_number().over(newest_first) - 1).cast("int"))
    return placed.withColumn("num_bits", bloom_bits(F.col("num_entries"), F.lit(rate))).withColumn("num_hashes", bloom_hashes(F.lit(rate)))


def pick(tables: DataFrame, fan_in: int, ratio: float, by: str | None = None) -> DataFrame:
    """ordinal (from 1) and id of the runs to merge, empty if there are too few.

    tables: id, file_size and perhaps busy; manifest-sized, in ``by`` separate manifests. Sorted by size and newest id,
    the first window of ``fan_in`` runs whose largest is at most ``ratio`` times its smallest wins, else the smallest.
    """
    fan_in = max(2, fan_in)
    free = tables.where(~F.col("busy")) if "busy" in tables.columns else tables
    group = [by] if by else []
    free = free.select(*group, "id", F.greatest(F.col("file_size"), F.lit(1)).alias("_size"), F.col("file_size").alias("_raw"))
    order = Window.partitionBy(*group).orderBy("_raw", F.col("id").desc())
    ranked = free.withColumn("_pos", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(order.rowsBetween(0, fan_in - 1))).withColumn("_largest", F.last("_size").over(order.rowsBetween(0, fan_in - 1)))
    fits = (F.col("_n") == fan_in) & (F.col("_largest").cast("double") <= F.col("_size").cast("double") * ratio)
    every = Window.partitionBy(*group)
    chosen = ranked.withColumn("_first", F.coalesce(F.min(F.when(fits, F.col("_pos"))).over(every), F.lit(1))).withColumn("_all", F.count(F.lit(1)).over(every))
    return chosen.where((F.col("_all") >= fan_in) & (F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_first") + fan_in)).select(*group, (F.col("_pos") - F.col("_first") + 1).alias("ordinal"), "id")


def compaction_due(manifest: DataFrame, trigger: int, running: int = 0, max_concurrent: int = 1, paused: bool = False) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("runs")).select("runs", (F.lit(not paused and running < max_concurrent) & (F.col("runs") >= trigger)).alias("due"))


def validate_inputs(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """id and error of each asked id that can't be merged: unknown or busy. ``ids``: id; ``manifest`` may have busy."""
    busy = F.coalesce(F.col("busy"), F.lit(False)) if "busy" in manifest.columns else F.lit(False)
    known = manifest.select(F.col("id"), busy.alias("_busy"), F.lit(True).alias("_known"))
    error = F.when(F.col("_known").isNull(), Status.INVALID_ARGUMENT.value).when(F.col("_busy"), Status.CONFLICT.value)
    return ids.select("id").distinct().join(known, "id", "left").select("id", error.alias("error")).where(F.col("error").isNotNull())


def check_inputs(manifest: DataFrame, ids: list[int]) -> None:
    """Raise unless at least two different known, free runs are asked for."""
    if len(set(ids)) < 2:
        raise EngineError(Status.INVALID_ARGUMENT, "a compaction needs at least two runs")
    bad = validate_inputs(manifest, manifest.sparkSession.createDataFrame([(i,) for i in ids], "id long")).collect()
    if bad:
        raise EngineError(Status(bad[0]["error"]), f"run {bad[0]['id']}")


def replace_in_manifest(tables: list, inputs: list[int], output) -> list:
    """The table list (newest first) after a merge: the output takes the place of the newest input. ``tables`` and ``output`` have an id."""
    if not set(inputs) <= {t["id"] for t in tables}:
        raise EngineError(Status.CONFLICT, "an input has left the manifest")
    at = min(i for i, t in enumerate(tables) if t["id"] in inputs)
    rest = [t for t in tables if t["id"] not in inputs]
    return [*rest[:at], output, *rest[at:]]


def _run_ids(inputs: DataFrame) -> DataFrame:
    """run_id of a job's inputs, broadcast: one number a run. Dealt out by run_id instead, the entries of a run would all meet in one task."""
    return F.broadcast(inputs.select(F.col("id").alias("run_id")))


def compacted(entries: DataFrame, inputs: DataFrame, output_id: int) -> DataFrame:
    """All runs' entries after the runs ``inputs`` (id) are merged into ``output_id``."""
    ids = _run_ids(inputs)
    merged = latest(entries.join(ids, "run_id", "left_semi")).withColumn("run_id", F.lit(output_id).cast("long"))
    return entries.join(ids, "run_id", "left_anti").unionByName(merged, allowMissingColumns=True)


def job_stats(entries: DataFrame, inputs: DataFrame, output_id: int) -> DataFrame:
    """One row: inputs, output, bytes and keys in and out, keys dropped, tombstones kept and dropped."""
    own = entries.join(_run_ids(inputs), "run_id", "left_semi")
    before = own.agg(F.count(F.lit(1)).alias("keys_in"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("bytes_in"))
    after = latest(own).agg(F.count(F.lit(1)).alias("keys_out"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("bytes_out"), F.count_if("is_tombstone").alias("tombstones_kept"))
    ids = inputs.agg(F.array_sort(F.collect_list("id")).alias("inputs"))
    both = before.withColumn("_j", F.lit(1)).join(after.withColumn("_j", F.lit(1)), "_j").join(ids.withColumn("_j", F.lit(1)), "_j")  # single rows
    return both.select(F.concat_ws(",", F.transform("inputs", lambda i: i.cast("string"))).alias("inputs"), F.lit(output_id).cast("long").alias("output"), "bytes_in", "bytes_out", "keys_in", "keys_out", F.greatest(F.col("keys_in") - F.col("keys_out"), F.lit(0)).cast("long").alias("keys_dropped"), "tombstones_kept", F.lit(0).cast("long").alias("tombstones_dropped"))


def wa_ratio(jobs: DataFrame) -> DataFrame:
    """Jobs, bytes in and out and their ratio; null where nothing was read."""
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")).withColumn("ratio", F.try_divide(F.col("bytes_out").cast("double"), F.col("bytes_in").cast("double")))


def throttle_budget(jobs: DataFrame, mb_per_s: int) -> DataFrame:
    """least_ms: how long the output of each job must take at the limit; 0 is no limit."""
    least = F.lit(0).cast("long") if mb_per_s <= 0 else F.floor(F.col("bytes_out") * 1000 / (mb_per_s * 1024 * 1024)).cast("long")
    return jobs.withColumn("least_ms", least)
