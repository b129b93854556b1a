"""Reports over logs, memory tables, runs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import ordered_prefix
from ..functions.sizes import entry_size
from .resolve import latest


def memtable_scan(entries: DataFrame) -> DataFrame:
    """ordinal (from 1, in key order), key, value, seq_no, is_tombstone of the newest versions."""
    return ordered_prefix(latest(entries), ["key"], "ordinal")


def memtable_dump(layered: DataFrame) -> DataFrame:
    """layered: layer (0 active, then frozen ones oldest first), entries. One row for each key of each layer with its size."""
    newest = layered.groupBy("layer", "key").agg(F.max(F.struct("seq_no", "is_tombstone", "value")).alias("e")).select("layer", "key", "e.*")
    ordinal = F.row_number().over(Window.partitionBy("layer").orderBy("key"))  # a layer is bounded by the memory table's limit
    return newest.select("layer", ordinal.alias("ordinal"), "key", "value", "seq_no", "is_tombstone", entry_size().alias("size_bytes"))


def version_info(layered: DataFrame) -> DataFrame:
    """layered: kind, part, key, value. kind, parts, entries and bytes."""
    return layered.groupBy("kind").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("entries"), F.sum(entry_size()).alias("bytes"))


def list_runs(manifest: DataFrame) -> DataFrame:
    columns = ["position", "id", "file_name", "min_key", "max_key", "min_seq_no", "max_seq_no", "num_entries", "file_size"]
    return manifest.select(*columns, F.sum("file_size").over(Window.partitionBy()).alias("total_size"))


def manifest_info(manifest: DataFrame, epoch: int, version: int = 1) -> DataFrame:
    """One row: version, epoch, next run id, watermark, tables, entries and bytes."""
    return manifest.agg(F.lit(version).alias("manifest_version"), F.lit(epoch).cast("long").alias("epoch"), (F.max("id") + 1).alias("next_sst_id"), F.max("max_seq_no").alias("flushed_seq_no_watermark"), F.count(F.lit(1)).alias("tables"), F.sum("num_entries").alias("entries"), F.sum("file_size").alias("bytes"))


def engine_stats(log: DataFrame, manifest: DataFrame, watermark: int) -> DataFrame:
    """One row of figures of log, unflushed writes and runs."""
    unflushed = latest(log.where(F.col("seq_no") > watermark).select("key", "value", "seq_no", "is_tombstone"))
    one = F.lit(1)
    a = log.agg(F.count(one).alias("log_records"), F.max("seq_no").alias("last_seq_no"), F.count_if("is_tombstone").alias("deletes"))
    b = unflushed.agg(F.count(one).alias("active_entries"), F.coalesce(F.sum(entry_size()), F.lit(0)).alias("active_bytes"))
    c = manifest.agg(F.count(one).alias("sst_count"), F.sum("file_size").alias("sst_bytes"), F.sum("num_entries").alias("sst_entries"), (F.max("id") + 1).alias("next_sst_id"))
    j = lambda df: df.withColumn("_j", F.lit(1))  # noqa: E731  single rows
    return j(a).join(j(b), "_j").join(j(c), "_j").drop("_j").withColumn("watermark", F.lit(watermark).cast("long"))


def compaction_stats(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: jobs, bytes in and out, keys dropped, ratio, runs and bytes that wait."""
    a = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.sum("keys_dropped").alias("keys_dropped"))
    b = manifest.agg(F.count(F.lit(1)).alias("runs"), F.sum("file_size").alias("backlog_bytes"))
    return a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j").drop("_j").withColumn("ratio", F.try_divide(F.col("bytes_out").cast("double"), F.col("bytes_in").cast("double")))


def run_info(blocks: DataFrame) -> DataFrame:
    """run_id, blocks, least, most and mean length, first key."""
    return blocks.groupBy("run_id").agg(F.count(F.lit(1)).alias("blocks"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg(F.col("length").cast("double")).alias("avg_length"), F.min("first_key").alias("first_key"))


def hit_rate(stats: DataFrame) -> DataFrame:
    """Adds rate: per cent of lookups that the cache answered, 0 without any."""
    total = F.col("hits") + F.col("misses")
    return stats.withColumn("rate", F.when(total > 0, 100.0 * F.col("hits") / total).otherwise(F.lit(0.0)))


def segment_stats(segments: DataFrame) -> DataFrame:
    """One row: active segment (the last), its bytes and how many there are. segments: segment, end_offset."""
    return segments.agg(F.max(F.struct("segment", "end_offset")).alias("a"), F.countDistinct("segment").alias("segments")).select(F.col("a.segment").alias("active_segment"), F.col("a.end_offset").alias("bytes"), "segments")


def background_status(jobs: DataFrame) -> DataFrame:
    """kind, jobs, the last job's number and when it ended. jobs: kind, job_no, ended_ms."""
    return jobs.groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.max(F.struct("ended_ms", "job_no")).alias("l")).select("kind", "jobs", F.col("l.job_no").alias("last_job"), F.col("l.ended_ms").alias("last_ended_ms"))
