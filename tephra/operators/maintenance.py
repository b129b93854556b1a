"""Recovery, retention and integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EngineError, Status


def truncate_corrupt(physical: DataFrame) -> DataFrame:
    """physical: segment, ord, ok, ... The records before the first bad one of each segment; later segments are still read."""
    bad = physical.where(~F.col("ok")).groupBy("segment").agg(F.min("ord").alias("_bad"))
    return physical.join(bad, "segment", "left").where(F.col("_bad").isNull() | (F.col("ord") < F.col("_bad"))).drop("_bad")


def wal_verify(physical: DataFrame) -> DataFrame:
    """segment, records (valid), needs_truncation and last_seqno of each segment; nothing is changed."""
    kept = truncate_corrupt(physical).groupBy("segment").agg(F.count(F.lit(1)).alias("records"), F.max("seq_no").alias("last_seqno"))
    every = physical.groupBy("segment").agg(F.count_if(~F.col("ok")).alias("_bad"))
    return every.join(kept, "segment", "left").select("segment", F.coalesce("records", F.lit(0)).cast("long").alias("records"), (F.col("_bad") > 0).alias("needs_truncation"), "last_seqno")


def log_cut(physical: DataFrame, cuts: DataFrame) -> DataFrame:
    """Records that end at or before the ``cut_offset`` of their segment; segments without one stay whole. Nothing is destroyed."""
    return physical.join(cuts, "segment", "left").where(F.col("cut_offset").isNull() | (F.col("end_offset") <= F.col("cut_offset"))).drop("cut_offset")


def orphan_runs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no manifest names."""
    return files.join(manifest.select("file_name"), "file_name", "left_anti")


def missing_runs(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select("file_name"), "file_name", "left_anti")


def require_all_runs(manifest: DataFrame, files: DataFrame) -> None:
    """Raise if a run that the manifest names isn't there."""
    gone = missing_runs(manifest, files).select("file_name").limit(1).collect()
    if gone:
        raise EngineError(Status.CORRUPTION, f"run {gone[0][0]} is missing")


def wal_retention(segments: DataFrame, watermark: int, active: int) -> DataFrame:
    """segments: segment, seq_no (of its records). Segments that can go: not the active one, and all records are in runs."""
    top = segments.groupBy("segment").agg(F.max("seq_no").alias("max_seq_no"))
    return top.where((F.col("max_seq_no") <= watermark) & (F.col("segment") != active))


def sweep_retired(retired: DataFrame, pinned: DataFrame, now_ms: int, grace_seconds: int) -> DataFrame:
    """Retired files that can be deleted: old enough, and no snapshot reads them."""
    old = retired.where(F.lit(now_ms) - F.col("deferred_at_ms") >= grace_seconds * 1000)
    return old.join(pinned.select("file_name").distinct(), "file_name", "left_anti")


def content_digest(entries: DataFrame) -> DataFrame:
    """run_id, rows and digest: the sum of the rows' hashes, the same in any order. For checks that read all of a run."""
    hashed = F.xxhash64("key", "value", "seq_no", "is_tombstone").cast("decimal(38,0)")
    return entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed).cast("string").alias("digest"))


def verify_runs(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """run_id and ok: whether rows and digest are those that were stored when the run was written."""
    now = content_digest(entries).withColumnsRenamed({"rows": "_rows", "digest": "_digest"})
    return stored.join(now, "run_id", "left").select("run_id", F.coalesce((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), F.lit(False)).alias("ok"))
