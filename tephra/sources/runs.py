"""Sorted runs as Parquet directories, split in key ranges, with a bloom filter on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "key string, value string, seq_no long, is_tombstone boolean"
#: Bytes of entries for which a run gets one more file.
FILE_BYTES = 256 << 20


def write_run(entries: DataFrame, path: str, size: int) -> None:
    """Write one entry a key, sorted in each file; files hold disjoint key ranges, so readers skip those that can't match.

    ``size``: bytes of the entries, or a bound of them; it decides the number of files.
    """
    columns = entries.select("key", "value", "seq_no", "is_tombstone")
    files = files_for(size)
    dealt = columns.coalesce(1) if files == 1 else columns.repartitionByRange(files, "key")
    _write(dealt, path)


def files_for(size: int) -> int:
    return max(1, -(-size // FILE_BYTES))


def write_merged(parts: DataFrame, merge, path: str, size: int) -> None:
    """Write ``merge(parts)``, one entry a key. ``parts`` are dealt into key ranges before they are merged, which then needs no exchange of its own."""
    files = files_for(size)
    dealt = parts.repartition(1) if files == 1 else parts.repartitionByRange(files, "key")
    _write(merge(dealt).select("key", "value", "seq_no", "is_tombstone"), path)


def write_runs(runs: DataFrame, folder: str) -> None:
    """Write all runs (run_id and entries) in one pass: a folder ``run_id=N`` for each, its files sorted by key."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.select("run_id", "key", "value", "seq_no", "is_tombstone").repartitionByRange(n, "run_id", "key").sortWithinPartitions("run_id", "key")
    dealt.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false").partitionBy("run_id").parquet(folder)


def _write(entries: DataFrame, path: str) -> None:
    entries.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false").mode("error").parquet(path)


def read_runs(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """run_id and entries of the runs; an empty relation for none."""
    if not paths:
        return spark.createDataFrame([], f"run_id long, {RUN}")
    out = None
    for run_id, path in paths.items():
        one = spark.read.schema(RUN).parquet(path).select(F.lit(run_id).cast("long").alias("run_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out
