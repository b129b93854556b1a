"""The folder that driver and executors share, and tables written there to cut the lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where all share one disk, a folder of our own. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tephra-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tephra/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete the tables written by this driver so far. DataFrames that read them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` has made for ``df``, once nothing reads it any more."""
    path = getattr(df, "_tephra_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove((df.sparkSession, path))


def mounted(folder: str) -> str:
    """The folder as a path that Python tasks can open: the formats that they write themselves need a mounted shared disk."""
    scheme, colon, rest = folder.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"{scheme}: is no mounted folder; binary files are written by Python tasks")
    return folder if not colon else "/" + rest.lstrip("/")


@contextlib.contextmanager
def scratch():
    """Tables written inside are deleted at its end, but for those that were passed to the function it yields."""
    mark, kept = len(_written), set()

    def stays(df: DataFrame) -> DataFrame:
        kept.add(df._tephra_path)
        return df

    yield stays
    for spark, path in _written[mark:]:
        if path not in kept:
            _delete(spark, path)
    _written[mark:] = [(s, p) for s, p in _written[mark:] if p in kept]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tephra_path = path
    return out
