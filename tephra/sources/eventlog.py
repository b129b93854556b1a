"""The event log: titled blocks of ``name: value`` lines, written by the driver and read back as rows."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EventLog:
    """Appends blocks to a file. A failure to write never fails the caller."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def record(self, title: str, block: tuple[str, str] | None = None, **attrs) -> None:
        lines = [f"====== {title} ======", f"timestamp_ms: {time.time_ns() // 1_000_000}", *(f"{k}: {v}" for k, v in attrs.items())]
        if block:
            lines += [f"{block[0]}:", *(f"  {x}" for x in block[1].splitlines())]
        try:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.path.open("a") as f:
                f.write("\n".join(lines) + "\n\n")
        except OSError:
            pass


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """no (place in the file), title, timestamp_ms, attrs (map) and block (indented lines). Blocks are split by Spark's reader."""
    raw = spark.read.option("lineSep", "====== ").text(path).withColumn("no", F.monotonically_increasing_id())
    # Splitting at "====== " leaves titles " TITLE ======" apart from what follows them.
    body = raw.where(F.col("value").rlike(r"(?s)^[A-Z_]+ ======\n"))
    text = F.regexp_replace("value", r"(?s)^[A-Z_]+ ======\n", "")
    lines = F.split(text, "\n")
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"^[A-Za-z_0-9]+: ")), lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_0-9]+): ", 1).alias("key"), F.regexp_replace(x, r"^[A-Za-z_0-9]+: ", "").alias("value")))
    indented = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("  ")), lambda x: F.substring(x, 3, 1 << 30)), "\n")
    rows = body.select("no", F.regexp_extract("value", r"^([A-Z_]+) ======", 1).alias("title"), F.map_from_entries(pairs).alias("attrs"), F.when(indented != "", indented).alias("block"))
    return rows.select("no", "title", F.col("attrs")["timestamp_ms"].cast("long").alias("timestamp_ms"), F.map_filter("attrs", lambda k, _: k != "timestamp_ms").alias("attrs"), "block")


def rollup(events: DataFrame) -> DataFrame:
    """title, events, first and last timestamp."""
    return events.groupBy("title").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))
