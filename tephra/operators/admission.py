"""The write path: which requests are accepted, in which order, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import last_value, ordered_prefix
from ..functions.sizes import entry_size, record_size
from ..model import MAX_PAYLOAD, RECORD_OVERHEAD, Status


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``status``: InvalidArgument for a write without a key, without a value to put, or too large for the log; else OK. Reads are never invalid."""
    write = F.col("op").isin("PUT", "DEL")
    no_key = F.coalesce(F.octet_length("key"), F.lit(0)) == 0
    no_value = (F.col("op") == "PUT") & F.col("value").isNull()
    too_large = record_size() - RECORD_OVERHEAD + 17 > MAX_PAYLOAD
    return requests.withColumn("status", F.when(write & (no_key | no_value | too_large), Status.INVALID_ARGUMENT.value).otherwise(Status.OK.value))


def admit(requests: DataFrame, close_no: int | None = None) -> DataFrame:
    """Adds ``status`` to write requests (req_no, op, key, value).

    A delete is accepted only if its key is live, which it is if the key's last valid request was a put: a delete
    leaves the key dead whether it was accepted or not. Requests after ``close_no`` don't change what is live; they
    are StoreClosed, but a delete of a key that isn't live is answered first.
    """
    checked = validate(requests)
    valid, invalid = checked.where(F.col("status") == Status.OK.value), checked.where(F.col("status") != Status.OK.value)
    open_ = F.lit(True) if close_no is None else F.col("req_no") <= close_no
    status = F.when((F.col("op") == "DEL") & ~F.coalesce(F.col("_before") == "PUT", F.lit(False)), Status.NOT_FOUND.value).when(~open_, Status.STORE_CLOSED.value).otherwise(Status.OK.value)
    judged = last_value(valid, "key", ["req_no"], F.when(open_, F.col("op")), "_before").withColumn("status", status).drop("_before")
    return judged.unionByName(invalid)


def accepted(requests: DataFrame) -> DataFrame:
    return admit(requests).where(F.col("status") == Status.OK.value).drop("status")


def assign_seq(rows: DataFrame, first: int = 1, order: str = "req_no") -> DataFrame:
    """Adds ``seq_no``: gapless numbers in the order of the requests."""
    return ordered_prefix(rows, [order], "seq_no").withColumn("seq_no", F.col("seq_no") + (first - 1))


def change_log(requests: DataFrame, first: int = 1) -> DataFrame:
    """seq_no, op, key, value of the accepted requests; the value of a delete is null."""
    return assign_seq(accepted(requests), first).select("seq_no", "op", "key", F.when(F.col("op") == "PUT", F.col("value")).alias("value"))


def run_gate(manifest: DataFrame, stop_writes: int) -> DataFrame:
    """One row: runs, stop_writes and whether writes are rejected; 0 switches the gate off."""
    return manifest.agg(F.count(F.lit(1)).alias("runs")).select("runs", F.lit(stop_writes).alias("stop_writes"), (F.lit(stop_writes > 0) & (F.col("runs") >= stop_writes)).alias("rejected"))


def op_delta(log: DataFrame) -> DataFrame:
    """seq_no, key, bytes_added, bytes_removed and total_bytes of a memory table after each write of one epoch."""
    sized = log.select("seq_no", "key", entry_size().alias("bytes_added"))
    sized = last_value(sized, "key", ["seq_no"], F.col("bytes_added"), "bytes_removed").fillna(0, ["bytes_removed"])
    return ordered_prefix(sized, ["seq_no"], "_row", {"total_bytes": F.col("bytes_added") - F.col("bytes_removed")}).drop("_row")


def stall_time(marks: DataFrame, by: str = "stream") -> DataFrame:
    """marks: stream, at_ms, no, kind (BEGIN or CLEAR). Stalls and their milliseconds; a second BEGIN, a CLEAR without one and an open stall count nothing."""
    w = Window.partitionBy(by).orderBy("at_ms", "no")
    runs = marks.withColumn("_prev", F.lag("kind").over(w)).where(F.coalesce(F.col("_prev") != F.col("kind"), F.col("kind") == "BEGIN"))
    paired = runs.withColumn("_next", F.lead("at_ms").over(w)).where((F.col("kind") == "BEGIN") & F.col("_next").isNotNull())
    return paired.groupBy(by).agg(F.count(F.lit(1)).alias("stalls"), F.sum(F.col("_next") - F.col("at_ms")).alias("stall_ms"))
