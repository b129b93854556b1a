"""Reader of binary log segments, whole segments to a task; and the packer that tests use.

    header   "LSMW", version 1, three zero bytes
    record   u32 payload length, payload, u32 checksum
    payload  u8 type (0 put, 1 delete), u64 seq_no, u32 key length, u32 value length, key, value (puts only)

Little-endian. The checksum's algorithm isn't specified, so records are read structurally and the sum is not checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import mounted

from ..model import MAX_PAYLOAD

#: Fixed values of the format.
MAGIC, VERSION, HEADER = b"LSMW", 1, 8

#: Rows and payload bytes that a task gathers before it hands them to Spark.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
#: Segments that share a folder.
FOLDER_SEGMENTS = 4096

PHYSICAL = "ord int, offset long, end_offset long, payload_len long, ok boolean, seq_no long, op string, key string, value string"


def pack_record(op: str, seq_no: int, key: str, value: str | None) -> bytes:
    k, v = key.encode(), (value or "").encode() if op == "PUT" else b""
    payload = struct.pack("<BQII", 0 if op == "PUT" else 1, seq_no, len(k), len(v)) + k + v
    return struct.pack("<I", len(payload)) + payload + struct.pack("<I", 0)


def pack_segment(records: list[tuple]) -> bytes:
    return MAGIC + bytes([VERSION, 0, 0, 0]) + b"".join(pack_record(*r) for r in records)


def records(raw: bytes) -> Iterator[tuple]:
    """Rows of PHYSICAL up to and with the first record that isn't whole."""
    if raw[:4] != MAGIC or len(raw) < HEADER or raw[4] != VERSION:
        yield 0, 0, len(raw), None, False, None, None, None, None
        return
    at, n = HEADER, 0
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0] if at + 4 <= len(raw) else None
        row = None
        if size is not None and 17 <= size <= MAX_PAYLOAD and at + 8 + size <= len(raw):
            kind, seq, kl, vl = struct.unpack_from("<BQII", raw, at + 4)
            if kind in (0, 1) and 17 + kl + vl == size and seq < 1 << 63 and (kind == 0 or vl == 0):
                try:
                    key, value = raw[at + 21 : at + 21 + kl].decode(), raw[at + 21 + kl : at + 21 + kl + vl].decode()
                    row = (n, at, at + 8 + size, size, True, seq, "DEL" if kind else "PUT", key, None if kind else value)
                except UnicodeDecodeError:
                    pass
        if row is None:
            yield n, at, len(raw), size, False, None, None, None, None
            return
        yield row
        at, n = row[2], n + 1


def read_wal(spark: SparkSession, folder: str) -> DataFrame:
    """segment (file name) and PHYSICAL of all segments below a folder; files come through Spark's own readers, so any file system will do.

    Segments may be small and many: Spark opens a task for every 32 of them, which are taken together to as many tasks as
    a shuffle has, and rows of several segments are handed back at once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("segment"), "content")

    def run(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        fields = [("segment", pa.string()), *((n, kinds[k]) for n, k in (c.split(" ") for c in PHYSICAL.split(", ")))]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        for given in batches:
            for segment, content in zip(given.column(0), given.column(1)):
                segment = segment.as_py()
                for r in records(content.as_py()):
                    rows.append((segment, *r))
                    size += r[3] if r[4] else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.coalesce(tasks).mapInArrow(run, f"segment string, {PHYSICAL}")


def write_wal(segments: DataFrame, folder: str) -> None:
    """segments: segment (number), seq_no, op, key, value. Each task writes whole segment files, one at a time; for test data and exports on a shared file system.

    FOLDER_SEGMENTS of them share a folder below ``folder``: no folder gets long, and Spark lists many folders in tasks.
    """
    import os

    folder = mounted(folder)
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, rows = None, []

        def put():
            within = os.path.join(folder, f"{own // FOLDER_SEGMENTS:06d}")
            os.makedirs(within, exist_ok=True)
            path = os.path.join(within, f"{own:06d}.wal")
            # Attempts of a task write apart; the last to be whole stays.
            temporary = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with open(temporary, "wb") as f:
                f.write(pack_segment(rows))
            os.replace(temporary, path)

        for given in batches:
            done = []
            for segment, *r in zip(*(c.to_pylist() for c in given.columns)):
                if rows and segment != own:
                    put()
                    done.append(own)
                    rows = []
                own = segment
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["segment"])
        if rows:
            put()
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64())], names=["segment"])

    segments.select(F.col("segment").cast("long").alias("segment"), "op", "seq_no", "key", "value").repartition("segment").sortWithinPartitions("segment", "seq_no").mapInArrow(run, "segment long").count()
