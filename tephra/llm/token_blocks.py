"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of whole documents:

    magic "PFR1", u32 ids, u32 ids in a block, u32 blocks, u32 x blocks: where each block starts after this index
    block: u32 minimum, u8 width, u8 exceptions, u16 zero, packed (id - minimum) of ``width`` bits each, low bits first,
           u8 x exceptions: places, u32 x exceptions: their whole (id - minimum)

The width is that of a block's ``percentile``-th difference; larger differences go to the exception list. The last
block is filled up with its minimum. Numbers are little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_texts
from .encoders import shared_encoder

MAGIC = b"PFR1"
BLOCK = 128
#: Share of a block's differences that its width covers.
PERCENTILE = 90
#: A segment is closed when it has so many ids; one longer document is a segment of its own.
SEGMENT_IDS = 1 << 17

SEGMENTS = "part int, segment long, part_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary"


def _widths(d: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.ceil(np.log2(d.astype(np.float64) + 1)).astype(np.int64)


def _pack_bits(d: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of each number of each row, one after another; rows of whole bytes (a row has a multiple of 8 numbers)."""
    rows, n = d.shape
    words = np.zeros((-(-n * w // 64) + 1, rows), np.uint64)
    low = (d.T.astype(np.uint64)) & np.uint64((1 << w) - 1)
    for i in range(n):
        at, shift = divmod(i * w, 64)
        words[at] |= low[i] << np.uint64(shift)
        if shift + w > 64:
            words[at + 1] |= low[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)[:, : n * w // 8]


def _unpack_bits(body: np.ndarray, w: int, n: int) -> np.ndarray:
    rows, size = body.shape
    whole = np.zeros((rows, -(-size // 8) * 8 + 8), np.uint8)
    whole[:, :size] = body
    words = np.ascontiguousarray(whole.view("<u8").T)
    out = np.empty((n, rows), np.uint32)
    for i in range(n):
        at, shift = divmod(i * w, 64)
        v = words[at] >> np.uint64(shift)
        if shift + w > 64:
            v = v | words[at + 1] << np.uint64(64 - shift)
        out[i] = v & np.uint64((1 << w) - 1)
    return out.T


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """ids: unsigned 32-bit. An empty array gives a header without blocks."""
    if not 0 < block <= 256 or block % 8:
        raise ValueError("a block has a multiple of 8 ids, 256 at most")
    n, nb = len(ids), -(-len(ids) // block)
    head = MAGIC + np.array([n, block, nb], "<u4").tobytes()
    if not n:
        return head
    x = np.full(nb * block, ids[(nb - 1) * block :].min(), np.uint32)
    x[:n] = ids
    x = x.reshape(nb, block)
    low = x.min(axis=1)
    d = x - low[:, None]
    width = _widths(np.partition(d, (block * percentile - 1) // 100, axis=1)[:, (block * percentile - 1) // 100])
    over = d.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    n_over = over.sum(axis=1)
    wide = n_over > 255  # a list counts to 255
    if wide.any():
        width[wide], over[wide], n_over[wide] = 32, False, 0
    size = 8 + width * (block // 8) + 5 * n_over
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    out = np.zeros(int(size.sum()), np.uint8)
    heads = np.zeros((nb, 8), np.uint8)
    heads[:, :4] = low.astype("<u4").view(np.uint8).reshape(nb, 4)
    heads[:, 4], heads[:, 5] = width, n_over
    out[start[:, None] + np.arange(8)] = heads
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = _pack_bits(d[rows], int(w))
            out[start[rows][:, None] + 8 + np.arange(packed.shape[1])] = packed
    b, place = np.nonzero(over)
    if len(b):
        first = start[b] + 8 + width[b] * (block // 8)
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        out[first + nth] = place
        out[(first + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = d[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + start.astype("<u4").tobytes() + out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    n, block, nb = (int(v) for v in np.frombuffer(payload, "<u4", 3, 4))
    if not nb:
        return np.empty(0, np.uint32)
    start = np.frombuffer(payload, "<u4", nb, 16).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=16 + 4 * nb)
    heads = body[start[:, None] + np.arange(8)]
    low, width, n_over = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel(), heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    d = np.zeros((nb, block), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            d[rows] = _unpack_bits(body[start[rows][:, None] + 8 + np.arange(w * block // 8)], int(w), block)
    if n_over.any():
        b = np.repeat(np.arange(nb), n_over)
        first = start[b] + 8 + width[b] * (block // 8)
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        d[b, body[first + nth]] = np.ascontiguousarray(body[(first + n_over[b] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (d + low[:, None]).ravel()[:n]


def write_token_segments(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS, partitions: int | None = None) -> DataFrame:
    """Encode ``text``, append ``end_id``, write segments in ascending order of ``key`` below ``path``; return them read back.

    A null text is encoded as an empty one; a null key comes first; rows with one key are ordered by their texts.
    Other columns are ignored. An empty table gives no segments. One shuffle moves the texts into ranges of the key;
    one key's rows can be dealt out over several ranges by their text's hash.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "text")

    def make():
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes() if end_id is not None else b""
        part = TaskContext.get().partitionId()
        state = {"segment": 0, "start": 0}

        def run(batch: pa.RecordBatch):
            out: dict[str, list] = {f.split(" ")[0]: [] for f in SEGMENTS.split(", ")}
            keys, ids = batch.column(0).to_pylist(), [encoder.ids(t) + tail for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(keys):
                end, total = at, 0
                while end < len(keys) and (end == at or total + len(ids[end]) // 4 <= segment_ids):
                    total += len(ids[end]) // 4
                    end += 1
                row = (part, state["segment"], state["start"], total, keys[at:end], [len(x) // 4 for x in ids[at:end]], pack(np.frombuffer(b"".join(ids[at:end]), "<u4")))
                for c, v in zip(out.values(), row):
                    c.append(v)
                state["segment"] += 1
                state["start"] += total
                at = end
            return out

        return run

    map_texts(ranged.drop("tie"), make, SEGMENTS).write.option("compression", "none").parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def read_token_segments(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode segments: key, start (ids of all documents before it), n_tokens, ids_crc32, part, segment and the ids' bytes."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each written partition: as many as tasks, not documents.
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def make():
        def run(batch: pa.RecordBatch):
            out: dict[str, list] = {"key": [], "part": [], "segment": [], "at": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for row in batch.to_pylist():
                ids, at = unpack(row["payload"]), 0
                for k, n in zip(row["doc_ids"], row["doc_lens"]):
                    own = ids[at : at + n].astype("<u4").tobytes()
                    for c, v in zip(out.values(), (k, row["part"], row["segment"], row["part_start"] + at, n, zlib.crc32(own), own)):
                        c.append(v)
                    at += n
            return out

        return run

    docs = map_texts(segments, make, "key long, part int, segment long, at long, n_tokens long, ids_crc32 long, ids binary", rows=4)
    return docs.join(starts, "part").select(F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "segment", "ids")


def op1_token_blocks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    segments = write_token_segments(docs, fresh_path(spark, "token-segments"))
    return read_token_segments(segments).drop("ids", "part")
