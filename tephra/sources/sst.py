"""Reader of binary run files, for data that was written in that format; and the packer that tests use.

    file     data blocks, filter block, index block, footer
    block    entries, u32 x restarts, u32 number of restarts, u32 checksum
    entry    varint shared, varint rest, u8 type (0 put, 1 delete), varint value length, u64 seq_no, rest of the key, value
    filter   u64 bits, u32 hashes, bits, u32 checksum
    index    u32 blocks, then u32 key length, first key, u64 offset, u64 length for each, u32 checksum
    footer   u8 version, three zero bytes, u64 x 7: index offset and size, filter offset and size, entries, least and
             largest seq_no; u32 checksum, magic

Little-endian. A key shares its first ``shared`` bytes with the one before it. The checksums' algorithm isn't specified:
files are read structurally, sums are not checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import mounted

from ..functions import bloom
from ..model import EngineError, Status

#: Fixed values of the format.
MAGIC, VERSION, FOOTER = b"LSMSSTB1", 1, 72

ENTRIES = "block_no int, key string, value string, seq_no long, is_tombstone boolean"
BLOCKS = "block_no int, first_key string, offset long, length long"


@dataclass
class RunFile:
    raw: bytes
    entries: int
    min_seq_no: int
    max_seq_no: int
    bits: int
    hashes: int
    filter: bytes
    blocks: list[tuple[str, int, int]]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def open_run(raw: bytes) -> RunFile:
    """Footer, filter and index; Corruption for what is no whole run."""
    try:
        if len(raw) < FOOTER or raw[-8:] != MAGIC or raw[-FOOTER] != VERSION:
            raise ValueError("no footer")
        index, index_size, filt, filter_size, n, low, high = struct.unpack_from("<7Q", raw, len(raw) - FOOTER + 4)
        if filt + filter_size != index or index + index_size != len(raw) - FOOTER:
            raise ValueError("sections don't fit")
        bits, hashes = struct.unpack_from("<QI", raw, filt)
        body = raw[filt + 12 : index - 4]
        if len(body) != -(-bits // 8):
            raise ValueError("the filter doesn't fit")
        (count,), at, blocks, end = struct.unpack_from("<I", raw, index), index + 4, [], 0
        for _ in range(count):
            (size,) = struct.unpack_from("<I", raw, at)
            key = raw[at + 4 : at + 4 + size].decode()
            offset, length = struct.unpack_from("<QQ", raw, at + 4 + size)
            if offset != end or offset + length > filt:
                raise ValueError("blocks don't fit")
            blocks.append((key, offset, length))
            at, end = at + 20 + size, offset + length
        return RunFile(raw, n, low, high, bits, hashes, body, blocks)
    except (ValueError, struct.error, IndexError) as e:
        raise EngineError(Status.CORRUPTION, str(e)) from None


def block_entries(run: RunFile, block_no: int) -> Iterator[tuple]:
    """key, value (null for a tombstone), seq_no, is_tombstone of one block."""
    _, at, length = run.blocks[block_no]
    try:
        (restarts,) = struct.unpack_from("<I", run.raw, at + length - 8)
        end, last = at + length - 8 - 4 * restarts, b""
        while at < end:
            shared, at = _varint(run.raw, at)
            rest, at = _varint(run.raw, at)
            dead = run.raw[at] == 1
            size, at = _varint(run.raw, at + 1)
            (seq,) = struct.unpack_from("<Q", run.raw, at)
            at += 8
            last = last[:shared] + run.raw[at : at + rest]
            value = run.raw[at + rest : at + rest + size]
            at += rest + size
            if at > end:
                raise ValueError("an entry is cut off")
            yield last.decode(), None if dead else value.decode(), seq, dead
    except (ValueError, struct.error, IndexError) as e:
        raise EngineError(Status.CORRUPTION, f"block {block_no}: {e}") from None


def lookup(run: RunFile, key: str) -> tuple[str, str | None]:
    """Status and value: filter first, then the block with the greatest first key that isn't above the key."""
    if not run.blocks or not bool(bloom.may_contain(run.filter, [key.encode()], run.bits, run.hashes)[0]):
        return Status.NOT_FOUND.value, None
    low, high = 0, len(run.blocks)
    wanted = key.encode()
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if run.blocks[mid][0].encode() <= wanted else (low, mid)
    for own, value, _, dead in block_entries(run, low - 1) if low else ():
        if own == key:
            return (Status.TOMBSTONE.value, None) if dead else (Status.FOUND.value, value)
    return Status.NOT_FOUND.value, None


def pack_run(entries: list[tuple[str, str | None, int, bool]], block_size: int = 8192, restart: int = 16, rate: float = 0.01) -> bytes:
    """entries: key, value, seq_no, is_tombstone, sorted by the keys' bytes."""
    import math

    out, index, at = bytearray(), [], 0
    while at < len(entries):
        body, restarts, first, last = bytearray(), [], entries[at][0], b""
        n = 0
        while at < len(entries) and len(body) + 4 * len(restarts) + 8 < block_size or n == 0:
            key, value, seq, dead = entries[at]
            raw, shared = key.encode(), 0
            if n % restart == 0:
                restarts.append(len(body))
            else:
                while shared < min(len(raw), len(last)) and raw[shared] == last[shared]:
                    shared += 1
            data = b"" if dead else (value or "").encode()
            body += _pack_varint(shared) + _pack_varint(len(raw) - shared) + bytes([dead]) + _pack_varint(len(data)) + struct.pack("<Q", seq) + raw[shared:] + data
            last, at, n = raw, at + 1, n + 1
        body += struct.pack(f"<{len(restarts) + 2}I", *restarts, len(restarts), 0)
        index.append((first, len(out), len(body)))
        out += body
    keys, per_key = [e[0].encode() for e in entries], -math.log(rate) / math.log(2) ** 2
    bits, hashes = -(-max(64, math.ceil(max(1, len(keys)) * per_key)) // 8) * 8, max(1, round(math.log(2) * per_key))
    filt = struct.pack("<QI", bits, hashes) + bloom.build(keys, bits, hashes) + bytes(4)
    table = struct.pack("<I", len(index)) + b"".join(struct.pack("<I", len(k.encode())) + k.encode() + struct.pack("<QQ", o, n) for k, o, n in index) + bytes(4)
    seqs = [e[2] for e in entries] or [0]
    footer = bytes([VERSION, 0, 0, 0]) + struct.pack("<7QI", len(out) + len(filt), len(table), len(out), len(filt), len(entries), min(seqs), max(seqs), 0) + MAGIC
    return bytes(out) + filt + table + footer


def write_sst(runs: DataFrame, folder: str) -> None:
    """runs: run_id, key, value, seq_no, is_tombstone. Runs are cut into key ranges; each task packs its pieces on a shared file system.

    A piece is a whole run file, ``range=R/RUN.sst``: it keeps its run's name, and a run is the union of its pieces.
    """
    import os

    folder = mounted(folder)
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, own, entries = TaskContext.get().partitionId(), None, []

        def put():
            os.makedirs(os.path.join(folder, f"range={part}"), exist_ok=True)
            path = os.path.join(folder, f"range={part}", f"{own:06d}.sst")
            # Attempts of a task write apart; the last to be whole stays.
            temporary = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with open(temporary, "wb") as f:
                f.write(pack_run(entries))
            os.replace(temporary, path)
            return pd.DataFrame({"run_id": [own]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if entries and r.run_id != own:
                    yield put()
                    entries = []
                own = r.run_id
                entries.append((r.key, None if r.is_tombstone else r.value, r.seq_no, r.is_tombstone))
        if entries:
            yield put()

    n = max(8, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = runs.select("run_id", "key", "value", "seq_no", "is_tombstone").repartitionByRange(n, "run_id", "key")
    ranged.sortWithinPartitions("run_id", "key").mapInPandas(run, "run_id long").count()


def _pack_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_sst(spark: SparkSession, folder: str, what: str = "entries") -> DataFrame:
    """file and ENTRIES, or with ``what="blocks"`` BLOCKS, of all run files below a folder, one task a file or more. Corrupt files raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    schema = ENTRIES if what == "entries" else BLOCKS
    names = ["file", *(c.split(" ")[0] for c in schema.split(", "))]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                found = open_run(bytes(content))
                for i, (first, offset, length) in enumerate(found.blocks):
                    rows = [(name, i, *e) for e in block_entries(found, i)] if what == "entries" else [(name, i, first, offset, length)]
                    yield pd.DataFrame(rows, columns=names).astype({"block_no": "int32"})

    return files.mapInPandas(run, f"file string, {schema}")
