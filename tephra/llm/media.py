"""Media columns as ISO base media containers.

``mux`` lays a payload down as 8-bit grey frames of 8 x 8 samples (64 bytes) in one track; ``demux`` walks the nested
boxes of any such container, decodes the sample tables and finds codec, duration and the byte ranges of key frames.
It reads box headers and tables only: payload bytes are touched by ``payload_of`` alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, written

#: Bytes of a frame, frames a second, frames from key frame to key frame and frames of a chunk.
FRAME = 64
RATE = 25
KEY_EVERY = 16
CHUNK_FRAMES = 256
#: Boxes that hold boxes (fixed values of the container format).
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
#: Nested deeper than this, a container is taken as broken.
DEPTH = 16

_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def mux(raw: bytes) -> bytes:
    """The bytes, padded to whole frames, in a container; equal bytes give equal containers."""
    payload = padded(raw)
    n = len(payload) // FRAME
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ", b"isom")
    data = box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    chunks = -(-n // CHUNK_FRAMES)
    offsets = first + np.arange(chunks, dtype=np.uint64) * (CHUNK_FRAMES * FRAME)
    wide = bool(offsets[-1] >= 1 << 32)
    stsc = [(1, CHUNK_FRAMES, 1)] if n >= CHUNK_FRAMES else []
    if n % CHUNK_FRAMES:
        stsc.append((chunks, n % CHUNK_FRAMES, 1))
    keys = np.arange(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    table = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, 1)),
        full_box(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        full_box(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
        full_box(b"stsz", struct.pack(">II", FRAME, n)),
        full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
        full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
        box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
    )
    track = box(b"trak", full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7), media)
    movie = box(b"moov", full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)), track, box(b"udta", box(b"nbyt", struct.pack(">Q", len(raw)))))
    return head + data + movie


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # from 0
    durations: int = 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte offset and length of each key frame."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))


@dataclass
class Movie:
    brand: str = ""
    n_bytes: int | None = None
    tracks: list[Track] = field(default_factory=list)


def boxes(raw: memoryview, at: int, end: int):
    """kind, start and end of the content of each box; ValueError if one doesn't fit."""
    while at < end:
        if end - at < 8:
            raise ValueError(f"a box header is cut off at {at}")
        size, kind = struct.unpack_from(">I4s", raw, at)
        start = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"a box header is cut off at {at}")
            size, start = struct.unpack_from(">Q", raw, start)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < start:
            raise ValueError(f"box {kind!r} at {at} doesn't fit")
        yield kind, start, stop
        at = stop


def demux(raw: bytes) -> Movie:
    """Codec, duration and sample places of all tracks. ValueError for what is no whole container."""
    view, movie = memoryview(raw), Movie()
    try:
        _walk(view, 0, len(raw), movie, None, 0)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a table is cut off: {e}") from None
    for t in movie.tracks:
        if len(t.offsets) != len(t.sizes) or (len(t.offsets) and int((t.offsets + t.sizes).max()) > len(raw)):
            raise ValueError("samples lie outside the container")
    if not movie.tracks:
        raise ValueError("no track")
    return movie


def _numbers(view: memoryview, at: int, stop: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > stop:
        raise ValueError("a table is cut off")
    return np.frombuffer(view, kind, n, at).astype(np.int64)


def _walk(view: memoryview, at: int, end: int, movie: Movie, tables: dict | None, depth: int) -> None:
    if depth > DEPTH:
        raise ValueError("boxes are nested too deep")
    for kind, start, stop in boxes(view, at, end):
        if kind == b"moof":
            raise ValueError("fragmented: samples lie in moof boxes")
        if kind == b"ftyp":
            movie.brand = bytes(view[start : start + 4]).decode("latin-1")
        elif kind == b"nbyt":
            movie.n_bytes = struct.unpack_from(">Q", view, start)[0]
        elif kind == b"trak":
            own: dict = {}
            _walk(view, start, stop, movie, own, depth + 1)
            movie.tracks.append(_track(own))
        elif kind in CONTAINERS:
            _walk(view, start, stop, movie, tables, depth + 1)
        elif tables is not None:
            _table(view, kind, start, stop, tables)


def _table(view: memoryview, kind: bytes, start: int, stop: int, t: dict) -> None:
    u32 = lambda at: struct.unpack_from(">I", view, at)[0]
    if kind == b"mdhd":
        t["time"] = struct.unpack_from(">IQ", view, start + 20) if view[start] == 1 else struct.unpack_from(">II", view, start + 12)
    elif kind == b"hdlr":
        t["handler"] = bytes(view[start + 8 : start + 12]).decode("latin-1")
    elif kind == b"stsd":
        if u32(start + 4):
            t["codec"] = bytes(view[start + 12 : start + 16]).decode("latin-1")
    elif kind == b"stts":
        t["stts"] = _numbers(view, start + 8, stop, 2 * u32(start + 4), ">u4").reshape(-1, 2)
    elif kind == b"stss":
        t["stss"] = _numbers(view, start + 8, stop, u32(start + 4), ">u4")
    elif kind == b"stsc":
        t["stsc"] = _numbers(view, start + 8, stop, 3 * u32(start + 4), ">u4").reshape(-1, 3)
    elif kind == b"stz2":
        raise ValueError("compact sample sizes (stz2)")
    elif kind == b"stsz":
        size, n = u32(start + 4), u32(start + 8)
        if size and n * size > 1 << 62:
            raise ValueError("samples lie outside the container")
        t["sizes"] = np.full(min(n, len(view)), size, np.int64) if size else _numbers(view, start + 12, stop, n, ">u4")
    elif kind in (b"stco", b"co64"):
        t["chunks"] = _numbers(view, start + 8, stop, u32(start + 4), ">u4" if kind == b"stco" else ">u8")


def _track(t: dict) -> Track:
    sizes, chunks = t.get("sizes", np.empty(0, np.int64)), t.get("chunks", np.empty(0, np.int64))
    runs = t.get("stsc", np.empty((0, 3), np.int64))
    offsets = np.empty(0, np.int64)
    if len(sizes):
        if not len(runs) or not len(chunks) or runs[0, 0] != 1:
            raise ValueError("samples without chunks")
        count = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)]))
        if len(count) != len(chunks) or count.sum() != len(sizes):
            raise ValueError("chunks and samples differ")
        chunk = np.repeat(np.arange(len(chunks)), count)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(count) - count
        offsets = chunks[chunk] + before - before[first[chunk]]
    keys = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise ValueError("a key frame that isn't there")
    stts = t.get("stts", np.empty((0, 2), np.int64))
    return Track(t.get("codec", ""), t.get("handler", ""), *t.get("time", (0, 0)), sizes, offsets, keys, int((stts[:, 0] * stts[:, 1]).sum()))


def payload_of(raw: bytes, track: Track) -> bytes:
    """The track's samples in order: stretches that follow each other in the container are taken at once."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(raw[a:b] for a, b in zip(track.offsets[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist()))


def main_track(movie: Movie) -> Track:
    """The first video track, else the first."""
    return next((t for t in movie.tracks if t.handler == "vide"), movie.tracks[0])


def _described(t: Track) -> dict:
    return {"codec": t.codec.strip(), "handler": t.handler, "timescale": t.timescale, "duration": t.durations, "seconds": round(t.durations / t.timescale, 6) if t.timescale else None, "samples": len(t.sizes), "keyframes": [[a, n] for a, n in t.key_ranges()]}


def feature(movie: Movie) -> str:
    """What is stored of the main track, as JSON; with several tracks also of each of them, in their order."""
    more = {"tracks": [_described(t) for t in movie.tracks]} if len(movie.tracks) > 1 else {}
    return json.dumps({"brand": movie.brand.strip()} | _described(main_track(movie)) | more, separators=(",", ":"))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media (a container with the text's UTF-8), written to the shared folder and read back.

    A null text is an empty one; null keys and repeated rows stay, other columns are ignored, an empty table stays empty.
    """

    def make():
        return lambda b: {"key": b.column(0), "media": [mux((t or "").encode()) for t in b.column(1).to_pylist()]}

    kind = dict(docs.dtypes)[key]
    return written(map_texts(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"key {kind}, media binary", rows=256).withColumnRenamed("key", key), "media")


def media_features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Features of a column of containers: codec and seconds of the main track, key frame ranges of all (in ``feature``), and digests of payload and stored bytes.

    Durations are those of the sample tables: edit lists don't count. Fragmented containers (moof) and compact sizes
    (stz2) aren't read and say so in ``error``.

    A null or broken container gives a row with nulls and what is wrong in ``error``; nothing raises. Repeated rows
    and null keys stay, an empty table gives an empty result, other columns are ignored. No shuffle.
    """
    kind = dict(media.dtypes)[key]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "seconds", "feature", "error"]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (*[None] * 9, "null")
        stored = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            movie = demux(raw)
        except ValueError as e:
            return (*[None] * 4, *stored, None, None, None, str(e))
        t = main_track(movie)
        payload = payload_of(raw, t)
        return (len(payload) if movie.n_bytes is None else movie.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), *stored, t.codec.strip(), t.durations / t.timescale if t.timescale else None, feature(movie), None)

    def make():
        def run(b: pa.RecordBatch):
            rows = [one(x) for x in b.column(1).to_pylist()]
            return {"key": b.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return run

    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, seconds double, feature string, error string"
    return map_texts(media.select(media[key].alias("key"), media[column].alias("media")), make, schema, rows=256).withColumnRenamed("key", key)


def op2_media(spark, sf_dir: str) -> DataFrame:
    return media_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("error")
