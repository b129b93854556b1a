"""Order-dependent folds: rotation of memory tables and rolling of log segments.

What a write does depends on all writes since the last reset, so a stream of writes is folded in order. Streams are
independent: rows are dealt out by stream, sorted, and each task folds its streams batch by batch, with the state of
one epoch (which the size limit bounds) carried from batch to batch. No stream is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import entry_size, record_size
from ..model import SEGMENT_HEADER


def _folded(rows: DataFrame, size, start, step, names: list[str], schema: str) -> DataFrame:
    """rows: stream, seq_no, key, value, and at_ms where time matters. ``start()`` is a stream's first state; ``step(state, key, size, at_ms)`` gives the new columns."""
    at = F.col("at_ms") if "at_ms" in rows.columns else F.lit(0)
    ordered = rows.select("stream", "seq_no", "key", size.alias("_size"), at.cast("long").alias("_at")).repartition("stream").sortWithinPartitions("stream", "seq_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for s, key, n, at in zip(pdf["stream"].tolist(), pdf["key"].tolist(), pdf["_size"].tolist(), pdf["_at"].tolist()):
                if state is None or s != stream:
                    stream, state = s, start()
                out.append(step(state, key, n, at))
            yield pd.concat([pdf[["stream", "seq_no", "key"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return ordered.mapInPandas(run, f"stream long, seq_no long, key string, {schema}")


def rotate_epochs(log: DataFrame, max_bytes: int, overhead: int = 32, cooldown_ms: int = 0) -> DataFrame:
    """Adds epoch (from 0) and total_bytes of the memory table after each write: it is frozen when a write brings it to ``max_bytes``; an overwrite replaces the old entry's bytes.

    Within ``cooldown_ms`` of the last rotation (by the log's at_ms) a full table goes on growing; the first write after that freezes it.
    """
    if cooldown_ms and "at_ms" not in log.columns:
        raise ValueError("a cooldown needs the time of each write (at_ms)")

    def start() -> dict:
        return {"epoch": 0, "total": 0, "sizes": {}, "last": None}

    def step(state: dict, key: str, n: int, at: int) -> tuple[int, int]:
        state["total"] += n - state["sizes"].get(key, 0)
        state["sizes"][key] = n
        epoch, total, last = state["epoch"], state["total"], state["last"]
        if total >= max_bytes and (last is None or at - last >= cooldown_ms):
            state.update(epoch=epoch + 1, total=0, sizes={}, last=at)
        return epoch, total

    return _folded(log, entry_size(overhead=overhead), start, step, ["epoch", "total_bytes"], "epoch long, total_bytes long")


def simulate_backpressure(log: DataFrame, max_bytes: int, max_immutables: int, flush_every: int, overhead: int = 32) -> DataFrame:
    """Adds outcome (OK or Backpressure), epoch, immutables and grace.

    A full memory table joins the queue of frozen ones. If the queue is full, the limit rises once to 1.25 times; at
    that limit writes are rejected until a flush takes the oldest from the queue, which happens after every
    ``flush_every`` requests. A freed place ends the grace at the next rotation.
    """

    def start() -> dict:
        return {"epoch": 0, "total": 0, "sizes": {}, "queue": 0, "grace": False, "blocked": False, "n": 0}

    def step(state: dict, key: str, n: int, at: int) -> tuple[str, int, int, bool]:
        state["n"] += 1
        if state["n"] % flush_every == 0 and state["queue"]:
            state["queue"] -= 1
            state["blocked"] = False
        if state["blocked"]:
            return "Backpressure", state["epoch"], state["queue"], state["grace"]
        epoch = state["epoch"]
        state["total"] += n - state["sizes"].get(key, 0)
        state["sizes"][key] = n
        if state["total"] >= (int(max_bytes * 1.25) if state["grace"] else max_bytes):
            if state["queue"] < max_immutables:
                state.update(epoch=epoch + 1, total=0, sizes={}, queue=state["queue"] + 1, grace=False)
            elif not state["grace"]:
                state["grace"] = True
            else:
                state["blocked"] = True
        return "OK", epoch, state["queue"], state["grace"]

    return _folded(log, entry_size(overhead=overhead), start, step, ["outcome", "epoch", "immutables", "grace"], "outcome string, epoch long, immutables long, grace boolean")


def wal_segments(log: DataFrame, roll_bytes: int, first: int = 1) -> DataFrame:
    """Adds segment and end_offset of each record: a segment that has reached ``roll_bytes`` is closed before the next append."""

    def start() -> dict:
        return {"segment": first, "size": SEGMENT_HEADER}

    def step(state: dict, key: str, n: int, at: int) -> tuple[int, int]:
        if state["size"] >= roll_bytes:
            state.update(segment=state["segment"] + 1, size=SEGMENT_HEADER)
        state["size"] += n
        return state["segment"], state["size"]

    return _folded(log, record_size(), start, step, ["segment", "end_offset"], "segment long, end_offset long")


def recover(log: DataFrame, watermark: int) -> DataFrame:
    """The records that a restart replays: all above the watermark, none dropped."""
    return log.where(log.seq_no > watermark)


def rebuild(log: DataFrame, watermark: int, max_bytes: int, max_immutables: int, overhead: int = 32) -> DataFrame:
    """The replayed records with epoch, immutables, grace and blocked of the memory tables that they fill again.

    The thresholds are those of the write path. From where the queue is full and the grace is used up, ``blocked`` is
    true: new writes wait for a flush, but the replay goes on into the active table, as its records are acknowledged.
    """

    def start() -> dict:
        return {"epoch": 0, "total": 0, "sizes": {}, "queue": 0, "grace": False, "blocked": False}

    def step(state: dict, key: str, n: int, at: int) -> tuple[int, int, bool, bool]:
        epoch = state["epoch"]
        state["total"] += n - state["sizes"].get(key, 0)
        state["sizes"][key] = n
        limit = int(max_bytes * 1.25) if state["grace"] else max_bytes
        if state["total"] >= limit and not state["blocked"]:
            if state["queue"] < max_immutables:
                state.update(epoch=epoch + 1, total=0, sizes={}, queue=state["queue"] + 1, grace=False)
            else:
                state.update(grace=True, blocked=state["grace"])
        return epoch, state["queue"], state["grace"], state["blocked"]

    return _folded(recover(log, watermark), entry_size(overhead=overhead), start, step, ["epoch", "immutables", "grace", "blocked"], "epoch long, immutables long, grace boolean, blocked boolean")
