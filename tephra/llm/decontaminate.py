"""Benchmark decontamination: find windows of benchmark words in documents, mark or remove what they cover.

Each task holds the windows' hashes as a sorted set and the benchmark's vocabulary. A document's words become numbers
of that vocabulary (0: not in it), windows without a 0 get a polynomial hash modulo 2**64 from running sums, hits are
looked up in the set and then verified word by word.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

#: Words in a window.
WINDOW = 13
#: A document is contaminated from this share of hit words: 20 * n_hit >= n_words.
SHARE = 20
#: Bytes of benchmark text that a task holds at once (or one item); a larger benchmark is scanned in several blocks of
#: items. A worker needs about 25 bytes for one of text.
BLOCK_BYTES = 8 << 20

#: ASCII letters in lower case, digits and all bytes from 0x80 are parts of words, all else is a gap.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Windows:
    """The windows of a block of items: sorted hashes, and for each where its words stand in the items' one array of word numbers, and whose it is."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = sorted({i for i, _ in items})
        rank = {n: r for r, n in enumerate(self.names)}
        parts = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint32) for _, text in items]
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        starts = np.cumsum([0, *map(len, parts)])
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(parts):
            if len(p):
                by_size[min(window, len(p))].append(k)
        self.sets = []
        for n, own in sorted(by_size.items()):
            hashes = np.concatenate([self._hashes(parts[k], n) for k in own])
            places = np.concatenate([np.arange(starts[k], starts[k] + len(parts[k]) - n + 1) for k in own]).astype(np.uint32)
            owners = np.concatenate([np.full(len(parts[k]) - n + 1, rank[items[k][0]], np.uint32) for k in own])
            order = np.lexsort((owners, hashes))
            self.sets.append((n, hashes[order], places[order], owners[order]))

    @staticmethod
    def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n numbers from each place on."""
        up = np.full(len(ids), _BASE)
        down = np.full(len(ids), _INVERSE)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            s = np.r_[np.uint64(0), np.cumsum(ids.astype(np.uint64) * np.multiply.accumulate(up))]
            return (s[n:] - s[:-n]) * np.multiply.accumulate(down)[: len(ids) - n + 1]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, hit stretches of words [start, end), items whose windows occur."""
        words = words_of(text)
        stretches: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.r_[0, np.cumsum(ids != 0)]
        for n, hashes, windows, owners in self.sets:
            if len(ids) < n:
                continue
            full = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(full):
                continue
            own = self._hashes(ids, n)[full]
            at, end = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            for i in np.flatnonzero(at < end).tolist():
                place, first, last = int(full[i]), int(at[i]), int(end[i])
                stand = windows[first:last].astype(np.int64)
                right = (self.words[stand[:, None] + np.arange(n)] == ids[place : place + n]).all(axis=1)
                if right.any():
                    stretches.append((place, place + n))
                    items.update(self.names[o] for o in np.unique(owners[first:last][right]).tolist())
        return len(words), joined(stretches), items


def joined(stretches) -> list[tuple[int, int]]:
    """Stretches in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()


def _blocks(items: DataFrame, block_bytes: int):
    """The items (i, t), one block at a time: at most ``block_bytes`` of text by the sizes that are counted for it, or one item.

    Items are cut into blocks in the order of their text's hash, also those of one id. Only block borders and one block
    are in the driver at a time; what a task has scanned of a block is written before the next one is read.
    """
    size = F.octet_length("t") + F.octet_length("i") + 16
    sized = items.select("i", "t", size.alias("size"), F.xxhash64("i", "t").alias("h"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= block_bytes:
        return iter([[(r["i"], r["t"]) for r in sized.collect()]])  # below the limit: proven by ``total``
    slices = 4 * -(-total // block_bytes)
    cut = written(sized.withColumn("slice", F.pmod("h", F.lit(slices))), "benchmark")

    def some(where, bytes_of: int, parts: int):
        """A part within the bound as one block; else cut again, down to single items."""
        if bytes_of <= block_bytes:
            yield [(r["i"], r["t"]) for r in cut.where(where).select("i", "t").collect()]
            return
        finer = F.pmod(F.shiftrightunsigned("h", 8), F.lit(parts))
        sizes = {r[0]: (r[1], r[2]) for r in cut.where(where).groupBy(finer.alias("f")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
        for f, (own, n) in sorted(sizes.items()):
            inner = where & (finer == f)
            if n == 1 or parts > 1 << 40:
                yield [(r["i"], r["t"]) for r in cut.where(inner).select("i", "t").collect()]
            else:
                yield from some(inner, own, parts * 64)

    def blocks():
        held, slices_of = 0, []
        for k, own in sorted((r[0], r[1]) for r in cut.groupBy("slice").agg(F.sum("size")).collect()):  # four numbers a block
            if slices_of and held + own > block_bytes:
                yield from some(F.col("slice").isin(slices_of), held, 64)
                held, slices_of = 0, []
            held, slices_of = held + own, [*slices_of, k]
        if slices_of:
            yield from some(F.col("slice").isin(slices_of), held, 64)

    return blocks()


def _first_block(blocks):
    """The only block, or None and all blocks where there are several."""
    first = next(blocks, [])
    second = next(blocks, None)
    return (first, None) if second is None else (None, itertools.chain([first, second], blocks))


def scan_windows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated and spans (array of hit stretches [a, b) of words).

    A null or empty text has no words. Items with a null id or text are left out; of items with one id all windows
    count for that id. Repeated rows of ``docs`` keep a row each, other columns are ignored, an empty table or
    benchmark gives no hits. No shuffle unless the benchmark exceeds ``block_bytes``: then the documents are scanned
    for each block of items, and the few hits of the blocks are brought together.
    """
    kind = dict(docs.dtypes)[key]
    only, blocks = _first_block(_blocks(_items(benchmark, item, item_text), block_bytes))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    if blocks is None:
        return map_texts(rows, _scanner(docs.sparkSession, only, window, True), f"key {kind}, {_RESULT}").withColumnRenamed("key", key)
    both = _scan_blocks(rows, blocks, kind, window).select("key", "n_words", "spans", "items")

    def make():
        def run(batch: pa.RecordBatch):
            r = batch.to_pylist()
            return _finished(batch.column(0), [(x["n_words"], joined([(s["a"], s["b"]) for s in x["spans"] or []]), set(x["items"] or [])) for x in r])

        return run

    return map_texts(both, make, f"key {kind}, {_RESULT}").withColumnRenamed("key", key)


def _scan_blocks(rows: DataFrame, blocks, kind: str, window: int) -> DataFrame:
    """key, of (hash of the text), n_words, spans and items of each row, brought together over the blocks of a large benchmark.

    The documents are scanned for one block after the other: a block is broadcast, its hits are written, and it goes.
    """
    rows = rows.select("key", "text", F.xxhash64("text").alias("of"))
    base = map_texts(rows, _counter, f"key {kind}, of long, n_words long")
    hits = None
    for block in blocks:
        scan = _scanner(rows.sparkSession, block, window, False)
        one = written(map_texts(rows, scan, f"key {kind}, of long, spans array<struct<a:long,b:long>>, items array<string>"), "benchmark-hits")
        scan.sent.destroy()
        hits = one if hits is None else hits.unionByName(one)
    # Only hits are left in these rows; equal rows have equal hits, so one of them is enough.
    found = hits.groupBy("key", "of").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items")).withColumnsRenamed({"key": "_key", "of": "_of"})
    return base.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("of") == F.col("_of")), "left").drop("_key", "_of")


def _counter():
    return lambda b: {"key": b.column(0), "of": b.column(2), "n_words": [len(words_of(t)) for t in b.column(1).to_pylist()]}


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<a:long,b:long>>"


def _finished(keys, found) -> dict:
    out: dict = {"key": keys, "n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": [], "spans": []}
    for n, spans, items in found:
        hit = sum(b - a for a, b in spans)
        out["n_words"].append(n)
        out["n_hit"].append(hit)
        out["n_items"].append(len(items))
        out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        out["contaminated"].append(hit > 0 and SHARE * hit >= n)
        out["spans"].append([{"a": a, "b": b} for a, b in spans])
    return out


def _scanner(spark, block, window: int, whole: bool):
    sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text, or one item

    def make():
        windows = Windows(sent.value, window)

        def run(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            found = [windows.scan(t) for t in texts]
            if whole:
                return _finished(batch.column(0), found)
            hit = [i for i, f in enumerate(found) if f[1]]
            at = pa.array(hit, pa.int64())
            return {"key": batch.column(0).take(at), "of": batch.column(2).take(at), "spans": [[{"a": a, "b": b} for a, b in found[i][1]] for i in hit], "items": [sorted(found[i][2]) for i in hit]}

        return run

    make.sent = sent
    return make


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the stretches and what stands between them; white space at a cut becomes one space."""
    raw = text.encode()
    gaps = raw.translate(_WORDS)
    starts, ends = [], []
    a = np.frombuffer(gaps, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, a, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : starts[first]].rstrip())
        at = int(ends[end - 1])
    out.append(raw[at:].lstrip() if spans else raw)
    return b" ".join(x for x in out if x).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with its columns: contaminated documents are gone; in the others the hit stretches of words are cut out.

    A document whose text is null, empty or without hits stays as it is. A row is judged by its own text: repeated rows
    go or stay together, rows with a null key are kept or cut like others, columns of any name are carried along, an
    empty table stays empty, and an empty benchmark leaves all as it is.
    """
    item, item_text, window = more.get("item", "item_id"), more.get("item_text", "text"), more.get("window", WINDOW)
    only, blocks = _first_block(_blocks(_items(benchmark, item, item_text), more.get("block_bytes", BLOCK_BYTES)))
    place, columns, schema = docs.columns.index(text), docs.columns, docs.schema
    if blocks is None:
        sent = docs.sparkSession.sparkContext.broadcast(only)  # at most BLOCK_BYTES of text, or one item

        def scan():
            windows = Windows(sent.value, window)
            return lambda batch: [windows.scan(t)[:2] for t in batch.column(place).to_pylist()]

        rows = docs
    else:
        found = _scan_blocks(docs.select(docs[key].alias("key"), docs[text].alias("text")), blocks, dict(docs.dtypes)[key], window)
        found = found.where(F.size("spans") > 0).select(F.col("key").alias("_hit_key"), F.col("of").alias("_hit_of"), F.struct("n_words", "spans").alias("_hit")).dropDuplicates(["_hit_key", "_hit_of"])
        rows = docs.join(found, docs[key].eqNullSafe(F.col("_hit_key")) & (F.xxhash64(docs[text]) == F.col("_hit_of")), "left").select(*[docs[c] for c in columns], "_hit")

        def scan():
            return lambda batch: [(h["n_words"], [(s["a"], s["b"]) for s in h["spans"]]) if h else (0, []) for h in batch.column(len(columns)).to_pylist()]

    def run(batches):
        from .common import slices

        find = scan()
        for batch in slices(batches):
            texts, keep = batch.column(place).to_pylist(), []
            for i, (n, spans) in enumerate(find(batch)):
                hit = sum(b - a for a, b in spans)
                keep.append(not (hit and SHARE * hit >= n))
                if hit and keep[-1]:
                    texts[i] = cut_spans(texts[i], spans)
            own = batch.columns[: len(columns)]
            own[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(own, names=columns).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, schema)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return scan_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), iw AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS (
    SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s
), places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
