"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every pair of neighbours is looked up by binary search
in the sorted pair keys, each word's lowest rank is found, and all places that have it are merged; words without a
pair in the table leave the array. Both ids of a pair are below 2**20, so a pair's key fits 64 bits.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .encoders import BYTE_SPLIT, CACHE_BYTES, ENTRY_BYTES, byte_letters, is_latin, tokenizer_path

#: The public split pattern of this family of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words that one flat array takes at most, but for a single longer word.
ARRAY_BYTES = 4 << 20
_SHIFT = np.int64(20)
_NONE = np.int64(1) << 40


class ByteBpe:
    def __init__(self, name_or_path: str = "byte_bpe_50k.json", cache_bytes: int = CACHE_BYTES):
        with open(tokenizer_path(name_or_path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)  # the lowest rank of a pair
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks, self.made = keys, first.astype(np.int64), made[first]
        self.rank_made = made
        to_byte = {c: b for b, c in enumerate(letters)}
        ids = {**vocab, **self.special}
        self.token_bytes: list[bytes] = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.token_bytes[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.limit, self.held = cache_bytes, 0
        self.words: dict[str | int, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= ARRAY_BYTES):
                size += len(words[end])
                end += 1
            out += self._rounds(words[at:end])
            at = end
        return out

    def _rounds(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            if len(sym) > 1:
                key = sym[:-1] << _SHIFT | sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][ok] = self.ranks[at[ok]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            n = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(lowest == _NONE, n)
            if over.any():  # words without a pair in the table leave
                done.append(sym[over])
                owner.append(word[over])
            hit = np.flatnonzero((rank == np.repeat(lowest, n)) & ~over)
            if len(hit):
                # Of places that follow each other (a pair of equal symbols), the first, third, ... are merged.
                run = np.r_[True, np.diff(hit) != 1]
                nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[nth % 2 == 0]
                sym[hit] = self.rank_made[rank[hit]]
                keep = ~over
                keep[hit + 1] = False
            else:
                keep = ~over
            sym, word = sym[keep], word[keep]
        if not done:
            return [b""] * len(words)
        ids, own = np.concatenate(done), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(own, minlength=len(words))) * 4
        return [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def _split(self, text: str) -> list[str]:
        return BYTE_SPLIT.findall(text) if is_latin(text) else self.split.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes; strings of special tokens give their ids. Null: none."""
        cut: list[list] = []
        for t in texts:
            if not t:
                cut.append([])
            elif self.special_split is not None and any(s in t for s in self.special):
                cut.append([w for x in self.special_split.split(t) if x for w in ([self.special[x]] if x in self.special else self._split(x))])
            else:
                cut.append(self._split(t))
        need: set[str] = set()
        for words in cut:
            need.update(words)
        ids = {i for i in self.special.values() if i in need}
        new = (need - ids) - self.words.keys()
        if self.held > self.limit:  # what one batch adds is bounded by the batch itself
            self.words, self.held, new = {}, 0, need - ids
        new = list(new)
        merged = self.merge_words([w.encode() for w in new])
        self.held += sum(map(len, merged)) + 4 * sum(map(len, new)) + ENTRY_BYTES * len(new)
        self.words.update(zip(new, merged))
        self.words.update((i, i.to_bytes(4, "little")) for i in ids)
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", errors="replace").encode()


@functools.cache
def shared_bpe(name_or_path: str) -> ByteBpe:
    """One encoder for all tasks of a worker."""
    return ByteBpe(name_or_path)


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", values: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again: key, n_tokens, ids_sha256, decoded_sha256; with ``values`` also ids (bytes) and decoded.

    A null text counts as empty. Each row stands for itself, so repeated rows and null keys stay as they are. No
    shuffle; a worker keeps CACHE_BYTES of pieces and those of one batch.
    """
    more = ", ids binary, decoded string" if values else ""

    def make():
        bpe = shared_bpe(tokenizer)
        sha = hashlib.sha256

        def run(batch: pa.RecordBatch):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            raw = [bpe.decode(x) for x in ids]
            out = {"key": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x).hexdigest() for x in ids], "decoded_sha256": [sha(x).hexdigest() for x in raw]}
            return out | {"ids": ids, "decoded": [x.decode() for x in raw]} if values else out

        return run

    kind = dict(docs.dtypes)[key]
    return map_texts(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("key", key)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
