"""Token blocks, BPE and counts against the tokenizers library on whole texts."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pytest
from odd import ODD_TEXTS, docs, empty
from pyspark.sql import functions as F

from tephra.llm.bpe import SPLIT, ByteBpe, encode_decode, op5_bpe
from tephra.llm.common import fresh_path
from tephra.llm.encoders import BYTE_SPLIT, LibraryEncoder, load_tokenizer, tokenizer_path
from tephra.llm.token_blocks import op1_token_blocks, pack, read_token_segments, unpack, write_token_segments
from tephra.llm.token_counts import count_tokens, op10_token_counts

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@functools.cache
def tokenizer_of(name):
    return load_tokenizer(tokenizer_path(name))


def library_ids(name, text):
    return tokenizer_of(name).encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_is_the_library(name, spark, sf_dir):
    encoder, tokenizer = LibraryEncoder(name, cache_bytes=100_000), load_tokenizer(tokenizer_path(name))
    texts = ODD_TEXTS + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in texts:
        assert encoder.ids(t) == raw(tokenizer.encode(t or "", add_special_tokens=False).ids), repr(t)[:80]


def test_numpy_merges_are_the_library(spark, sf_dir):
    bpe, tokenizer = ByteBpe(BYTE, cache_bytes=100_000), load_tokenizer(tokenizer_path(BYTE))
    texts = ODD_TEXTS + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for at in range(0, len(texts), 7):
        for t, ids in zip(texts[at : at + 7], bpe.encode_batch(texts[at : at + 7])):
            want = tokenizer.encode(t or "", add_special_tokens=False).ids
            assert ids == raw(want)
            assert bpe.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False)
    broken = [64, 200, 12520, 249]
    assert bpe.decode(raw(broken)).decode() == tokenizer.decode(broken, skip_special_tokens=False)


def test_split_classes_are_those_of_unicode():
    import regex

    split = regex.compile(SPLIT)
    rng = np.random.default_rng(3)
    every = "".join(map(chr, range(1, 0x250)))
    texts = [every, "".join(c + " " for c in every), "".join(c + "x" for c in every), "".join(c + "1 " for c in every)]
    texts += ["".join(rng.choice(list(" '\n\tsSTrevmld.!1\u00e9\u00bd\x1c\u00a0"), 60)) for _ in range(500)]
    for t in texts:
        assert BYTE_SPLIT.findall(t) == split.findall(t)
    encoder, tokenizer = LibraryEncoder(WORD), load_tokenizer(tokenizer_path(WORD))
    for t in texts:
        assert encoder.ids(t) == raw(tokenizer.encode(t, add_special_tokens=False).ids)


def random_texts(n, seed, top=0x3000):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        low, high = [(1, 0x250), (1, top), (0x20, 0x7F)][int(rng.integers(3))]
        codes = rng.integers(low, high, int(rng.integers(1, 14)))
        yield "".join(" " if rng.random() < 0.1 else chr(c) for c in codes)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_every_character_as_the_library(name):
    """Alone, in capitals and inside words, each in a text of its own; and random mixtures."""
    encoder, tokenizer = LibraryEncoder(name), tokenizer_of(name)
    texts = [t for c in map(chr, range(1, 0x3000)) for t in (c, c.upper(), f"a{c}b", f"A{c}{c.upper()} X")]
    texts += random_texts(5000, 5)
    for t, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encoder.ids(t) == raw(want.ids), ascii(t)


def test_very_long_texts():
    """Megabytes of one word, of words and of non-Latin letters, against the library."""
    for name in (WORD, BYTE):
        encoder, tokenizer = LibraryEncoder(name), tokenizer_of(name)
        for t in ("ab c " * 400_000, "z" * 100_000, "\u0416\u0438 " * 200_000):
            assert encoder.ids(t) == raw(tokenizer.encode(t, add_special_tokens=False).ids)
    bpe = ByteBpe(BYTE)
    for t in ("ab c " * 400_000, "z" * 100_000, "\u0416\u0438 " * 200_000):
        assert bpe.encode_batch([t])[0] == raw(library_ids(BYTE, t)) and bpe.decode(bpe.encode_batch([t])[0]).decode() == t


@pytest.mark.parametrize("block", [8, 128, 256])
def test_pack_round_trip(block):
    rng = np.random.default_rng(1)
    for ids in ([], [5], [0, 2**32 - 1] * 300, list(range(1000)), rng.integers(0, 2**32, 3000), rng.integers(0, 49408, 20000), [7] * 129):
        a = np.array(ids, np.uint32)
        for percentile in (1, 50, 90, 100):
            assert (unpack(pack(a, block, percentile)) == a).all()
    with pytest.raises(ValueError):
        unpack(b"nothing of the kind")


def check_blocks(df, texts_by_key):
    rows = sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1:2])
    start = 0
    for doc_id, at, n, crc in sorted(rows, key=lambda r: (r[1], r[2])):
        assert at == start
        start += n
    keys = [r[0] for r in sorted(rows, key=lambda r: r[1])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted((k if k is not None else -1, zlib.crc32(raw(library_ids(WORD, t) + [2]))) for k, t in texts_by_key)
    assert sorted((r[0] if r[0] is not None else -1, r[3]) for r in rows) == want


def test_blocks_of_odd_rows(spark):
    d = docs(spark)
    pairs = [(r["doc_id"], r["text"]) for r in d.collect()]
    for n in (1, 3):
        check_blocks(read_token_segments(write_token_segments(d, fresh_path(spark, "t"), segment_ids=50, partitions=n)), pairs)
    assert read_token_segments(write_token_segments(empty(spark), fresh_path(spark, "t"))).count() == 0


def test_op1(spark, sf_dir):
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_blocks(op1_token_blocks(spark, sf_dir), pairs)


def test_op5(spark, sf_dir):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for got, source in ((op5_bpe(spark, sf_dir), d), (encode_decode(docs(spark)), docs(spark)), (encode_decode(empty(spark)), empty(spark))):
        want = []
        for r in source.collect():
            ids = library_ids(BYTE, r["text"])
            want.append((r["doc_id"], len(ids), sha(raw(ids)), sha(tokenizer_of(BYTE).decode(ids, skip_special_tokens=False).encode())))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def want_counts(source):
    out = []
    for r in source.collect():
        n = len(library_ids(BYTE, r["text"]))
        out.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
    return sorted(out, key=repr)


def test_op10(spark, sf_dir):
    assert sorted(map(tuple, op10_token_counts(spark, sf_dir).collect()), key=repr) == want_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_counts_come_from_the_cache(spark):
    path = fresh_path(spark, "cache")
    d = docs(spark)
    assert sorted(map(tuple, count_tokens(d, path).collect()), key=repr) == want_counts(d)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("digest").distinct().count() == d.select(F.coalesce("text", F.lit(""))).distinct().count()
    more = d.unionByName(docs(spark, ["a new text", "The and of the"], start=100))
    assert sorted(map(tuple, count_tokens(more, path).collect()), key=repr) == want_counts(more)
    assert spark.read.parquet(path).count() == stored.count() + 1
    # Another tokenizer has its own counts.
    piece = count_tokens(d, path, tokenizer="piece_bpe_32k.model").where("doc_id = 18").first()
    assert piece["n_tokens"] != 0 and spark.read.parquet(path).select("tokenizer").distinct().count() == 2
    assert count_tokens(empty(spark), path).count() == 0
