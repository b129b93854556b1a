"""Token counts behind a cache of digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_texts, written
from .encoders import file_digest, shared_encoder, tokenizer_path

CACHE = "digest binary, n_tokens long, tokenizer string"
SALTS = 4
#: Words of 64 bits in the filter of missing digests: a table of proven size that is broadcast.
FILTER_WORDS = 1 << 16
#: Counting options that are part of the cached version.
OPTIONS = "add_special_tokens=False,truncation=None,padding=None"


def tokenizer_version(name_or_path: str) -> str:
    """Digest of the vocabulary file and of how it is used; counts of another version are never taken."""
    return hashlib.sha256(f"{file_digest(tokenizer_path(name_or_path))}|{OPTIONS}".encode()).hexdigest()[:32]


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return lambda p=sentencepiece.SentencePieceProcessor(model_file=path): lambda t: len(p.encode(t, num_threads=1)) if t else 0
    return lambda: shared_encoder(path).count


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row, a null text as an empty one.

    Texts are normalised (null to empty; nothing that could change a count) and digested; digests are joined to the
    cache at ``cache_path``. One row stands for each digest that is missing there: only its text is encoded, and the
    count is appended. Repeated rows share a digest and keep a row each. Null keys and an empty table are kept as they
    are, other columns are ignored. Digests are shuffled, and the texts that may be missing from the cache, so that one
    of each is encoded: rows that hit the cache are held back by a bitmap of the missing digests before their texts move,
    as long as these fill at most a quarter of it; beyond, most texts are new, and all move. Without a miss no text is
    read a second time. Two writers may append one digest twice; a reader takes one.
    """
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    version = tokenizer_version(tokenizer)
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    keyed = written(texts.select("k", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "digests")

    def cached() -> DataFrame:
        try:
            table = spark.read.schema(CACHE).parquet(cache_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], CACHE)
        return table.where(F.col("tokenizer") == version)

    # The key that stands for a digest: of null and other keys the least, null first.
    first = keyed.groupBy("digest").agg(F.min(F.struct(F.col("k").isNotNull().alias("has"), F.col("k"))).alias("first"))
    misses = written(first.join(cached().select("digest").distinct(), "digest", "left_anti").select(F.col("digest").alias("d"), F.col("first.k").alias("stands")), "misses")
    missing = misses.count()
    digested = texts.withColumn("digest", digest)
    if missing <= 16 * FILTER_WORDS:
        word, bit = F.pmod(F.xxhash64("digest"), F.lit(FILTER_WORDS)), F.pmod(F.xxhash64("digest", F.lit("bit")), F.lit(64)).cast("int")
        bitmap = misses.select(F.col("d").alias("digest")).select(word.alias("word"), F.expr("shiftleft(1L, int(pmod(xxhash64(digest, 'bit'), 64L)))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
        held = digested.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(bitmap), "word")  # FILTER_WORDS rows at most
        digested = held.where(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1")).select("k", "text", "digest")
    encode = digested.join(misses, (F.col("digest") == F.col("d")) & F.col("k").eqNullSafe(F.col("stands"))).select("digest", "text")

    def make():
        count = _counter(path)()
        seen: set[bytes] = set()

        def run(batch: pa.RecordBatch):
            # Rows that repeat key and text stand for one digest together: they meet in a task, which encodes one of them.
            new = [i for i, d in enumerate(batch.column(0).to_pylist()) if d not in seen and not seen.add(d)]
            rows = batch.take(pa.array(new, pa.int64()))
            return {"digest": rows.column(0), "n_tokens": [count(t) for t in rows.column(1).to_pylist()]}

        return run

    if missing:
        counted = map_texts(encode, make, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(version))
        counted.write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = cached().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # A digest with a third of all rows: its count is copied under salts, and the rows are dealt out over them.
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(counts, ["digest", "salt"]).select(F.col("k").cast(kind).alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """A cache of its own for each call: every distinct text is encoded once."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "count-cache"))
