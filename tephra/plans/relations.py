"""The engine's relations over the test tables, as DataFrames and as SQL text for the checks.

requests       events: the key is the user, an error deletes, all else puts the props
log            the accepted requests of ``requests``, numbered
stock          orders: each order a put under its own key; streams are eight shards of the customers
line_log       lineitem: all rows in the order of all columns; returned lines delete their order's key
runs           line_log in seven runs of falling size (the first half, the next quarter, ...), latest version of a key in each
blocks         runs cut at every 64th key
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import ordered_prefix
from ..functions.shared import written
from ..functions.sizes import entry_size
from ..operators import admission, compaction

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RUNS = 7
BLOCK_KEYS = 64
#: The table sizes that thresholds are set for; any will do.
CLOSE_NO, WATERMARK, STREAMS = 700, 400, 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def requests(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    if dirty:
        key = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(key)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("req_no"), F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"), key.alias("key"), F.col("props").alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.change_log(requests(spark, sf_dir))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.resolve import entries_of

    return entries_of(log(spark, sf_dir))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % STREAMS).alias("stream"), F.col("o_orderkey").alias("seq_no"), F.lit("PUT").alias("op"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))


def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, seq_no, is_tombstone of line_log."""
    rows = ordered_prefix(read(spark, sf_dir, "lineitem").select(*LINE_COLUMNS), LINE_COLUMNS, "seq_no")
    dead = F.col("l_returnflag") == "R"
    return rows.select(F.col("l_orderkey").cast("string").alias("key"), F.when(~dead, F.col("l_linestatus")).alias("value"), "seq_no", dead.alias("is_tombstone"))


def _run_id(n: int):
    """Which share of the log a row lies in, by whole numbers only."""
    out = F.lit(RUNS - 1)
    for r in range(RUNS - 2, -1, -1):
        out = F.when(F.col("seq_no") * (1 << (r + 1)) <= n * ((1 << (r + 1)) - 1), r).otherwise(out)
    return out.cast("long")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").count()
    rows = line_entries(spark, sf_dir).withColumn("run_id", _run_id(n))
    newest = rows.groupBy("run_id", "key").agg(F.max(F.struct("seq_no", "is_tombstone", "value")).alias("e"))
    return written(newest.select("run_id", "key", "e.value", "e.seq_no", "e.is_tombstone"), "runs")


def manifest(entries: DataFrame) -> DataFrame:
    """A row a run, with a file name."""
    return written(compaction.run_metadata(entries).withColumn("file_name", F.format_string("%06d.sst", F.col("id"))), "manifest")


def blocks(entries: DataFrame) -> DataFrame:
    """run_id, block_no, first_key, length: runs cut at every BLOCK_KEYS-th key. A run's rows are numbered in ranges of its keys."""
    placed = ordered_prefix(entries, ["run_id", "key"], "_row")
    first = placed.groupBy("run_id").agg(F.min("_row").alias("_first"))
    numbered = placed.join(first, "run_id").withColumn("block_no", F.floor((F.col("_row") - F.col("_first")) / BLOCK_KEYS).cast("int"))
    return numbered.groupBy("run_id", "block_no").agg(F.min("key").alias("first_key"), F.sum(entry_size()).alias("length"))


def asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: every 50th order, of which some have no lines, and some keys that don't exist."""
    some = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("key"))
    return some.unionByName(some.select(F.concat(F.col("key"), F.lit("x")).alias("key")))


def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of ``stock`` in segments of 40 records; every 97th record is damaged."""
    w = Window.partitionBy("segment").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = stock(spark, sf_dir).select(F.floor(F.col("seq_no") / 40).alias("segment"), "seq_no", "op", "key", "value", (F.col("seq_no") % 97 != 0).alias("ok"))
    from ..functions.sizes import record_size

    return rows.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).withColumn("end_offset", F.sum(record_size()).over(w) + 8)


_SIZE = "CAST(strlen(key) + strlen(coalesce(value, '')) + 32 AS BIGINT)"

SQL = {
    "requests": "requests AS (SELECT event_id AS req_no, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, 'user:' || CAST(user_id AS VARCHAR) AS key, props AS value FROM events)",
    "dirty": "dirty AS (SELECT event_id AS req_no, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, CASE WHEN user_id % 10 = 0 THEN '' ELSE 'user:' || CAST(user_id AS VARCHAR) END AS key, props AS value FROM events)",
    "log": "log AS (SELECT CAST(row_number() OVER (ORDER BY req_no) AS BIGINT) AS seq_no, req_no, op, key, CASE WHEN op = 'PUT' THEN value END AS value, op = 'DEL' AS is_tombstone FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY req_no) AS prev FROM requests) WHERE op = 'PUT' OR prev = 'PUT')",
    "stock": "stock AS (SELECT o_custkey % 8 AS stream, o_orderkey AS seq_no, 'PUT' AS op, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders)",
    "line": f"line AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS value, row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) AS seq_no, l_returnflag = 'R' AS is_tombstone, count(*) OVER () AS n FROM lineitem)",
    "runs": "runs AS (SELECT run_id, key, value, seq_no, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq_no DESC) AS rn FROM (SELECT *, CAST(CASE " + " ".join(f"WHEN seq_no * {1 << (r + 1)} <= n * {(1 << (r + 1)) - 1} THEN {r}" for r in range(RUNS - 1)) + f" ELSE {RUNS - 1} END AS BIGINT) AS run_id FROM line)) WHERE rn = 1)",
    "manifest": f"manifest AS (SELECT run_id AS id, printf('%06d.sst', run_id) AS file_name, min(key) AS min_key, max(key) AS max_key, min(seq_no) AS min_seq_no, max(seq_no) AS max_seq_no, count(*) AS num_entries, CAST(sum({_SIZE}) AS BIGINT) AS file_size, count(*) FILTER (WHERE is_tombstone) AS tombstones, CAST(row_number() OVER (ORDER BY run_id DESC) - 1 AS INTEGER) AS position FROM runs GROUP BY run_id)",
    "blocks": f"blocks AS (SELECT run_id, CAST(block_no AS INTEGER) AS block_no, min(key) AS first_key, CAST(sum({_SIZE}) AS BIGINT) AS length FROM (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY key) - 1) // {BLOCK_KEYS} AS block_no FROM runs) GROUP BY run_id, block_no)",
    "asked": "asked AS (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || 'x' FROM orders WHERE o_orderkey % 50 = 0)",
    "physical": "physical AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, CAST(sum(strlen(key) + strlen(value) + 25) OVER w + 8 AS BIGINT) AS end_offset FROM (SELECT CAST(o_orderkey // 40 AS BIGINT) AS segment, o_orderkey AS seq_no, 'PUT' AS op, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value, o_orderkey % 97 <> 0 AS ok FROM orders) WINDOW w AS (PARTITION BY segment ORDER BY seq_no ROWS UNBOUNDED PRECEDING))",
}
_NEEDS = {"log": ["requests"], "runs": ["line"], "manifest": ["runs"], "blocks": ["runs"]}
SIZE = _SIZE


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the definitions of the named relations and of what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in order) + " " + body
