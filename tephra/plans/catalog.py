"""Every query of the key-value engine with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.shared import fresh_path, written
from ..functions.sizes import bloom_bits, bloom_hashes
from ..operators import admission, compaction, folds, inspection, maintenance, resolve
from ..sources import eventlog, manifest_store, sst, wal
from ..sources import requests as request_source
from . import relations as R
from .relations import SIZE, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LATEST = "SELECT key, value, CAST(seq_no AS BIGINT) AS seq_no, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS rn FROM {0}) WHERE rn = 1"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Write path


@query(sql("SELECT req_no, op, key, CASE WHEN key = '' THEN 'InvalidArgument' ELSE 'OK' END AS status FROM dirty", "dirty"))
def validate_requests(spark, d):
    return admission.validate(R.requests(spark, d, dirty=True)).select("req_no", "op", "key", "status")


@query(sql("SELECT req_no, op, key, CASE WHEN op = 'PUT' OR prev = 'PUT' THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY req_no) AS prev FROM requests)", "requests"))
def admit_deletes(spark, d):
    return admission.admit(R.requests(spark, d)).select("req_no", "op", "key", "status")


@query(sql(f"SELECT req_no, op, key, CASE WHEN key = '' THEN 'InvalidArgument' WHEN op = 'DEL' AND coalesce(prev, 'DEL') <> 'PUT' THEN 'NOT_FOUND' WHEN req_no > {R.CLOSE_NO} THEN 'StoreClosed' ELSE 'OK' END AS status FROM (SELECT *, last_value(CASE WHEN req_no <= {R.CLOSE_NO} THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY req_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dirty)", "dirty"))
def closed_gate(spark, d):
    return admission.admit(R.requests(spark, d, dirty=True), R.CLOSE_NO).select("req_no", "op", "key", "status")


@query(sql("SELECT req_no, seq_no, op, key FROM log", "log"))
def assign_seq(spark, d):
    return admission.assign_seq(admission.accepted(R.requests(spark, d))).select("req_no", "seq_no", "op", "key")


@query(sql("SELECT key, value, CAST(seq_no AS BIGINT) AS seq_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS rn FROM log WHERE op = 'PUT') WHERE rn = 1", "log"))
def put_state(spark, d):
    return resolve.latest(R.log_entries(spark, d).where(~F.col("is_tombstone"))).select("key", "value", "seq_no")


@query(sql("SELECT count(*) AS runs, 5 AS stop_writes, count(*) >= 5 AS rejected FROM manifest", "manifest"))
def l0_gate(spark, d):
    return admission.run_gate(R.manifest(R.runs(spark, d)), 5)


@query(sql(f"SELECT seq_no, key, size AS bytes_added, coalesce(prev, 0) AS bytes_removed, CAST(sum(size - coalesce(prev, 0)) OVER (ORDER BY seq_no) AS BIGINT) AS total_bytes FROM (SELECT *, lag(size) OVER (PARTITION BY key ORDER BY seq_no) AS prev FROM (SELECT seq_no, key, {SIZE} AS size FROM log))", "log"))
def op_delta(spark, d):
    return admission.op_delta(R.log(spark, d))


@query("""WITH m AS (SELECT user_id AS stream, epoch_us(ts) // 1000 AS at_ms, event_id AS no, CASE WHEN event_type = 'error' THEN 'BEGIN' ELSE 'CLEAR' END AS kind FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY stream ORDER BY at_ms, no) AS prev FROM m) WHERE coalesce(prev <> kind, kind = 'BEGIN'))
SELECT stream, count(*) AS stalls, CAST(sum(nxt - at_ms) AS BIGINT) AS stall_ms FROM (SELECT *, lead(at_ms) OVER (PARTITION BY stream ORDER BY at_ms, no) AS nxt FROM r) WHERE kind = 'BEGIN' AND nxt IS NOT NULL GROUP BY stream""")
def stall_time(spark, d):
    e = R.read(spark, d, "events").where("event_type IN ('error', 'purchase')")
    marks = e.select(F.col("user_id").alias("stream"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"), F.col("event_id").alias("no"), F.when(F.col("event_type") == "error", "BEGIN").otherwise("CLEAR").alias("kind"))
    return admission.stall_time(marks)


# Folds

_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq_no) AS i FROM stock)"


@query(sql(f", {_NUMBERED}, f AS (SELECT stream, seq_no, key, i, {SIZE} AS total, CAST(0 AS BIGINT) AS epoch FROM n WHERE i = 1 UNION ALL SELECT n.stream, n.seq_no, n.key, n.i, CASE WHEN f.total >= 4096 THEN 0 ELSE f.total END + CAST(strlen(n.key) + strlen(n.value) + 32 AS BIGINT), f.epoch + CASE WHEN f.total >= 4096 THEN 1 ELSE 0 END FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1) SELECT stream, seq_no, key, epoch, total AS total_bytes FROM f", "stock", recursive=True))
def rotate_epochs(spark, d):
    return folds.rotate_epochs(R.stock(spark, d), 4096)


@query(sql(f", {_NUMBERED}, f AS (SELECT stream, seq_no, key, i, CAST(8 + strlen(key) + strlen(value) + 25 AS BIGINT) AS size, CAST(1 AS BIGINT) AS segment FROM n WHERE i = 1 UNION ALL SELECT n.stream, n.seq_no, n.key, n.i, CASE WHEN f.size >= 4096 THEN 8 ELSE f.size END + CAST(strlen(n.key) + strlen(n.value) + 25 AS BIGINT), f.segment + CASE WHEN f.size >= 4096 THEN 1 ELSE 0 END FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1) SELECT stream, seq_no, key, segment, size AS end_offset FROM f", "stock", recursive=True))
def wal_segments(spark, d):
    return folds.wal_segments(R.stock(spark, d), 4096)


def _overwrites_sql(columns: str, cooldown_ms: int) -> str:
    """The fold of rotate_epochs: a key's former entry counts only if it was written after the last rotation (cut)."""
    numbered = f"n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq_no) AS i, lag(seq_no) OVER k AS prev_no, lag(size) OVER k AS prev_size FROM (SELECT *, CAST(substr(key, 6) AS BIGINT) % 4 AS stream, {SIZE} AS size FROM log) WINDOW k AS (PARTITION BY key ORDER BY seq_no))"
    step = f"SELECT n.stream, n.i, n.seq_no, n.key, f.following AS epoch, f.cut, f.total + n.size - CASE WHEN n.prev_no > f.cut THEN n.prev_size ELSE 0 END AS grown, (grown >= 128 AND (f.last_ms IS NULL OR 7 * n.seq_no - f.last_ms >= {cooldown_ms})) AS rot, f.last_ms FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1"
    return f""", {numbered}, f AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq_no, '' AS key, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS following, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS total_bytes, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS last_ms FROM n
UNION ALL SELECT stream, i, seq_no, key, epoch, CASE WHEN rot THEN epoch + 1 ELSE epoch END, CASE WHEN rot THEN seq_no ELSE cut END, grown, CASE WHEN rot THEN 0 ELSE grown END, CASE WHEN rot THEN 7 * seq_no ELSE last_ms END FROM ({step})) SELECT {columns} FROM f WHERE i > 0"""


def _user_stream(spark, d) -> DataFrame:
    """The log in four streams of users, a write every seven milliseconds."""
    return R.log(spark, d).withColumn("stream", F.expr("CAST(substr(key, 6) AS BIGINT) % 4")).withColumn("at_ms", 7 * F.col("seq_no"))


@query(sql(_overwrites_sql("stream, seq_no, key, epoch, total_bytes", 0), "log", recursive=True))
def rotate_overwrites(spark, d):
    return folds.rotate_epochs(_user_stream(spark, d), 128)


@query(sql(_overwrites_sql("stream, seq_no, key, epoch, total_bytes", 700), "log", recursive=True))
def rotate_cooldown(spark, d):
    return folds.rotate_epochs(_user_stream(spark, d), 128, cooldown_ms=700)


def _queue_sql(columns: str, above: int, max_bytes: int, queue: int, flush_every: int) -> str:
    """Rotation with a bounded queue, one grace and a block; with flush_every also the rejections and flushes."""
    freed = f"(n.i % {flush_every} = 0 AND f.immutables > 0)" if flush_every else "FALSE"
    added = "CASE WHEN stuck THEN 0 ELSE n.size END" if flush_every else "n.size"
    step = f"SELECT n.stream, n.i, n.seq_no, n.key, f.following AS epoch, {freed} AS freed, f.immutables - CASE WHEN freed THEN 1 ELSE 0 END AS waiting, (f.blocked AND NOT freed) AS stuck, f.grace, f.total + {added} AS grown, (NOT stuck AND grown >= CASE WHEN f.grace THEN {int(max_bytes * 1.25)} ELSE {max_bytes} END) AS reached, (reached AND waiting < {queue}) AS rot FROM f JOIN n ON n.stream = f.stream AND n.i = f.i + 1"
    return f""", n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq_no) AS i, {SIZE} AS size FROM stock WHERE seq_no > {above}), f AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq_no, '' AS key, 'OK' AS outcome, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS following, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS immutables, FALSE AS grace, FALSE AS blocked FROM n
UNION ALL SELECT stream, i, seq_no, key, CASE WHEN stuck THEN 'Backpressure' ELSE 'OK' END, epoch, CASE WHEN rot THEN epoch + 1 ELSE epoch END, CASE WHEN rot THEN 0 ELSE grown END, waiting + CASE WHEN rot THEN 1 ELSE 0 END, (NOT rot AND (grace OR reached)), stuck OR (reached AND NOT rot AND grace) FROM ({step})) SELECT {columns} FROM f WHERE i > 0"""


@query(sql(_queue_sql("stream, seq_no, key, outcome, epoch, immutables, grace", -1, 1024, 2, 40), "stock", recursive=True))
def backpressure_sim(spark, d):
    return folds.simulate_backpressure(R.stock(spark, d), 1024, 2, 40)


@query(sql(_queue_sql("stream, seq_no, key, epoch, immutables, grace, blocked", R.WATERMARK, 1024, 8, 0), "stock", recursive=True))
def rebuild_memtables(spark, d):
    return folds.rebuild(R.stock(spark, d), R.WATERMARK, 1024, 8)


@query(sql(LATEST.format(f"(SELECT * FROM log WHERE seq_no > {R.WATERMARK})"), "log"))
def recover_state(spark, d):
    return resolve.latest(folds.recover(R.log_entries(spark, d), R.WATERMARK))


# Reads


@query(sql(LATEST.format("log"), "log"))
def latest_state(spark, d):
    return resolve.latest(R.log_entries(spark, d))


@query(sql(f"SELECT key, value, seq_no FROM ({LATEST.format('log')}) WHERE NOT is_tombstone", "log"))
def live_state(spark, d):
    return resolve.live(R.log_entries(spark, d))


@query(sql(LATEST.format("line"), "line"))
def latest_lines(spark, d):
    return resolve.latest(R.line_entries(spark, d))


@query(sql(f"SELECT 'user:3' AS key, coalesce(max(CASE WHEN is_tombstone THEN 'TOMBSTONE' ELSE 'FOUND' END), 'NOT_FOUND') AS status, max(value) AS value FROM ({LATEST.format('log')}) WHERE key = 'user:3'", "log"))
def point_get(spark, d):
    return resolve.get(R.log_entries(spark, d), "user:3")


_STATUS = "CASE WHEN l.seq_no IS NULL THEN 'NOT_FOUND' WHEN l.is_tombstone THEN 'TOMBSTONE' ELSE 'FOUND' END"


@query(sql(f"SELECT a.key, {_STATUS} AS status, CASE WHEN NOT l.is_tombstone THEN l.value END AS value FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN ({LATEST.format('runs')}) l USING (key)", "asked", "runs"))
def multi_get(spark, d):
    return resolve.multi_get(R.runs(spark, d), R.asked_keys(spark, d))


@query(sql(f"SELECT a.key, {_STATUS} AS status, CASE WHEN NOT l.is_tombstone THEN l.value END AS value, CAST(l.position AS INTEGER) AS position FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS rn FROM (SELECT *, (run_id + 3) % {R.RUNS} AS position FROM runs)) WHERE rn = 1) l USING (key)", "asked", "runs"))
def layered_get(spark, d):
    layers = R.runs(spark, d).withColumn("position", ((F.col("run_id") + 3) % R.RUNS).cast("int"))
    return resolve.layered_get(layers, R.asked_keys(spark, d))


@query(sql("SELECT a.key, m.id FROM (SELECT DISTINCT key FROM asked) a JOIN manifest m ON a.key >= m.min_key AND a.key <= m.max_key", "asked", "manifest"))
def prune_runs(spark, d):
    return resolve.prune_runs(R.manifest(R.runs(spark, d)), R.asked_keys(spark, d))


@query(sql("SELECT DISTINCT b.run_id, a.key, max(b.block_no) AS block_no FROM (SELECT DISTINCT key FROM asked) a JOIN blocks b ON b.first_key <= a.key GROUP BY b.run_id, a.key", "asked", "blocks"))
def block_lookup(spark, d):
    runs = R.runs(spark, d)
    asked = R.asked_keys(spark, d).distinct().withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(R.RUNS - 1).cast("long"))))
    return resolve.block_lookup(R.blocks(runs), asked)


@query(sql("""SELECT a.key, TRUE AS checked_memtable, count(*) FILTER (WHERE m.id IS NOT NULL AND a.key >= m.min_key AND a.key <= m.max_key) AS sstables_consulted, count(*) FILTER (WHERE m.id IS NOT NULL AND NOT (a.key >= m.min_key AND a.key <= m.max_key)) AS range_skipped, h.hit_position
FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN (SELECT key, CASE WHEN bool_or(run_id = 6) THEN -1 ELSE min(position) END AS hit_position FROM (SELECT r.key, r.run_id, m.position FROM runs r LEFT JOIN manifest m ON m.id = r.run_id) GROUP BY key) h USING (key)
LEFT JOIN (SELECT * FROM manifest WHERE id <> 6) m ON m.position <= coalesce(h.hit_position, 2147483647) GROUP BY a.key, h.hit_position""", "asked", "manifest"))
def lookup_trace(spark, d):
    runs = R.runs(spark, d)
    manifest = R.manifest(runs).where("id <> 6")
    return resolve.lookup_trace(runs.where("run_id = 6"), runs.where("run_id <> 6"), manifest, R.asked_keys(spark, d))


@query(sql(f"SELECT a.key, {_STATUS} AS status, CASE WHEN NOT l.is_tombstone THEN l.value END AS value FROM (SELECT DISTINCT 'user:' || CAST(user_id AS VARCHAR) AS key FROM events) a LEFT JOIN ({LATEST.format(f'(SELECT * FROM log WHERE seq_no > {R.WATERMARK})')}) l USING (key)", "log"))
def memtable_get(spark, d):
    keys = R.requests(spark, d).select("key").distinct()
    return resolve.multi_get(R.log_entries(spark, d).where(F.col("seq_no") > R.WATERMARK), keys)


@query(sql(f"SELECT a.key, {_STATUS} AS status, CASE WHEN NOT l.is_tombstone THEN l.value END AS value FROM (SELECT DISTINCT key FROM asked) a LEFT JOIN (SELECT * FROM runs WHERE run_id = 0) l USING (key)", "asked", "runs"))
def run_get(spark, d):
    return resolve.multi_get(R.runs(spark, d).where("run_id = 0"), R.asked_keys(spark, d))


@query(sql("SELECT id AS run_id, num_entries AS keys, CAST(0 AS BIGINT) AS false_negatives FROM manifest", "manifest"))
def bloom_probe(spark, d):
    """Every key of a run must be found in its filter."""
    runs = R.runs(spark, d)
    params = R.manifest(runs).select(F.col("id").alias("run_id"), "num_bits", "num_hashes")
    filters = written(bloom.build_filters(runs, params), "filters")
    return bloom.probe(runs.select("run_id", "key"), filters).groupBy("run_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("may_contain")).alias("false_negatives"))


@query(sql("SELECT id, num_entries, CAST(((greatest(64, CAST(ceil(num_entries * (-ln(0.01) / (ln(2) * ln(2)))) AS BIGINT)) + 7) // 8) * 8 AS BIGINT) AS num_bits, CAST(least(30, greatest(1, round(ln(2) * (-ln(0.01) / (ln(2) * ln(2)))))) AS INTEGER) AS num_hashes FROM manifest", "manifest"))
def bloom_params(spark, d):
    return R.manifest(R.runs(spark, d)).select("id", "num_entries", bloom_bits(F.col("num_entries"), F.lit(0.01)).alias("num_bits"), bloom_hashes(F.lit(0.01)).alias("num_hashes"))


# Sources and sinks


@query(sql("SELECT run_id, key, value, CAST(seq_no AS BIGINT) AS seq_no, is_tombstone FROM runs", "runs"))
def run_scan(spark, d):
    """Runs written as sorted files with bloom filters, and read back."""
    from ..sources.runs import RUN, write_runs

    folder = fresh_path(spark, "runs")
    write_runs(R.runs(spark, d), folder)
    return spark.read.schema(f"{RUN}, run_id long").parquet(folder).select("run_id", "key", "value", "seq_no", "is_tombstone")


@query(sql("SELECT printf('%06d.sst', run_id) AS file, key, value, CAST(seq_no AS BIGINT) AS seq_no, is_tombstone FROM runs", "runs"))
def sst_scan(spark, d):
    """All runs packed as binary run files, a file for each range of a run's keys, and read back."""
    folder = fresh_path(spark, "sst")
    sst.write_sst(R.runs(spark, d), folder)
    return sst.read_sst(spark, folder).drop("block_no")


@query(sql(f"SELECT row_number() OVER (ORDER BY key) AS ordinal, key, value, seq_no, is_tombstone FROM ({LATEST.format('log')})", "log"))
def memtable_scan(spark, d):
    return inspection.memtable_scan(R.log_entries(spark, d)).select("ordinal", "key", "value", "seq_no", "is_tombstone")


@query(sql(f"SELECT CAST(layer AS INTEGER) AS layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY key) AS INTEGER) AS ordinal, key, value, seq_no, is_tombstone, {SIZE} AS size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY layer, key ORDER BY seq_no DESC) AS rn FROM (SELECT *, seq_no % 3 AS layer FROM log)) WHERE rn = 1", "log"))
def memtable_dump(spark, d):
    return inspection.memtable_dump(R.log_entries(spark, d).withColumn("layer", (F.col("seq_no") % 3).cast("int")))


@query(sql("SELECT printf('%06d.wal', o_orderkey // 40) AS segment, o_orderkey AS seq_no, 'PUT' AS op, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value, TRUE AS ok FROM orders", "stock"))
def wal_dump(spark, d):
    """Binary segments, written and read back."""
    folder = fresh_path(spark, "wal")
    wal.write_wal(R.stock(spark, d).withColumn("segment", F.floor(F.col("seq_no") / 40)), folder)
    return wal.read_wal(spark, folder).select("segment", "seq_no", "op", "key", "value", "ok")


@query(sql("SELECT CAST(row_number() OVER (ORDER BY seq_no) AS BIGINT) AS ordinal, seq_no, op, key, value FROM physical p WHERE ord < coalesce((SELECT min(ord) FROM physical b WHERE b.segment = p.segment AND NOT b.ok), 2147483647)", "physical"))
def log_replay(spark, d):
    from ..functions.ordered import ordered_prefix

    return ordered_prefix(maintenance.truncate_corrupt(R.physical(spark, d)).select("seq_no", "op", "key", "value"), ["seq_no"], "ordinal")


def _stored_manifest(spark, d):
    store = manifest_store.ManifestStore(spark, fresh_path(spark, "table"))
    current, seen = store.load(), []
    for r in R.manifest(R.runs(spark, d)).orderBy("id").collect():  # one row a run
        table = {c: r[c] for c in ("id", "file_name", "min_key", "max_key", "min_seq_no", "max_seq_no", "file_size", "num_entries")} | {"created_at": 0, "bloom_params": {"num_bits": r["num_bits"], "num_hashes": r["num_hashes"], "false_positive_rate": 0.01}}
        current = store.commit(current | {"next_sst_id": r["id"] + 1, "flushed_seq_no_watermark": r["max_seq_no"], "tables": [table, *current["tables"]]})
        seen.append(current["epoch"])
    return store


@query(sql("SELECT CAST(e.epoch AS BIGINT) AS epoch, CAST(e.epoch - 1 - m.id AS INTEGER) AS position, m.id, m.file_name, m.min_key, m.max_key, m.min_seq_no, m.max_seq_no, m.num_entries, m.file_size FROM manifest m, range(1, 8) AS e(epoch) WHERE m.id < e.epoch", "manifest"))
def manifest_scan(spark, d):
    """Manifests committed one epoch a run, and read back."""
    store = _stored_manifest(spark, d)
    return manifest_store.manifest_relation(spark, f"{store.files.base}/manifest").select("epoch", "position", "id", "file_name", "min_key", "max_key", "min_seq_no", "max_seq_no", "num_entries", "file_size")


@query(sql("SELECT key, value, seq_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_no DESC) AS rn FROM runs WHERE run_id < 3) WHERE rn = 1 AND NOT is_tombstone", "runs"))
def snapshot_at(spark, d):
    """The live state of the third epoch, while later ones exist."""
    runs = R.runs(spark, d)
    ids = [t["id"] for t in _stored_manifest(spark, d).load(3)["tables"]]
    return resolve.live(runs.where(F.col("run_id").isin(ids)))


@query(sql("SELECT req_no, CASE WHEN req_no % 7 = 6 THEN NULL WHEN req_no % 7 = 5 THEN 'GET' ELSE op END AS op, CASE WHEN req_no % 7 = 6 THEN NULL ELSE key END AS key, CASE WHEN req_no % 7 < 5 AND op = 'PUT' THEN value END AS value FROM requests", "requests"))
def request_parse(spark, d):
    r = R.requests(spark, d)
    put = F.to_json(F.struct(F.struct("key", "value").alias("Put")))
    lines = r.select("req_no", F.when(F.col("req_no") % 7 == 6, F.lit('"Stats"')).when(F.col("req_no") % 7 == 5, F.to_json(F.struct(F.struct("key").alias("Get")))).when(F.col("op") == "PUT", put).otherwise(F.to_json(F.struct(F.struct("key").alias("Del")))).alias("line"))
    return request_source.parse_requests(lines).select("req_no", "op", "key", "value")


@query("""SELECT event_id AS req_no, ['Stats', 'BgStatus', 'CompactionRun', 'CompactionRun', 'Shutdown', 'Configure', 'Put', NULL][event_id % 8 + 1] AS kind,
CASE WHEN event_id % 8 = 2 THEN CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) END AS files, CASE WHEN event_id % 8 = 4 THEN user_id % 2 = 0 END AS graceful, CASE WHEN event_id % 8 = 5 THEN CAST(user_id AS VARCHAR) END AS fan_in FROM events""")
def command_parse(spark, d):
    e, rest = R.read(spark, d, "events"), F.col("event_id") % 8
    bodies = ['"Stats"', '"BgStatus"', '{"CompactionRun":{"files":[%d,%d]}}', '{"CompactionRun":{"files":null}}', '{"Shutdown":{"graceful":%s}}', '{"Configure":{"name":"n","size_tiered_fan_in":%d}}', '{"Put":{"key":"%d","value":""}}', '"Nothing"']
    given = {2: [F.col("event_id"), F.col("user_id")], 4: [(F.col("user_id") % 2 == 0).cast("string")], 5: [F.col("user_id")], 6: [F.col("user_id")]}
    line = F.lit(None).cast("string")
    for i, body in enumerate(bodies):
        line = F.when(rest == i, F.format_string(body, *given[i]) if i in given else F.lit(body)).otherwise(line)
    parsed = request_source.parse_commands(e.select(F.col("event_id").alias("req_no"), line.alias("line")))
    return parsed.select("req_no", "kind", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"), "graceful", F.col("settings")["size_tiered_fan_in"].alias("fan_in"))


@query("SELECT event_id AS req_no, CASE WHEN event_type = 'error' THEN '{\"Error\":\"' ELSE '{\"Ok\":\"' END || event_type || '\"}' AS line FROM events")
def response_json(spark, d):
    rows = R.read(spark, d, "events").select(F.col("event_id").alias("req_no"), F.when(F.col("event_type") == "error", "Corruption").otherwise("OK").alias("status"), F.col("event_type").alias("message"))
    return request_source.response_lines(rows).select("req_no", "line")


@query(sql("SELECT id, min_key, max_key, CAST(min_seq_no AS BIGINT) AS min_seq_no, CAST(max_seq_no AS BIGINT) AS max_seq_no, num_entries, file_size, tombstones, position FROM manifest", "manifest"))
def run_metadata(spark, d):
    return compaction.run_metadata(R.runs(spark, d)).drop("num_bits", "num_hashes")


@query(sql(f"SELECT count(*) AS num_entries, min(key) AS min_key, max(key) AS max_key, min(seq_no) AS min_seq_no, max(seq_no) AS max_seq_no, CAST(sum({SIZE}) AS BIGINT) AS file_size FROM ({LATEST.format('log')})", "log"))
def flush(spark, d):
    """A table takes all requests in one batch and flushes them: the new run's manifest row."""
    from .table import VersionedTable

    table = VersionedTable(spark, fresh_path(spark, "table"))
    table.write(R.requests(spark, d))
    new = table.flush()
    columns = ["num_entries", "min_key", "max_key", "min_seq_no", "max_seq_no", "file_size"]
    return spark.createDataFrame([tuple(new[c] for c in columns)], "num_entries long, min_key string, max_key string, min_seq_no long, max_seq_no long, file_size long")


# Compaction


@query(sql(LATEST.format("(SELECT * FROM runs WHERE run_id IN (1, 3, 5))"), "runs"))
def merge_runs(spark, d):
    runs = R.runs(spark, d)
    return compaction.merge_runs(*[runs.where(F.col("run_id") == i) for i in (1, 3, 5)])


_PICK = """, r AS (SELECT id, greatest(file_size, 1) AS size, row_number() OVER o AS pos, count(*) OVER w AS n, last_value(greatest(file_size, 1)) OVER w AS largest, count(*) OVER () AS total FROM manifest WINDOW o AS (ORDER BY file_size, id DESC), w AS (ORDER BY file_size, id DESC ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
p AS (SELECT coalesce(min(pos) FILTER (WHERE n = 2 AND CAST(largest AS DOUBLE) <= CAST(size AS DOUBLE) * 1.8), 1) AS f FROM r), picked AS (SELECT CAST(pos - f + 1 AS INTEGER) AS ordinal, id FROM r, p WHERE total >= 2 AND pos >= f AND pos < f + 2)"""


@query(sql(f"{_PICK} SELECT ordinal, id FROM picked", "manifest"))
def pick_compaction(spark, d):
    return compaction.pick(R.manifest(R.runs(spark, d)), 2, 1.8)


@query(sql("SELECT count(*) AS runs, count(*) >= 3 AS due FROM manifest", "manifest"))
def compaction_due(spark, d):
    return compaction.compaction_due(R.manifest(R.runs(spark, d)), 3)


@query(sql("SELECT i.id, CASE WHEN m.id IS NULL THEN 'InvalidArgument' ELSE 'Conflict' END AS error FROM (SELECT range AS id FROM range(0, 12)) i LEFT JOIN manifest m USING (id) WHERE m.id IS NULL OR m.id % 3 = 1", "manifest"))
def validate_inputs(spark, d):
    manifest = R.manifest(R.runs(spark, d)).withColumn("busy", F.col("id") % 3 == 1)
    return compaction.validate_inputs(manifest, spark.range(12))


@query(sql(f"{_PICK} SELECT run_id, key, value, CAST(seq_no AS BIGINT) AS seq_no, is_tombstone FROM runs WHERE run_id NOT IN (SELECT id FROM picked) UNION ALL SELECT CAST({R.RUNS} AS BIGINT), key, value, seq_no, is_tombstone FROM ({LATEST.format('(SELECT * FROM runs WHERE run_id IN (SELECT id FROM picked))')})", "manifest"))
def compact(spark, d):
    runs = R.runs(spark, d)
    return compaction.compacted(runs, compaction.pick(R.manifest(runs), 2, 1.8), R.RUNS).select("run_id", "key", "value", "seq_no", "is_tombstone")


def _job_sql(ids: str, output: int) -> str:
    own = f"(SELECT * FROM runs WHERE run_id IN ({ids}))"
    return f"SELECT '{ids.replace(' ', '')}' AS inputs, CAST({output} AS BIGINT) AS output, (SELECT CAST(sum({SIZE}) AS BIGINT) FROM {own}) AS bytes_in, CAST(sum({SIZE}) AS BIGINT) AS bytes_out, (SELECT count(*) FROM {own}) AS keys_in, count(*) AS keys_out, (SELECT count(*) FROM {own}) - count(*) AS keys_dropped, count(*) FILTER (WHERE is_tombstone) AS tombstones_kept, CAST(0 AS BIGINT) AS tombstones_dropped FROM ({LATEST.format(own)})"


_JOBS = (("0, 1", 7), ("2, 3, 4", 8), ("5, 6", 9))
_JOBS_SQL = " UNION ALL ".join(f"({_job_sql(ids, out)})" for ids, out in _JOBS)


def _jobs(spark, runs: DataFrame) -> DataFrame:
    out = None
    for ids, output in _JOBS:
        one = compaction.job_stats(runs, spark.createDataFrame([(int(i),) for i in ids.split(", ")], "id long"), output)
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(_JOBS_SQL, "runs"))
def compaction_job_stats(spark, d):
    return _jobs(spark, R.runs(spark, d))


@query(sql(f"SELECT count(*) AS jobs, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_out) AS DOUBLE) / CAST(sum(bytes_in) AS DOUBLE) AS ratio FROM ({_JOBS_SQL})", "runs"))
def wa_ratio(spark, d):
    return compaction.wa_ratio(_jobs(spark, R.runs(spark, d)))


@query(sql(f"SELECT output, bytes_out, CAST(bytes_out * 1000 // (1 * 1024 * 1024) AS BIGINT) AS least_ms FROM ({_JOBS_SQL})", "runs"))
def throttle_budget(spark, d):
    return compaction.throttle_budget(_jobs(spark, R.runs(spark, d)), 1).select("output", "bytes_out", "least_ms")


# Maintenance


@query(sql("SELECT segment, ord, seq_no, key FROM physical p WHERE ord < coalesce((SELECT min(ord) FROM physical b WHERE b.segment = p.segment AND NOT b.ok), 2147483647)", "physical"))
def truncate_corrupt(spark, d):
    return maintenance.truncate_corrupt(R.physical(spark, d)).select("segment", "ord", "seq_no", "key")


@query(sql(", b AS (SELECT segment, min(ord) FILTER (WHERE NOT ok) AS bad FROM physical GROUP BY segment) SELECT p.segment, count(*) FILTER (WHERE b.bad IS NULL OR ord < b.bad) AS records, b.bad IS NOT NULL AS needs_truncation, max(seq_no) FILTER (WHERE b.bad IS NULL OR ord < b.bad) AS last_seqno FROM physical p JOIN b USING (segment) GROUP BY p.segment, b.bad", "physical"))
def wal_verify(spark, d):
    return maintenance.wal_verify(R.physical(spark, d))


@query(sql("SELECT segment, ord, seq_no FROM physical WHERE segment % 5 <> 0 OR end_offset <= 600", "physical"))
def log_cut(spark, d):
    p = R.physical(spark, d)
    cuts = p.where("segment % 5 = 0").select("segment").distinct().withColumn("cut_offset", F.lit(600))
    return maintenance.log_cut(p, cuts).select("segment", "ord", "seq_no")


def _files(manifest: DataFrame) -> DataFrame:
    """Files of a folder in which every third run is missing and that holds strangers."""
    there = manifest.where("id % 3 <> 2").select("file_name")
    return there.unionByName(manifest.select(F.format_string("%06d.sst", F.col("id") + 100).alias("file_name")))


@query(sql("SELECT printf('%06d.sst', id + 100) AS file_name FROM manifest", "manifest"))
def orphan_runs(spark, d):
    m = R.manifest(R.runs(spark, d))
    return maintenance.orphan_runs(_files(m), m)


@query(sql("SELECT id, file_name FROM manifest WHERE id % 3 = 2", "manifest"))
def missing_runs(spark, d):
    m = R.manifest(R.runs(spark, d))
    return maintenance.missing_runs(m, _files(m)).select("id", "file_name")


@query(sql(f"SELECT segment, max(seq_no) AS max_seq_no FROM physical GROUP BY segment HAVING max(seq_no) <= {R.WATERMARK} AND segment <> 3", "physical"))
def wal_retention(spark, d):
    return maintenance.wal_retention(R.physical(spark, d), R.WATERMARK, 3)


@query(sql("SELECT file_name, CAST(id * 10000 AS BIGINT) AS deferred_at_ms FROM manifest WHERE 60000 - id * 10000 >= 30000 AND id % 2 = 0", "manifest"))
def sweep_retired(spark, d):
    m = R.manifest(R.runs(spark, d))
    retired = m.select("file_name", (F.col("id") * 10000).alias("deferred_at_ms"))
    return maintenance.sweep_retired(retired, m.where("id % 2 = 1"), 60_000, 30)


@query(sql("SELECT id AS run_id, id <> 4 AS ok FROM manifest", "manifest"))
def verify_run(spark, d):
    """The fourth run loses a row after its digest is stored."""
    runs = R.runs(spark, d)
    stored = written(maintenance.content_digest(runs), "digests")
    lost = runs.where("run_id = 4").agg(F.min("key")).first()[0]
    return maintenance.verify_runs(runs.where(~((F.col("run_id") == 4) & (F.col("key") == lost))), stored)


# Reports


@query(sql(f"SELECT kind, count(DISTINCT part) AS parts, count(*) AS entries, CAST(sum({SIZE}) AS BIGINT) AS bytes FROM (SELECT CASE WHEN run_id = 6 THEN 'active' WHEN run_id = 5 THEN 'immutable' ELSE 'sstable' END AS kind, run_id AS part, key, value FROM runs) GROUP BY kind", "runs"))
def version_info(spark, d):
    kind = F.when(F.col("run_id") == 6, "active").when(F.col("run_id") == 5, "immutable").otherwise("sstable")
    return inspection.version_info(R.runs(spark, d).withColumn("kind", kind).withColumn("part", F.col("run_id")))


@query(sql("SELECT position, id, file_name, min_key, max_key, CAST(min_seq_no AS BIGINT) AS min_seq_no, CAST(max_seq_no AS BIGINT) AS max_seq_no, num_entries, file_size, CAST(sum(file_size) OVER () AS BIGINT) AS total_size FROM manifest", "manifest"))
def list_runs(spark, d):
    return inspection.list_runs(R.manifest(R.runs(spark, d)))


@query(sql("SELECT 1 AS manifest_version, CAST(7 AS BIGINT) AS epoch, max(id) + 1 AS next_sst_id, max(max_seq_no) AS flushed_seq_no_watermark, count(*) AS tables, CAST(sum(num_entries) AS BIGINT) AS entries, CAST(sum(file_size) AS BIGINT) AS bytes FROM manifest", "manifest"))
def manifest_info(spark, d):
    return inspection.manifest_info(R.manifest(R.runs(spark, d)), 7)


@query(sql(f"""SELECT (SELECT count(*) FROM line) AS log_records, (SELECT max(seq_no) FROM line) AS last_seq_no, (SELECT count(*) FROM line WHERE is_tombstone) AS deletes, count(*) AS active_entries, CAST(coalesce(sum({SIZE}), 0) AS BIGINT) AS active_bytes,
(SELECT count(*) FROM manifest) AS sst_count, (SELECT CAST(sum(file_size) AS BIGINT) FROM manifest) AS sst_bytes, (SELECT CAST(sum(num_entries) AS BIGINT) FROM manifest) AS sst_entries, (SELECT max(id) + 1 FROM manifest) AS next_sst_id, CAST({R.WATERMARK} AS BIGINT) AS watermark FROM ({LATEST.format(f'(SELECT * FROM line WHERE seq_no > {R.WATERMARK})')})""", "line", "manifest"))
def engine_stats(spark, d):
    return inspection.engine_stats(R.line_entries(spark, d), R.manifest(R.runs(spark, d)), R.WATERMARK)


@query(sql(f"SELECT count(*) AS jobs, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(keys_dropped) AS BIGINT) AS keys_dropped, (SELECT count(*) FROM manifest) AS runs, (SELECT CAST(sum(file_size) AS BIGINT) FROM manifest) AS backlog_bytes, CAST(sum(bytes_out) AS DOUBLE) / CAST(sum(bytes_in) AS DOUBLE) AS ratio FROM ({_JOBS_SQL})", "manifest"))
def compaction_stats(spark, d):
    runs = R.runs(spark, d)
    return inspection.compaction_stats(_jobs(spark, runs), R.manifest(runs))


@query(sql("SELECT run_id, count(*) AS blocks, min(length) AS min_length, max(length) AS max_length, avg(CAST(length AS DOUBLE)) AS avg_length, min(first_key) AS first_key FROM blocks GROUP BY run_id", "blocks"))
def run_info(spark, d):
    return inspection.run_info(R.blocks(R.runs(spark, d)))


@query("SELECT user_id, hits, misses, CASE WHEN hits + misses > 0 THEN 100.0::DOUBLE * hits / (hits + misses) ELSE 0.0::DOUBLE END AS rate FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS hits, count(*) FILTER (WHERE event_type = 'view') AS misses FROM events GROUP BY user_id)")
def read_stats(spark, d):
    e = R.read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.count_if(F.col("event_type") == "view").alias("misses"))
    return inspection.hit_rate(e)


@query(sql("SELECT max(segment) AS active_segment, max(end_offset) FILTER (WHERE segment = (SELECT max(segment) FROM physical)) AS bytes, count(DISTINCT segment) AS segments FROM physical", "physical"))
def segment_stats(spark, d):
    return inspection.segment_stats(R.physical(spark, d).select("segment", "end_offset"))


@query("SELECT event_type AS kind, count(*) AS jobs, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS last_job, max(epoch_us(ts) // 1000) AS last_ended_ms FROM events GROUP BY event_type")
def bg_status(spark, d):
    e = R.read(spark, d, "events")
    return inspection.background_status(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("job_no"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ended_ms")))


@query("SELECT upper(event_type) AS title, count(*) AS events, CAST(min(event_id) AS BIGINT) AS first_ms, CAST(max(event_id) AS BIGINT) AS last_ms FROM events GROUP BY event_type")
def event_rollup(spark, d):
    """An event log with a block for each event, written as text and read back."""
    path = fresh_path(spark, "events-log")
    e = R.read(spark, d, "events")
    e.select(F.format_string("====== %s ======\ntimestamp_ms: %d\nuser: %d\n", F.upper("event_type"), F.col("event_id"), F.col("user_id"))).write.text(path)
    return eventlog.rollup(eventlog.read_events(spark, path))
