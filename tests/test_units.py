"""Golden cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tephra.config import TINY, EngineConfig, load_config, save_config, set_active
from tephra.functions import bloom
from tephra.functions.sizes import bloom_bits, bloom_hashes, entry_size, record_size
from tephra.model import EngineError, Status
from tephra.operators import admission, compaction, folds, maintenance, resolve
from tephra.plans import relations as R
from tephra.plans.catalog import QUERIES
from tephra.sources import eventlog, sst, wal
from tephra.sources.requests import parse_commands, parse_requests

REQ = "req_no long, op string, key string, value string"
ENTRIES = "position int, key string, value string, seq_no long, is_tombstone boolean"

#: id:size of live runs in creation order and the runs that were merged, fan-in 2 and ratio 2.
PICKS = [
    ("0:294 1:300 2:390 3:403", [0, 1]),
    ("2:390 3:403 4:491", [2, 3]),
    ("4:491 5:638 6:532", [4, 6]),
    ("5:638 7:899 8:390", [8, 5]),
    ("7:899 9:719 10:391", [10, 9]),
    ("7:899 11:719 12:407", [12, 11]),
    ("7:899 13:952 14:447", [7, 13]),
    ("14:447 15:1438 16:415", [16, 14]),
    ("15:1438 17:707 18:403", [18, 17]),
    ("15:1438 19:1015 20:380", [19, 15]),
    ("20:380 21:2184 22:390", [20, 22]),
    ("21:2184 23:623 24:391", [24, 23]),
    ("21:2184 25:916 26:407", [26, 25]),
    ("21:2184 27:1197 28:447", [27, 21]),
    ("28:447 29:2399 30:415", [30, 28]),
    ("29:2399 31:707 32:403", [32, 31]),
    ("29:2399 33:1015 34:402", [34, 33]),
    ("29:2399 35:1163 36:402 37:390 38:415 39:439", [37, 36]),
    ("29:2399 35:1163 38:415 39:439 40:620", [38, 39]),
    ("29:2399 35:1163 40:620 41:707", [40, 41]),
    ("29:2399 35:1163 42:1245", [35, 42]),
    ("1:10 2:100 3:1000", [1, 2]),  # no window within the ratio: the smallest
    ("5:10", []),
    ("1:50 2:50 3:50", [3, 2]),  # equal sizes: the newer first
    ("1:0 2:0", [2, 1]),
]


def test_admission(spark):
    rows = [(1, "DEL", "a", None), (2, "PUT", "a", "x"), (3, "PUT", "", "y"), (4, "DEL", "a", None), (5, "DEL", "a", None), (6, "PUT", "a", ""), (7, "PUT", None, "z"), (8, "PUT", "b", None)]
    got = {r["req_no"]: r["status"] for r in admission.admit(spark.createDataFrame(rows, REQ)).collect()}
    assert got == {1: "NOT_FOUND", 2: "OK", 3: "InvalidArgument", 4: "OK", 5: "NOT_FOUND", 6: "OK", 7: "InvalidArgument", 8: "InvalidArgument"}
    log = admission.change_log(spark.createDataFrame(rows, REQ)).orderBy("seq_no").collect()
    assert [(r["seq_no"], r["op"], r["key"], r["value"]) for r in log] == [(1, "PUT", "a", "x"), (2, "DEL", "a", None), (3, "PUT", "a", "")]


def test_read_without_key_is_no_error(spark):
    assert admission.validate(spark.createDataFrame([(1, "GET", "", None)], REQ)).first()["status"] == "OK"
    empty = spark.createDataFrame([], "key string, value string, seq_no long, is_tombstone boolean")
    assert tuple(resolve.get(empty, "")  .first()) == ("", "NOT_FOUND", None)


def test_closed_answers_dead_deletes_first(spark):
    rows = [(1, "PUT", "a", "x"), (2, "DEL", "a", None), (3, "DEL", "b", None), (4, "PUT", "b", "x"), (5, "DEL", "b", None)]
    got = [r["status"] for r in admission.admit(spark.createDataFrame(rows, REQ), 1).orderBy("req_no").collect()]
    assert got == ["OK", "StoreClosed", "NOT_FOUND", "StoreClosed", "NOT_FOUND"]


def test_sizes(spark):
    log = spark.createDataFrame([(1, "PUT", "user:1", "Ana"), (2, "PUT", "user:1", "Petar"), (3, "DEL", "user:1", None), (4, "PUT", "grad", "Niš")], "seq_no long, op string, key string, value string")
    got = [tuple(r)[2:] for r in admission.op_delta(log).orderBy("seq_no").collect()]
    assert got == [(41, 0, 41), (43, 41, 43), (38, 43, 38), (40, 0, 78)]
    assert spark.range(1).select(record_size(F.lit("user:1"), F.lit("Ana")), entry_size(F.lit("a"), F.lit(None).cast("string"))).first()[:] == (34, 33)


@pytest.mark.parametrize(("n", "p", "bits", "hashes"), [(32, 0.01, 312, 7), (48, 0.01, 464, 7), (1, 0.01, 64, 7), (100, 0.5, 152, 1), (100, 0.9, 152, 1)])
def test_bloom_sizing(spark, n, p, bits, hashes):
    assert tuple(spark.range(1).select(bloom_bits(F.lit(n), F.lit(p)), bloom_hashes(F.lit(p))).first()) == (bits, hashes)


def test_bloom_filter_has_no_false_negatives():
    keys = [f"key:{i}".encode() for i in range(500)]
    body = bloom.build(keys, 4800, 7)
    assert bloom.may_contain(body, keys, 4800, 7).all()
    assert bloom.may_contain(body, [f"other:{i}".encode() for i in range(500)], 4800, 7).mean() < 0.05
    assert bloom.fnv1a([b"", b"a"], 0).tolist() == [0xCBF29CE484222325, ((0xCBF29CE484222325 ^ 97) * 0x100000001B3) % 2**64]


def test_picks(spark):
    rows = [(case, int(i), int(s)) for case, (text, _) in enumerate(PICKS) for i, s in (x.split(":") for x in text.split())]
    got = compaction.pick(spark.createDataFrame(rows, "case long, id long, file_size long"), 2, 2.0, by="case").orderBy("case", "ordinal").collect()
    for case, (_, want) in enumerate(PICKS):
        assert [r["id"] for r in got if r["case"] == case] == want


def test_pick_leaves_busy_runs(spark):
    df = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 11, False)], "id long, file_size long, busy boolean")
    assert [r["id"] for r in compaction.pick(df, 1, 2.0).orderBy("ordinal").collect()] == [2, 3]


def test_merge_and_positions(spark):
    schema = "key string, value string, seq_no long, is_tombstone boolean"
    a = spark.createDataFrame([("a", "x", 5, False), ("b", "y", 2, False)], schema)
    b = spark.createDataFrame([("a", "z", 3, False), ("c", None, 4, True)], schema)
    assert sorted(map(tuple, compaction.merge_runs(a, b).collect())) == [("a", "x", 5, False), ("b", "y", 2, False), ("c", None, 4, True)]
    layers = spark.createDataFrame([(0, "k", "old", 10, False), (1, "k", "new", 30, False)], ENTRIES)
    keys = spark.createDataFrame([("k",)], "key string")
    assert resolve.layered_get(layers, keys).first()["value"] == "old"
    assert resolve.multi_get(layers.drop("position"), keys).first()["value"] == "new"


def test_tombstone_hides_older_value_and_empty_value_lives(spark):
    e = spark.createDataFrame([("a", "x", 1, False), ("a", None, 2, True), ("b", "", 3, False), ("c", None, 4, True), ("c", "y", 5, False)], "key string, value string, seq_no long, is_tombstone boolean")
    assert {r["key"]: r["value"] for r in resolve.live(e).collect()} == {"b": "", "c": "y"}
    assert resolve.get(e, "a").first()["status"] == "TOMBSTONE"


def test_long_manifests_are_met_in_parts(spark):
    manifest = spark.createDataFrame([(i, i, f"k{i % 5}", f"k{i % 5 + i % 3}") for i in range(11)], "id long, position int, min_key string, max_key string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(9)], "key string")
    want = {(f"k{k}", i) for k in range(9) for i in range(11) if i % 5 <= k <= i % 5 + i % 3}
    entries = spark.createDataFrame([(4, "k1", "x", 1, False)], "run_id long, key string, value string, seq_no long, is_tombstone boolean")
    traces = []
    for at_once in (2, 3, 100):
        got = resolve.prune_runs(manifest, keys, at_once).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
        traces.append(sorted(map(str, resolve.lookup_trace(entries.where("run_id < 0"), entries, manifest, keys, at_once).collect())))
    assert traces[0] == traces[1] == traces[2] and len(traces[0]) == 9


def test_manifest_replacement():
    tables = [{"id": 5}, {"id": 3}, {"id": 4}, {"id": 1}]
    assert [t["id"] for t in compaction.replace_in_manifest(tables, [4, 3], {"id": 9})] == [5, 9, 1]
    with pytest.raises(EngineError) as e:
        compaction.replace_in_manifest(tables, [8], {"id": 9})
    assert e.value.status is Status.CONFLICT


def test_rotation_and_segments(spark):
    rows = [(0, i, f"k{i:02d}", "x" * 29) for i in range(1, 10)]  # 64 bytes each
    df = spark.createDataFrame(rows, "stream long, seq_no long, key string, value string")
    got = folds.rotate_epochs(df, 256).orderBy("seq_no").collect()
    assert [r["epoch"] for r in got] == [0] * 4 + [1] * 4 + [2] and got[3]["total_bytes"] == 256
    same = spark.createDataFrame([(0, i, "k", "x" * 31) for i in range(9)], "stream long, seq_no long, key string, value string")
    assert {r["epoch"] for r in folds.rotate_epochs(same, 256).collect()} == {0}  # overwrites don't grow
    wal_rows = spark.createDataFrame([(0, i, "user:1", "Ana") for i in range(3)], "stream long, seq_no long, key string, value string")
    assert [(r["segment"], r["end_offset"]) for r in folds.wal_segments(wal_rows, 76).orderBy("seq_no").collect()] == [(1, 42), (1, 76), (2, 42)]


def test_backpressure(spark):
    df = spark.createDataFrame([(0, i, f"k{i:03d}", "x" * 28) for i in range(40)], "stream long, seq_no long, key string, value string")
    got = folds.simulate_backpressure(df, 128, 1, 1000).orderBy("seq_no").collect()
    # Two writes fill the first table, two more reach the limit (grace), one more 1.25 times of it.
    assert [r["outcome"] for r in got[:5]] == ["OK"] * 5 and all(r["outcome"] == "Backpressure" for r in got[5:])


def test_rebuild_drops_nothing_and_cooldown_delays(spark):
    schema = "stream long, seq_no long, key string, value string"
    df = spark.createDataFrame([(0, i, f"k{i:03d}", "x" * 28) for i in range(12)], schema)  # 64 bytes each
    got = folds.rebuild(df, 1, 128, 1).orderBy("seq_no").collect()
    assert [r["seq_no"] for r in got] == list(range(2, 12)) and [r["epoch"] for r in got] == [0, 0] + [1] * 8
    assert [r["grace"] for r in got[:5]] == [False, False, False, True, True] and [r["blocked"] for r in got] == [False] * 4 + [True] * 6
    timed = df.withColumn("at_ms", F.col("seq_no") * 10)
    assert [r["epoch"] for r in folds.rotate_epochs(timed, 128, cooldown_ms=50).orderBy("seq_no").collect()] == [0, 0] + [1] * 5 + [2] * 5
    with pytest.raises(ValueError):
        folds.rotate_epochs(df, 128, cooldown_ms=50)


def test_commands(spark):
    lines = ['"Stats"', ' "FlushNow" ', '"Put"', '{"CompactionRun":{"files":[3,1]}}', '{"CompactionRun":{"files":null}}', '{"Shutdown":{"graceful":true}}', '{"Configure":{"name":"a","block_size":64}}', '{"Del":{"key":"x"}}', '{"Drop":{}}', "garbage", None]
    got = [tuple(r)[2:] for r in parse_commands(spark.createDataFrame(list(enumerate(lines)), "no long, line string")).orderBy("no").collect()]
    none = (None, None, None)
    assert got == [("Stats", *none), ("FlushNow", *none), (None, *none), ("CompactionRun", [3, 1], None, None), ("CompactionRun", *none), ("Shutdown", None, True, None), ("Configure", None, None, {"name": "a", "block_size": "64"}), ("Del", *none), (None, *none), (None, *none), (None, *none)]


def test_last_value_of_a_frequent_key(spark):
    from tephra.functions.ordered import last_value, ordered_prefix

    rows = [("hot" if i % 3 else f"k{i % 7}", i, i if i % 5 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, no long, v long")
    got = {r["no"]: (r["before"], r["with_it"]) for r in last_value(last_value(df, "k", ["no"], F.col("v"), "before", partitions=9), "k", ["no"], F.col("v"), "with_it", current=True, partitions=5).collect()}
    last = {}
    for k, no, v in rows:
        before = last.get(k)
        last[k] = v if v is not None else before
        assert got[no] == (before, last[k])
    numbered = ordered_prefix(df.select("no"), ["no"], "n", {"total": F.col("no")}, partitions=7).collect()
    assert all(r["n"] == r["no"] + 1 and r["total"] == r["no"] * (r["no"] + 1) // 2 for r in numbered)


def test_retention_and_truncation(spark):
    seg = spark.createDataFrame([(1, 10), (2, 20), (3, 25)], "segment long, seq_no long")
    for mark, want in ((20, [1, 2]), (19, [1]), (99, [1, 2])):
        assert sorted(r["segment"] for r in maintenance.wal_retention(seg, mark, 3).collect()) == want
    p = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)], "segment long, ord int, ok boolean")
    assert sorted(map(tuple, maintenance.truncate_corrupt(p).select("segment", "ord").collect())) == [(1, 0), (2, 0)]


def test_ratio_without_bytes_is_null(spark):
    assert compaction.wa_ratio(spark.createDataFrame([], "bytes_in long, bytes_out long")).first()["ratio"] is None
    jobs = spark.createDataFrame([(0, 2 << 20)], "bytes_in long, bytes_out long")
    assert compaction.throttle_budget(jobs, 1).first()["least_ms"] == 2000 and compaction.throttle_budget(jobs, 0).first()["least_ms"] == 0


def _dealt_by_run(df) -> bool:
    return "hashpartitioning(run_id" in df._jdf.queryExecution().executedPlan().toString()


def test_entries_of_a_job_are_not_dealt_out_by_run(spark, tmp_path):
    rows = [(0, "a", "x", 1, False), (0, "b", "yy", 2, False), (1, "a", None, 3, True), (2, "c", "z", 4, False)]
    spark.createDataFrame(rows, "run_id long, key string, value string, seq_no long, is_tombstone boolean").write.parquet(str(tmp_path / "runs"))
    entries, inputs = spark.read.parquet(str(tmp_path / "runs")), spark.createDataFrame([(0,), (1,)], "id long")
    stats = compaction.job_stats(entries, inputs, 7)
    assert not _dealt_by_run(stats) and tuple(stats.first()) == ("0,1", 7, 102, 68, 3, 2, 1, 1, 0)
    after = compaction.compacted(entries, inputs, 7)
    assert not _dealt_by_run(after)
    assert sorted(tuple(r[c] for c in ("run_id", "key", "seq_no")) for r in after.collect()) == [(2, "c", 4), (7, "a", 3), (7, "b", 2)]


@pytest.mark.parametrize("name", ["compaction_stats", "throttle_budget", "wa_ratio"])
def test_job_reports_make_the_runs_once_and_deal_out_none(name, spark, sf_dir, monkeypatch):
    made, runs = [], R.runs
    monkeypatch.setattr(R, "runs", lambda *a: made.append(a) or runs(*a))
    assert not _dealt_by_run(QUERIES[name](spark, sf_dir)) and len(made) == 1


def test_wal_reader_stops_at_damage(spark, tmp_path):
    raw = wal.pack_segment([("PUT", 1, "a", "x"), ("DEL", 2, "a", None), ("PUT", 3, "ključ", "")])
    (tmp_path / "000001.wal").write_bytes(raw)
    (tmp_path / "000002.wal").write_bytes(raw[:-7])
    (tmp_path / "000003.wal").write_bytes(b"LSM")
    got = wal.read_wal(spark, str(tmp_path)).orderBy("segment", "ord").collect()
    assert [(r["segment"][5], r["ok"], r["seq_no"], r["value"]) for r in got] == [("1", True, 1, "x"), ("1", True, 2, None), ("1", True, 3, ""), ("2", True, 1, "x"), ("2", True, 2, None), ("2", False, None, None), ("3", False, None, None)]


def test_many_small_segments_are_read_in_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wal, "FOLDER_SEGMENTS", 100)
    monkeypatch.setattr(wal, "BATCH_ROWS", 7)
    rows = [(i // 3, i, "DEL" if i % 5 == 0 else "PUT", f"k{i}", None if i % 5 == 0 else "v" * (i % 4)) for i in range(1500)]
    wal.write_wal(spark.createDataFrame(rows, "segment long, seq_no long, op string, key string, value string").repartition(3), str(tmp_path / "log"))
    assert len(list(tmp_path.glob("log/*/*.wal"))) == 500 and not list(tmp_path.glob("log/**/*.tmp"))
    read = wal.read_wal(spark, str(tmp_path / "log"))
    got = read.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) <= 8  # 500 files are 16 tasks of Spark's own
    assert all(r["ok"] for r in got) and sorted((int(r["segment"][:-4]), r["seq_no"], r["op"], r["key"], r["value"]) for r in got) == rows


def test_run_files(spark, tmp_path):
    entries = [(f"key:{i:04d}", None if i % 5 == 0 else "v" * (i % 40), i + 1, i % 5 == 0) for i in range(300)]
    for size, restart in ((64, 1), (256, 4), (8192, 16)):
        run = sst.open_run(sst.pack_run(entries, size, restart))
        assert [e for b in range(len(run.blocks)) for e in sst.block_entries(run, b)] == entries and (run.entries, run.min_seq_no, run.max_seq_no) == (300, 1, 300)
        for key, value, _, dead in entries[::7]:
            assert sst.lookup(run, key) == (("TOMBSTONE", None) if dead else ("FOUND", value))
        assert {sst.lookup(run, k)[0] for k in ("", "key:", "key:0001x", "z")} == {"NOT_FOUND"}
    raw = sst.pack_run(entries, 256)
    assert sst.open_run(sst.pack_run([])).blocks == []
    for bad in (b"", raw[:-1], raw[10:], raw[:-80] + raw[-72:]):
        with pytest.raises(EngineError):
            sst.open_run(bad)
    (tmp_path / "000001.sst").write_bytes(raw)
    assert [tuple(r)[2:] for r in sst.read_sst(spark, str(tmp_path)).orderBy("key").collect()] == entries
    blocks = sst.read_sst(spark, str(tmp_path), "blocks").orderBy("block_no").collect()
    assert blocks[0]["first_key"] == "key:0000" and sum(b["length"] for b in blocks) < len(raw)


def test_command_line(spark, tmp_path):
    from tephra.__main__ import run

    folder = str(tmp_path / "t")
    assert run(spark, [folder, "put", "--key", "a", "--value", "x"]) == ["OK"]
    assert run(spark, [folder, "del", "--key", "b"]) == ["NOT_FOUND"]
    assert run(spark, [folder, "flush"]) == ["run 0: 1 entries, 34 bytes"]
    assert run(spark, [folder, "get", "--key", "a"]) == ["FOUND", "x"] and run(spark, [folder, "compact"]) == ["nothing to compact"]
    assert run(spark, [folder, "manifest"])[-1] == "tables: 1" and len(run(spark, [folder, "runs"])) == 1


def test_requests_and_events(spark, tmp_path):
    lines = spark.createDataFrame([('{"Put":{"key":"a","value":""}}',), ('{"Get":{"key":"a"}}',), ('{"Del":{"key":"b"}}',), ('"Stats"',), ("garbage",)], "line string")
    assert [tuple(r)[1:] for r in parse_requests(lines).collect()] == [("PUT", "a", ""), ("GET", "a", None), ("DEL", "b", None), (None, None, None), (None, None, None)]
    log = eventlog.EventLog(tmp_path / "events.log")
    log.record("INIT", ("config", "{\n  1\n}"), epoch=3)
    log.record("FLUSH", entries=5)
    got = eventlog.read_events(spark, str(tmp_path / "events.log")).orderBy("no").collect()
    assert [(r["title"], r["attrs"], r["block"]) for r in got] == [("INIT", {"epoch": "3"}, "{\n  1\n}"), ("FLUSH", {"entries": "5"}, None)]


def test_config(tmp_path):
    assert load_config(folder=tmp_path) == EngineConfig()
    save_config(TINY, "tiny", tmp_path)
    assert load_config("tiny", tmp_path) == TINY and TINY.retired_run_grace_seconds == 30
    with pytest.raises(FileNotFoundError):
        load_config("other", tmp_path)
    save_config(TINY.replace(block_size=1), "default", tmp_path)
    assert load_config(folder=tmp_path).block_size == 1
    set_active(TINY, tmp_path)
    assert load_config(folder=tmp_path) == TINY and load_config("default", tmp_path).block_size == 1


def test_all_runs_pass_through_run_files(spark, sf_dir):
    got = QUERIES["sst_scan"](spark, sf_dir)
    assert {r["file"] for r in got.select("file").distinct().collect()} == {f"{i:06d}.sst" for i in range(R.RUNS)}
    assert got.count() == R.runs(spark, sf_dir).count()
