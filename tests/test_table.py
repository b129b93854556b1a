"""The durable table against a dictionary, its recovery, and streams against batches."""

from __future__ import annotations

import random

import pytest

from tephra.config import TINY
from tephra.model import EngineError, Status
from tephra.plans.table import VersionedTable
from tephra.streaming.ingest import admitted_stream, ingest

REQ = "req_no long, op string, key string, value string"


def _requests(spark, rng, n, first):
    return [(first + i, rng.choice(["PUT", "PUT", "DEL"]), f"k{rng.randrange(8)}", rng.choice(["", "x", "y" * 5])) for i in range(n)]


def test_table_against_a_dictionary(spark, tmp_path):
    rng, model, n = random.Random(7), {}, 0
    table = VersionedTable(spark, str(tmp_path / "t"), TINY)
    snapshots = {}
    for round_ in range(4):
        rows = _requests(spark, rng, 25, n)
        n += len(rows)
        got = {r["req_no"]: r["status"] for r in table.write(spark.createDataFrame(rows, REQ)).collect()}
        for no, op, key, value in rows:
            assert got[no] == ("OK" if op == "PUT" or key in model else "NOT_FOUND")
            if op == "PUT":
                model[key] = value
            else:
                model.pop(key, None)
        if round_ != 2:
            table.flush()
            epoch = table.store.load()["epoch"]
            snapshots[epoch] = dict(model)
        assert {r["key"]: r["value"] for r in table.state().collect()} == model
    job = table.compact()
    job_epoch = table.store.load()["epoch"]
    assert job and job["keys_dropped"] == job["keys_in"] - job["keys_out"]
    assert {r["key"]: r["value"] for r in table.state().collect()} == model
    for epoch, want in snapshots.items():
        assert {r["key"]: r["value"] for r in table.state(epoch).collect()} == want
    key = next(iter(model))
    assert table.get(key) == ("FOUND", model[key]) and table.get("nothing") == ("NOT_FOUND", None)
    again = VersionedTable(spark, str(tmp_path / "t"), TINY)
    assert again.recover() == [] and {r["key"]: r["value"] for r in again.state().collect()} == model
    assert again.jobs() == [job] and again.job_relation().first()["keys_in"] == job["keys_in"]
    retired = {t["file_name"] for t in table.store.load(job_epoch - 1)["tables"] if t["id"] in job["inputs"]}
    assert again.sweep() == []  # within the grace period
    assert again.sweep(pinned_epochs=[job_epoch - 1], now_ms=10**15) == []
    assert set(again.sweep(now_ms=10**15)) == retired and again.recover() == []
    assert {r["key"]: r["value"] for r in again.state().collect()} == model


def test_a_batch_is_stored_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TINY)
    batch = spark.createDataFrame([(1, "PUT", "a", "x"), (2, "DEL", "a", None), (3, "PUT", "a", "y")], REQ)
    assert table.write(batch, 0).count() == 3 and table.write(batch, 0) is None
    table.flush()
    table.write(batch, 1)
    assert table.write(batch, 0) is None and table.last_seq() == 6


def test_of_two_writers_one_gets_conflict(spark, tmp_path, monkeypatch):
    """Both have read the same last number: the first is stored, the second is told, and nothing is lost."""
    one, two = (VersionedTable(spark, str(tmp_path / "t"), TINY) for _ in range(2))
    monkeypatch.setattr(two, "last_seq", lambda: 0)
    one.write(spark.createDataFrame([(1, "PUT", "a", "x")], REQ))
    for _ in range(2):  # also after the first writer's batch has gone into a run
        with pytest.raises(EngineError) as e:
            two.write(spark.createDataFrame([(1, "PUT", "b", "y")], REQ))
        assert e.value.status is Status.CONFLICT
        assert {r["key"] for r in one.state().collect()} == {"a"}
        one.flush()
    assert len(one.store.files.names("log")) == 0 and one.last_seq() == 1
    monkeypatch.undo()
    two.write(spark.createDataFrame([(1, "DEL", "a", None), (2, "PUT", "b", "y")], REQ))
    assert {r["key"] for r in one.state().collect()} == {"b"}


def test_torn_files_and_folders_are_never_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TINY)
    table.write(spark.createDataFrame([(1, "PUT", "a", "x")], REQ))
    table.flush()
    table.write(spark.createDataFrame([(1, "PUT", "b", "y")], REQ))
    # What writers leave that end before they publish: half a manifest and a log folder without a commit.
    (tmp_path / "t/manifest/.000000000002.json.0.tmp").write_text("{")
    (tmp_path / "t/commits/.00000000000000000003.0.tmp").write_text("")
    spark.createDataFrame([(3, "PUT", "c", "z")], "seq_no long, op string, key string, value string").write.parquet(str(tmp_path / "t/log/00000000000000000003-x"))
    again = VersionedTable(spark, str(tmp_path / "t"), TINY)
    assert {r["key"] for r in again.state().collect()} == {"a", "b"} and again.last_seq() == 2
    again.recover()
    assert not (tmp_path / "t/manifest/.000000000002.json.0.tmp").exists() and not (tmp_path / "t/log/00000000000000000003-x").exists()
    files = again.store.files
    assert not files.create("manifest/000000000001.json", "{") and files.create("x/y", "1") and not files.create("x/y", "2") and files.read("x/y") == "1"
    # The way of stores that aren't a local disk.
    files.fs.create(files._path("x/.h")).close()
    assert files._rename(files._path("x/.h"), files._path("x/z")) and files.exists("x/z")
    files.fs.create(files._path("x/.h")).close()
    assert not files._rename(files._path("x/.h"), files._path("x/z"))


def test_puts_read_nothing_and_runs_are_verified(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), TINY)
    table.write(spark.createDataFrame([(i, "PUT", f"k{i}", "x") for i in range(9)], REQ))
    run = table.flush()
    assert [tuple(r) for r in table.verify().collect()] == [(run["id"], True)]
    with monkeypatch.context() as m:
        m.setattr(table, "entries", lambda *a, **k: pytest.fail("a batch of puts looks nothing up"))
        table.write(spark.createDataFrame([(1, "PUT", "k1", "y")], REQ))
    assert table.runs(key="z", upto="zz").count() == 0 and table.runs(key="a", upto="k0").count() == 9
    path = f"{tmp_path}/t/runs/{run['file_name']}"
    spark.createDataFrame([("k0", "other", 1, False)], "key string, value string, seq_no long, is_tombstone boolean").write.mode("overwrite").parquet(path)
    assert [tuple(r) for r in table.verify().collect()] == [(run["id"], False)]


def test_gates_and_recovery(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TINY.replace(l0_stop_writes=1))
    table.write(spark.createDataFrame([(1, "PUT", "a", "x")], REQ))
    flushed = table.flush()
    assert table.flush() is None and flushed["num_entries"] == 1
    with pytest.raises(EngineError) as e:
        table.write(spark.createDataFrame([(2, "PUT", "b", "x")], REQ))
    assert e.value.status is Status.BACKPRESSURE
    with pytest.raises(EngineError) as e:
        table.compact([0, 9])
    assert e.value.status is Status.INVALID_ARGUMENT
    table.pause()
    with pytest.raises(EngineError) as e:
        table.compact()
    assert e.value.status is Status.PAUSED
    table.close()
    with pytest.raises(EngineError) as e:
        table.write(spark.createDataFrame([(2, "PUT", "b", "x")], REQ))
    assert e.value.status is Status.STORE_CLOSED
    stale = table.store.load(0)
    with pytest.raises(EngineError) as e:
        table.store.commit(stale)
    assert e.value.status is Status.CONFLICT
    (tmp_path / "t/runs/000099-000099").mkdir()
    assert VersionedTable(spark, str(tmp_path / "t")).recover() == ["000099-000099"]
    table.store.files.delete(f"runs/{flushed['file_name']}")
    with pytest.raises(EngineError) as e:
        VersionedTable(spark, str(tmp_path / "t")).recover()
    assert e.value.status is Status.CORRUPTION


def test_reports_slots_and_shutdown(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), TINY.replace(compaction_io_mb_per_s=1))
    for i in range(2):
        table.write(spark.createDataFrame([(1, "PUT", f"k{i}", "x")], REQ))
        table.flush()
    table.write(spark.createDataFrame([(1, "PUT", "k9", "xyz"), (2, "DEL", "k0", None)], REQ))
    assert table.get("k9") == ("FOUND", "xyz") and table.get("k1") == ("FOUND", "x") and table.get("a") == ("NOT_FOUND", None)
    s = table.stats()
    assert (s["log_batches"], s["log_records"], s["last_seq_no"], s["active_entries"], s["active_bytes"]) == (1, 2, 4, 2, 2 + 3 + 32 + 2 + 32)
    assert (s["sst_count"], s["sst_entries"], s["watermark"], s["lookups"], s["lookups_found"], s["manifest_epoch"]) == (2, 2, 2, 3, 2, 2)
    assert s["runs_consulted"] + s["runs_skipped"] >= 6 and s["runs_skipped"] > 0
    table._reserve([0])
    assert table.compact() is None  # the picker leaves out what is held
    with pytest.raises(EngineError) as e:
        table.compact([0, 1])
    assert e.value.status is Status.CONFLICT
    with pytest.raises(EngineError) as e:
        table._reserve([1])  # free, but the one slot is taken
    assert e.value.status is Status.CONFLICT
    assert table.status()["files_in_progress"] == [0]
    table._release([0])
    job = table.compact([0, 1])
    status = table.status()
    assert status["last_compaction"] == job and status["running_jobs"] == 0 and status["pending_deletions"] == 2 and status["last_flush"]["sstable_id"] == 1
    assert table.shutdown()["num_entries"] == 2 and table.closed and table.shutdown(graceful=False) is None
    assert {r["key"]: r["value"] for r in table.state().collect()} == {"k1": "x", "k9": "xyz"}


def _stream(spark, tmp_path, rows):
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], REQ).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_ingest_stream_equals_batch(spark, tmp_path):
    rows = _requests(spark, random.Random(3), 60, 0)
    table = VersionedTable(spark, str(tmp_path / "t"), TINY)
    ingest(_stream(spark, tmp_path, rows), table, str(tmp_path / "c")).awaitTermination()
    model = {}
    for _, op, key, value in rows:
        if op == "PUT":
            model[key] = value
        else:
            model.pop(key, None)
    # Files are read in the order in which they were written.
    assert {r["key"]: r["value"] for r in table.state().collect()} == model


def test_stateful_admission(spark, tmp_path):
    rows = _requests(spark, random.Random(5), 40, 0)
    q = admitted_stream(_stream(spark, tmp_path, rows)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    live, want = set(), {}
    for no, op, key, _ in rows:
        want[no] = "OK" if op == "PUT" or key in live else "NOT_FOUND"
        live = live | {key} if op == "PUT" else live - {key}
    assert {r["req_no"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
