"""A durable versioned key-value table: a change log, sorted runs and manifests in one folder."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.shared import scratch, written
from ..functions.sizes import bloom_bits, bloom_hashes, entry_size, record_size
from ..model import KV_LOG, EngineError, Status
from ..operators import admission, compaction, maintenance, resolve
from ..sources.eventlog import EventLog
from ..sources.manifest_store import ManifestStore
from ..sources.runs import read_runs, write_merged, write_run


class VersionedTable:
    """One writer appends batches of requests; readers take a manifest's snapshot and the log above its watermark."""

    def __init__(self, spark: SparkSession, base: str, config: EngineConfig | None = None):
        self.spark, self.base, self.config = spark, base.rstrip("/"), config or EngineConfig()
        self.store = ManifestStore(spark, self.base)
        self.events = EventLog(self.config.event_log_path) if self.config.event_log_path != EngineConfig().event_log_path else None
        self.paused = self.closed = False
        self.counters, self.last_flush = Counter(), None
        self._lock, self._busy, self._running = threading.Lock(), set(), 0

    # Reading

    def _run_path(self, table: dict) -> str:
        return f"{self.base}/runs/{table['file_name']}"

    def commits(self) -> list[dict]:
        """The batches of the log in order: first, last, folder and batch_id. A folder that no commit names was left by a writer that failed."""
        return [json.loads(self.store.files.read(f"commits/{n}")) for n in self.store.files.names("commits")]

    def log(self, above: int = 0) -> DataFrame:
        """Records of the change log above a number; only batches that hold some are read."""
        batches = [c["folder"] for c in self.commits() if c["last"] > above]
        if not batches:
            return self.spark.createDataFrame([], KV_LOG)
        return self.spark.read.schema(KV_LOG).parquet(*[f"{self.base}/log/{n}" for n in batches]).where(F.col("seq_no") > above)

    def runs(self, manifest: dict | None = None, key: str | None = None, upto: str | None = None) -> DataFrame:
        """Entries of a snapshot's runs; with a key (or a range of keys) only of those whose range can hold it."""
        manifest = manifest or self.store.load()
        tables = [t for t in manifest["tables"] if key is None or t["min_key"] <= (upto or key) and key <= t["max_key"]]
        if key is not None:
            self.counters.update(runs_consulted=len(tables), runs_skipped=len(manifest["tables"]) - len(tables))
        return read_runs(self.spark, {t["id"]: self._run_path(t) for t in tables})

    def entries(self, epoch: int | None = None, key: str | None = None, upto: str | None = None) -> DataFrame:
        """All versions that a read sees: runs of the snapshot, and for the newest one the log above its watermark."""
        manifest = self.store.load(epoch)
        found = self.runs(manifest, key, upto).select("key", "value", "seq_no", "is_tombstone")
        return found if epoch is not None else found.unionByName(resolve.entries_of(self.log(manifest["flushed_seq_no_watermark"])))

    def state(self, epoch: int | None = None) -> DataFrame:
        return resolve.live(self.entries(epoch))

    def get(self, key: str, epoch: int | None = None) -> tuple[str, str | None]:
        row = resolve.get(self.entries(epoch, key), key).first()
        self.counters.update(lookups=1, lookups_found=row["status"] == Status.FOUND.value)
        return row["status"], row["value"]

    def multi_get(self, keys: DataFrame, epoch: int | None = None) -> DataFrame:
        return resolve.multi_get(self.entries(epoch), keys)

    def last_seq(self) -> int:
        manifest = self.store.load()
        return max(0, manifest["flushed_seq_no_watermark"], *(t["max_seq_no"] for t in manifest["tables"]), *(c["last"] for c in self.commits()))

    # Writing

    def write(self, requests: DataFrame, batch_id: int | None = None) -> DataFrame | None:
        """Append a batch (req_no, op, key, value) and return req_no, key, status. Deletes see what is stored and what the batch itself has put.

        A batch with an id is stored once: None is returned if it is there already, as after a stream's restart.
        """
        if batch_id is not None and self._stored(batch_id):
            return None
        if self.closed:
            raise EngineError(Status.STORE_CLOSED, self.base)
        if self.config.l0_stop_writes and len(self.store.load()["tables"]) >= self.config.l0_stop_writes:
            self.counters["write_stalls"] += 1
            raise EngineError(Status.BACKPRESSURE, "too many runs")
        with scratch() as stays:
            batch = written(requests.select("req_no", "op", "key", "value"), "batch")
            judged = stays(written(self._judged(batch), "judged"))
            first = self.last_seq() + 1
            accepted = judged.where(F.col("status") == Status.OK.value)
            n = accepted.count()
            if n:
                self._append(admission.assign_seq(accepted, first), first, first + n - 1, batch_id)
        if batch_id is not None:
            self.store.files.create(f"batches/{batch_id:020d}", str(n))
        return judged.select("req_no", "key", "status")

    def _judged(self, batch: DataFrame) -> DataFrame:
        """The batch with statuses. Only keys that it deletes are looked up, in the runs whose range can hold them; a batch of puts reads nothing."""
        deletes = batch.where("op = 'DEL'").select("key")
        low, high = deletes.agg(F.min("key"), F.max("key")).first()
        if low is None:
            return admission.admit(batch)
        stored = resolve.live(self.entries(key=low, upto=high).join(deletes.distinct(), "key", "left_semi"))
        # What is live already goes before the batch as puts, which are not written again.
        before = stored.select(F.lit(-1).cast("long").alias("req_no"), F.lit("PUT").alias("op"), "key", F.lit("").alias("value"))
        return admission.admit(before.unionByName(batch)).where("req_no >= 0")

    def _append(self, log: DataFrame, first: int, last: int, batch_id: int | None) -> None:
        """Write the records to a folder of their own, then publish them under their first number; of two writers with one number the second gets Conflict."""
        folder = f"{first:020d}-{uuid.uuid4().hex}"
        log.select("seq_no", "op", "key", F.when(F.col("op") == "PUT", F.col("value")).alias("value")).write.parquet(f"{self.base}/log/{folder}")
        mine = self.store.files.create(f"commits/{first:020d}", json.dumps({"first": first, "last": last, "folder": folder, "batch_id": batch_id}))
        # The number may have been taken, flushed and cleared away since it was read.
        late = mine and self.store.load()["flushed_seq_no_watermark"] >= first
        if late:
            self.store.files.delete(f"commits/{first:020d}")
        if late or not mine:
            self.store.files.delete(f"log/{folder}")
            raise EngineError(Status.CONFLICT, f"another writer has stored {first}")

    def _stored(self, batch_id: int) -> bool:
        return self.store.files.exists(f"batches/{batch_id:020d}") or any(c["batch_id"] == batch_id for c in self.commits())

    def _table(self, run_id: int, name: str) -> dict:
        rate = self.config.bloom_false_positive
        e = self.spark.read.parquet(f"{self.base}/runs/{name}")
        n = F.count(F.lit(1))
        m = e.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq_no").alias("min_seq_no"), F.max("seq_no").alias("max_seq_no"), n.alias("num_entries"), F.sum(entry_size()).alias("file_size"), bloom_bits(n, F.lit(rate)).alias("num_bits"), bloom_hashes(F.lit(rate)).alias("num_hashes")).first().asDict()
        bloom = {"num_bits": m.pop("num_bits"), "num_hashes": m.pop("num_hashes"), "false_positive_rate": rate}
        digest = maintenance.content_digest(e.withColumn("run_id", F.lit(run_id).cast("long"))).first()
        return {"id": run_id, "file_name": name, **m, "created_at": int(time.time()), "bloom_params": bloom, "digest": digest["digest"]}

    def verify(self) -> DataFrame:
        """run_id and ok: whether each run still holds the rows and the digest with which it was published. Reads all of them."""
        tables = self.store.load()["tables"]
        stored = self.spark.createDataFrame([(t["id"], t["num_entries"], t.get("digest")) for t in tables], "run_id long, rows long, digest string")
        return maintenance.verify_runs(self.runs(), stored)

    def flush(self) -> dict | None:
        """The log above the watermark becomes the newest run; log batches that it covers go. None if there is nothing."""
        manifest = self.store.load()
        log = self.log(manifest["flushed_seq_no_watermark"])
        top, size = log.agg(F.max("seq_no"), F.sum(record_size())).first()
        if top is None:
            return None
        began = time.time()
        run_id = manifest["next_sst_id"]
        name = f"{run_id:06d}-{manifest['epoch'] + 1:06d}"
        write_run(resolve.latest(resolve.entries_of(log.where(F.col("seq_no") <= top))), f"{self.base}/runs/{name}", size)
        table = self._table(run_id, name)
        new = self.store.commit(manifest | {"next_sst_id": run_id + 1, "flushed_seq_no_watermark": max(top, manifest["flushed_seq_no_watermark"]), "tables": [table, *manifest["tables"]]})
        self.trim_log(new)
        self.last_flush = {"sstable_id": run_id, "file": name, "entries": table["num_entries"], "bytes": table["file_size"], "dur_ms": int(1000 * (time.time() - began)), "completed_at_ms": int(1000 * time.time())}
        self._event("FLUSH", sstable_id=run_id, entries=table["num_entries"], manifest_epoch=new["epoch"])
        return table

    def trim_log(self, manifest: dict) -> list[str]:
        """Delete the batches whose records are all in runs: their commits first, then what they name."""
        gone = [c for c in self.commits() if c["last"] <= manifest["flushed_seq_no_watermark"]]
        for c in gone:
            self.store.files.delete(f"commits/{c['first']:020d}")
            self.store.files.delete(f"log/{c['folder']}")
        return [c["folder"] for c in gone]

    def compact(self, ids: list[int] | None = None) -> dict | None:
        """Merge the given runs, or those that the picker chooses; statistics of the job, or None if there is nothing to do.

        A job holds its runs and one of ``compaction_max_concurrent`` slots until it ends; without a free slot, or if one
        of the runs is held, the call gets Conflict. With ``compaction_io_mb_per_s`` it takes as long as its output needs.
        """
        manifest = self.store.load()
        if not manifest["tables"]:
            return None
        tables = self.spark.createDataFrame([(t["id"], t["file_size"], t["id"] in self._busy) for t in manifest["tables"]], "id long, file_size long, busy boolean")
        if ids is None:
            if self.paused:
                raise EngineError(Status.PAUSED, "compaction")
            ids = [r["id"] for r in compaction.pick(tables, self.config.size_tiered_fan_in, self.config.size_tiered_size_ratio).orderBy("ordinal").collect()]
            if not ids:
                return None
        else:
            compaction.check_inputs(tables, ids)
        self._reserve(ids)
        try:
            return self._compact(manifest, ids)
        finally:
            self._release(ids)

    def _reserve(self, ids: list[int]) -> None:
        """All of the runs and a slot, or Conflict and nothing."""
        with self._lock:
            if self._running >= self.config.compaction_max_concurrent or self._busy & set(ids):
                raise EngineError(Status.CONFLICT, f"runs {ids}: no free slot, or held by another job")
            self._running += 1
            self._busy |= set(ids)

    def _release(self, ids: list[int]) -> None:
        with self._lock:
            self._running -= 1
            self._busy -= set(ids)

    def _compact(self, manifest: dict, ids: list[int]) -> dict:
        own = [t for t in manifest["tables"] if t["id"] in ids]
        run_id = manifest["next_sst_id"]
        name = f"{run_id:06d}-{manifest['epoch'] + 1:06d}"
        began = time.time()
        parts = read_runs(self.spark, {t["id"]: self._run_path(t) for t in own}).drop("run_id")
        write_merged(parts, compaction.merge_runs, f"{self.base}/runs/{name}", sum(t["file_size"] for t in own))
        table = self._table(run_id, name)
        rate = self.config.compaction_io_mb_per_s
        if rate:
            time.sleep(max(0.0, table["file_size"] / (rate << 20) - (time.time() - began)))
        keys_in = sum(t["num_entries"] for t in own)
        job = {"job_id": len(self.jobs()), "inputs": ids, "output": run_id, "bytes_in": sum(t["file_size"] for t in own), "bytes_out": table["file_size"], "keys_in": keys_in, "keys_out": table["num_entries"], "keys_dropped": max(0, keys_in - table["num_entries"]), "duration_ms": int(1000 * (time.time() - began))}
        self.store.commit(manifest | {"next_sst_id": run_id + 1, "tables": compaction.replace_in_manifest(manifest["tables"], ids, table)}, job)
        self._event("COMPACTION", **{k: job[k] for k in ("job_id", "inputs", "output", "bytes_in", "bytes_out")})
        return job

    def jobs(self) -> list[dict]:
        """Statistics of all compactions, oldest first, as the manifests keep them."""
        return [m["job"] for m in self.store.history() if m.get("job")]

    def job_relation(self) -> DataFrame:
        columns = ["job_id", "inputs", "output", "bytes_in", "bytes_out", "keys_in", "keys_out", "keys_dropped", "duration_ms"]
        rows = [tuple(j[c] for c in columns) for j in self.jobs()]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} {'array<long>' if c == 'inputs' else 'long'}" for c in columns))

    def maintain(self) -> None:
        """What background workers would do after a batch: flush first, then compact while it is due."""
        self.flush()
        if not self.paused and len(self.store.load()["tables"]) >= self.config.l0_compaction_trigger:
            self.compact()

    def sweep(self, pinned_epochs: list[int] = (), now_ms: int | None = None) -> list[str]:
        """Delete retired runs that are old enough and that neither the newest manifest nor a pinned epoch names; manifests stay."""
        keep = {t["file_name"] for e in [None, *pinned_epochs] for t in self.store.load(e)["tables"]}
        retired = [(n, at) for n, at in self.store.retired() if self.store.files.exists(f"runs/{n}")]
        if not retired:
            return []
        pinned = self.spark.createDataFrame([(k,) for k in keep], "file_name string")
        due = maintenance.sweep_retired(self.spark.createDataFrame(retired, "file_name string, deferred_at_ms long"), pinned, now_ms or int(1000 * time.time()), self.config.retired_run_grace_seconds)
        gone = [r["file_name"] for r in due.collect()]
        for name in gone:
            self.store.files.delete(f"runs/{name}")
        return gone

    def recover(self) -> list[str]:
        """At start, while nobody writes: every run that the manifest names must be there; runs, log folders and half-written files that writers left without a commit are deleted."""
        manifest = self.store.load()
        there = self.store.files.names("runs")
        missing = [t["file_name"] for t in manifest["tables"] if t["file_name"] not in there or not self.store.files.exists(f"runs/{t['file_name']}/_SUCCESS")]
        if missing:
            raise EngineError(Status.CORRUPTION, f"run {missing[0]} is missing")
        named = {t["file_name"] for e in self.store.epochs() for t in self.store.load(e)["tables"]}
        orphans = [n for n in there if n not in named]
        for n in orphans:
            self.store.files.delete(f"runs/{n}")
        named = {c["folder"] for c in self.commits()}
        for n in self.store.files.names("log"):
            if n not in named:
                self.store.files.delete(f"log/{n}")
        for folder in ("manifest", "commits", "batches"):
            self.store.files.clear_hidden(folder)
        return orphans

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def close(self) -> None:
        """Later writes raise StoreClosed. The log is durable, so nothing is flushed."""
        self.closed = True

    def shutdown(self, graceful: bool = True) -> dict | None:
        """No more writes. Gracefully the log is flushed, after jobs that run have ended or ``shutdown_timeout_ms`` is over; fast, it is left to the next start."""
        self.closed = True
        end = time.time() + self.config.shutdown_timeout_ms / 1000
        while graceful and self._running and time.time() < end:
            time.sleep(0.05)
        flushed = self.flush() if graceful else None
        self._event("SHUTDOWN", graceful=graceful, flushed=flushed is not None)
        return flushed

    # Reports

    def stats(self) -> dict[str, object]:
        """Figures of the log, of what is unflushed, of runs, reads, manifest and jobs. One aggregation over the unflushed log; the rest is in the driver."""
        manifest, commits = self.store.load(), self.commits()
        watermark, tables, c = manifest["flushed_seq_no_watermark"], manifest["tables"], self.config
        unflushed = resolve.latest(resolve.entries_of(self.log(watermark)))
        size = entry_size(overhead=c.memtable_size_overhead_bytes_per_entry)
        entries, size = unflushed.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        lookups = self.counters["lookups"]
        return {
            "log_batches": len(commits), "log_records": sum(x["last"] - x["first"] + 1 for x in commits), "last_seq_no": self.last_seq(),
            "memtable_overhead_bytes": c.memtable_size_overhead_bytes_per_entry, "rotation_cooldown_ms": c.rotation_cooldown_ms,
            "active_entries": entries, "active_bytes": size, "memtable_max_bytes": c.memtable_max_bytes, "flush_due": size >= c.memtable_max_bytes,
            "writes_blocked": bool(c.l0_stop_writes) and len(tables) >= c.l0_stop_writes, "write_stalls": self.counters["write_stalls"],
            "sst_count": len(tables), "sst_bytes": sum(t["file_size"] for t in tables), "sst_entries": sum(t["num_entries"] for t in tables), "next_sst_id": manifest["next_sst_id"], "watermark": watermark,
            "lookups": lookups, "lookups_found": self.counters["lookups_found"], "found_rate": 100.0 * self.counters["lookups_found"] / lookups if lookups else 0.0,
            "runs_consulted": self.counters["runs_consulted"], "runs_skipped": self.counters["runs_skipped"],
            "manifest_path": f"{self.base}/manifest", "manifest_version": manifest["manifest_version"], "manifest_epoch": manifest["epoch"], "versions_published": len(self.store.epochs()),
            "compaction_running": self._running, "compaction_paused": self.paused, "closed": self.closed, "bg_tick_ms": c.bg_tick_ms, "shutdown_timeout_ms": c.shutdown_timeout_ms,
        }

    def status(self) -> dict[str, object]:
        """What the table's jobs do and did: gates, runs held, last flush of this process, last compaction, retired runs that wait."""
        jobs, now = self.jobs(), int(1000 * time.time())
        waiting = [at for name, at in self.store.retired() if self.store.files.exists(f"runs/{name}")]
        return {
            "closed": self.closed, "paused": self.paused, "running_jobs": self._running, "files_in_progress": sorted(self._busy),
            "last_flush": self.last_flush, "total_jobs": len(jobs), "last_compaction": jobs[-1] if jobs else None,
            "sst_count": len(self.store.load()["tables"]), "l0_compaction_trigger": self.config.l0_compaction_trigger,
            "pending_deletions": len(waiting), "oldest_waiting_s": max(((now - at) // 1000 for at in waiting), default=0),
            "write_stalls": self.counters["write_stalls"],
        }

    def _event(self, title: str, **attrs) -> None:
        if self.events:
            self.events.record(title, **attrs)
