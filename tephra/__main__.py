"""Command line over a table's folder: python -m tephra FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import load_config
from .model import EngineError
from .plans.table import VersionedTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tephra")
    p.add_argument("folder")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"put": ["key", "value"], "get": ["key"], "del": ["key"], "load": ["path"], "flush": [], "compact": [], "runs": [], "manifest": [], "state": [], "recover": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(f"--{a}", required=True)
        if name == "compact":
            s.add_argument("--files", help="comma-separated run ids")
        if name in ("get", "state"):
            s.add_argument("--epoch", type=int)
    return p


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """The lines that a command prints; EngineError if it fails."""
    a = parser().parse_args(argv)
    table = VersionedTable(spark, a.folder, load_config(a.config))
    if a.command in ("put", "del"):
        row = (1, a.command.upper(), a.key, getattr(a, "value", None))
        return [r["status"] for r in table.write(spark.createDataFrame([row], "req_no long, op string, key string, value string")).collect()]
    if a.command == "load":  # requests as JSON lines: req_no, op, key, value
        judged = table.write(spark.read.schema("req_no long, op string, key string, value string").json(a.path))
        return [f"{r['status']}: {r['count']}" for r in judged.groupBy("status").count().orderBy("status").collect()]
    if a.command == "get":
        status, value = table.get(a.key, a.epoch)
        return [status] if value is None else [status, value]
    if a.command == "flush":
        new = table.flush()
        return [f"run {new['id']}: {new['num_entries']} entries, {new['file_size']} bytes" if new else "nothing to flush"]
    if a.command == "compact":
        job = table.compact([int(i) for i in a.files.split(",")] if a.files else None)
        return [f"{job['inputs']} -> {job['output']}: {job['keys_in']} -> {job['keys_out']} keys" if job else "nothing to compact"]
    manifest = table.store.load()
    if a.command == "runs":
        return [f"{i} {t['id']} {t['file_name']} [{t['min_key']}, {t['max_key']}] {t['num_entries']} {t['file_size']}" for i, t in enumerate(manifest["tables"])]
    if a.command == "manifest":
        return [f"{k}: {manifest[k]}" for k in ("manifest_version", "epoch", "next_sst_id", "flushed_seq_no_watermark")] + [f"tables: {len(manifest['tables'])}"]
    if a.command == "recover":
        return [f"deleted {n}" for n in table.recover()]
    table.state(a.epoch).orderBy("key").show(1000, False)
    return []


if __name__ == "__main__":
    try:
        print("\n".join(run(SparkSession.builder.getOrCreate(), sys.argv[1:])))
    except EngineError as e:
        print(e, file=sys.stderr)
        sys.exit(1)
