"""Engine configuration: one explicit object, read from and written to JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    # Names and defaults are fixed values: stored configurations must load.
    data_dir: str = "./data"
    memtable_max_bytes: int = 67_108_864
    max_immutable_tables: int = 4
    memtable_size_overhead_bytes_per_entry: int = 32
    rotation_cooldown_ms: int = 0
    block_size: int = 8192
    bloom_false_positive: float = 0.01
    wal_fsync_every_n: int = 1
    wal_segment_roll_bytes: int = 134_217_728
    compression: str = "off"
    log_level: str = "info"
    sst_dir: str = "data/sst"
    restart_interval: int = 16
    max_build_buffer_mb: int = 32
    block_cache_mb: int = 64
    cache_index_blocks: bool = True
    max_open_files: int = 1024
    manifest_path: str = "data/manifest.json"
    publish_log_level: str = "info"
    event_log_path: str = "data/events.log"
    size_tiered_fan_in: int = 4
    size_tiered_size_ratio: float = 2.0
    tombstone_grace_seconds: int = 86_400
    compaction_max_concurrent: int = 1
    compaction_io_mb_per_s: int = 0
    l0_compaction_trigger: int = 8
    l0_stop_writes: int = 20
    bg_tick_ms: int = 500
    shutdown_timeout_ms: int = 5000

    @property
    def retired_run_grace_seconds(self) -> int:
        """What ``tombstone_grace_seconds`` governs: how long files of retired runs are kept."""
        return self.tombstone_grace_seconds

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        """Unknown names raise; missing ones take their defaults."""
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    def replace(self, **changes) -> EngineConfig:
        return dataclasses.replace(self, **changes)


#: A configuration in which a few rows fill every structure; for tests.
TINY = EngineConfig(memtable_max_bytes=256, block_size=64, wal_segment_roll_bytes=1024, size_tiered_fan_in=2, l0_compaction_trigger=3, tombstone_grace_seconds=30, bg_tick_ms=100)


#: The name under which the active configuration is kept (a fixed value).
ACTIVE = ".active"


def find_config(name: str, folder: str | Path = ".") -> Path | None:
    """The first that exists of: name, name.json, config/name, config/name.json."""
    base = Path(folder)
    return next((p for p in (base / name, base / f"{name}.json", base / "config" / name, base / "config" / f"{name}.json") if p.is_file()), None)


def load_config(name: str | None = None, folder: str | Path = ".") -> EngineConfig:
    """The named configuration, else the active one, else one named ``default``, else the built-in values. A named one that is missing raises."""
    found = find_config(name, folder) if name else find_config(ACTIVE, folder) or find_config("default", folder)
    if found is None:
        if name:
            raise FileNotFoundError(name)
        return EngineConfig()
    return EngineConfig.from_json(found.read_text())


def save_config(config: EngineConfig, name: str, folder: str | Path = ".") -> Path:
    path = Path(folder) / "config" / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(config.to_json())
    return path


def set_active(config: EngineConfig, folder: str | Path = ".") -> Path:
    """Later starts without a name take this configuration; what runs already keeps its own."""
    return save_config(config, ACTIVE, folder)
