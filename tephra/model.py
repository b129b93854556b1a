"""Relations of the engine and the names of its states."""

from __future__ import annotations

from enum import Enum

REQUESTS = "req_no long, op string, key string, value string"
KV_LOG = "seq_no long, op string, key string, value string"
ENTRIES = "run_id long, key string, value string, seq_no long, is_tombstone boolean"
BLOOM_PARAMS = "struct<num_bits:bigint,num_hashes:int,false_positive_rate:double>"
MANIFEST_TABLE = f"struct<id:bigint,file_name:string,min_key:string,max_key:string,min_seq_no:bigint,max_seq_no:bigint,created_at:bigint,file_size:bigint,num_entries:bigint,bloom_params:{BLOOM_PARAMS}>"
MANIFEST = f"manifest_version int, epoch long, next_sst_id long, flushed_seq_no_watermark long, tables array<{MANIFEST_TABLE}>"

#: Bytes that an entry takes in memory besides key and value, and a log record besides them; both fixed values.
ENTRY_OVERHEAD = 32
RECORD_OVERHEAD = 25
#: Log segments begin with a header of so many bytes.
SEGMENT_HEADER = 8
#: Largest log payload that can be read back; larger requests are rejected on admission.
MAX_PAYLOAD = 10_485_760


class Status(str, Enum):
    OK = "OK"
    FOUND = "FOUND"
    TOMBSTONE = "TOMBSTONE"
    NOT_FOUND = "NOT_FOUND"
    INVALID_ARGUMENT = "InvalidArgument"
    STORE_CLOSED = "StoreClosed"
    BACKPRESSURE = "Backpressure"
    PAUSED = "Paused"
    CONFLICT = "Conflict"
    IO_ERROR = "IoError"
    CORRUPTION = "Corruption"
    INTERNAL_ERROR = "InternalError"
    NOT_IMPLEMENTED = "NotImplemented"


class EngineError(Exception):
    def __init__(self, status: Status, message: str):
        super().__init__(f"{status.value}: {message}")
        self.status = status
