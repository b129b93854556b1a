"""Streams of requests: into a table batch by batch, or into a live view with state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.shared import scratch
from ..plans.table import VersionedTable


def ingest(requests: DataFrame, table: VersionedTable, checkpoint: str, maintain: bool = True) -> StreamingQuery:
    """Write each micro-batch of a stream (req_no, op, key, value), once even after a restart, and maintain the table after it. Stop it with ``stop()``, gracefully after ``processAllAvailable()``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        with scratch():  # nothing of a batch is kept but what the table stores
            table.write(batch, batch_id)
            if maintain:
                table.maintain()

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VIEW = StructType([StructField("key", StringType()), StructField("req_no", LongType()), StructField("op", StringType()), StructField("value", StringType()), StructField("status", StringType())])


class AdmissionState(StatefulProcessor):
    """Latest operation of each key. A delete is accepted only after a put; tombstones stay in the state, one a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("op", StringType()), StructField("req_no", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get() if self.last.exists() else None
        op = last[0] if last else None
        out = []
        for pdf in rows:
            for r in pdf.sort_values("req_no").itertuples(index=False):
                ok = r.op == "PUT" or op == "PUT"
                out.append((key[0], r.req_no, r.op, r.value if r.op == "PUT" else None, "OK" if ok else "NOT_FOUND"))
                op = r.op
                self.last.update((op, int(r.req_no)))
        yield pd.DataFrame(out, columns=[f.name for f in VIEW.fields])

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame) -> DataFrame:
    """key, req_no, op, value and status of a stream's valid writes. Needs the RocksDB state store."""
    return requests.where("length(key) > 0 AND op IN ('PUT', 'DEL')").groupBy("key").transformWithStateInPandas(AdmissionState(), VIEW, outputMode="Append", timeMode="None")
