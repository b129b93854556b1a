"""Helpers shared by the operators: Arrow batches, and the written tables of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.shared import discard, fresh_path, release, scratch, shared_dir, written

__all__ = ["SLICE_ROWS", "by_merge", "discard", "fresh_path", "map_texts", "release", "scratch", "shared_dir", "slices", "written"]

#: Rows that an Arrow batch is cut into before it becomes Python objects.
SLICE_ROWS = 512


def by_merge(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: the join is by sort and merge, whatever Spark takes its size for.

    Before anything has run, Spark takes a table's size for that of its compressed files, and leaves out the rows that
    an explode adds: 64 times as many rows pass for a small side, and are collected by the driver to be broadcast.
    """
    return side.hint("merge")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow: ``make()`` runs once in a task and returns f(RecordBatch) -> dict of columns or None."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in slices(batches, rows):
            got = f(part)
            if got is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((got[n] for n in out.names), out)], schema=out)

    return df.mapInArrow(run, schema)
