"""Global row numbers and running sums without a window that collapses to one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def _in_ranges(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    """The rows dealt into ranges, sorted and written once; adds _part (the range) and _at (the place in it, from 0)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # In the generated id the partition is above bit 33 and the place in it below.
    ranged = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    return ranged.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def last_value(df: DataFrame, by: str, order: list[str], value: Column, name: str, current: bool = False, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the last value that isn't null among the rows of the same ``by`` before each row (with ``current``: and of it).

    A frequent ``by`` is cut into ranges of ``order`` like all else: each range is looked through on its own, and the
    last value before it comes from one row for each range of that ``by``.
    """
    ranged = _in_ranges(df.withColumn("_v", value), [by, *order], partitions)
    own = Window.partitionBy("_part", by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    lasts = ranged.where(F.col("_v").isNotNull()).groupBy("_part", by).agg(F.max(F.struct("_at", "_v")).alias("_l"))
    pieces = ranged.select("_part", by).distinct().join(lasts, ["_part", by], "left")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("_part", by, F.last("_l._v", ignorenulls=True).over(before).alias("_carry"))
    out = ranged.withColumn(name, F.last("_v", ignorenulls=True).over(own)).join(carry, ["_part", by])
    return out.withColumn(name, F.coalesce(name, "_carry")).select(*df.columns, name)


def ordered_prefix(df: DataFrame, order: list[str], index: str = "row_no", sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``index`` (1, 2, ... in the order of the columns) and running sums to and with each row.

    The rows are dealt into ranges, sorted and written once; a row's place in its range and the totals of the ranges
    before it give its global place. Only one row a range meets in a single task. Ties are numbered in some order.
    """
    sums = sums or {}
    ranged = _in_ranges(df.withColumns({f"_v_{c}": e.cast("long") for c, e in sums.items()}), order, partitions)
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({c: F.sum(f"_v_{c}").over(own) for c in sums}) if sums else ranged
    out = out.join(offsets, "_part").withColumn(index, F.col("_o") + F.col("_at") + 1)
    for c in sums:
        out = out.withColumn(c, F.col(c) + F.col(f"_o_{c}"))
    return out.select(*df.columns, index, *sums)
