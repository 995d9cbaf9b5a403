"""Places in an order over whole tables and groups, without one task for a table or a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talus.sources.store import staged


def placed(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with the 1-based place of each row in its group (or the table) in this order; nulls come first.

    Rows are dealt to ranges of group and order and sorted there. A row's place is its
    number in its range plus the rows of its group in the ranges before: a running sum
    over one count for each group and range. ``order`` has to tell all rows apart, or places
    of equal rows follow the ranges' files.
    """
    group = group or []
    rows = staged(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    side = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_of"), "_first", before.alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.col("_part") == F.col("_of"))
    return rows.join(side, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
