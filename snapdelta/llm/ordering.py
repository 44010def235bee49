"""Running totals over tables that no single task should sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that share a bucket of the order, on average.
BUCKET_ROWS = 20_000


def running_total(rows: DataFrame, group: list[str], order: Column, ties: list[str], size: str, out: str, n_rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds out, the sum of size over the rows of the same group that come before in the order (a bigint spread evenly over its range, as a hash is), then by ties.

    The order is cut into equal ranges, about one per bucket_rows rows; rows are summed within a range, and ranges'
    totals, one row each, among themselves. Both use one exchange of the rows.
    """
    buckets = max(1, n_rows // bucket_rows)
    place = F.least(F.floor((order.cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")
    keyed = rows.withColumn("o__", order).withColumn("b__", place)
    inner = Window.partitionBy(*group, "b__").orderBy("o__", *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("l__", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    totals = rows.select(*group, size, order.alias("o__")).withColumn("b__", F.least(F.floor((F.col("o__").cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int"))
    totals = totals.groupBy(*group, "b__").agg(F.sum(size).alias("t__"))
    outer = Window.partitionBy(*group).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, "b__", F.coalesce(F.sum("t__").over(outer), F.lit(0)).alias("p__"))
    return local.join(before, [*group, "b__"]).withColumn(out, (F.col("l__") + F.col("p__")).cast("bigint")).drop("o__", "b__", "l__", "p__")
