"""Places in one order over all rows, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, bucket: Column, *order: Column | str, name: str = "rank") -> DataFrame:
    """rows with their places from 1, in order of `bucket` first and `order` within a bucket.

    Rows are numbered bucket by bucket, and the counts of the buckets, a much smaller table, are added up: `bucket` has to
    follow the order and should have many values.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = counts.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = rows.withColumn(name, within).join(starts, F.col("_bucket").eqNullSafe(F.col("_of")))
    return numbered.withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before", "_of")
