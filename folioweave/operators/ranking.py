"""Row numbers without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioweave.session import materialise


def row_numbers(df: DataFrame, order: list[Column], name: str, partition: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``, the row number from 1 by ``order``, within ``partition`` if given.

    Rows are range-partitioned by (partition, order) and numbered within each range; the
    counts of the ranges before it, a row per range and group met there, give the offset.  A
    group of any size is spread over many tasks.  ``order`` must be total for a definite result.
    """
    partition = partition or []
    keys = [F.col(p) for p in partition]
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy("_range", *partition).orderBy(*order)
    counts = ranged.groupBy("_range", *partition).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if partition else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    for p in partition:
        offsets = offsets.withColumnRenamed(p, f"_key_{p}")
    met = F.col("_range") == F.col("_range_of")
    for p in partition:
        met = met & F.col(p).eqNullSafe(F.col(f"_key_{p}"))
    joined = ranged.withColumn(name, F.row_number().over(local).cast("long")).join(offsets.withColumnRenamed("_range", "_range_of"), met)
    return joined.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)
