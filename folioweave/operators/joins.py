"""Joins whose key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose two sides meet by a shuffle, whatever size the optimiser believes them to have.

    It goes by the compressed size of the files below and doesn't see that a Python function
    makes many rows of one, so what it broadcasts may be a hundred times its threshold, all of
    it held by the driver.
    """
    return df.hint("merge")


def skew_safe_left_join(rows: DataFrame, groups: DataFrame, key: str, unique: Column, size: str, top: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``groups``, one row per ``key``, that no hot key can slow down.

    The ``top`` groups with the most rows (column ``size`` of ``groups``) are broadcast, which
    is a fixed bound whatever the data; the rows of all other keys meet by a shuffle.  Rows
    already matched get the random key ``unique`` hashes to, so they spread evenly instead of
    meeting again in one task.  NULL keys match nothing.  Columns of ``groups`` must not occur
    in ``rows`` except for ``key``; ``size`` is dropped.
    """
    values = [c for c in groups.columns if c not in (key, size)]
    hot = groups.orderBy(F.col(size).desc(), F.col(key)).limit(top)
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.select(F.col(key).alias("_cold_key"), F.lit(False).alias("_cold_side"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    met = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    kind = groups.schema[key].dataType
    out = out.withColumn("_met", met).withColumn("_shuffle_key", F.when(met, F.xxhash64(unique).cast("string").cast(kind)).otherwise(F.col(key)))
    out = out.join(cold, (F.col("_shuffle_key") == F.col("_cold_key")) & (F.col("_met") == F.col("_cold_side")), "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*rows.columns, *(both.getField(v).alias(v) for v in values))
