"""Records that arrive as files: incremental scans and duplicates dropped on the way in."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.functions.text import RESOLVERS
from folioweave.operators.resolve import keyed
from folioweave.session import forget_later, shared_dir


def arrivals(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a table's parquet files, in the schema of those that exist."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    local = path.removeprefix("file://")
    if os.path.isfile(local):  # a stream reads folders
        return reader.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(local))
    return reader.parquet(path)


def first_of_key(stream: DataFrame, time: str = "fetched_at", delay: str = "60 days", resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """The first record of each key that arrives; keys are remembered for ``delay`` behind the latest time.

    ``delay`` bounds the state and what may be late: a record older than that is dropped, whether its key is new or not.  A
    delay longer than the data is deep loses nothing and keeps every key.
    """
    rows = keyed(stream, resolvers).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return rows.dropDuplicatesWithinWatermark(["key_kind", "key"]).drop("_at")


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now and stop; a later call with the same checkpoint takes what came since, each record once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_seen(spark: SparkSession, path: str, resolvers: tuple[str, ...] = RESOLVERS) -> DataFrame:
    """(key_kind, key) of the records a stream over the whole table lets through: no record is too late, so every key stays in the state."""
    base = f"{shared_dir(spark)}/folioweave-streams/{uuid.uuid4().hex}"
    forget_later(spark, base)
    stream = first_of_key(arrivals(spark, path).select("paper_id", "title", "doi", "fetched_at"), delay="20000 days", resolvers=resolvers).select("key_kind", "key")
    land(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema("key_kind STRING, key STRING").parquet(f"{base}/rows")
