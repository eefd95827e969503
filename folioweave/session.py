"""Session set-up and the shared folder for lineage cuts.

Executors may be lost at any time, so intermediate results that several jobs read are
written to the folder that ``spark.checkpoint.dir`` names; block-manager copies are never
relied on.  Only where that setting is absent (unit tests, a laptop) a temporary folder
is used, and only under a local master.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "folioweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    # workers on this machine find the package beside the one that runs; on a cluster it is installed (pyproject.toml)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, without a trailing slash."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", "") or (spark.sparkContext.getCheckpointDir() or "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="folioweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, a folder for each value of column ``by`` if given, and return the table that was written.

    Cuts the lineage; unlike a cache it survives the loss of executors, and unlike
    ``checkpoint()`` it is columnar, so later reads are pruned and have true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioweave-tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_later(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when Python ends, or at the next ``drop_materialised``."""
    if not _written:
        atexit.register(drop_materialised)
    _written[path] = spark


def drop_materialised() -> None:
    """Delete every table and stream folder this process has written; called when Python ends."""
    while _written:
        path, spark = _written.popitem()
        try:
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            pass
