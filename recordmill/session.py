"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    # dates are cut out of timestamps as text, so the zone has to be fixed
    "spark.sql.session.timeZone": "UTC",
    # a JSON object may repeat a key; the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM interprets methods above 8,000 bytes of code; wide expressions are faster
    # as many small compiled methods than fused into a stage that is too big to compile
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows may hold whole blocks of vectors
    "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
    # rows for a few partitions go to a few open files; without this every wide row is sorted by its partition first
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # only the partitions present in the written data are replaced
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the library depends on; sizes stay the cluster's."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "recordmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A local master may
    fall back to a temporary folder; a cluster without the setting is an error,
    because executors could not see each other's files.
    """
    return f"{named_path(spark, name)}-{uuid.uuid4().hex}"


def named_path(spark: SparkSession, name: str) -> str:
    """The path of a name under the shared folder, the same on every call."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="recordmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/recordmill/{name}"


def small_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation.

    Its size is known to the optimizer, which then decides on broadcasting by itself.
    """
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns)))))
