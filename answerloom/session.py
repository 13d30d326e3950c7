"""Session helpers: configuration for tests/bench and tables written to the cluster's shared folder."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "answerloom", **conf: str) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    n = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-process ``local`` session may go without: it gets one scratch folder of its own. A cluster without the
    setting is an error, since a folder of the driver's machine is not visible to executors.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[context.applicationId]


def durable(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table into the shared folder (in folders of the columns ``by``) and reading it back.

    A written table survives lost executors and, unlike a checkpoint of rows, lets every later reader prune columns.
    ``drop_tables`` deletes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables of ``durable``; frames that read them must have been used up."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _TABLES.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
