"""Table sinks: generations with a pointer, upserts, deletes, partition replacement."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import last_per_key
from ..session import durable


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.getFileStatus(target).isDirectory()


def write_files(rows: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files below ``folder``, in parallel by executors; a repeated task writes the same files again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                target = f"{root}/{path.as_py()}"
                files.create_dir(target.rpartition("/")[0], recursive=True)
                with files.open_output_stream(target) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def publish_generation(df: DataFrame, path: str, generation: str, partition_by: list[str] | None = None) -> bool:
    """SNK-1: write a full snapshot under its generation key, then move the pointer.

    A complete generation (its ``_SUCCESS`` marker exists) is reused; readers follow the pointer, so they never see a
    half-written one. Returns True when data was written.
    """
    spark = df.sparkSession
    target = f"{path}/gen={generation}"
    fresh = not _exists(spark, f"{target}/_SUCCESS")
    if fresh:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    pointer = spark.range(1).select(F.lit(generation).alias("generation"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")
    return fresh


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the generation the newest pointer row names."""
    newest = spark.read.parquet(f"{path}/pointer").agg(F.max_by("generation", "published_at")).first()[0]
    return spark.read.parquet(f"{path}/gen={newest}")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """SNK-2: insert or replace by key. The delta is reduced to one row per key by a combining aggregate, then the
    untouched base rows come from an anti join, so base payloads are never grouped or sorted."""
    newest = last_per_key(delta, key, order) if order else delta.dropDuplicates(key)
    return base.join(newest.select(*key), key, "left_anti").unionByName(newest.select(*base.columns))


def delete_where(base: DataFrame, keys: DataFrame) -> DataFrame:
    """SNK-3: rows whose key columns match are removed."""
    return base.join(keys, keys.columns, "left_anti")


def replace_versions(df: DataFrame, path: str, column: str, replaced: DataFrame | None = None, buckets: int = 64) -> None:
    """SNK-4: rows of the ``replaced`` versions (of those in ``df`` unless given) make way for ``df``; a version that comes
    back without rows loses its old ones. Versions share a fixed number of hash buckets, and only touched ones are written."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")
    gone = (df if replaced is None else replaced).select(column).distinct()
    new = df.withColumn("_bucket", bucket)
    if _exists(spark, path):
        touched = gone.select(bucket.alias("_bucket")).unionByName(new.select("_bucket")).distinct()
        kept = spark.read.parquet(path).join(touched, "_bucket", "left_semi").join(gone, column, "left_anti")
        new = durable(new.unionByName(kept.select(*new.columns)))
        empty = touched.join(new.select("_bucket"), "_bucket", "left_anti").collect()  # at most ``buckets`` rows
        fs, _ = _fs(spark, path)
        for row in empty:
            fs.delete(_fs(spark, f"{path}/_bucket={row[0]}")[1], True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
