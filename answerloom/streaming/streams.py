"""Streaming forms of the stateful behaviours. Every stream runs to the end of its input (``availableNow``), resumes from its
checkpoint, and writes idempotently per micro-batch, so a lost executor or driver repeats a batch without doubling it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scale import grouped_list, last_per_key, top_k
from ..operators import blocks as blk
from ..operators import chunks as chk
from ..operators.conversation import MAX_TOPICS, confirmed_values
from ..sources import files


def _batch_writer(path: str, by: str = "batch"):
    """Each micro-batch owns one partition folder; a repeated batch overwrites its own output."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{by}={batch_id}")

    return write


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", writer=None) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(writer or _batch_writer(path)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# --- STR-1 -------------------------------------------------------------------------------------------------------------

def incremental_index(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """New files become blocks and chunks in bounded batches; ``progress`` holds totals per version, and a version is
    complete only when every child row is there. The checkpoint is the cursor. A batch opens and decodes its files once, into
    ``staged``, which the next batch overwrites."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(landing)
    )

    def index(batch: DataFrame, batch_id: int) -> None:
        readable = F.col("error_code").isNull() & F.col("ext").isin(*files.TEXT_EXTENSIONS)
        routed = files.classify_files(batch).withColumn("bytes", F.when(readable, F.col("bytes")))
        decoded = files.decode_text(routed).select(F.col("sha256").alias("version_id"), "filename", "ext", "error_code", "text")
        decoded.write.mode("overwrite").parquet(f"{out}/staged")
        staged = spark.read.schema(decoded.schema).parquet(f"{out}/staged")
        versions = staged.where("text is not null")
        markdown = blk.markdown_blocks(versions.where("ext <> 'txt'").select("version_id", "text"))
        plain = blk.text_blocks(versions.where("ext = 'txt'").select("version_id", "text"))
        names = ["version_id", "ordinal", "block_type", "content", "heading_path", "page_number"]
        drafts = chk.assign_chunk_ids(chk.chunk_generic(markdown.select(*names).unionByName(plain.select(*names))))
        drafts.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        stored = spark.read.schema(drafts.schema).parquet(f"{out}/chunks/batch={batch_id}")
        progress = stored.groupBy("version_id").agg(F.count_if(F.col("kind") == "child").alias("total"))
        seen = versions.select("version_id", "filename").join(progress, "version_id", "left").fillna(0, ["total"])
        rejected = staged.where("error_code is not null").select(
            F.lit(None).cast("string").alias("version_id"), "filename", F.lit(0).cast("long").alias("total"), "error_code")
        seen.withColumn("error_code", F.lit(None).cast("string")).unionByName(rejected).write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")

    run_to_end(raw, out, checkpoint, writer=index)


def indexed_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks over all batches; a version that arrived twice counts once."""
    return spark.read.parquet(f"{out}/chunks").drop("batch").dropDuplicates(["chunk_id"])


# --- keyed views -------------------------------------------------------------------------------------------------------

def keyed_view(stream: DataFrame, path: str, checkpoint: str, key: str, view) -> None:
    """Keep ``view(rows of the touched keys)`` up to date: every batch is stored, and the keys it touches are computed anew
    from all stored rows. Rows may come late, in any order or twice; one batch or many give the same newest view."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{path}/rows").where(F.col("batch") <= batch_id)
        touched = stored.where(F.col("batch") == batch_id).select(key).distinct()
        view(stored.drop("batch").join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/view/batch={batch_id}")

    run_to_end(stream, path, checkpoint, writer=step)


def newest_view(spark: SparkSession, path: str, key: str) -> DataFrame:
    return last_per_key(spark.read.parquet(f"{path}/view"), [key], [F.col("batch")]).drop("batch")


# --- STR-2 -------------------------------------------------------------------------------------------------------------

def topic_view(turns: DataFrame) -> DataFrame:
    """``conv_id, context_version, last_turn, topics, confirmed`` from turn rows (conv_id, turn, reset, topic_keys,
    entity_values): the latest place of each topic since the last reset, and the confirmed values of turns with a topic."""
    once = turns.dropDuplicates(["conv_id", "turn"])
    heads = once.groupBy("conv_id").agg(F.count(F.lit(1)).alias("context_version"), F.max("turn").alias("last_turn"), F.max(F.when(F.col("reset"), F.col("turn"))).alias("_reset"))
    meant = once.where(F.size("topic_keys") > 0)
    places = meant.select("conv_id", "turn", F.posexplode("topic_keys").alias("_p", "topic")).groupBy("conv_id", "topic").agg(F.max(F.struct("turn", "_p")).alias("_at"))
    alive = places.join(heads.select("conv_id", "_reset"), "conv_id").where(F.col("_reset").isNull() | (F.col("_at.turn") >= F.col("_reset")))
    stacks = top_k(alive, ["conv_id"], [F.col("_at").desc()], MAX_TOPICS, "_r").groupBy("conv_id").agg(grouped_list(F.col("topic"), F.col("_r")).alias("topics"))
    mentions = meant.select("conv_id", "turn", F.posexplode("entity_values").alias("_p", "value"))
    confirmed = confirmed_values(mentions.select("conv_id", F.struct("turn", "_p").alias("at"), "value"))
    none = F.array().cast("array<string>")
    return heads.drop("_reset").join(stacks, "conv_id", "left").join(confirmed, "conv_id", "left").withColumn(
        "topics", F.coalesce("topics", none)).withColumn("confirmed", F.coalesce("confirmed", none))


def topic_state_stream(turns: DataFrame, path: str, checkpoint: str) -> None:
    keyed_view(turns, path, checkpoint, "conv_id", topic_view)


# --- STR-3 -------------------------------------------------------------------------------------------------------------

def history_view(messages: DataFrame, limit: int = 100, ttl_seconds: int = 900) -> DataFrame:
    """``conv_id, messages, last_ts, expires_at``: the last ``limit`` messages since the last silence of more than
    ``ttl_seconds``. Messages (conv_id, ts, turn, text) are ordered by time, then turn; a repeated one counts once."""
    order = Window.partitionBy("conv_id").orderBy("ts", "turn")
    silent = F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    marked = messages.dropDuplicates(["conv_id", "ts", "turn"]).withColumn("_starts", silent)
    starts = marked.groupBy("conv_id").agg(F.max(F.when(F.col("_starts"), F.struct("ts", "turn"))).alias("_from"))
    current = marked.join(starts, "conv_id").where(F.col("_from").isNull() | (F.struct("ts", "turn") >= F.col("_from")))
    newest = top_k(current, ["conv_id"], [F.col("ts").desc(), F.col("turn").desc()], limit, "_back")
    return newest.groupBy("conv_id").agg(grouped_list(F.col("text"), -F.col("_back")).alias("messages"), F.max("ts").alias("last_ts")).withColumn(
        "expires_at", F.col("last_ts") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def history_ttl(messages: DataFrame, path: str, checkpoint: str, limit: int = 100, ttl_seconds: int = 900) -> None:
    """The view carries when it expires; a reader drops rows whose time is past."""
    keyed_view(messages, path, checkpoint, "conv_id", lambda rows: history_view(rows, limit, ttl_seconds))


# --- STR-4 -------------------------------------------------------------------------------------------------------------

def dedupe_stream(uploads: DataFrame, path: str, checkpoint: str) -> None:
    """The same content of a document is taken once, across batches and restarts: each batch is held against the stored
    hashes by an anti join, so no state grows in memory."""
    keys = ["document_id", "sha256"]

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(keys)
        if batch_id:
            taken = batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id).select(*keys)
            new = new.join(taken, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_to_end(uploads, path, checkpoint, writer=step)
