"""Registered queries: streams over the given tables, run to the end of their input."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as cv
from ..streaming import streams as st
from .q_blocks import PACK, WHOLE
from .q_conversation import topic_turns
from .q_relational import scratch
from .registry import ORACLES, query, table


FILE_BYTES = 1 << 20


def in_parts(spark, df, path, parts: int = 4):
    """The rows as a folder of files dealt by hash, so a stream takes them in several micro-batches and out of order."""
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("dedupe_stream", "SELECT DISTINCT lang AS document_id, sha256(text) AS sha256 FROM documents")
def q_dedupe_stream(spark, d):
    out = scratch(spark, "dedupe")
    uploads = table(spark, d, "documents").select(F.col("lang").alias("document_id"), F.sha2(F.col("text"), 256).alias("sha256"), "doc_id")
    st.dedupe_stream(in_parts(spark, uploads, f"{out}/uploads"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("document_id", "sha256")


@query("topic_state_stream", f"SELECT conv_id, context_version, topics, confirmed FROM ({ORACLES['topic_state']}) x")
def q_topic_stream(spark, d):
    """Turns arrive in several files in no order; the result equals ``topic_state``."""
    out = scratch(spark, "topics")
    products = F.filter("entities", lambda e: e["type"] == "product")
    values = F.transform(products, lambda e: e["raw_value"])
    label = lambda i: F.coalesce(F.get(F.col("entity_values"), F.lit(0)), cv._label_of(i["domain"]))
    turns = topic_turns(spark, d).withColumn("entity_values", values).withColumn(
        "topic_keys", F.transform("intents", lambda i: F.concat_ws(":", i["domain"], i["action"], label(i))))
    turns = turns.select("conv_id", "turn", "reset", "topic_keys", "entity_values")
    st.topic_state_stream(in_parts(spark, turns, f"{out}/turns"), f"{out}/state", f"{out}/checkpoint")
    rows = st.newest_view(spark, f"{out}/state", "conv_id")
    return rows.select("conv_id", "context_version", F.array_join("topics", "|").alias("topics"), F.array_join("confirmed", "|").alias("confirmed"))


@query("history_ttl", """WITH g AS (SELECT user_id, event_id, ts, event_type, ts > lag(ts) OVER w + INTERVAL 900 SECONDS AS silent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g),
 c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM n QUALIFY part = max(part) OVER (PARTITION BY user_id))
SELECT user_id AS conv_id, CAST(count(*) AS INT) AS kept, string_agg(event_type, '|' ORDER BY ts, event_id) AS messages FROM c WHERE back <= 100 GROUP BY user_id""")
def q_history_ttl(spark, d):
    out = scratch(spark, "history")
    events = table(spark, d, "events").select(
        F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("turn"), F.col("event_type").alias("text"))
    st.history_ttl(in_parts(spark, events, f"{out}/messages"), f"{out}/state", f"{out}/checkpoint")
    return st.newest_view(spark, f"{out}/state", "conv_id").select("conv_id", F.size("messages").alias("kept"), F.array_join("messages", "|").alias("messages"))


@query("incremental_index", f"WITH {WHOLE}, {PACK} SELECT kind, content FROM generic")
def q_incremental_index(spark, d):
    """Documents land as text files of about FILE_BYTES each, far below the reader's limit; chunks come from the stream."""
    out = scratch(spark, "landing")
    docs = table(spark, d, "documents").select(F.col("lang"), F.col("text").alias("value"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    docs.repartition(1 + size // FILE_BYTES, F.xxhash64("value")).write.partitionBy("lang").option("lineSep", "\n\n").text(f"{out}/files")
    st.incremental_index(spark, f"{out}/files", f"{out}/index", f"{out}/checkpoint")
    return st.indexed_chunks(spark, f"{out}/index").select("kind", "content")
