"""Relational operators over the knowledge tables: identity, versions, activity, visibility, quality rules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import dealt_join, first_per_key, last_per_key, small_side, split_rank, top_k
from ..functions.text import fold, strip
from ..session import durable

IDENTITY = ("owner", "title", "domain", "knowledge_type")


def assign_documents(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """REL-1: one active logical document per (owner, title, domain, knowledge type).

    The id of a new document is a hash of its identity, so no shuffle is needed to agree on it; ids of already known
    active documents (``existing``: identity columns, document_id, status) win.
    """
    key = F.sha2(F.concat_ws("\x1f", *[F.col(c) for c in IDENTITY]), 256)
    out = uploads.withColumn("document_id", key)
    if existing is None:
        return out
    known = first_per_key(
        existing.where(F.col("status") != "deleted").withColumn("_key", key), ["_key"], [F.col("document_id")],
        keep=["document_id"],
    ).withColumnRenamed("document_id", "_known")
    return (
        out.withColumnRenamed("document_id", "_key").join(known, "_key", "left")
        .withColumn("document_id", F.coalesce(F.col("_known").cast("string"), F.col("_key"))).drop("_key", "_known")
    )


def dedupe_versions(uploads: DataFrame, row_id: str = "upload_id", ts: str = "ts") -> DataFrame:
    """REL-2: the first arrival of a content hash inside a document is the version, later ones are duplicates.

    Winners come from a combining aggregate and are matched back on the unique row id, so a hash shared by a third
    of all uploads neither lands in one task nor skews a join.
    """
    winners = uploads.groupBy("document_id", "sha256").agg(
        F.min_by(F.col(row_id), F.struct(F.col(ts), F.col(row_id))).alias(row_id)
    )
    return uploads.join(winners.select(row_id, F.lit(True).alias("_first")), row_id, "left").withColumn(
        "deduplicated", F.col("_first").isNull()
    ).drop("_first")


def number_versions(
    versions: DataFrame, position: Column, tiebreak: list[Column], existing: DataFrame | None = None,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """REL-3: version_number continues from the highest number of the document, in arrival order."""
    numbered = split_rank(versions, ["document_id"], position, tiebreak, "version_number", hot_rows)
    if existing is None:
        return numbered
    top = existing.groupBy("document_id").agg(F.max("version_number").alias("_max"))
    return numbered.join(top, "document_id", "left").withColumn(
        "version_number", F.col("version_number") + F.coalesce(F.col("_max"), F.lit(0))
    ).drop("_max")


def _activity(indexes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """index x version x document rows that may be served."""
    docs = documents.where(F.col("document_status") == "active")
    vers = versions.where((F.col("version_status") == "ready") & F.col("is_current"))
    idx = indexes.where(F.col("index_status") == "active")
    return idx.join(vers, "version_id").join(docs, "document_id")


def active_children(chunks: DataFrame, versions: DataFrame, documents: DataFrame, indexes: DataFrame) -> DataFrame:
    """REL-4: servable child chunks. The three small dimensions join first; chunks meet them once, on version_id."""
    return chunks.where(F.col("kind") == "child").join(_activity(indexes, versions, documents), "version_id")


def _met_scopes(requests: DataFrame, served: DataFrame) -> DataFrame:
    """``requests`` once for every distinct scope list of its owner and domain that it may see, as ``access_scope``. Scope lists are
    held against each other, not rows."""
    asked = requests.select("owner", "domain", "allowed_scopes").distinct()
    kinds = served.select("owner", "domain", "access_scope").distinct()
    met = asked.join(kinds, ["owner", "domain"]).where(F.arrays_overlap("access_scope", "allowed_scopes"))
    return requests.join(small_side(met), ["owner", "domain", "allowed_scopes"])


def active_indexes(requests: DataFrame, versions: DataFrame, documents: DataFrame, indexes: DataFrame) -> DataFrame:
    """REL-5: per request the servable indexes of its owner and domain whose scopes meet the allowed ones.

    The pairs grow with the product of requests and indexes: only pairs of the result are made, dealt over tasks by their number.
    """
    served = durable(_activity(indexes, versions, documents))
    return dealt_join(_met_scopes(requests, served), served, ["owner", "domain", "access_scope"])


def validate_children(hits: DataFrame, facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REL-6: recalled (chunk, index) pairs re-checked against the fact tables (``active_children`` output).

    Returns the accepted hits and the discarded count per query.
    """
    fact = facts.select(
        F.col("chunk_id"), F.col("index_version_id"), F.col("document_id").alias("_doc"),
        F.col("version_id").alias("_ver"), F.col("parent_chunk_id"), F.col("owner").alias("_owner"),
        F.col("domain").alias("_domain"), F.col("access_scope").alias("_scope"),
    )
    asked = small_side(requests.select("query_id", "owner", "domain", "allowed_scopes"))
    checked = hits.join(asked, "query_id").join(fact, ["chunk_id", "index_version_id"], "left")
    ok = (
        (F.col("document_id") == F.col("_doc")) & (F.col("version_id") == F.col("_ver"))
        & (F.col("owner") == F.col("_owner")) & (F.col("domain") == F.col("_domain"))
        & F.arrays_overlap("_scope", "allowed_scopes") & F.col("parent_chunk_id").isNotNull()
    )
    flagged = checked.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    discarded = flagged.groupBy("query_id").agg(F.count_if(~F.col("accepted")).alias("discarded"))
    return flagged.where("accepted").select(*hits.columns, "parent_chunk_id"), discarded


def activate_versions(builds: DataFrame) -> DataFrame:
    """REL-7: newest complete build of a document is active and makes its version current; older complete ones are
    superseded; incomplete ones keep their status. The winner row is found by a combining aggregate."""
    complete = (F.col("indexed") == F.col("total")) & (F.col("status") != "failed")
    winners = builds.where(complete).groupBy("document_id").agg(
        F.max_by("build_id", F.struct("built_at", "build_id")).alias("build_id")
    )
    return (
        builds.join(winners.select("build_id", F.lit(True).alias("_win")), "build_id", "left")
        .withColumn("is_current", F.coalesce("_win", F.lit(False)))
        .withColumn(
            "index_status",
            F.when(F.col("_win"), "active").when(complete, "superseded").otherwise(F.col("status")),
        ).drop("_win")
    )


def backfill_current(versions: DataFrame, indexes: DataFrame) -> DataFrame:
    """REL-8: is_current = an active index of the version exists."""
    live = indexes.where(F.col("index_status") == "active").select("version_id").distinct()
    return versions.join(live.withColumn("_live", F.lit(True)), "version_id", "left").withColumn(
        "is_current", F.coalesce("_live", F.lit(False))
    ).drop("_live")


def build_key(sha: Column, provider: str, model: str, dimension: int, chunk_schema: str, collection: str) -> Column:
    parts = [F.lit(x) for x in (provider, model, str(dimension), chunk_schema, collection)]
    return F.sha2(F.concat_ws("|", sha, *parts), 256)


def plan_builds(versions: DataFrame, indexes: DataFrame, **config) -> DataFrame:
    """REL-9: (version, build key) pairs that no index covers yet."""
    wanted = versions.withColumn("build_key", build_key(F.col("sha256"), **config))
    return wanted.join(indexes.select("version_id", "build_key"), ["version_id", "build_key"], "left_anti")


def _fits(collection: str, model: str, dimension: int) -> Column:
    return (F.col("collection") == collection) & (F.col("model") == model) & (F.col("dimension") == dimension)


def split_compatible(targets: DataFrame, collection: str, model: str, dimension: int) -> DataFrame:
    """REL-10: per request the indexes usable by the vector channel and the count that is not (lexical mode: 0)."""
    fits = _fits(collection, model, dimension)
    return targets.groupBy("query_id", "mode").agg(
        F.count_if(fits | (F.col("mode") != "vector")).alias("compatible"),
        F.count_if(~fits & (F.col("mode") != "bm25")).alias("incompatible"),
    )


def split_active(requests: DataFrame, versions: DataFrame, documents: DataFrame, indexes: DataFrame, collection: str, model: str, dimension: int) -> DataFrame:
    """REL-10 over REL-5: ``split_compatible`` of ``active_indexes`` without its pairs. Indexes are counted by owner, domain and
    scope list, and requests meet the counts."""
    served = _activity(indexes, versions, documents)
    fits = _fits(collection, model, dimension)
    counts = durable(served.groupBy("owner", "domain", "access_scope").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(fits).alias("_fit"), F.count_if(~fits).alias("_not")))
    met = _met_scopes(requests, counts).join(small_side(counts), ["owner", "domain", "access_scope"])
    return met.groupBy("query_id", "mode").agg(
        F.sum(F.when(F.col("mode") != "vector", F.col("_all")).otherwise(F.col("_fit"))).alias("compatible"),
        F.sum(F.when(F.col("mode") != "bm25", F.col("_not")).otherwise(0)).alias("incompatible"))


def chunk_counts(versions: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """REL-11: block, chunk and child counts per version (0 when none)."""
    nb = blocks.groupBy("version_id").agg(F.count(F.lit(1)).alias("block_count"))
    nc = chunks.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if(F.col("kind") == "child").alias("child_count")
    )
    return versions.join(nb, "version_id", "left").join(nc, "version_id", "left").fillna(
        0, ["block_count", "chunk_count", "child_count"]
    )


def list_chunks(chunks: DataFrame, kind: str | None = None, n: int = 500) -> DataFrame:
    """REL-12: first n chunks of every version in ordinal order."""
    rows = chunks if kind is None else chunks.where(F.col("kind") == kind)
    return top_k(rows, ["version_id"], [F.col("ordinal")], n, "position")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """REL-13 / AUD-1: newest row per key."""
    return last_per_key(df, keys, order)


def ingestion_status(documents: DataFrame, versions: DataFrame, jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """REL-14: document x version x newest job x counts; a failed job fails its version and keeps its code."""
    last = latest_by(jobs, ["version_id"], [F.col("created_at"), F.col("job_id")])
    joined = versions.join(documents, "document_id").join(last, "version_id", "left").join(counts, "version_id", "left")
    failed = F.coalesce(F.col("job_status") == "failed", F.lit(False))
    return joined.withColumn(
        "version_status", F.when(failed, "failed").otherwise(F.col("version_status"))
    ).withColumn("error_code", F.when(failed, F.col("error_code"))).fillna(0, ["block_count", "chunk_count"])


def active_documents(documents: DataFrame) -> DataFrame:
    """REL-15: not deleted, per owner with the newest update first."""
    return documents.where(F.col("document_status") != "deleted").orderBy(
        F.col("owner"), F.col("updated_at").desc(), F.col("document_id")
    )


def check_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """REL-16: one scan that yields a (rule, key) row for every violated rule (a rule column is TRUE when broken)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def check_unique(df: DataFrame, rule: str, columns: list[str]) -> DataFrame:
    dup = df.groupBy(*columns).count().where("count > 1")
    return dup.select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key"))


def check_reference(df: DataFrame, rule: str, key: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    ids = target.select(F.col(target_key).alias(column)).distinct()
    lost = df.where(F.col(column).isNotNull()).join(ids, column, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def assign_batches(
    df: DataFrame, keys: list[str], position: Column, tiebreak: list[Column], size: int, hot_rows: int = 1_000_000
) -> DataFrame:
    """REL-17: keyset pages of a fixed size in position order."""
    ranked = split_rank(df, keys, position, tiebreak, "_page", hot_rows)
    return ranked.withColumn("batch", F.floor((F.col("_page") - 1) / size).cast("long")).drop("_page")


def user_upsert(users: DataFrame, seen: DataFrame) -> DataFrame:
    """REL-18: one row per external id; the last display name seen wins over the stored one."""
    stored = users.select("external_id", "display_name", F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("_new"))
    fresh = seen.select("external_id", "display_name", "ts", F.lit(1).alias("_new"))
    return stored.unionByName(fresh).groupBy("external_id").agg(
        F.max_by("display_name", F.struct("_new", "ts", "display_name")).alias("display_name"),
        F.max(1 - F.col("_new")).cast("boolean").alias("existed"),
    )


def owner_scope(df: DataFrame, requesters: DataFrame) -> DataFrame:
    """REL-19: (request, row) pairs a requester may see: same owner and the document still active. The pairs grow with the
    product of both sides, so they are dealt over tasks by their number."""
    rows = df.where(F.col("document_status") == "active")
    return dealt_join(requesters, rows, ["owner"])


def normalize_scopes(labels: Column, folded: bool = False) -> Column:
    """REL-20: strip, drop blanks, dedupe in order; an empty list means public."""
    clean = F.filter(F.transform(labels, lambda x: fold(strip(x)) if folded else strip(x)), lambda x: F.length(x) > 0)
    unique = F.array_distinct(clean)
    return F.when(F.size(unique) > 0, unique).otherwise(F.array(F.lit("public")))


def scope_violation(scopes: Column, max_length: int = 64, max_count: int = 32) -> Column:
    return F.exists(scopes, lambda x: F.length(x) > max_length) | (F.size(scopes) > max_count)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
