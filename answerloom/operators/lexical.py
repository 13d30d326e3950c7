"""BM25 over whole corpora for whole query sets."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import BROADCAST_ROWS, fits_broadcast, top_k
from ..functions.text import fold, strip
from ..functions.tokens import bigram_tokenizer
from ..session import durable
from . import lexical_index
from .lexical_index import SET, B, K1, LexicalIndex, gain


def _with_set(df: DataFrame) -> DataFrame:
    return df if SET in df.columns else df.withColumn(SET, F.lit(0))


def bm25_index(chunks: DataFrame, tokenizer: Callable[[Column], Column] | None = None, field: str = "text",
               stored: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """LEX-1: (documents with their tokens and length, corpus statistics per target set).

    Chunks stay one row each, with the columns ``keep``; postings are made by the search from the query vocabulary only.
    ``stored`` writes the token table once, so that statistics and searches do not tokenize the corpus again. For a corpus that is
    searched by top k, ``lexical_index.build`` stores postings with block maxima.
    """
    tokenize = tokenizer or bigram_tokenizer()
    docs = _with_set(chunks).select(SET, "chunk_id", *keep, tokenize(F.col(field)).alias("tokens")).withColumn("length", F.size("tokens"))
    docs = durable(docs) if stored else docs
    stats = docs.groupBy(SET).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    return docs, stats


def postings(docs: DataFrame) -> DataFrame:
    """Term frequency per chunk and document frequency per term of the whole corpus."""
    return docs.select(SET, "chunk_id", "length", F.explode("tokens").alias("term")).groupBy(SET, "chunk_id", "length", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def counted_postings(chunks: DataFrame, tokenizer: Callable[[Column], Column] | None = None, field: str = "text", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``chunk_id, term, tf, length, df`` of every posting of one target set.

    Postings are made inside the tasks that read the texts and written by blocks, so texts are tokenized once and term frequencies need no
    exchange. Terms of many blocks, at most ``max_rows`` of them, meet their document frequency by a broadcast; only what is left,
    blocks of rare terms, is shuffled. Chunks that repeat an id are one chunk if they are of one length, which takes an exchange of all postings.
    """
    if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
        tf = postings(bm25_index(chunks, tokenizer, field)[0])
        return tf.join(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("chunk_id", "term", "tf", "length", "df")
    held = lexical_index.build(chunks, tokenizer, field, lexical_index.TOGETHER).postings
    df = durable(held.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("_blocks")))
    level = F.floor(F.log2("_blocks"))
    cut, room = 0, max_rows
    for at, many in sorted(df.groupBy(level).count().collect(), reverse=True):
        room -= many
        if room < 0:
            cut = at + 1
            break
    common, rare = df.where(level >= cut).drop("_blocks"), df.where(level < cut).drop("_blocks")
    seldom = held.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term")
    met = held.join(F.broadcast(common), "term").select("term", "rows", "df").unionByName(seldom.select("term", "rows", "df"))
    return met.select("term", "df", F.explode("rows").alias("r")).select("r.chunk_id", "term", F.col("r.tf").cast("long").alias("tf"), "r.length", "df")


TOKENS_PER_TASK, PAIRS_PER_TASK, MOST_TASKS = 500_000, 2_000_000, 20_000
"""What one task of ``bm25_scores`` counts and scores in memory; tasks are set by it, since shuffled bytes say little of either."""


def bm25_scores(docs: DataFrame, stats: DataFrame, queries: DataFrame, tokenizer=None, k1: float = K1, b: float = B,
                keep: tuple[str, ...] = (), ask: tuple[str, ...] = (), may: Column | None = None) -> DataFrame:
    """Score of every (query, chunk) pair that shares a term and meets ``may``, a condition on the columns ``keep`` of the
    documents and ``ask`` of the queries. Statistics are those of all documents.

    Only tokens of the query vocabulary survive the scan. They are distributed by chunk, so term frequencies, pair
    scores and the first top-k cut need no further exchange, and a common term is spread over its chunks. Tasks grow with the
    tokens and with the pairs there can be, so what one task holds does not. The query
    side is broadcast when its measured size allows; otherwise the join shuffles on the term and AQE splits hot terms.
    """
    tokenize = tokenizer or bigram_tokenizer()
    size = stats.agg(F.coalesce(F.sum(F.col("n") * F.col("avg_length")), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tasks = min(MOST_TASKS, 1 + int(max(size["tokens"] / TOKENS_PER_TASK, size["n"] * queries.count() / PAIRS_PER_TASK)))
    terms = _with_set(queries).select(SET, "query_id", *ask, F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    small = fits_broadcast(terms)
    send = F.broadcast if small else (lambda df: df)
    vocabulary = terms.select(SET, "term").distinct()
    tf = (
        docs.select(SET, "chunk_id", *keep, "length", F.explode("tokens").alias("term"))
        .join(send(vocabulary), [SET, "term"], "left_semi").repartition(tasks, F.col("chunk_id"))
        .groupBy(SET, "chunk_id", *keep, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy(SET, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(send(df), [SET, "term"]).join(send(stats), SET).select(
        SET, "query_id", *ask, "term", idf.alias("idf"), "avg_length")
    one = F.col("idf") * gain(F.col("tf"), F.col("length"), F.col("avg_length"), k1, b)
    pairs = tf.join(send(weighted), [SET, "term"])
    return (
        (pairs if may is None else pairs.where(may)).groupBy("query_id", "chunk_id").agg(F.sum(one).alias("score"))
        .where("score > 0").withColumn("score", F.round("score", 9))
    )


def bm25_search(chunks: DataFrame | LexicalIndex, queries: DataFrame, k: int = 20, tokenizer=None, field: str = "text",
                targets: DataFrame | None = None) -> DataFrame:
    """LEX-2: exact top k per query, from a stored index or from chunks that are indexed first.

    LEX-3 with ``targets`` (target_set, version_id): ``queries`` carries ``target_set``, and N, average length and df are those of the set's versions.
    """
    index = chunks if isinstance(chunks, LexicalIndex) else lexical_index.build(chunks, tokenizer, field)
    return lexical_index.search(index, queries, k, tokenizer, targets, best=k)[0]


def _phrase(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def fielded_search(index: DataFrame, queries: DataFrame, k: int = 20, tokenizer=None, boosts: tuple[float, ...] = (2.5, 4.0, 2.0, 6.0)) -> DataFrame:
    """LEX-4: max(title boost * title, content) + phrase boosts + a boost when a domain term is shared.

    ``index``: chunk_id, title, content, owner, domain, access_scope, active, domain_terms. A phrase is a run of
    consecutive tokens. Field scores use the statistics of the active index; owner, domain and scopes hold inside every join
    that makes pairs.
    """
    title_boost, title_phrase, body_phrase, term_boost = boosts
    tokenize = tokenizer or bigram_tokenizer()
    live = index.where("active")
    asked = queries.withColumn("_phrase", _phrase(tokenize(F.col("query"))))

    own, wish = ("owner", "domain", "access_scope"), ("_o", "_d", "allowed_scopes")
    can = (F.col("owner") == F.col("_o")) & (F.col("domain") == F.col("_d")) & F.arrays_overlap("access_scope", "allowed_scopes")
    known = queries.withColumns({"_o": F.col("owner"), "_d": F.col("domain")}).drop("owner", "domain")

    def field(name: str) -> DataFrame:
        docs, stats = bm25_index(live, tokenize, name, stored=True, keep=own)
        return bm25_scores(docs, stats, known, tokenize, keep=own, ask=wish, may=can)

    shared = live.select("chunk_id", *own, F.explode("domain_terms").alias("_t")).withColumn("_t", fold("_t"))
    wanted = known.select("query_id", *wish, F.explode("domain_terms").alias("_t")).withColumn("_t", fold("_t")).distinct()
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    zero = F.lit(0.0)
    parts = [
        field("title").select("query_id", "chunk_id", F.col("score").alias("t"), zero.alias("c"), zero.alias("d")),
        field("content").select("query_id", "chunk_id", zero.alias("t"), F.col("score").alias("c"), zero.alias("d")),
        shared.join(wanted, (shared["_t"] == wanted["_t"]) & can).select("query_id", "chunk_id", zero.alias("t"), zero.alias("c"), F.lit(term_boost).alias("d")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "chunk_id").agg(
        F.max("t").alias("t"), F.max("c").alias("c"), F.max("d").alias("d"))
    facts = live.select("chunk_id", _phrase(tokenize(F.col("title"))).alias("_tp"),
                        _phrase(tokenize(F.col("content"))).alias("_cp"))
    side = asked.select("query_id", "_phrase")
    side = F.broadcast(side) if fits_broadcast(side) else side
    has = F.length(strip("_phrase")) > 0
    score = (
        F.greatest(F.col("t") * title_boost, F.col("c")) + F.col("d")
        + F.when(has & F.contains("_tp", F.col("_phrase")), title_phrase).otherwise(0.0)
        + F.when(has & F.contains("_cp", F.col("_phrase")), body_phrase).otherwise(0.0)
    )
    scored = merged.join(side, "query_id").join(facts, "chunk_id").select(
        "query_id", "chunk_id", F.round(score, 9).alias("score")).where("score > 0")
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def generation_key(indexes: DataFrame, dictionary_hash: str, schema_tag: str = "lexical-v1") -> DataFrame:
    """LEX-5: key of the snapshot: schema tag, sorted index ids, dictionary hash. The ids of an owner are
    gathered into one row, as the digest's definition runs over all of them in order: the row grows with an owner's active indexes."""
    return indexes.groupBy("owner").agg(F.array_sort(F.collect_set("index_version_id")).alias("_ids")).select(
        "owner", F.sha2(F.concat_ws("|", F.lit(schema_tag), F.array_join("_ids", "|"), F.lit(dictionary_hash)), 256).alias("generation"))
