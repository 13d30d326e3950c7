"""Embeddings: hashing, checks, exact and approximate search."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import fits_broadcast, top_k
from ..functions.tokens import tokenize_unigram


TOGETHER = 1024
"""Texts whose features are counted together."""


def _digests(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (first 8 bytes of the SHA-256, unsigned, modulo dim) and sign (lowest bit of the ninth byte) of every word."""
    raw = np.frombuffer(b"".join([sha256(w.encode()).digest() for w in words]), np.uint8).reshape(-1, 32)
    head = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64)
    return (head % np.uint64(dim)).astype(np.int64), np.where(raw[:, 8] & 1, 1.0, -1.0)


def _hashed(texts: pa.Array, tokens: pa.Array, dim: int) -> np.ndarray:
    """(texts, dim): unit vectors. Every distinct feature is hashed once."""
    n = len(texts)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten()
    row = np.repeat(np.arange(n), sizes)
    inside = pa.array(row[1:] == row[:-1], pa.bool_())
    pairs = pc.binary_join_element_wise(words[:-1], words[1:], "").filter(inside) if len(words) > 1 else words.slice(0, 0)
    coded = pa.concat_arrays([words, pairs]).dictionary_encode()
    bucket, sign = _digests(coded.dictionary.to_pylist(), dim)
    code = coded.indices.to_numpy()
    row = np.concatenate([row, row[1:][inside.to_numpy(zero_copy_only=False)]])
    cells = np.bincount(row * dim + bucket[code], sign[code], n * dim).reshape(n, dim)
    norm = np.sqrt((cells * cells).sum(1))
    lone = np.flatnonzero((norm == 0) & texts.is_valid().to_numpy(zero_copy_only=False))
    cells[lone, _digests(texts.take(pa.array(lone)).to_pylist(), dim)[0]] = 1.0
    return cells / np.where(norm > 0, norm, 1.0)[:, None]


def hash_embed(df: DataFrame, text: str = "text", dim: int = 128) -> DataFrame:
    """VEC-1: signed feature hashing of unigrams and adjacent pairs, L2-normalised; a text whose cells are all zero has its own bucket.

    Row-local: features are counted in Arrow batches, so neither they nor the texts are shuffled. A null text has a vector of zeros.
    """
    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        parts = [_hashed(texts.slice(at, TOGETHER), tokens.slice(at, TOGETHER), dim).ravel() for at in range(0, len(texts), TOGETHER)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(np.concatenate([np.empty(0), *parts])))

    return df.withColumn("vector", embed(F.col(text), tokenize_unigram(F.col(text))))


def check_vectors(df: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding", texts: DataFrame | None = None) -> DataFrame:
    """VEC-2: (key, problem) rows: wrong dimension, non-finite value, and texts without exactly one vector."""
    v = F.col(vector)
    bad_value = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull() | (F.size(v) != dim), "dimension").when(bad_value, "not_finite")
    rows = df.select(F.col(key).cast("string").alias("key"), problem.alias("problem")).where("problem is not null")
    if texts is None:
        return rows
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    wrong = texts.select(key).join(per, key, "left").where(F.coalesce("_n", F.lit(0)) != 1)
    return rows.unionByName(wrong.select(F.col(key).cast("string").alias("key"), F.lit("vector_count").alias("problem")))


def cosine(a: Column, b: Column) -> Column:
    """VEC-3: NULL when the sizes differ or a side is zero."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(
        total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm)


BLOCK_BYTES = 64 << 20


def _hits(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['vec_id']}, score double"


def _unit(rows) -> np.ndarray:
    m = np.asarray(np.stack(rows), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (-score, id); NaN never ranks."""
    ok = np.flatnonzero(~np.isnan(scores))
    if len(ok) > k:
        cut = -np.partition(-scores[ok], k - 1)[k - 1]
        ok = ok[scores[ok] >= cut]
    names = ids[ok].astype(str) if ids.dtype == object else ids[ok]
    return ok[np.lexsort((names, -scores[ok]))[:k]]


def _block_hits(vec: pd.DataFrame, ask: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact top-k of one block of vectors for one block of queries, in steps whose scores fit BLOCK_BYTES."""
    step = max(1, BLOCK_BYTES // (8 * max(1, len(vec))))
    alike = [one for _, one in ask.groupby(ask["vector"].map(len))]  # queries of one length at a time
    return pd.concat([_step_hits(vec, one.iloc[at:at + step], k) for one in alike for at in range(0, len(one), step)])


def allowed_pairs(vec: pd.DataFrame, ask: pd.DataFrame) -> np.ndarray | None:
    """(vectors, queries): whether scopes and whitelist let the query see the vector; None where neither is given."""
    allowed = None
    if "access_scope" in vec.columns and "allowed_scopes" in ask.columns:
        labels = {s: i for i, s in enumerate(sorted({s for row in ask["allowed_scopes"] for s in row}))}

        def bits(rows) -> np.ndarray:
            out = np.zeros((len(rows), max(1, len(labels))), dtype=np.float32)
            for r, row in enumerate(rows):
                for s in row:
                    if s in labels:
                        out[r, labels[s]] = 1
            return out

        allowed = (bits(vec["access_scope"]) @ bits(ask["allowed_scopes"]).T) > 0
    if "index_version_id" in vec.columns and "index_version_ids" in ask.columns:
        index = vec["index_version_id"].to_numpy()
        listed = np.stack([np.isin(index, np.asarray(one)) for one in ask["index_version_ids"]], axis=1)
        allowed = listed if allowed is None else allowed & listed
    return allowed


def _step_hits(vec: pd.DataFrame, ask: pd.DataFrame, k: int) -> pd.DataFrame:
    """A matrix product, never a list of pairs."""
    width = len(ask["vector"].iloc[0])
    vec = vec[vec["embedding"].map(lambda v: v is not None and len(v) == width)]
    if vec.empty:
        return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    ids = vec["vec_id"].to_numpy()
    scores = np.round(_unit(vec["embedding"]) @ _unit(ask["vector"]).T, 9)
    allowed = allowed_pairs(vec, ask)
    if allowed is not None:
        scores[~allowed] = np.nan
    parts = []
    for q, query in enumerate(ask["query_id"].to_numpy()):
        pick = _best(scores[:, q], ids, k)
        parts.append(pd.DataFrame({"query_id": query, "chunk_id": ids[pick], "score": scores[pick, q]}))
    return pd.concat(parts)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 20, rows_per_shard: int = 200_000, max_query_rows: int = 4096) -> DataFrame:
    """VEC-4: exact cosine top-k per query among the vectors of its domain that its scopes and whitelist allow.

    ``vectors``: vec_id, embedding, domain [, access_scope, index_version_id];
    ``queries``: query_id, vector, domain [, allowed_scopes, index_version_ids].
    A query set that fits goes to every task once; each Arrow batch becomes a matrix product and hands on k rows per
    query. A larger set meets hashed shards of the vectors, so neither side, nor one hot domain, sits in one task.
    """
    hits = _hits(vectors, queries)
    if fits_broadcast(queries, max_query_rows):
        asked = queries.toPandas()
        if asked.empty:
            return vectors.sparkSession.createDataFrame([], hits + ", rank int")
        by_domain = vectors.sparkSession.sparkContext.broadcast({d: g.reset_index(drop=True) for d, g in asked.groupby("domain")})

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for domain, rows in batch.groupby("domain"):
                    ask = by_domain.value.get(domain)
                    if ask is not None:
                        yield _block_hits(rows, ask, k)

        near = vectors.join(F.broadcast(queries.select("domain").distinct()), "domain", "left_semi").mapInPandas(scan, hits)
    else:
        largest = vectors.groupBy("domain").count().agg(F.max("count")).first()[0] or 0
        shards = max(1, -(-largest // rows_per_shard))
        blocks = max(1, -(-queries.count() // max_query_rows))
        left = vectors.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
            "_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
            return _block_hits(a, b, k)

        keys = ["domain", "_shard", "_block"]
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, hits)
    return top_k(near, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def vector_search_lsh(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """VEC-5: the approximate variant, by cells and codes (``vector_index``). Domain, scopes and whitelist hold as in the exact
    search, scores are exact, and no answer comes back short."""
    from .vector_index import approximate_search

    return approximate_search(vectors, queries, k)


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found, per query."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def build_vectors(children: DataFrame, plan: DataFrame, dim: int = 128, embed=None) -> tuple[DataFrame, DataFrame]:
    """VEC-6: vectors of the children of planned builds, and per build whether every child has one (activation gate).

    ``embed`` may be any DataFrame -> DataFrame step adding ``vector`` (for instance an iterator pandas UDF).
    """
    todo = children.join(plan.select("version_id", "build_key"), "version_id")
    vectors = (embed or (lambda df: hash_embed(df, "content", dim)))(todo)
    total = todo.groupBy("version_id", "build_key").agg(F.count(F.lit(1)).alias("total"))
    done = vectors.groupBy("version_id").agg(F.count_if(F.size("vector") == dim).alias("indexed"))
    gate = total.join(done, "version_id", "left").fillna(0, ["indexed"]).withColumn(
        "complete", F.col("indexed") == F.col("total"))
    return vectors, gate
