"""Approximate vector search by coarse cells and product-quantised codes.

Training reads a bounded hash sample and gives a codebook: unit centroids of cells, centroids of sub-vectors, and how many
cells a query must visit and how many candidates it must rescore so that the sample's own nearest neighbours are found. The
index has every vector with its cell and one byte per sub-vector. The sample knows neither the table's size nor the filters
of the queries, so ``widened`` raises both numbers until a bounded sample of the real queries loses no neighbour. A search visits the nearest cells of every query,
ranks their rows by codes alone (vectors are not read), and fetches vectors only for the best few per query, which the
exact cosine then ranks. Domain, scopes and whitelist are tested in the cell, before anything is ranked; a query that still
gets fewer than k hits is searched exactly.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import top_k
from ..session import durable
from .vectors import _best, _unit, allowed_pairs, cosine, vector_search

SUBVECTORS = 16
CENTROIDS = 256
MAX_CELLS = 1024
SAMPLE = 16_384
"""Rows the codebook is trained on, at most."""
TARGET = 0.998
"""Share of the sample's true neighbours that the chosen probes and the chosen number of rescored rows must each reach."""
ASKED, MARGIN = 256, 2
"""Queries that are also searched exactly, and by how much the rest gets more rescored rows than these need."""
ROWS_PER_TASK = 65_536


@dataclass(frozen=True)
class Codebook:
    cells: np.ndarray
    """(cells, dimension), unit length"""
    parts: np.ndarray
    """(sub-vectors, centroids, width of a sub-vector); the last sub-vector is filled up with zeros"""
    dim: int
    probes: int
    rescored: int

    def split(self, unit: np.ndarray) -> np.ndarray:
        m, _, width = self.parts.shape
        return np.pad(unit, ((0, 0), (0, m * width - unit.shape[1]))).reshape(len(unit), m, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit rows."""
        split = self.split(unit)
        codes = np.stack([_nearest(split[:, j], self.parts[j]) for j in range(len(self.parts))], axis=1)
        return np.argmax(unit @ self.cells.T, axis=1).astype(np.int32), codes.astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(queries, sub-vectors, centroids): inner products of a query's sub-vectors with the centroids."""
        return np.einsum("qmw,mcw->qmc", self.split(unit), self.parts)

    def visits(self, unit: np.ndarray, probes: int) -> np.ndarray:
        near = unit @ self.cells.T
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centroids.T - (centroids * centroids).sum(axis=1) / 2, axis=1)


def _centroids(rows: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Plain k-means; an empty cluster is put on a row that lies far from its centroid."""
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    if len(centres) < n:
        return np.concatenate([centres, np.zeros((n - len(centres), rows.shape[1]))])
    for _ in range(rounds):
        own = _nearest(rows, centres)
        count = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = count > 0
        centres[filled] = sums[filled] / count[filled, None]
        if (~filled).any():
            far = ((rows - centres[own]) ** 2).sum(axis=1)
            centres[~filled] = rows[np.argsort(-far)[:(~filled).sum()]]
    return centres


def code_scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate cosine of one query with every row of ``codes``."""
    return table[np.arange(len(table)), codes].sum(axis=1)


def train(vectors: DataFrame, k: int = 10, cells: int | None = None, subvectors: int = SUBVECTORS, sample: int = SAMPLE, seed: int = 7) -> Codebook | None:
    """A codebook from at most ``sample`` rows (those with the smallest hash of the id); None if there is no usable row."""
    rows = vectors.select("embedding").where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["embedding"]
    if rows.empty:
        return None
    size = rows.map(len).mode()[0]
    unit = _unit(list(rows[rows.map(len) == size]))
    unit = unit[~np.isnan(unit).any(axis=1)]
    if not len(unit) or not size:
        return None
    rng = np.random.default_rng(seed)
    n = cells or int(np.clip(np.sqrt(vectors.count()), 1, min(MAX_CELLS, max(1, len(unit) // 16))))
    centres = _centroids(unit, n, rng)
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)
    m = min(subvectors, size)
    width = -(-size // m)
    m = -(-size // width)
    padded = np.pad(unit, ((0, 0), (0, m * width - size))).reshape(len(unit), m, width)
    parts = np.stack([_centroids(padded[:, j], CENTROIDS, rng) for j in range(m)])
    return _calibrated(Codebook(centres, parts, int(size), n, len(unit)), unit, k)


def _calibrated(book: Codebook, unit: np.ndarray, k: int) -> Codebook:
    """Probes and rescored rows with which the sample's first rows find their own k nearest neighbours."""
    asked = unit[:256]
    cell, codes = book.encode(unit)
    exact = asked @ unit.T
    true = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    place = np.argsort(book.visits(asked, len(book.cells)), axis=1)  # of every cell in a query's order
    cell_rank = np.take_along_axis(place, cell[true], axis=1)
    near = np.stack([code_scores(t, codes) for t in book.tables(asked)])
    code_rank = np.take_along_axis(np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1), true, axis=1)
    probes = int(np.quantile(cell_rank, TARGET, method="higher")) + 1
    rescored = max(6 * k, int(np.quantile(code_rank, TARGET, method="higher")) + 1)
    return Codebook(book.cells, book.parts, book.dim, probes, rescored)


def build(vectors: DataFrame, book: Codebook) -> DataFrame:
    """The index: all columns of ``vectors`` with ``cell`` and ``code``, written by cell. Rows that can't have a cosine (null, zero or
    other dimension) are in no answer and not in the index."""
    kept = [f"{n} {t}" for n, t in vectors.dtypes]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["embedding"].map(lambda v: v is not None and len(v) == book.dim)]
            if batch.empty:
                continue
            unit = _unit(batch["embedding"])
            ok = ~np.isnan(unit).any(axis=1)
            batch, unit = batch[ok], unit[ok]
            if len(batch):
                cell, codes = book.encode(unit)
                yield batch.assign(cell=cell, code=[c.tobytes() for c in codes])

    coded = vectors.mapInPandas(encode, ", ".join([*kept, "cell int", "code binary"]))
    # A cell's rows go to a few files, so a hot cell (copies of one vector) is not written by one task.
    return durable(coded.repartition(F.col("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(4))), by=["cell"])


def candidates(index: DataFrame, book: Codebook, queries: DataFrame, rescored: int | None = None, probes: int | None = None,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``query_id, chunk_id, cell, near``: the rows of visited cells that rank first by codes, ``rescored`` per query.

    A task holds neighbouring cells of one domain up to about ``rows_per_task`` rows, with the queries that visit any of them, and hands on
    ``rescored`` rows per query at most. A cell with more rows of a domain is cut by hash of the id."""
    wanted, visited = rescored or book.rescored, min(probes or book.probes, len(book.cells))
    limits = [c for c in ("allowed_scopes", "index_version_ids") if c in queries.columns]
    marks = [c for c in ("access_scope", "index_version_id") if c in index.columns]
    asked = queries.select("query_id", "domain", "vector", *limits)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].map(lambda v: v is not None and len(v) == book.dim)]
            if len(batch):
                unit = _unit(batch["vector"])
                ok = ~np.isnan(unit).any(axis=1)
                batch, unit = batch[ok], unit[ok]
            if len(batch):
                yield batch.assign(vector=list(unit), visit=list(book.visits(unit, visited).astype(np.int32)))

    schema = ", ".join([*(f"{n} {t}" for n, t in asked.dtypes if n != "vector"), "vector array<double>", "visit array<int>"])
    visits = durable(asked.mapInPandas(visit, schema))
    before = F.sum("n").over(Window.partitionBy("domain").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # one row per cell
    sizes = durable(index.groupBy("domain", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "domain", "cell", F.floor(F.coalesce(before, F.lit(0)) / rows_per_task).alias("part"), F.ceil(F.col("n") / rows_per_task).cast("int").alias("pieces")))
    same = [F.col(c).alias(c) for c in sizes.columns]
    left = index.select("vec_id", "domain", "cell", "code", *marks).join(sizes, ["domain", "cell"]).withColumn(
        "piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    meets = visits.select("query_id", "domain", F.explode("visit").alias("cell")).join(sizes.select(*same), ["domain", "cell"]).groupBy(
        "query_id", "part").agg(F.max("pieces").alias("pieces"))  # empty cells go
    right = visits.join(meets, "query_id").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def rank(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "chunk_id": [], "cell": [], "near": []})]
        if len(rows) and len(ask):
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            ids, cells, allowed = rows["vec_id"].to_numpy(), rows["cell"].to_numpy(), allowed_pairs(rows, ask)
            for q, (query, unit, seen) in enumerate(zip(ask["query_id"].to_numpy(), ask["vector"], ask["visit"])):
                at = np.zeros(len(book.cells), bool)
                at[seen] = True
                at = at[cells] if allowed is None else at[cells] & allowed[:, q]
                at = np.flatnonzero(at)
                near = code_scores(book.tables(np.asarray(unit)[None])[0], codes[at])
                pick = _best(near, ids[at], wanted)
                parts.append(pd.DataFrame({"query_id": query, "chunk_id": ids[at[pick]], "cell": cells[at[pick]], "near": near[pick]}))
        return pd.concat(parts)

    kinds = dict(index.dtypes) | dict(queries.dtypes)
    keys = ["domain", "part", "piece"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        rank, f"query_id {kinds['query_id']}, chunk_id {kinds['vec_id']}, cell int, near double")
    return top_k(found, ["query_id"], [F.col("near").desc(), F.col("chunk_id")], wanted).drop("rank")


def search(index: DataFrame, book: Codebook, queries: DataFrame, k: int = 10, rescored: int | None = None, probes: int | None = None,
           whole: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by exact cosine among the candidates; queries with fewer than k hits are searched exactly
    in ``whole`` (the index, unless the table behind it holds vectors of other lengths too)."""
    few = durable(candidates(index, book, queries, rescored, probes))
    pairs = few.join(index.select("cell", F.col("vec_id").alias("chunk_id"), "embedding"), ["cell", "chunk_id"]).join(
        queries.select("query_id", "vector"), "query_id")
    scored = pairs.select("query_id", "chunk_id", F.round(cosine(F.col("vector"), F.col("embedding")), 9).alias("score")).where("score is not null")
    near = durable(top_k(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k))
    filled = near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    rest = vector_search(index if whole is None else whole, queries.join(filled, "query_id", "left_anti"), k)
    return near.join(filled, "query_id", "left_semi").unionByName(rest.select(*near.columns))


def widened(index: DataFrame, book: Codebook, queries: DataFrame, k: int = 10, asked: int = ASKED) -> Codebook:
    """The codebook with the probes and rescored rows by which ``asked`` queries (smallest hash of the id) find all of their exact
    neighbours in the whole index under their own filters, and a margin for the other queries."""
    some = durable(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(asked))
    true = durable(vector_search(index, some, k).select("query_id", "chunk_id").join(
        index.select(F.col("vec_id").alias("chunk_id"), "cell"), "chunk_id").join(some.select("query_id", "vector"), "query_id"))
    found = true.groupBy("query_id").agg(F.first("vector").alias("vector"), F.collect_set("cell").alias("cells")).toPandas()  # k cells of ``asked`` queries
    if found.empty:
        return book
    place = np.argsort(book.visits(_unit(found["vector"]), len(book.cells)), axis=1)
    deepest = 1 + max(int(p[list(c)].max()) for p, c in zip(place, found["cells"]))
    probes = min(len(book.cells), max(book.probes, deepest + -(-deepest // 8)))
    rows, rescored = index.count(), book.rescored
    while rescored < rows and true.join(candidates(index, book, some, rescored, probes), ["query_id", "chunk_id"], "left_anti").limit(1).count():
        rescored *= 2
    return replace(book, probes=probes, rescored=MARGIN * rescored)


def approximate_search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """VEC-5: train, build, widen and search in one go. A table that is searched again keeps its widened codebook and index."""
    book = train(vectors, k)
    if book is None:
        return vector_search(vectors, queries, k)
    index = build(vectors, book)
    return search(index, widened(index, book, queries, k), queries, k, whole=vectors)
