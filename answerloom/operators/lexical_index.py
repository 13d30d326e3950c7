"""A stored inverted index with block maxima, and exact BM25 top-k that skips blocks.

A block is a handful of chunks of about the same length. The index has one row per term and block: the block's postings and
their largest term frequency and smallest length. A search first adds up what every block can reach at most for a query,
scores the most promising blocks, and then only blocks whose bound is not below the k-th best score so far; what is skipped
can't be in the answer, so the rows are those of an exhaustive search. For few queries both steps run in the tasks that read the index.

Statistics are additive over versions (chunks, lengths, document frequencies), so any set of versions a query may search gets its own
N, average length and df from the same index; sets may overlap and no text or posting is repeated for them.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.scale import fits_broadcast, small_side, top_k
from ..functions.tokens import bigram_tokenizer
from ..session import durable

K1, B = 1.2, 0.75
SET = "target_set"
BLOCK = 8
"""Chunks in a block, on average."""
TOGETHER = 1024
"""Chunks whose postings are handed on together; a multiple of BLOCK."""
SLACK = 1e-7
"""Above the rounding of scores, so a tie with the k-th best is never skipped."""


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame
    """term, block, n, max_tf, min_length, rows (chunk_id, version_id, tf, length); written"""
    versions: DataFrame
    """version_id, n, measured, total; written"""


def gain(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def _blocks(batches: Iterator[pa.RecordBatch], block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Postings of every ``block`` rows in turn, and one row without a term that lists the block's chunks.

    Tokens become codes once; one sort by (block, term, row) gives term frequencies and the postings in order."""
    number = TaskContext.get().partitionId() << 32
    kind = schema.field("rows").type

    def rows_of(part: pa.RecordBatch, row: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> pa.Array:
        take = pa.array(row, pa.int32())
        structs = pa.StructArray.from_arrays(
            [part.column(0).take(take), part.column(1).take(take), pa.array(tf, pa.int32()), part.column(3).take(take)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), structs).cast(kind)

    def batch_of(terms: pa.Array, blocks: np.ndarray, starts: np.ndarray, most: np.ndarray, least: np.ndarray, rows: pa.Array, total: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            terms, pa.array(blocks, pa.int64()), pa.array(np.diff(starts, append=total), pa.int64()), pa.array(most, pa.int32()), pa.array(least, pa.int32()), rows], schema=schema)

    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            n = part.num_rows
            own = np.arange(0, n, block)
            yield batch_of(pa.nulls(len(own), pa.string()), number + np.arange(len(own)), own, 0 * own, 0 * own, rows_of(part, np.arange(n), np.zeros(n, int), own), n)
            lengths = part.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
            coded = part.column(2).flatten().dictionary_encode()
            if len(coded):
                row, many = np.repeat(np.arange(n), sizes), len(coded.dictionary)
                key = np.sort(((row // block) * many + coded.indices.to_numpy()) * block + row % block)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                key, tf = key[first], np.diff(first, append=len(key))
                group, row = key // block, key // block // many * block + key % block
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                terms = coded.dictionary.take(pa.array(group[starts] % many))
                yield batch_of(terms.cast(pa.string()), number + group[starts] // many, starts, np.maximum.reduceat(tf, starts),
                               np.minimum.reduceat(lengths[row], starts), rows_of(part, row, tf, starts), len(row))
            number += len(own)


def build(chunks: DataFrame, tokenizer: Callable[[Column], Column] | None = None, field: str = "text", block: int = BLOCK) -> LexicalIndex:
    """LEX-1, stored: ``chunks`` has chunk_id, the text, and version_id if sets of versions will be searched.

    Nothing is shuffled: a task sorts its chunks by length and turns every ``block`` of them into postings, so a common term is
    spread over all tasks. Texts are tokenized once."""
    tokenize = tokenizer or bigram_tokenizer()
    version = F.col("version_id") if "version_id" in chunks.columns else F.lit(0)
    docs = chunks.select("chunk_id", version.alias("version_id"), tokenize(F.col(field)).alias("tokens")).withColumn("length", F.size("tokens"))
    kinds = dict(docs.dtypes)
    given = chunks.sparkSession.createDataFrame([], f"term string, block long, n long, max_tf int, min_length int, rows array<struct<chunk_id: {kinds['chunk_id']}, version_id: {kinds['version_id']}, tf: int, length: int>>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, block, to_arrow_schema(given))

    table = durable(docs.sortWithinPartitions("length").mapInArrow(run, given))
    listed = table.where("term is null").select(F.explode("rows").alias("r")).groupBy(F.col("r.version_id").alias("version_id"))
    versions = listed.agg(F.count(F.lit(1)).alias("n"), F.count("r.length").alias("measured"), F.sum("r.length").alias("total"))
    return LexicalIndex(table.where("term is not null"), durable(versions))


def weights(index: LexicalIndex, queries: DataFrame, tokenizer: Callable[[Column], Column] | None = None, members: DataFrame | None = None) -> DataFrame:
    """``query_id, target_set, term, idf, avg_length`` of every query term that the searched versions have."""
    tokenize = tokenizer or bigram_tokenizer()
    asked = queries if members is not None else queries.withColumn(SET, F.lit(0))
    terms = durable(asked.select(SET, "query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term")))
    known = index.postings.join(small_side(terms.select("term").distinct()), "term", "left_semi")
    if members is None:
        df = known.groupBy("term").agg(F.sum("n").alias("df")).withColumn(SET, F.lit(0))
        counted = index.versions.withColumn(SET, F.lit(0))
    else:
        member = members.select(SET, "version_id").distinct()
        held = known.select("term", F.explode("rows.version_id").alias("version_id")).groupBy("term", "version_id").agg(F.count(F.lit(1)).alias("df"))
        df = held.join(member, "version_id").join(terms.select(SET, "term").distinct(), [SET, "term"], "left_semi").groupBy(SET, "term").agg(F.sum("df").alias("df"))
        counted = index.versions.join(member, "version_id")
    stats = counted.groupBy(SET).agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("measured")).alias("avg_length"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return durable(terms.join(df, [SET, "term"]).join(stats, SET).select("query_id", SET, "term", idf.alias("idf"), "avg_length"))


def bounds(index: LexicalIndex, weighted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, block, bound``: what no chunk of the block can exceed. Reads block maxima only, not postings."""
    most = F.col("idf") * gain(F.col("max_tf"), F.col("min_length"), F.col("avg_length"), k1, b)
    heads = index.postings.select("term", "block", "max_tf", "min_length")
    return durable(heads.join(small_side(weighted), "term").groupBy("query_id", "block").agg(F.sum(most).alias("bound")))


FEW_QUERIES = 4096
"""Query sets up to this size go to every task; larger ones meet postings by a join on terms."""
GROUP = 7
"""Postings of 2 ** GROUP blocks in a row are scored together."""
STEP = 1 << 21
"""(Query, posting) pairs that are numbers at once."""
CELLS = 1 << 22
"""(Query, chunk) sums that are kept at once."""


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges in turn whose sizes add up to about STEP."""
    upto = np.cumsum(sizes)
    cuts = np.searchsorted(upto, np.arange(STEP, upto[-1], STEP)) + 1 if len(upto) else []
    ends = np.unique([0, *cuts, len(sizes)])
    return zip(ends[:-1].tolist(), ends[1:].tolist())


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every range its number and its positions, one after the other."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


@dataclass(frozen=True)
class _Asked:
    """Weights of all queries, sorted by term. A query and its set have a number."""
    terms: pd.Index
    starts: np.ndarray
    sizes: np.ndarray
    ids: pd.Index
    number: np.ndarray
    own: np.ndarray
    idf: np.ndarray
    average: np.ndarray
    names: pd.DataFrame


def _asked(weighted: DataFrame) -> _Asked:
    rows = weighted.toPandas().sort_values("term", kind="stable")
    own, ids = pd.factorize(rows["query_id"])
    number = rows.groupby(["query_id", SET], sort=False).ngroup()
    names = rows.assign(number=number).drop_duplicates("number").sort_values("number")[["query_id", SET]]
    terms, starts, sizes = np.unique(rows["term"].to_numpy(object), return_index=True, return_counts=True)
    return _Asked(pd.Index(terms, dtype=object), starts, sizes, pd.Index(ids), number.to_numpy(), own, rows["idf"].to_numpy(float), rows["avg_length"].to_numpy(float), names)


def _visible(postings: pa.Table, wanted: pa.Table, asked: _Asked) -> tuple[np.ndarray, np.ndarray]:
    """The number of every posting's block, and which blocks a query wants."""
    blocks, block = np.unique(postings.column("block").to_numpy(), return_inverse=True)
    at = pd.Index(blocks).get_indexer(wanted.column("block").to_numpy())
    visible = np.zeros((len(blocks), len(asked.ids)), bool)
    visible[at[at >= 0], asked.ids.get_indexer(wanted.column("query_id").to_pandas())[at >= 0]] = True  # every query here has weights
    return block, visible


def _group_scores(postings: pa.Table, block: np.ndarray, visible: np.ndarray, asked: _Asked, k1: float, b: float, best: int | None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query numbers, postings of their chunks, scores) of a group of blocks.

    Terms, chunks and queries are numbers here, and sums are cells of a matrix. With ``best``, chunks that can't be among a query's first
    ``best`` of the group are left out."""
    rows = pa.concat_arrays([c.flatten() for c in postings.column("rows").chunks])
    sizes = pc.list_value_length(postings.column("rows")).to_numpy()
    code = lambda c: pc.dictionary_encode(rows.field(c), null_encoding="encode").indices.to_numpy()
    _, sample, chunk = np.unique(code("chunk_id").astype(np.int64) * len(rows) + code("version_id"), return_index=True, return_inverse=True)
    tf, length = (rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "length"))
    term = asked.terms.get_indexer(postings.column("term").to_pandas())  # and every posting a term of a query
    first, wide = np.cumsum(sizes) - sizes, max(1, CELLS // len(sample))
    parts = []
    for least in range(0, len(asked.names), wide):  # one turn, unless blocks are large
        score = np.zeros(min(wide, len(asked.names) - least) * len(sample))
        for low, high in _cut(asked.sizes[term]):
            head, w = _pairs(asked.starts[term[low:high]], asked.sizes[term[low:high]])
            head += low
            seen = visible[block[head], asked.own[w]] & (asked.number[w] >= least) & (asked.number[w] < least + wide)
            head, w = head[seen], w[seen]
            for start, end in _cut(sizes[head]):
                of, posting = _pairs(first[head[start:end]], sizes[head[start:end]])
                x = w[start:end][of]
                one = asked.idf[x] * (tf[posting] * (k1 + 1) / (tf[posting] + k1 * (1 - b + b * length[posting] / asked.average[x])))
                score += np.bincount((asked.number[x] - least) * len(sample) + chunk[posting], one, len(score))
        score = score.reshape(-1, len(sample))
        keep = score > 0
        if best is not None and len(sample) > best:
            keep &= score >= np.partition(score, len(sample) - best, axis=1)[:, [len(sample) - best]] - SLACK
        number, c = np.nonzero(keep)
        parts.append((number + least, sample[c], score[number, c]))
    number, posting, score = (np.concatenate(c) for c in zip(*parts))
    return number, rows.take(pa.array(posting)), score


def _score_type(known: DataFrame, weighted: DataFrame) -> StructType:
    row = known.schema["rows"].dataType.elementType
    return StructType([weighted.schema["query_id"], weighted.schema[SET], row["chunk_id"], row["version_id"], StructField("score", DoubleType())])


def _score_rows(number: np.ndarray, chosen: pa.Array, score: np.ndarray, asked: _Asked, schema: pa.Schema) -> pa.Table:
    columns = [pa.array(asked.names[c].to_numpy(), schema.field(c).type).take(pa.array(number)) for c in ("query_id", SET)]
    columns += [chosen.field(c).cast(schema.field(c).type) for c in ("chunk_id", "version_id")]
    return pa.Table.from_arrays([*columns, pa.array(score)], schema=schema)


def _scored_in_groups(known: DataFrame, blocks: DataFrame, weighted: DataFrame, k1: float, b: float, best: int | None) -> DataFrame:
    """``query_id, target_set, chunk_id, version_id, score``: postings are shuffled once by group of blocks; no pair of them and a query becomes a row."""
    given = _score_type(known, weighted)
    shared = known.sparkSession.sparkContext.broadcast(_asked(weighted))

    def run(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = to_arrow_schema(given)
        if not postings.num_rows or not wanted.num_rows:
            return schema.empty_table()
        scores = _group_scores(postings, *_visible(postings, wanted, shared.value), shared.value, k1, b, best)
        return _score_rows(*scores, shared.value, schema)

    group = lambda df: df.withColumn("_group", F.shiftright("block", GROUP)).groupBy("_group")
    return group(known).cogroup(group(blocks)).applyInArrow(run, given)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(postings, number of each one's block among them, whether each block may go on elsewhere) of at most ``most`` blocks in turn.

    Postings of a block follow each other in a written file. What is read of a file begins and ends anywhere, so the first and last block of
    every ``_split`` may be cut; all others are whole."""
    def out(part: pa.Table, starts: np.ndarray, cut: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        ends = np.append(starts, part.num_rows)
        for low in range(0, len(starts), most):
            high = min(low + most, len(starts))
            yield part.slice(ends[low], ends[high] - ends[low]), np.repeat(np.arange(high - low), np.diff(ends[low:high + 1])), cut[low:high]

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        block, split = (part.column(c).to_numpy() for c in ("block", "_split"))
        starts = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(split) != 0)))
        own = split[starts]
        other = np.append(before is None or own[0] != before, np.diff(own) != 0)  # begins a split
        yield from out(part.slice(0, starts[-1]), starts[:-1], other[:-1] | other[1:])
        held, before = part.slice(starts[-1]), own[-2] if len(own) > 1 else before
    if held is not None:
        yield from out(held, np.zeros(1, int), np.ones(1, bool))


def _bounds_of(part: pa.Table, block: np.ndarray, many: int, asked: _Asked, k1: float, b: float) -> np.ndarray:
    """What no chunk of a block can exceed, by block and query."""
    term = asked.terms.get_indexer(part.column("term").to_pandas())
    most, least = (part.column(c).to_numpy().astype(float) for c in ("max_tf", "min_length"))
    bound = np.zeros(many * len(asked.ids))
    for low, high in _cut(asked.sizes[term]):
        head, x = _pairs(asked.starts[term[low:high]], asked.sizes[term[low:high]])
        head += low
        one = asked.idf[x] * (most[head] * (k1 + 1) / (most[head] + k1 * (1 - b + b * least[head] / asked.average[x])))
        bound += np.bincount(block[head] * len(asked.ids) + asked.own[x], one, len(bound))
    return bound.reshape(many, -1)


class _Scan:
    """Bounds and scores made inside the tasks that read the index, for up to FEW_QUERIES queries: whole blocks need no exchange, and no
    bound of a (query, block) pair is kept that isn't among a query's first or can't hold one of its answers."""

    def __init__(self, index: LexicalIndex, weighted: DataFrame, k1: float, b: float):
        context = weighted.sparkSession.sparkContext
        self.weighted, self.k1, self.b = weighted, k1, b
        asked = _asked(weighted)
        self.asked, self.most = context.broadcast(asked), max(1, CELLS // max(1, len(asked.ids)))
        split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_split")
        self.known = index.postings.select("term", "block", "max_tf", "min_length", "rows", split).join(F.broadcast(weighted.select("term").distinct()), "term", "left_semi")

    def first(self, depth: int) -> DataFrame:
        """``query_id, block, bound, cut`` of at least ``depth`` blocks a query: those of the highest bounds, and all that may be cut."""
        shared, most, k1, b = self.asked, self.most, self.k1, self.b
        given = StructType([self.weighted.schema["query_id"], StructField("block", LongType()), StructField("bound", DoubleType()), StructField("cut", BooleanType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, schema = shared.value, to_arrow_schema(given)
            floor, kept, room = np.full(len(asked.ids), -np.inf), [], 0

            def rows(query: np.ndarray, block: np.ndarray, bound: np.ndarray, cut: bool) -> pa.RecordBatch:
                ids = pa.array(asked.ids.to_numpy(), schema.field("query_id").type).take(pa.array(query))
                return pa.RecordBatch.from_arrays([ids, pa.array(block), pa.array(bound), pa.array(np.full(len(query), cut))], schema=schema)

            def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                query, block, bound = (np.concatenate(c) for c in zip(*kept))
                order = np.lexsort((block, -bound, query))
                query, block, bound = query[order], block[order], bound[order]
                at = np.arange(len(query)) - np.searchsorted(query, query)
                floor[query[at == depth - 1]] = bound[at == depth - 1]
                return query[at < depth], block[at < depth], bound[at < depth]

            for part, of, cut in _runs(batches, most):
                bound = _bounds_of(part, of, len(cut), asked, k1, b)
                names = part.column("block").to_numpy()[np.searchsorted(of, np.arange(len(cut)))]
                at, query = np.nonzero((bound > 0) & cut[:, None])
                if len(at):
                    yield rows(query, names[at], bound[at, query], True)
                at, query = np.nonzero((bound > floor) & (bound > 0) & ~cut[:, None])
                kept.append((query, names[at], bound[at, query]))
                room += len(at)
                if room > 4 * depth * len(floor):
                    kept = [best()]
                    room = len(kept[0][0])
            if room:
                yield rows(*best(), False)

        found = durable(self.known.drop("rows").mapInArrow(run, given))
        whole = found.where("not cut")
        parted = found.where("cut").groupBy("query_id", "block").agg(F.sum("bound").alias("bound"), F.first("cut").alias("cut"))
        return durable(whole.unionByName(parted.select(*whole.columns)))

    def rest(self, first: DataFrame, kth: DataFrame, best: int | None) -> DataFrame:
        """As ``_scored_in_groups``, of the whole blocks that are not among ``first`` and whose bound is not below ``least``."""
        shared, most, k1, b = self.asked, self.most, self.k1, self.b
        asked = shared.value
        least = np.full(len(asked.ids), -np.inf)
        known = kth.toPandas()
        least[asked.ids.get_indexer(known["query_id"])] = known["least"]
        done = first.select("query_id", "block").toPandas()
        done = done.assign(query=asked.ids.get_indexer(done["query_id"])).sort_values("block")
        state = self.weighted.sparkSession.sparkContext.broadcast((least, done["block"].to_numpy(np.int64), done["query"].to_numpy(int)))
        given = _score_type(self.known, self.weighted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, (least, blocks, queries), schema = shared.value, state.value, to_arrow_schema(given)
            for part, of, cut in _runs(batches, most):
                bound = _bounds_of(part, of, len(cut), asked, k1, b)
                visible = (bound > 0) & (bound + SLACK >= least) & ~cut[:, None]
                names = part.column("block").to_numpy()[np.searchsorted(of, np.arange(len(cut)))]
                low, high = np.searchsorted(blocks, names), np.searchsorted(blocks, names, "right")
                at, pair = _pairs(low, high - low)
                visible[at, queries[pair]] = False
                held = visible.any(axis=1)
                if held.any():
                    part = part.filter(pa.array(held[of]))
                    number, chosen, score = _group_scores(part, (np.cumsum(held) - 1)[of[held[of]]], visible[held], asked, k1, b, best)
                    if best is not None:
                        own = asked.ids.get_indexer(asked.names["query_id"])[number]
                        keep = score + SLACK >= least[own]
                        number, chosen, score = number[keep], chosen.filter(pa.array(keep)), score[keep]
                    yield from _score_rows(number, chosen, score, asked, schema).combine_chunks().to_batches()

        return self.known.mapInArrow(run, given)


def _few(weighted: DataFrame) -> bool:
    return fits_broadcast(weighted) and weighted.select("query_id", SET).distinct().count() <= FEW_QUERIES


def _of_members(scored: DataFrame, members: DataFrame | None) -> DataFrame:
    if members is not None:
        scored = scored.join(members.select(SET, "version_id"), [SET, "version_id"], "left_semi")
    return scored.select("query_id", "chunk_id", F.round("score", 9).alias("score")).where("score > 0")


def block_scores(index: LexicalIndex, weighted: DataFrame, blocks: DataFrame, members: DataFrame | None = None, k1: float = K1, b: float = B, best: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks of the given (query_id, block) rows that share a term with the query; with ``best``,
    at least of those that can be among its first ``best``. ``blocks`` is a written table."""
    if _few(weighted):
        blocks = blocks.select("query_id", "block").join(F.broadcast(weighted.select("query_id").distinct()), "query_id", "left_semi")
        known = index.postings.select("term", "block", "rows").join(F.broadcast(weighted.select("term").distinct()), "term", "left_semi")
        held = blocks.select("block").distinct()
        known = known.join(F.broadcast(held), "block", "left_semi") if fits_broadcast(held) else known
        scored = _scored_in_groups(known, blocks, weighted, k1, b, best if members is None else None)
    else:
        wanted = durable(blocks.select("query_id", "block").join(weighted, "query_id"))
        known = index.postings.select("term", "block", "rows").join(small_side(wanted.select("term").distinct()), "term", "left_semi")
        found = known.join(small_side(wanted), ["term", "block"]).withColumn("row", F.explode("rows"))
        one = F.col("idf") * gain(F.col("row.tf"), F.col("row.length"), F.col("avg_length"), k1, b)
        scored = found.groupBy("query_id", SET, F.col("row.chunk_id").alias("chunk_id"), F.col("row.version_id").alias("version_id")).agg(F.sum(one).alias("score"))
    return _of_members(scored, members)


def search(index: LexicalIndex, queries: DataFrame, k: int = 20, tokenizer: Callable[[Column], Column] | None = None, members: DataFrame | None = None,
           k1: float = K1, b: float = B, best: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(top k per query with rank, all scored pairs; with ``best`` at least k, those that can be among a query's first ``best``). With ``members`` (target_set, version_id), ``queries`` carries ``target_set``."""
    weighted = weights(index, queries, tokenizer, members)
    order = [F.col("score").desc(), F.col("chunk_id")]
    depth = max(16, 2 * k)

    def first_of(bound: DataFrame) -> DataFrame:
        return durable(top_k(bound, ["query_id"], [F.col("bound").desc(), F.col("block")], depth, "_at").drop("_at"))

    def kth_of(early: DataFrame) -> DataFrame:
        return top_k(early, ["query_id"], order, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))

    def left(bound: DataFrame, first: DataFrame, kth: DataFrame) -> DataFrame:
        return durable(bound.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(kth, "query_id", "left").where(
            F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "block"))

    if _few(weighted):
        scan = _Scan(index, weighted, k1, b)
        bound = scan.first(depth)
        first = first_of(bound)
        early = durable(block_scores(index, weighted, first, members, k1, b, best))
        kth = durable(kth_of(early))
        cut = block_scores(index, weighted, left(bound.where("cut"), first, kth), members, k1, b, best)
        scored = early.unionByName(cut).unionByName(_of_members(scan.rest(first, kth, best if members is None and best is not None and best <= k else None), members))
    else:
        bound = bounds(index, weighted, k1, b)
        first = first_of(bound)
        early = durable(block_scores(index, weighted, first, members, k1, b, best))
        scored = early.unionByName(block_scores(index, weighted, left(bound, first, kth_of(early)), members, k1, b, best))
    return top_k(scored, ["query_id"], order, k), scored
