"""Hard-negative mining with anchor spanning-tree bounds.

Components become floor(256 * x), scores are exact integer inner products. Anchors of one label in a block form a spanning
tree with short edges. The root's scores of all candidates of a shard are computed; a child's score differs from its
parent's by at most edge length times candidate norm, so an interval is known before anything is computed, and only
candidates whose interval meets the wanted window are scored. Windows come from the task (30 to 90 hundredths of each
positive's score) and tighten to the k-th best score that the parent's own picks have for the child.

Two passes over cells of anchors and candidates: the first finds each anchor's best rows of its label, the second fills the
windows with rows of other labels. A cell holds at most about ``BLOCK`` anchors and ``SHARD`` candidates whatever the sizes of labels,
and hands on k rows per window, so neither a hot label nor the number of anchors meets in one task. Copies of a vector have zero edge
length and are scored once per path. Every row is compared with every anchor, by bound or by score; nothing is sampled.

No part is taken by rows with a null id, label or vector, an empty vector, a null or non-finite component, or a scaled
norm of 2**31 and more (scores would leave the long range). Rows of one id count once (least label, then least vector).
Vectors of different lengths don't meet. Ties go to the smaller id. An empty table gives an empty result. Other columns don't matter.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.session import durable

BLOCK = 2048
SHARD = 32_768
DEPTH = 24
"""Edges on the longest path of a tree; a walk keeps one interval per candidate and node of the path."""
SCALE = 256
FULL = 0.75
"""Share of overlapping candidates from which scoring all is cheaper than picking them."""
HITS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
POSITIVES = "anchor_id long, positive_id long, positive_score long"


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, q``: rows that take part, one per id, with their scaled integer components."""
    v = F.col("embedding")
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).try_cast("int"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    fit = whole.select("vec_id", "label", scaled.alias("q")).where(~F.exists("q", lambda x: x.isNull())).where(norm < 2.0**62)
    return fit.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of every row; row 0 is the root. Nearest rows are attached first; rows at DEPTH get no children."""
    n = len(points)
    parent, depth = np.full(n, -1), np.zeros(n, np.int64)
    length = np.full(n, np.inf)
    open_ = np.ones(n, bool)
    at = 0
    open_[0] = False
    for _ in range(n - 1):
        if depth[at] < DEPTH:
            gap = points - points[at]
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            nearer = open_ & (far < length)
            length[nearer], parent[nearer] = far[nearer], at
        at = int(np.argmin(np.where(open_, length, np.inf)))
        open_[at] = False
        depth[at] = depth[parent[at]] + 1
    length[0] = 0
    return parent, length


def exact_type(bound: float) -> type:
    """The cheapest type in which sums up to ``bound`` are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (-score, id)."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Walk:
    """Candidates of a cell and how they are scored for anchors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, anchors: np.ndarray) -> None:
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        reach = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) * norms.max(initial=0)
        kind = exact_type(1.001 * reach)
        self.ids, self.norms = ids, norms * (1 + 1e-9)
        self.vectors, self.anchors = vectors.astype(kind), anchors.astype(kind)
        self.parent, self.length = spanning_tree(anchors.astype(np.float64))
        self.scored = 0

    def run(self, windows: list[list[tuple[int, int]]], k: int, skip: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, positions, scores) of the k best candidates of every (low, high) window of every anchor.
        ``skip``: ids that are not candidates of the anchor in the same place."""
        children: list[list[int]] = [[] for _ in self.parent]
        for node, above in enumerate(self.parent.tolist()):
            if above >= 0:
                children[above].append(node)
        nothing = np.zeros(0, np.int64)
        stack: list[tuple[int, np.ndarray | None, np.ndarray | None, np.ndarray]] = [(0, None, None, nothing)]
        while stack:
            node, centre, radius, seeds = stack.pop()
            anchor, own = self.anchors[node], windows[node]
            floors = [low for low, _ in own]
            if len(seeds):
                seeds = seeds if skip is None else seeds[self.ids[seeds] != skip[node]]
                known = (self.vectors[seeds] @ anchor).astype(np.int64)
                for w, (low, high) in enumerate(own):
                    inside = known[(known >= low) & (known <= high)]
                    if len(inside) >= k:
                        floors[w] = int(np.partition(inside, len(inside) - k)[len(inside) - k])
            if centre is None:
                centre, radius = (self.vectors @ anchor).astype(np.float64), np.zeros(len(self.ids))
                at = np.arange(len(self.ids))
                self.scored += len(at)
            else:
                centre, radius = centre.copy(), radius + self.length[node] * (1 + 1e-9) * self.norms
                low, high = min(floors, default=1) - 0.5, max((h for _, h in own), default=0) + 0.5
                at = np.flatnonzero((centre + radius >= low) & (centre - radius <= high) & (radius > 0))
                if len(at) > FULL * len(self.ids):
                    at = np.arange(len(self.ids))
                centre[at] = self.vectors @ anchor if len(at) == len(self.ids) else self.vectors[at] @ anchor
                radius[at] = 0
                self.scored += len(at)
                at = np.flatnonzero(radius == 0)
            if skip is not None:
                at = at[self.ids[at] != skip[node]]
            scores = centre[at].astype(np.int64)
            picks = [nothing]
            for w, (_, high) in enumerate(own):
                inside = np.flatnonzero((scores >= floors[w]) & (scores <= high))
                pick = inside[best(scores[inside], self.ids[at[inside]], k)]
                picks.append(at[pick])
                yield node, w, at[pick], scores[pick]
            seeds = np.unique(np.concatenate(picks)) if children[node] else nothing
            stack += [(child, centre, radius, seeds) for child in reversed(children[node])]


def columns(table: pa.Table, by: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Table]]:
    """(vector length, rows, matrix, table) for every vector length of the table."""
    lists = table[by].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, values[lists.offsets.to_numpy()[rows][:, None] + np.arange(d)], table.take(pa.array(rows))


WHOLE = (-(2**62) - 1, 2**62 + 1)


def _same_label(k: int):
    def run(_: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        asked = {d: (m, t) for d, _, m, t in columns(anchors, "q")} if anchors.num_rows else {}
        for d, _, vectors, rows in columns(candidates, "q") if asked and candidates.num_rows else ():
            if d in asked:
                ids, own = rows["vec_id"].to_numpy(), asked[d][1]["vec_id"].to_numpy()
                for node, _, at, scores in Walk(ids, vectors, asked[d][0]).run([[WHOLE]] * len(own), k, own):
                    out.append((np.full(len(at), own[node]), ids[at], scores))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "positive_id", "positive_score"])
    return run


def _other_labels(k: int, low: int, high: int):
    def run(_: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64),) * 5]
        asked = {d: (m, t) for d, _, m, t in columns(anchors, "q")} if anchors.num_rows else {}
        for d, _, vectors, rows in columns(candidates, "q") if asked and candidates.num_rows else ():
            if d not in asked:
                continue
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            own, own_labels, positives = asked[d][1]["vec_id"].to_numpy(), asked[d][1]["label"].to_numpy(), asked[d][1]["positives"].to_pylist()
            for label in np.unique(own_labels).tolist():
                mine, others = np.flatnonzero(own_labels == label), np.flatnonzero(labels != label)
                if not len(others):
                    continue
                # low * p <= 100 * n <= high * p in whole numbers
                windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives[i]] for i in mine]
                for node, w, at, scores in Walk(ids[others], vectors[others], asked[d][0][mine]).run(windows, k):
                    p = positives[mine[node]][w]
                    n = len(at)
                    out.append((np.full(n, own[mine[node]]), np.full(n, p["id"]), np.full(n, p["score"]), ids[others[at]], scores))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], [c.split()[0] for c in HITS.split(", ")])
    return run


def own(*names: str) -> list[Column]:
    """Columns under their own name that a table with the same origin doesn't share."""
    return [F.col(n).alias(n) for n in names]


def split(key: str, pieces: Column) -> Column:
    return F.pmod(F.xxhash64(key), pieces).cast("int")


def each(pieces: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), pieces.cast("int") - 1))


def pieces_of(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def ranked(hits: DataFrame, keys: list[str], score: str, by: str, k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def positives(rows: DataFrame, is_anchor: Column, k: int = 5) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the k best other rows of every anchor's label."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).where("a > 0")
    sized = sizes.select("label", pieces_of(F.col("n"), SHARD).alias("shards"), pieces_of(F.col("a"), BLOCK).alias("blocks"))
    both = rows.join(sized, "label")
    anchors = both.where(is_anchor).withColumn("block", split("vec_id", F.col("blocks"))).withColumn("shard", each(F.col("shards")))
    others = both.withColumn("shard", split("vec_id", F.col("shards"))).withColumn("block", each(F.col("blocks")))
    keys = ["label", "block", "shard"]
    left, right = (df.select(*own("vec_id", "q"), F.col("label").alias(f"{n}_label"), F.col("block").alias(f"{n}_block"), F.col("shard").alias(f"{n}_shard"))
                   for df, n in ((anchors, "a"), (others, "c")))
    hits = left.groupBy(*[f"a_{c}" for c in keys]).cogroup(right.groupBy(*[f"c_{c}" for c in keys])).applyInArrow(_same_label(k), POSITIVES)
    return ranked(hits, ["anchor_id"], "positive_score", "positive_id", k).drop("rank")


def negatives(rows: DataFrame, found: DataFrame, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """The k best rows of other labels in every positive's window, ranked from 1. A negative positive score has no window."""
    asked = found.where("positive_score >= 0").groupBy("anchor_id").agg(  # at most k positives each
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    anchors = durable(rows.join(asked.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    blocks, shards = max(1, -(-anchors.count() // BLOCK)), max(1, -(-rows.count() // SHARD))
    left = anchors.select("vec_id", "label", "q", "positives", split("vec_id", F.lit(blocks)).alias("a_block"), each(F.lit(shards)).alias("a_shard"))
    right = rows.select(*own("vec_id", "label", "q"), each(F.lit(blocks)).alias("c_block"), split("vec_id", F.lit(shards)).alias("c_shard"))
    hits = left.groupBy("a_block", "a_shard").cogroup(right.groupBy("c_block", "c_shard")).applyInArrow(_other_labels(k, low, high), HITS)
    return ranked(hits, ["anchor_id", "positive_id"], "negative_score", "negative_id", k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``vectors``: vec_id, label, embedding."""
    rows = durable(usable(vectors))
    found = durable(positives(rows, is_anchor, n_positives))
    return negatives(rows, found, n_negatives, low, high).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
