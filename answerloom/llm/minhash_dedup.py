"""Near-dedup by b-bit MinHash.

1. One pass over the texts gives every document its set of five-word shingles as 64-bit hashes, a fingerprint of the set
   and the band keys of its minima. Documents with one fingerprint are one class; only classes go on.
2. Band keys that several classes share make them candidates. Their texts are fetched once, and of many more minima the
   low ``BITS`` bits are kept and packed. Agreeing bits, less what chance alone lets agree, estimate the similarity.
3. Star round: in every bucket each class meets only the class with the most bucket mates, so a bucket of any size gives
   as many pairs as members. Pairs that the estimate allows are confirmed on the full sets, links become components.
4. Rest: only buckets that still hold several components are looked at again. What lies outside a bucket's largest
   component meets all members of other components; the estimate is tested inside the join, and a pair counts in one of
   its buckets only. Pairs are confirmed on the full sets and merge components.

Bands miss a pair of similarity 0.75 with probability 5e-6, the estimate (4.5 standard deviations of room) with 4e-6;
no pair is dropped for the size of its bucket. Components come from label propagation with pointer jumping.

Null text and text without words have an empty set: linked with nothing, kept. Fewer words than five are one shingle.
A component is named by its smallest id (null ids count last). Repeated rows share their class; rows that share an id
stay or go together. An empty table gives an empty result. Other columns don't matter.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import fresh
from answerloom.session import durable

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BITS, MINIMA = 1, 2048
"""Low bits kept of each minimum, and how many minima a packed signature has."""
BLOCK = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
SEED = 20_011
LANES = BITS * MINIMA // 64


@cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows; A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    windows = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        windows *= ODD
        windows ^= windows >> np.uint64(29)
        windows += hashes[k:len(hashes) - width + k + 1]
    windows ^= windows >> np.uint64(32)
    windows *= ODD
    windows ^= windows >> np.uint64(29)
    return np.unique(windows)


def minima(items: np.ndarray, n: int) -> np.ndarray:
    """The n minima (upper halves of multiply-add values), in blocks of bounded size."""
    a, b = permutations(n)
    found = np.full(n, 0xFFFFFFFF, np.uint32)
    wide = max(1, (1 << 18) // min(len(items), BLOCK))
    for at in range(0, len(items), BLOCK):
        block = items[at:at + BLOCK]
        for p in range(0, n, wide):
            values = np.multiply.outer(a[p:p + wide], block)
            values += b[p:p + wide, None]
            least = values.view(np.uint32)[:, 1::2].min(axis=1)
            np.minimum(found[p:p + wide], least, out=found[p:p + wide])
    return found


def band_keys(items: np.ndarray) -> list[int]:
    rows = minima(items, BANDS * ROWS).reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), seed=band)) for band, row in enumerate(rows)]


def packed(items: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed into LANES 64-bit numbers."""
    low = (minima(items, MINIMA)[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(low.astype(np.uint8).ravel()).view(np.int64)


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def fingerprint(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def least_estimate() -> float:
    """The threshold less 4.5 standard deviations of the estimate at the threshold."""
    chance, wanted = 2.0 ** -BITS, PERCENT / 100
    agree = wanted + (1 - wanted) * chance
    return wanted - 4.5 * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of the packed signatures in the struct columns ``a`` and ``b`` (one bit a minimum)."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(LANES)))
    chance = 2.0 ** -BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


SETS = "doc_id long, fp binary, n_shingles long, bands array<long>"
SIGNED = "fp binary, text string, " + ", ".join(f"s{i} long" for i in range(LANES))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, sizes, bands = [], [], []
        for text in batch.column(1):
            items = shingles(text.as_py())
            prints.append(fingerprint(items))
            sizes.append(len(items))
            bands.append(band_keys(items) if len(items) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                         ["doc_id", "fp", "n_shingles", "bands"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts whose set is the wanted one (an id may stand for several texts)."""
    for batch in batches:
        rows = []
        for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items = shingles(text)
            if fingerprint(items) == wanted:
                rows.append((wanted, text, *packed(items).tolist()))
        if rows:
            types = [pa.binary(), pa.string(), *[pa.int64()] * LANES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["fp", "text", *(f"s{i}" for i in range(LANES))])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= PERCENT * union on their full sets."""
    last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        links = []
        for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
            if b != last[0]:
                last = (b, shingles(text_b))
            one, two = shingles(text_a), last[1]
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= PERCENT * (len(one) + len(two) - common):
                links.append((a, b))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], ["a", "b"])


def confirmed(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Links among ``pairs`` (a, b): the estimate first, in the join, then the full sets."""
    lanes = F.struct(*(f"s{i}" for i in range(LANES)))
    left = signed.select(F.col("fp").alias("a"), F.col("text").alias("text_a"), lanes.alias("x"))
    right = signed.select(F.col("fp").alias("b"), F.col("text").alias("text_b"), lanes.alias("y"))
    near = pairs.join(left, "a").join(right, "b").filter(estimate("x", "y") >= least_estimate())
    return near.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) for every node of the links (a, b)."""
    edges = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = durable(lower.join(above, "comp").select("node", F.least("comp", "top").alias("comp"), "was"))
        labels = step.select("node", "comp")
        if step.filter("comp <> was").isEmpty():
            return labels


def class_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, fp, n_shingles; classes: fp, component_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(docs.mapInArrow(_sets, SETS))
    sets = rows.filter("fp IS NOT NULL")
    classes = durable(sets.groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.first("bands").alias("bands")))
    banded = classes.select("fp", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("mates")).filter("mates > 1")
    members = durable(banded.join(shared, "key"))
    mates = durable(members.groupBy("fp").agg(F.sum("mates").alias("degree")))
    wanted = classes.join(mates, "fp").select("fp", F.col("min_id").alias("wanted_id"))
    fetched = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("fp", "text")
    signed = durable(fetched.mapInArrow(_sign, SIGNED).dropDuplicates(["fp"]))

    heads = members.join(mates, "fp").groupBy("key").agg(F.max_by("fp", F.struct("degree", "fp")).alias("b"))
    stars = members.join(heads, "key").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    labels = components(confirmed(stars, signed))

    labelled = durable(members.select("key", "fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    homes = (labelled.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
             .agg(F.max_by("comp", F.struct("n", "comp")).alias("home"), F.count("*").alias("comps")).filter("comps > 1").drop("comps"))
    lanes = F.struct(*(f"s{i}" for i in range(LANES)))
    mixed = labelled.join(homes, "key")
    detail = signed.select("fp", lanes.alias("sig")).join(classes.select("fp", "bands"), "fp")
    mixed = durable(mixed.join(detail, "fp"))
    one, two = (mixed.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("fp", "comp", "home", "bands", "sig"))) for side in "ab")
    rest = one.filter("a_comp <> a_home").join(two, "key").filter(
        (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("b_home")) | (F.col("a_comp") < F.col("b_comp")))
        & (estimate("a_sig", "b_sig") >= least_estimate()) & (F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("key")))
    more = durable(confirmed(rest.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct(), signed))
    by_node = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    joined = (more.join(by_node, "a", "left").withColumn("a", F.coalesce("comp_a", "a")).drop("comp_a")
              .join(by_node.select(F.col("a").alias("b"), F.col("comp_a").alias("comp_b")), "b", "left").withColumn("b", F.coalesce("comp_b", "b")))
    tops = components(joined.select("a", "b").filter("a <> b"))

    final = (classes.select("fp", "min_id").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
             .join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("fp", "min_id", F.coalesce("top", "comp").alias("comp")))
    final = durable(final)
    named = final.join(final.groupBy("comp").agg(F.min("min_id").alias("component_id")), "comp").select("fp", "component_id")
    return rows.select("doc_id", "fp", "n_shingles"), named


def group_near(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    rows, named = class_components(docs)
    linked = rows.filter("fp IS NOT NULL").join(named, "fp").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("fp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with all their columns."""
    stay = fresh("stay_id", docs.columns)
    keep = durable(group_near(docs).filter("kept").select(F.col("doc_id").alias(stay)).distinct())
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[stay]), "left_semi").select(*[f"`{c}`" for c in docs.columns])
