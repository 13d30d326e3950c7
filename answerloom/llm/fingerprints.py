"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the ``K`` smallest different hashes of a text's shingles of five words (letters A-Z lower-cased); with fewer
words the whole sequence is one shingle. The fingerprint of parts taken together is the ``K`` smallest of their
fingerprints, so long texts are sketched in parts and fingerprints of rows merge in any order. Two fingerprints estimate
resemblance (the share of common hashes among the ``K`` smallest of both), containment and the number of different
shingles; with fewer than ``K`` shingles these are exact.

Hashing is array arithmetic over the bytes of many texts at once: prefix sums of byte times power give every word's
polynomial, five mixed word hashes give a shingle's, one sort by (text, hash) gives all sketches of a block.

Null counts as empty text. A text without words has the empty fingerprint, which resembles only itself. Equal texts have
equal fingerprints. The next document is the next in descending ``doc_id`` (null last), equal ids by hash of the text;
after the last comes the first. Repeated rows follow each other. An empty table gives an empty result. Other columns don't
matter.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import row_map
from answerloom.session import durable

K = 256
SHINGLE = 5
HASH_BITS = 48
PART = 1 << 19
"""Bytes hashed at once; a longer text is cut into such parts, which share SHINGLE - 1 words."""
BASE = 0x9E3779B97F4A7C15
MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LEAST = -(2**63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of them."""
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of lower-cased texts, in order of the texts; repeated shingles come repeatedly."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    white = WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))  # a word's first byte, then the first after it, in turns
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)])])
    word = mixed((sums[end] - sums[start]) * inverse[start])
    first = np.searchsorted(start, bounds)
    count = np.diff(first)
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(word), np.uint64)
    for i, m in enumerate(MULTIPLIERS):
        total += padded[i:len(word) + i] * m
    text = np.repeat(np.arange(len(texts)), count)
    whole = np.arange(len(word)) + SHINGLE <= first[1:][text]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    for t in short.tolist():
        at = first[t]
        own = word[at:at + count[t]]
        total[at] = (own * MULTIPLIERS[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        whole[at] = True
    return text[whole], mixed(total[whole]) >> np.uint64(64 - HASH_BITS)


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end at white space; each begins with the last SHINGLE - 1 words of the one before."""
    words_back = b""
    at = 0
    while at < len(text):
        stop = min(len(text), at + size)
        while stop < len(text) and not WHITE[text[stop]]:
            stop += 1
        part = words_back + text[at:stop]
        yield part
        words_back = b" ".join(part.split()[1 - SHINGLE:]) + b" "
        at = stop


def sketches(texts: list[str], k: int = K, part: int = PART) -> list[np.ndarray]:
    """The sorted bottom-k hashes of every text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        rows, code = shingle_hashes([t for _, t in held])
        key = np.unique((rows.astype(np.uint64) << np.uint64(HASH_BITS)) | code)  # at most 2**16 texts are held
        rows = (key >> np.uint64(HASH_BITS)).astype(np.int64)
        bounds = np.searchsorted(rows, np.arange(len(held) + 1))
        key &= np.uint64((1 << HASH_BITS) - 1)
        for (i, _), low, high in zip(held, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = key[low:min(high, low + k)]

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").lower()
        if len(data) > part:
            out[i] = merged([sketches([p.decode("utf-8", "surrogatepass")], k, 2 * len(p))[0] for p in parts_of(data, part)], k)
            continue
        if held and (size + len(data) > part or len(held) >= 1 << (64 - HASH_BITS)):
            flush()
            held, size = [], 0
        held.append((i, data))
        size += len(data) + 1
    if held:
        flush()
    return out


def merged(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two bottom-k sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = np.append(both[:-1][~twice], both[-1])[:k]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def written(sketch: np.ndarray) -> str:
    """Six bytes a hash, in base 64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id`` and ``sketch`` (sorted hashes) of every row."""
    def rows(columns: dict[str, list]) -> dict[str, list]:
        return {"doc_id": columns["doc_id"], "sketch": [s.astype(np.int64) for s in sketches([t or "" for t in columns["text"]], k)]}

    return row_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, sketch array<long>")


def merge(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """The fingerprint of each key's parts together. Hashes are combined and cut to ``k`` before the shuffle, so a key with
    any number of parts sends few; a key whose parts are all empty has the empty fingerprint."""
    codes = parts.select(*keys, F.explode(sketch).alias("_h")).distinct()
    least = codes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("_s"))
    named = parts.select(*keys).distinct()
    same = [named[c].eqNullSafe(whole[c]) for c in keys]
    return named.join(whole, same, "left").select(*[named[c] for c in keys], F.coalesce("_s", F.array().cast("array<long>")).alias(sketch))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / F.element_at(sketch, k))


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles; 1 for two empty fingerprints."""
    union = _union(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    common = resemblance(a, b, k) * distinct_shingles(_union(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def range_of(cuts: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Number of the range of (id, tie). An id that holds several cuts has as many ranges, by its tie."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
    return low + np.minimum(share * (high - low), np.maximum(high - low - 1, 0)).astype(np.int64)


def followed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows with the range of their id and the text's hash, number of ranges). Ranges hold about equal numbers of rows, also where one id
    has many."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    fractions = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    cuts = np.array(docs.agg(F.percentile_approx(order, fractions, 20 * n)).first()[0] or [], dtype=np.int64)

    @F.pandas_udf("int")
    def ranges(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(range_of(cuts, ids.to_numpy(), ties.to_numpy()).astype(np.int32))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), order.alias("at"), F.xxhash64(text).alias("tie"))
    return rows.withColumn("span", ranges("at", "tie")), len(cuts) + 1


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mark``: every partition holds ranges in descending order, each with a marked copy of the row that follows
    its last one. Texts are shuffled once; the copies are one row per range."""
    spark = docs.sparkSession
    rows, n = followed(docs)
    tops = sorted(((r["span"], *r["top"]) for r in rows.groupBy("span").agg(F.max(F.struct("at", "tie")).alias("top")).toLocalIterator()), reverse=True)
    next_tops = [(*tops[(i + 1) % len(tops)], tops[i][0]) for i in range(len(tops))]
    plan = spark.createDataFrame(next_tops, "span int, at long, tie long, before int")
    copies = rows.join(F.broadcast(plan), ["span", "at", "tie"]).groupBy("before", "doc_id", "at", "tie").agg(F.max("text").alias("text"))
    marked = durable(copies.select("doc_id", "text", "at", "tie", F.col("before").alias("span"), F.lit(True).alias("mark")))
    both = rows.withColumn("mark", F.lit(False)).select(*marked.columns).unionByName(marked)
    return both.repartitionById(n, F.col("span")).sortWithinPartitions(
        "span", "mark", F.desc("at"), F.desc("tie"), F.desc("text")).select("doc_id", "text", "mark")


def near_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    def made(rows: list[tuple], prints: list[np.ndarray]) -> pa.RecordBatch:
        pairs = [i for i in range(len(rows) - 1) if not rows[i][2]]
        edited = []
        for i in pairs:
            text, half = rows[i][1], len(rows[i][1]) // 2
            edited.append(text[:len(text) - half] + rows[i + 1][1][:half])
        other = sketches(edited, k)
        columns = [
            [rows[i][0] for i in pairs], [len(rows[i][1]) for i in pairs],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            [written(prints[i]) for i in pairs], [written(s) for s in other],
            [likeness(prints[i], s, k) for i, s in zip(pairs, other)], [likeness(prints[i], prints[i + 1], k) for i in pairs]]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        prints: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for row in zip(*batch.columns):
                rows.append(tuple(v.as_py() for v in row))
                size += len(rows[-1][1])
                if size > PART:
                    prints += sketches([r[1] for r in rows[len(prints):]], k)
                    yield made(rows, prints)
                    rows, prints, size = rows[-1:], prints[-1:], 0
        if rows:
            prints += sketches([r[1] for r in rows[len(prints):]], k)
            yield made(rows, prints)

    return in_order(docs).mapInArrow(run, RESULT)
