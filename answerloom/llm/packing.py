"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

A bin is opened with the longest remaining piece; a bitset subset-sum over the remaining lengths finds the fullest
combination that fits, which is then removed. Pieces of one length are interchangeable, so the search runs on the
histogram (at most ``CAPACITY`` different lengths, however many documents there are) and a combination is removed as
often as its lengths last: every step uses up a length, so there are at most about as many patterns as lengths.

Pieces find their bins without meeting each other. They are numbered within their length (by hash range, then inside
the range); a pattern owns a run of numbers of each of its lengths, and bin, slot and offset follow by arithmetic.

Null text is empty; a document always ends in the id 1, so an empty one is a piece of length 1. A text longer than a
sequence is cut; repeated rows are packed each on their own. An empty table gives an empty result. Other columns don't
matter. The vocabulary file is a parameter.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.session import durable

CAPACITY = 4096
END_ID = 1
RANGES = 256
CACHED_WORDS = 300_000
TOGETHER = 1 << 20
"""Characters whose new words are encoded together."""
BEYOND_LATIN = re.compile("[^\x00-\xff]")
LATIN_WORD = re.compile(r"[a-zß-öø-ÿ]+\Z")
LONE_STOP = re.compile(r"[,.](?<=[a-zß-öø-ÿ][,.])(?=[ \n])")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordIds:
    """Ids of a text as little-endian bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its space-separated
    parts. Parts are looked up in a cache of two generations (the older one goes when the younger is full); new ones are
    encoded together. To meet fewer different parts, texts of Latin-1 letters are lower-cased first, as the tokenizer
    does itself (no composition and no context there), and a comma or stop between a letter and a space is set apart.
    A part of such letters alone is one word to the tokenizer, so it goes to the tokenizer's model as the bytes' letters.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        letters = {b: c for c, b in byte_of_letter().items()}
        self.spelling = str.maketrans({chr(n): "".join(letters[b] for b in chr(n).encode()) for n in range(0x80, 0x100)})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        if "<|" not in text and not BEYOND_LATIN.search(text):  # special tokens are told by their case
            text = LONE_STOP.sub(r" \g<0>", text.lower())
        return text.replace("\n", " ").split(" ")

    def learn(self, wanted: set[str]) -> None:
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        words, others = [], []
        for part in wanted:
            if (ids := self.old.get(part)) is not None:
                self.young[part] = ids
            else:
                (words if LATIN_WORD.match(part) else others).append(part)
        spelt = [w if w.isascii() else w.translate(self.spelling) for w in words]
        for new, found in ((words, self.model.encode_batch_fast(spelt, add_special_tokens=False)), (others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))):
            for part, ids in zip(new, found):
                self.young[part] = struct.pack(f"<{len(ids.ids)}I", *ids.ids)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        held: list[tuple[list[str], list[bytes | None]]] = []
        size = 0
        for text in texts:
            parts = self.parts(text)
            held.append((parts, list(map(self.young.get, parts))))
            size += len(text)
            if size > TOGETHER:
                yield from self._filled(held)
                held, size = [], 0
        yield from self._filled(held)

    def _filled(self, held: list[tuple[list[str], list[bytes | None]]]) -> Iterator[bytes]:
        missing = {p for parts, found in held if None in found for p, f in zip(parts, found) if f is None}
        if missing:
            self.learn(missing)
        young = self.young
        for parts, found in held:
            yield b"".join([young[p] if f is None else f for p, f in zip(parts, found)] if None in found else found)


@cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, so later tasks find the words of earlier ones."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and ``spread``, a hash that depends on content only."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = word_ids(path), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), words.encode(t.as_py() or "" for t in batch.column(1))):
                ids = text + END_ID.to_bytes(4, "little")
                number = doc_id.as_py()
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    crc = zlib.crc32(part)
                    out.append((number, at // step, at // 4, len(part) // 4, crc, zlib.crc32(b"%d:%d" % (number or 0, at), crc)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "spread"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to ``room`` (long pieces first, so few are used).

    Copies of a length are added in powers of two; the bitset after each addition is kept to walk the choice back.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            grown = bits | (bits << (take * length)) & mask
            if grown != bits:
                steps.append((length, take, bits))
                bits = grown
            left, chunk = left - take, 2 * chunk
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for length, take, earlier in reversed(steps):
        if not earlier >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def bin_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: copies in each}) until no piece is left. The longest remaining piece opens every bin."""
    counts, patterns = dict(histogram), []
    while counts:
        first = max(counts)
        rest = {n: c - (n == first) for n, c in counts.items() if c > (n == first)}
        chosen = fullest(rest, capacity - first)
        chosen[first] = chosen.get(first, 0) + 1
        bins = min(counts[n] // k for n, k in chosen.items())
        patterns.append((bins, chosen))
        for n, k in chosen.items():
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
    return patterns


def pattern_runs(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: runs of (first number, numbers, copies per bin, first bin, offset in the bin)."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    first_bin = 0
    for bins, chosen in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            k, own = chosen[length], runs.setdefault(length, [])
            own.append((own[-1][0] + own[-1][1] if own else 0, bins * k, k, first_bin, offset))
            offset += k * length
        first_bin += bins
    return runs


def run_blocks(runs: dict[int, list[tuple[int, int, int, int, int]]]) -> list[tuple]:
    """(length, total, blocks, block, runs): the numbers of a length are cut into as many blocks as it has runs, and every
    block has the runs that reach into it, so a piece looks at few runs."""
    rows = []
    for length, own in runs.items():
        total, blocks = own[-1][0] + own[-1][1], len(own)
        held: dict[int, list[tuple]] = {}
        for run in own:
            for block in range(run[0] * blocks // total, (run[0] + run[1] - 1) * blocks // total + 1):
                held.setdefault(block, []).append(run)
        rows += [(length, total, blocks, block, own_runs) for block, own_runs in held.items()]
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, path, capacity))
    span = F.pmod(F.xxhash64("spread"), F.lit(RANGES)).cast("int")
    ranged = cut.withColumn("span", span)
    sums = durable(ranged.groupBy("length", "span").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # one row per length
    rows = run_blocks(pattern_runs(bin_patterns(histogram, capacity)))
    plan = spark.createDataFrame(rows, "length long, total long, blocks long, block long, runs array<struct<first: long, numbers: long, copies: long, first_bin: long, at: long>>")
    earlier = Window.partitionBy("length").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "span").orderBy("spread", "doc_id", "piece")
    numbered = ranged.withColumn("n", F.row_number().over(inside) - 1).join(starts, ["length", "span"]).withColumn("n", F.col("n") + F.col("base"))
    # Both sides of these joins are bounded by the capacity: a row per length, and two rows at most per run of a pattern.
    lengths = F.broadcast(plan.select("length", "total", "blocks").distinct())
    blocked = numbered.join(lengths, "length").withColumn("block", F.expr("n * blocks div total"))
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("n")) & (F.col("n") < r["first"] + r["numbers"])), 1)
    found = blocked.join(F.broadcast(plan.select("length", "block", "runs")), ["length", "block"]).withColumn("run", run)
    within = F.col("n") - F.col("run.first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first_bin") + F.floor(within / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + within % F.col("run.copies") * F.col("length")).cast("long").alias("offset"))
