"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Both tokenizers cut the same bytes; an offset where tokens of both end is a shared cut. An interval of a text (at first
the whole text) looks for the shared cut nearest to its middle: token ends of A around the middle, in rounds of twice as
many, are bisected into the ends of B. At a cut the interval becomes two; an interval without one inside is a group. The
intervals of all texts of a block are halved together, level by level, so a level is a few array operations.

A group links each of its A tokens to each of its B tokens. Counting runs over blocks of texts: a block hands on each id
pair once with the number of its documents that hold it, pairs are summed over blocks, and what a block needs of these sums
comes back to it by its number. So what is shuffled are the different pairs of blocks, not the links, and no group holds
more than one block (``TOGETHER`` characters of text, or one longer text).

Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
string. Strings of special tokens inside texts are plain text. Repeated rows are documents of their own. An empty table
gives an empty result. Other columns don't matter. The vocabulary files are parameters.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.packing import byte_of_letter
from answerloom.session import durable

TOGETHER = 8 << 20
"""Characters of text in a block."""
SMALL_GROUP = 1 << 12
"""Links of a group that are written out one by one; a larger group multiplies the counts of its different ids."""
# Fixed value: the split of tokenizer A's vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = "block long, nth int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs long, links binary, pairs array<long>, docs array<int>"
PAIR_BASE = 1 << 16
"""Ids of B are below this; a pair is ``a * PAIR_BASE + b``."""
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def vocabulary_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids and token bytes of both sides for " " + text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            given = json.load(f)
        letters, special = byte_of_letter(), {t["id"] for t in given["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in given["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})  # ids are in merge order
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_a[i] = piece
        n = self.b.get_piece_size()
        if n > PAIR_BASE:
            raise ValueError(f"vocabulary B has {n} ids, more than {PAIR_BASE}")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.written = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(n) for end in ",;"]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B, or None if either doesn't give the text back."""
        if not text:
            return None
        whole = " " + text
        a, b, want = self.a.encode_ordinary(whole), self.b.encode(text, num_threads=1), whole.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return a, b


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): every row's start, start + 1, ... as often as its size says."""
    row = np.repeat(np.arange(len(starts)), sizes)
    return row, np.arange(len(row)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def near_middle(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per interval, the A token of [low, high) nearest to the middle whose end is a B end too, and the B token; -1 if none."""
    found, other = np.full(len(low), -1), np.full(len(low), -1)
    centre = (low + high) // 2
    first, after, step = centre.copy(), centre.copy(), 1  # [first, after) has been looked at
    rest = np.flatnonzero(low < high)
    while len(rest):
        left, right = np.maximum(first[rest] - step // 2, low[rest]), np.minimum(after[rest] + (step + 1) // 2, high[rest])
        row, token = ragged(left, right - left)
        if step > 1:
            new = (token < first[rest][row]) | (token >= after[rest][row])
            row, token = row[new], token[new]
        end = ends_a[token]
        place = np.searchsorted(ends_b, end)
        shared = np.flatnonzero(ends_b[place] == end)
        row, token, place = row[shared], token[shared], place[shared]
        if step > 1 and len(row):
            order = np.lexsort((np.abs(token - centre[rest[row]]), row))
            order = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            row, token, place = row[order], token[order], place[order]
        found[rest[row]], other[rest[row]] = token, place
        first[rest], after[rest] = left, right
        rest = rest[(found[rest] < 0) & ((left > low[rest]) | (right < high[rest]))]
        step *= 2
    return found, other


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every group, in order. ``docs_a`` and ``docs_b``: first token of every text, and the end.

    Halves stay side by side, so every level asks in ascending order."""
    a0, a1, b0, b1 = docs_a[:-1], docs_a[1:], docs_b[:-1], docs_b[1:]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a0):
        cut, other = near_middle(ends_a, ends_b, a0, np.where(b1 - b0 > 1, a1 - 1, a0))
        leaf = cut < 0
        leaves.append((a0[leaf], b0[leaf]))
        a0, a1, b0, b1, cut, other = (x[~leaf] for x in (a0, a1, b0, b1, cut, other))
        a0, a1, b0, b1 = (np.stack(x, axis=1).ravel() for x in ((a0, cut + 1), (cut + 1, a1), (b0, other + 1), (other + 1, b1)))
    first_a, first_b = (np.concatenate(x) for x in zip(*leaves)) if leaves else (np.zeros(0, np.int64),) * 2
    order = np.argsort(first_a)
    return first_a[order], first_b[order]


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc: np.ndarray, base: int,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Different (text, id pair) keys in order, and the links each stands for. Key: text * (ids of A * ids of B) + pair."""
    n_a, n_b = np.diff(first_a, append=len(ids_a)), np.diff(first_b, append=len(ids_b))
    links = n_a * n_b
    one, large = links == 1, links > SMALL_GROUP
    keys = [doc[one] * base + pair_code(ids_a[first_a[one]], ids_b[first_b[one]])]
    some = np.flatnonzero(~one & ~large)
    row, at = ragged(np.zeros(len(some), np.int64), links[some])
    group = some[row]
    keys.append(doc[group] * base + pair_code(ids_a[first_a[group] + at // n_b[group]], ids_b[first_b[group] + at % n_b[group]]))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, count = key[first], np.diff(first, append=len(key))
    for g in np.flatnonzero(large):
        a, many_a = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        b, many_b = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        product = doc[g] * base + pair_code(a[:, None], b[None, :]).ravel()
        key, where = np.unique(np.concatenate([key, product]), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate([count, (many_a[:, None] * many_b[None, :]).ravel()]))
        count = total
    return key, count


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) * PAIR_BASE + b


def align_block(tok: Tokenizers, doc_ids: list, texts: list[str | None], block: int, digest: bool) -> pa.RecordBatch:
    """One row per text; the first also holds the block's links and different pairs."""
    n = len(texts)
    a_parts, b_parts, good = [], [], []
    for i, text in enumerate(texts):
        if (ids := tok.encode(text or "")) is not None:
            a_parts.append(np.array(ids[0], np.int32))
            b_parts.append(np.array(ids[1], np.int32))
            good.append(i)
    n_a, n_b, n_groups, n_links, n_pairs = (np.zeros(n, np.int64) for _ in range(5))
    written = [""] * n
    pairs, docs, packed = np.zeros(0, np.int64), np.zeros(0, np.int32), b""
    if good:
        at = np.array(good)
        n_a[at], n_b[at] = [len(x) for x in a_parts], [len(x) for x in b_parts]
        docs_a, docs_b = (np.concatenate([[0], np.cumsum(x[at])]) for x in (n_a, n_b))
        ids_a, ids_b = np.concatenate(a_parts), np.concatenate(b_parts)
        del a_parts, b_parts
        first_a, first_b = leaf_groups(np.cumsum(tok.size_a[ids_a]), np.cumsum(tok.size_b[ids_b]), docs_a, docs_b)
        doc = np.searchsorted(docs_a, first_a, side="right") - 1
        links = np.diff(first_a, append=len(ids_a)) * np.diff(first_b, append=len(ids_b))
        n_groups[at] = np.bincount(doc, minlength=len(at))
        n_links[at] = np.diff(np.concatenate([[0], np.cumsum(links)])[np.searchsorted(doc, np.arange(len(at) + 1))])
        for i, text in zip(good, written_groups(tok, ids_a, ids_b, first_a, first_b, docs_a + docs_b)):
            written[i] = hashlib.sha256(text.encode()).hexdigest() if digest else text
        base = PAIR_BASE * len(tok.bytes_a)
        key, count = linked_pairs(ids_a, ids_b, first_a, first_b, doc, base)
        own, pair = np.divmod(key, base)
        n_pairs[at] = np.bincount(own, minlength=len(at))
        pairs, where = np.unique(pair, return_inverse=True)
        docs = np.bincount(where).astype(np.int32)
        packed = zstandard.ZstdCompressor(level=1).compress(where.astype("<u4").tobytes() + count.astype("<u8").tobytes())
    lone = [None] * (n - 1)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(doc_ids, pa.int64()), *map(pa.array, (n_a, n_b, n_groups, n_links)),
        pa.array(written, pa.string()), pa.array(n_pairs), pa.array([packed, *lone], pa.binary()),
        pa.array([pairs, *lone], pa.list_(pa.int64())), pa.array([docs, *lone], pa.list_(pa.int32()))], [c.split()[0] for c in ROWS.split(", ")])


def written_groups(tok: Tokenizers, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text. Both sides' tokens are put in the order in which they are written."""
    last_a, last_b = np.append(first_a[1:], len(ids_a)) - 1, np.append(first_b[1:], len(ids_b)) - 1
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.zeros(len(ids_a), np.int64)
    mark[last_a] = 1
    place = np.arange(len(ids_a)) + np.repeat(first_b, last_a - first_a + 1)
    code[place] = 2 * ids_a.astype(np.int64) + mark
    mark = np.zeros(len(ids_b), np.int64)
    mark[last_b] = 1
    place = np.arange(len(ids_b)) + np.repeat(last_a + 1, last_b - first_b + 1)
    code[place] = 2 * (len(tok.bytes_a) + ids_b.astype(np.int64)) + mark
    get = tok.written.__getitem__
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield "".join(map(get, code[start:end].tolist()))[:-1]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, groups`` (written out, or their SHA-256), and what counting needs."""
    path_a, path_b = path_a or vocabulary_a(), path_b or vocabulary_b()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = tokenizers(path_a, path_b), TaskContext.get().partitionId()
        ids, texts, held, made = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "") + 64
                if held > TOGETHER:
                    yield align_block(tok, ids, texts, task << 32 | made, digest)
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield align_block(tok, ids, texts, task << 32 | made, digest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold an id pair linked, and whether no other pair of its A id is in more.

    ``aligned`` must be a written table. The highest count per A id is one row per id of A's vocabulary: a bounded broadcast."""
    counts = durable(block_pairs(aligned).groupBy("pair").agg(F.sum("held").alias("n")))
    a = F.expr(f"pair div {PAIR_BASE}").alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def block_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("held"))


def _sums(_: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
    texts = texts.sort_by("nth")
    n_pairs = texts["n_pairs"].to_numpy()
    count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, bool)
    place = found["place"].to_numpy()
    count[place], best[place] = found["n"].to_numpy(), found["best"].to_numpy(zero_copy_only=False)
    packed = texts["links"][0].as_py()
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    total = int(n_pairs.sum())
    where, links = np.frombuffer(raw, "<u4", total), np.frombuffer(raw, "<u8", total, 4 * total).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(n_pairs)])
    n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (links * best[where], links * count[where]))
    return pa.table([*(texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), texts["groups"]],
                    [c.split()[0] for c in RESULT.split(", ")])


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    aligned = durable(align(docs, path_a, path_b, digest=True))
    found = block_pairs(aligned).select("block", "place", "pair").join(pair_counts(aligned), "pair")
    back = found.select(F.col("block").alias("of_block"), "place", "n", "best")
    return aligned.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_sums, RESULT)
