"""Exact dedup: Grace hash partitioning with open-addressing tables that compare complete content.

1. Every task combines the equal texts of its own rows in a bounded table and hands on one record per text it has seen
   (hash, content, copies, largest id), so a group of copies of any size crosses the shuffle as one record per table.
2. Records are shuffled by hash. A task fills an open-addressing table; once that outgrows its bytes, table and input go
   to spill files by the next four bits of the hash, and every file is treated alike until it fits. Files live in a
   folder of the task and go with it; a lost task starts anew from the shuffle.
3. A class record (sha256 of the content, id that stays, copies) is joined to the rows, which carry their own sha256.

Null text counts as empty. Texts are equal when identical. The largest ``doc_id`` stays; a null id is smaller than any
other. Of rows with the same text and id one stays. An empty table gives an empty result. Other columns don't matter.
"""
from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import fresh

TABLE_BYTES = 48 << 20
"""Content a table may hold before it is handed on (map side) or spilled (reduce side)."""
FAN_BITS = 4
RECORD = "hash long, content binary, copies long, max_id long"
CLASS = "sha string, keep_id long, group_size long"


def later(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing: slots point at entries, equal hashes compare whole contents."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.copies: list[int] = []
        self.ids: list[int | None] = []
        self.held = 0

    def add(self, code: int, content: bytes, copies: int, doc_id: int | None) -> None:
        at = code & self.mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                self.copies[entry] += copies
                self.ids[entry] = later(self.ids[entry], doc_id)
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(code)
        self.contents.append(content)
        self.copies.append(copies)
        self.ids.append(doc_id)
        self.held += len(content) + 200
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for entry, code in enumerate(self.hashes):
            at = code & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry

    def records(self) -> Iterator[tuple[int, bytes, int, int | None]]:
        return zip(self.hashes, self.contents, self.copies, self.ids)


def grace_classes(records: Iterable[tuple[int, bytes, int, int | None]], limit: int = TABLE_BYTES, depth: int = 0,
                  ) -> Iterator[tuple[int, bytes, int, int | None]]:
    """One record per different content. Spills by bits of the hash as often as ``limit`` asks; past the last bit only
    contents of one hash remain, and those stay in the table."""
    table, source = ContentTable(), iter(records)
    for record in source:
        table.add(*record)
        if table.held > limit and len(table.hashes) > 1 and depth * FAN_BITS < 64:
            break
    else:
        yield from table.records()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(i)) for i in range(1 << FAN_BITS)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]
        shift, mask = 64 - FAN_BITS * (depth + 1), (1 << FAN_BITS) - 1
        try:
            for part in (table.records(), source):
                for record in part:
                    pickle.dump(record, files[(record[0] >> shift) & mask], protocol=5)
        finally:
            for f in files:
                f.close()
        del table
        for path in paths:
            yield from grace_classes(_read(path), limit, depth + 1)
            os.remove(path)


def _read(path: str) -> Iterator[tuple[int, bytes, int, int | None]]:
    with open(path, "rb", buffering=1 << 16) as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: equal texts of a task meet before the shuffle, in a table of bounded size."""
    def out(table: ContentTable) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([_signed(h) for h in table.hashes], pa.int64()), pa.array(table.contents, pa.binary()),
             pa.array(table.copies, pa.int64()), pa.array(table.ids, pa.int64())], ["hash", "content", "copies", "max_id"])

    table = ContentTable()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for doc_id, text in zip(ids.to_pylist(), texts):
            content = text.as_py() or b""
            table.add(xxhash.xxh64_intdigest(content), content, 1, doc_id)
            if table.held > TABLE_BYTES // 4:
                yield out(table)
                table = ContentTable()
    if table.hashes:
        yield out(table)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple[int, bytes, int, int | None]]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield row[0] & (2**64 - 1), row[1], row[2], row[3]

    held: list[tuple[str, int | None, int]] = []

    def out() -> pa.RecordBatch:
        sha, keep, size = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(sha), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], ["sha", "keep_id", "group_size"])

    for _, content, copies, max_id in grace_classes(records()):
        held.append((hashlib.sha256(content).hexdigest(), max_id, copies))
        if len(held) == 10_000:
            yield out()
            held = []
    if held:
        yield out()


def content_classes(docs: DataFrame) -> DataFrame:
    """One row per different text: ``sha``, ``keep_id`` (largest doc_id), ``group_size``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_combine, RECORD).repartition("hash").mapInArrow(_merge, CLASS)


def _sha(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def group_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too."""
    same = Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0))
    rows = docs.select("doc_id", _sha().alias("text_sha256")).withColumn("copy", F.row_number().over(same))
    classes = content_classes(docs).withColumnRenamed("sha", "text_sha256")
    return rows.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Of equal rows with one id, the first by the other columns stays."""
    sha, copy = fresh("sha", docs.columns), fresh("copy", docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy(sha, "doc_id").orderBy(*[F.col(f"`{c}`").cast("string") for c in rest] or [F.lit(0)])
    keys = content_classes(docs).select(F.col("sha").alias(fresh("stay_sha", docs.columns)), F.col("keep_id").alias(fresh("stay_id", docs.columns)))
    rows = docs.withColumn(sha, _sha()).withColumn(copy, F.row_number().over(same)).filter(F.col(copy) == 1)
    return rows.join(keys, (rows[sha] == keys[0]) & rows["doc_id"].eqNullSafe(keys[1]), "left_semi").select(*[f"`{c}`" for c in docs.columns])
