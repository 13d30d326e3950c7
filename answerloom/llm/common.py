"""Small helpers of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"
"""A word of the contracts: what ``bytes.split()`` gives on the UTF-8 text."""


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores put before it until no column of ``taken`` (any case) has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def learnable(doc_id: str, modulus: int) -> Column:
    """The remainder that separates learning from held-out rows; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def row_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply a function of column lists to every Arrow batch; the batches of a task are independent."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            if batch.num_rows:
                out = rows(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)
