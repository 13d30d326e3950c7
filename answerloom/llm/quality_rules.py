"""Quality rules: bands of zstandard ratios over whole documents and over fixed chunks.

A text of language compresses within a band that moves with its length. Above the band it repeats itself, below it is
noise (encoded bytes, random identifiers). The whole text is measured once and every chunk of ``CHUNK`` bytes again, so
a long text with a repetitive or incompressible stretch is caught though its total looks normal. The last chunk is the
text's final ``CHUNK`` bytes. How many chunks, and how many in a row, may lie outside their band moves with the number of
chunks (LIMITS): a long text may hold a table, an index or a listing, a short one may not consist of it. Texts below ``CHUNK``
bytes are measured whole only, and below 100 bytes no rule but the base rules holds: zstandard doesn't tell prose from noise there.

Letters of two or three bytes would compress better than the same language in letters of one. Lengths and ratios are
therefore those of a recoding: ASCII stays, and the other code points of the text get one byte each, from 128 on. Korean
syllables count as their letters. With more than ONE_BYTE other code points the most frequent get one byte and the rare ones
stay in UTF-8, if the frequent ones are nearly all (FREQUENT) of the occurrences; else (ideographs) the text is measured in UTF-8.

The base rules of the corpus come first: a text with fewer than ten words, or with more than a fifth of its words in
five-word windows that occur twice, fails. Null text has no words and fails. Every row gives one row; repeated rows give
repeated results; an empty table gives an empty result; other columns don't matter.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from answerloom.llm.common import row_map

LEVEL = 3
CHUNK = 2048
BANDS = (
    (100, 0.0, 99.0),
    (300, 0.85, 1.75),
    (1_000, 1.15, 2.15),
    (3_000, 1.40, 2.40),
    (10_000, 1.60, 2.60),
    (1 << 62, 1.70, 2.95),
)
"""(recoded bytes below, least ratio, greatest ratio). Fixed limits of level 3; prose of any length lies inside with room."""
CHUNK_BAND = (1.30, 2.45)
LIMITS = ((8, 0.25, 2), (32, 0.20, 4), (128, 0.15, 10), (1 << 62, 0.15, 20))
"""(chunks below, share, run): a text is rejected when this share of its chunks, or this many in a row, lie outside CHUNK_BAND."""
ONE_BYTE = 128
FREQUENT = 0.9
SYLLABLES = re.compile("[\uac00-\ud7a3]+")
SYMBOLS = "#*$%&|<>"
RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, its first occurrence included."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def dup_lines(text: str) -> int:
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return repeated


def recoded(text: str) -> bytes:
    """One byte per letter whatever the script."""
    if text.isascii():
        return text.encode()
    letters = SYLLABLES.sub(lambda m: unicodedata.normalize("NFD", m[0]), text)
    others = sorted(c for c in set(letters) if c > "\x7f")
    if len(others) > ONE_BYTE:
        count = Counter(c for c in letters if c > "\x7f")
        others = sorted(count, key=lambda c: (-count[c], c))[:ONE_BYTE]
        if sum(count[c] for c in others) < FREQUENT * count.total():
            return text.encode("utf-8", "surrogatepass")
        code = {c: bytes([128 + i]) for i, c in enumerate(others)}
        return b"".join(code.get(c) or c.encode("utf-8", "surrogatepass") for c in letters)
    return letters.translate({ord(c): chr(128 + i) for i, c in enumerate(others)}).encode("latin-1")


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int, int]:
    """Ratio of the whole, number of chunks, chunks below and above the chunk band, most chunks outside it in a row."""
    if not raw:
        return 0.0, 0, 0, 0, 0
    low = high = row = most = 0
    chunks = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
    if chunks and len(raw) % CHUNK:
        chunks.append(len(raw) - CHUNK)
    for at in chunks:
        r = CHUNK / len(compressor.compress(raw[at:at + CHUNK]))
        low += r < CHUNK_BAND[0]
        high += r > CHUNK_BAND[1]
        row = 0 if CHUNK_BAND[0] <= r <= CHUNK_BAND[1] else row + 1
        most = max(most, row)
    return len(raw) / len(compressor.compress(raw)), len(chunks), low, high, most


def in_bands(size: int, ratio: float, chunks: int, outside: int, in_a_row: int) -> bool:
    least, most = next((lo, hi) for below, lo, hi in BANDS if size < below)
    share, run = next((s, r) for below, s, r in LIMITS if chunks < below)
    return least <= ratio <= most and in_a_row < run and (not outside or outside < share * chunks)


def measure(doc_id: int | None, text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeated = repeat_words(words)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    coded = recoded(text)
    ratio, chunks, low, high, in_a_row = compression(coded, compressor)
    return (doc_id, len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup_lines(text), repeated, failed,
            not failed and in_bands(len(coded), ratio, chunks, low + high, in_a_row), ratio, chunks, low, high)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, the compression figures and the verdict ``kept``."""
    names = [part.split()[0] for part in RESULT.split(", ")]

    def rows(columns: dict[str, list]) -> dict[str, list]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        out = [measure(i, t, compressor) for i, t in zip(columns["doc_id"], columns["text"])]
        return dict(zip(names, map(list, zip(*out))))

    return row_map(docs.select("doc_id", "text"), rows, RESULT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows whose text is kept, all columns untouched, without a shuffle or join."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            verdicts = [measure(None, t.as_py(), compressor)[7] for t in batch.column(at)]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
