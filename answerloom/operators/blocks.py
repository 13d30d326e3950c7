"""Document text to source blocks. Everything folds inside the document's own row: no shuffle."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scale import by_slices
from ..functions.text import bind, is_blank, rstrip, split_lines, strip

HEADING_LINE = r"(?U)^(#{1,6})\s+(.+?)\s*$"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"


def clean_block(content: Column | str) -> Column:
    """DOC-5: outer blanks stripped, every line right-stripped, inner newlines kept; blank becomes NULL."""
    lines = F.transform(split_lines(strip(content)), lambda x: rstrip(x))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def text_blocks(df: DataFrame, column: str = "text", separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """DOC-1: stripped non-blank paragraphs, numbered from 0."""
    parts = F.filter(F.transform(F.split(F.col(column), separator), lambda x: strip(x)), lambda x: F.length(x) > 0)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(parts).alias("ordinal", "_part")).select(
        *rest, "ordinal", F.lit("paragraph").alias("block_type"), clean_block(F.col("_part")).alias("content"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page_number"),
    )


def table_cells(line: Column) -> Column:
    """DOC-3: cells of one pipe row, outer pipes dropped."""
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|"), lambda x: strip(x))


def normalize_table(rows: Column) -> Column:
    """DOC-4: rows of cells to self-describing lines; NULL when nothing is left."""
    clean = F.filter(
        F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit(""))))),
        lambda r: F.exists(r, lambda c: F.length(c) > 0),
    )
    return bind(clean, lambda c: bind(c[0], lambda head: _table_text(c, head)))


def _table_text(clean: Column, head: Column) -> Column:
    def column_name(i: Column) -> Column:
        given = F.coalesce(F.get(head, i), F.lit(""))
        return F.when(F.length(given) > 0, given).otherwise(F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列")))

    def joined(row: Column, name) -> Column:
        cells = F.transform(row, lambda v, i: F.when(F.length(v) > 0, F.concat(name(i), F.lit("="), v)))
        return F.array_join(F.array_compact(cells), "；")

    body = F.transform(
        F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))),
        lambda r, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("行："), joined(r, column_name)),
    )
    only = F.get(head, F.lit(0))
    inner = F.filter(F.transform(split_lines(only), lambda x: strip(x)), lambda x: F.length(x) > 0)
    boxed = F.when(
        F.size(inner) >= 2,
        F.concat(F.lit("第1行："), inner[0], F.lit("="), F.array_join(F.slice(inner, F.lit(2), F.size(inner) - 1), "\n")),
    ).otherwise(F.concat(F.lit("第1行：内容="), only))
    plain = joined(head, lambda i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列")))
    single = F.when(F.size(head) == 1, boxed).otherwise(F.concat(F.lit("第1行："), plain))
    return F.when(F.size(clean) == 0, F.lit(None)).when(F.size(clean) == 1, single).otherwise(F.array_join(body, "\n"))


def _classified_lines(lines: Column) -> Column:
    """One struct per line: text, heading level and title, and what the line may start or end."""
    following = F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))

    def one(line: Column, nxt: Column) -> Column:
        level = F.length(F.regexp_extract(line, HEADING_LINE, 1))
        pipe = F.contains(line, F.lit("|"))
        return F.struct(
            line.alias("line"), level.alias("level"), F.regexp_extract(line, HEADING_LINE, 2).alias("title"),
            pipe.alias("pipe"), is_blank(line).alias("blank"),
            (pipe & (level == 0) & F.rlike(nxt, F.lit(TABLE_RULE))).alias("opens"),
        )

    return F.zip_with(lines, following, one)


def folded_lines(lines: list[str], levels: list[int], titles: list[str], pipes: list[bool], blanks: list[bool], rules: list[bool]) -> list[dict]:
    """Headings, paragraphs and tables of classified lines. ``rules``: the line opens a table, so the next one is its rule."""
    done: list[dict] = []
    path: list[str] = []
    held: list[str] = []
    in_table = skip = False
    for line, level, title, pipe, blank, opens in zip([*lines, ""], [*levels, 0], [*titles, ""], [*pipes, False], [*blanks, True], [*rules, False]):
        if skip:  # the rule below a table's head
            skip = False
            continue
        carry = in_table and pipe
        if carry or (not in_table and level == 0 and not blank and not opens):
            held.append(line)
            continue
        if held:
            done.append({"kind": "table" if in_table else "paragraph", "lines": held, "path": path})
        if level:
            path = [*path[:level - 1], title]
            done.append({"kind": "heading", "lines": [title], "path": path})
        held = [] if level or blank else [line]
        in_table = skip = opens
    return done


_TEXTS = T.ArrayType(T.StringType())
_FOLDED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("lines", _TEXTS), T.StructField("path", _TEXTS)]))


@F.arrow_udf(_FOLDED)
def _folded(items: pa.Array) -> pa.Array:
    return by_slices(items, lambda row: None if row["line"] is None else folded_lines(*row.values()), to_arrow_type(_FOLDED))


def markdown_blocks(df: DataFrame, column: str = "text") -> DataFrame:
    """DOC-2/3: headings, paragraphs and pipe tables with their heading path.

    The path is cut to level-1 entries and appended, so a skipped level shifts the later ones.
    """
    rest = [c for c in df.columns if c != column]
    lines = df.select(*rest, split_lines(F.col(column)).alias("_lines"))
    items = lines.select(*rest, _classified_lines(F.col("_lines")).alias("_items"))
    def every(field: str) -> Column:
        return F.transform("_items", lambda x: x[field]).alias(field)

    fields = F.struct(*map(every, ("line", "level", "title", "pipe", "blank", "opens")))
    folded = items.select(*rest, _folded(fields).alias("_done"))

    def finished(b: Column) -> Column:
        text = F.when(b["kind"] == "table", normalize_table(F.transform(b["lines"], table_cells))).otherwise(
            F.array_join(b["lines"], "\n")
        )
        return F.struct(b["kind"].alias("block_type"), clean_block(text).alias("content"), b["path"].alias("heading_path"))

    blocks = F.filter(F.transform("_done", finished), lambda b: b["content"].isNotNull())
    return folded.select(*rest, F.posexplode(blocks).alias("ordinal", "_b")).select(
        *rest, "ordinal", "_b.block_type", "_b.content", "_b.heading_path", F.lit(None).cast("int").alias("page_number")
    )
