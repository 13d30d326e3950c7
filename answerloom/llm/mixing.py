"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. The key space of a source is cut into fixed ranges; words are summed per (source,
range), prefix sums over these few sums give every range its start, and inside a range the rows are sorted by key and
summed on. A source's budget is then cut at its exact word: whole epochs first, and of the last epoch the rows before
the cut, the row on the cut in part. Nothing depends on partitions, so a rerun gives the same rows, and no task holds
more than one range of one source, whatever share of the rows a source has.

Sources by code point, null last, weigh 5, 2, 1, repeating. They share ``epochs`` (150%) of all words; a source never
takes more than ``most`` (2) times its own words, and what it leaves goes to the others by weight. Null text has no
words. Rows without words are taken 0 times. Equal rows are interchangeable. An empty table gives an empty result.
Other columns pass through untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import WORD, fresh
from answerloom.session import durable

WEIGHTS = (5, 2, 1)
EPOCHS_PERCENT = 150
MOST = 2
RANGE_DIGITS = 3
"""Hex digits of the key that name a range: 4,096 ranges a source."""


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key() -> Column:
    """A hash of id and text; equal rows share it."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to a table with ``source, source_size``: water-filling in closed form, in whole numbers.

    Sources are sorted by the level at which they are full (most * size / weight). With S the capacity of those before
    and W the weight of this and all later ones, a source is full if what is left, split by weight, reaches its level;
    the first source that isn't full fixes the level of all later ones. The table has one row per source.
    """
    one = Window.partitionBy(F.lit(0))
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    by_level = one.orderBy((MOST * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, on = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("all_words") * EPOCHS_PERCENT - 100 * MOST * F.col("size_before")  # in hundredths of a word
    full = F.col("weight") * left >= 100 * MOST * F.col("source_size") * F.col("weight_on")
    ranked = (
        sizes.withColumn("weight", weigh)
        .withColumn("all_words", F.sum("source_size").over(one))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_on", F.sum("weight").over(on))
        .withColumn("left", left).withColumn("full", full)
    )
    level = F.first(F.when(~F.col("full"), F.struct("left", "weight_on")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("level", level).select(
        *sizes.columns,
        F.when(F.col("level").isNull(), (MOST * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("level.left") / (100.0 * F.col("level.weight_on"))).alias("target"))


def mix(docs: DataFrame, into: str | None = None) -> tuple[DataFrame, str]:
    """All rows, with one struct column ``into`` (size, source_size, target, taken, rank key); and that column's name.

    ``taken`` is the words the mix takes from the row, repeats counted: ``taken div size`` whole passes, then the first
    ``taken mod size`` words (more than none for one row of a source at most).
    """
    name = into or fresh("mix", docs.columns)
    src, key, span, size, before, fact = (fresh(n, [*docs.columns, name]) for n in ("mix_source", "mix_key", "mix_range", "mix_size", "mix_before", "mix_fact"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, so one exchange serves window and join
    keyed = docs.select("*", source.alias(src), random_key().alias(key), word_count().alias(size)).withColumn(span, F.substring(key, 1, RANGE_DIGITS))
    sums = durable(keyed.groupBy(F.col(src).alias("name"), F.col(span).alias("span")).agg(F.sum(size).alias("words")))
    sizes = sums.groupBy("name").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes.select("name", F.expr("CASE WHEN name <> '' THEN substring(name, 2) END").alias("source"), "source_size"))
    earlier = Window.partitionBy("name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    facts = durable(starts.join(goal.drop("source"), "name"))
    inside = Window.partitionBy(src, span).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(before, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    facts = facts.select(F.col("name").alias(src), F.col("span").alias(span), F.struct("start", "source_size", "target").alias(fact))
    joined = placed.join(facts, [src, span])
    budget = F.round(F.col(f"{fact}.target")).cast("long")
    whole = F.when(F.col(f"{fact}.source_size") > 0, F.expr(f"CAST(round({fact}.target) AS BIGINT) div {fact}.source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col(f"{fact}.source_size")
    part = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col(f"{fact}.start") - F.col(before)))
    result = F.struct(F.col(size).alias("size"), F.col(f"{fact}.source_size").alias("source_size"), F.col(f"{fact}.target").alias("target"),
                      (whole * F.col(size) + part).cast("long").alias("taken"), F.col(key).alias("key"))
    return joined.select(*[f"`{c}`" for c in docs.columns], result.alias(name)), name


def draw(docs: DataFrame) -> DataFrame:
    """The mix itself: rows as often as they are taken, with their columns; the row on a source's cut is also given once
    with its text cut after the last word that the budget holds."""
    mixed, m = mix(docs)
    passes, extra = F.expr(f"{m}.taken div {m}.size"), F.col(f"{m}.taken") % F.col(f"{m}.size")
    copies = F.when(F.col(f"{m}.size") > 0, passes + F.when(extra > 0, 1).otherwise(0)).otherwise(F.lit(0))
    nth = fresh("nth", mixed.columns)
    rows = mixed.filter(F.col(f"{m}.taken") > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(nth))
    pieces = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (extra + 1).cast("int"))
    cut = F.array_join(F.slice(pieces, F.lit(1), extra.cast("int")), "")
    text = F.when(F.col(nth) > passes, cut).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
