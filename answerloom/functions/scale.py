"""Building blocks that keep plans safe when one key holds a large share of the rows."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure (not guess) a side: reads at most max_rows+1 rows of it."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    width = F.lit(8 * len(df.columns))
    for name in text:
        width = width + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    for name in nested:
        width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return row[0] <= max_rows and row[1] <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise the shuffle join (with AQE skew splitting) stays."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


PAIRS_PER_TASK = 20_000_000
LEFT_LIST, RIGHT_LIST = 168, 128
"""Rows of a side that ``dealt_join`` pairs at a time."""
ROWS_PER_RANGE = 50_000


def _listed(df: DataFrame, keys: list[str], most: int, rows: int, name: str) -> DataFrame:
    """``keys``, ``_list`` (a number) and ``name``, at most ``most`` rows of one key, in the order of all columns.

    Ranges of all columns hold ``ROWS_PER_RANGE`` of the ``rows`` each, so few keys are cut and no key is one task's; lists follow
    positions, so equal rows don't fill one. The order leaves nothing open but equal rows, so a retried task makes the same lists.
    """
    rest = [c for c in df.columns if c not in keys]
    ranged = df.repartitionByRange(math.ceil(rows / ROWS_PER_RANGE), *keys, *rest).sortWithinPartitions(*keys, *rest)
    number = F.floor(F.monotonically_increasing_id() / most).alias("_list")
    at = ranged.select(*keys, F.struct(F.lit(0).alias("_"), *rest).alias("_row"), number)
    return at.groupBy(*keys, "_list").agg(F.collect_list("_row").alias(name))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], pairs_per_task: int = PAIRS_PER_TASK, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of few key values, whose output is far larger than its sides: work is dealt by output pairs, not by input bytes.

    Key counts of both sides give the number of pairs and so the number of tasks. A left side that fits is broadcast to the
    dealt right side; otherwise both are cut into pieces and every task joins a piece with a piece, so no key is one task's.
    Rows meet as lists, and every row of a right list is followed by the same rows of a left one: a column is a run or repeats
    within a page of a columnar file, so the written pairs take a fraction of the bytes that they take in the order of a join.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name))

    pairs, lefts, rights, most = counted(left, "_l").join(counted(right, "_r"), keys).agg(
        F.sum(F.col("_l") * F.col("_r")), F.sum("_l"), F.sum("_r"), F.max("_l")).first()
    tasks = math.ceil((pairs or 0) / pairs_per_task)
    small = fits_broadcast(left, max_rows)
    if tasks <= 1:
        return (F.broadcast(left) if small else left).join(right, keys)

    def lists(left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
        return (_listed(left, keys, max(1, min(LEFT_LIST, left_rows)), lefts, "_ls").withColumnRenamed("_list", "_ln"),
                _listed(right, keys, max(1, min(RIGHT_LIST, right_rows)), rights, "_rs").withColumnRenamed("_list", "_rn"))

    if small:
        ls, rs = lists(LEFT_LIST, int(pairs_per_task / 4 / most))  # a right list meets all left rows of its key
        met = F.broadcast(ls).join(rs.repartition(tasks), keys)
    else:
        n = math.ceil(math.sqrt(tasks))
        every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cell = [*keys, "_i", "_j"]

        def cut(df: DataFrame, number: str, own: str, other: str) -> DataFrame:
            piece = F.pmod(F.xxhash64(*keys, number), F.lit(n)).cast("int")
            return df.withColumn(own, piece).withColumn(other, every).repartition(n * n, *cell)

        ls, rs = lists(*[math.isqrt(pairs_per_task) // 4] * 2)
        met = cut(ls, "_ln", "_i", "_j").join(cut(rs, "_rn", "_j", "_i"), cell)
    pairs_of = met.select(*keys, "_ls", F.explode("_rs").alias("_r")).select(*keys, "_r", F.explode("_ls").alias("_l"))
    return pairs_of.select(*keys, *[F.col(f"_{s}")[c].alias(c) for s, df in (("l", left), ("r", right)) for c in df.columns if c not in keys])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Feed CPU-heavy row-local work to all cores when the rows of the input lie in fewer tasks than there are cores.

    Rows per task are counted, not splits: a file of few large row groups has many splits, and most of them are empty. An input
    whose rows fill most cores, as any large one does, is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("n"))  # reads no column of a plain table
    rows, most = parts.agg(F.sum("n"), F.max("n")).first()
    return df.repartition(cores, key) if rows and rows < 0.75 * cores * most else df


SLICE_ROWS = 64


def by_slices(rows: pa.Array, work: Callable, kind: pa.DataType) -> pa.Array:
    """``work`` on every value that is not null, few rows at a time: only these are Python objects at once, not the texts of a whole batch."""
    parts = (rows.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(rows), SLICE_ROWS))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([None if row is None else work(row) for row in part], kind) for part in parts)])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """First row of every key by ``order`` as a combining aggregate.

    ``min_by`` is pre-aggregated before the shuffle, so a hot key sends one row per task, not its whole group.
    """
    value = keep or [c for c in df.columns if c not in keys]
    chosen = F.min_by(F.struct(*value), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in value])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    value = keep or [c for c in df.columns if c not in keys]
    chosen = F.max_by(F.struct(*value), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in value])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """row_number <= k; Catalyst limits each group before the shuffle (WindowGroupLimit)."""
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


SLICES = 64


def _sliced(df: DataFrame, keys: list[str], position: Column, hot_rows: int, max_hot: int):
    """Adds ``_at`` (the position), ``_cuts`` (NULL for ordinary keys) and ``_slice``, the position range inside a hot key.

    A hot key is cut at approximate quantiles of its positions, so ranges hold about equal numbers of rows however the
    positions are spread. Cuts are doubles; rows are ordered by the position itself, which may be finer.
    """
    base = df.withColumn("_at", position).withColumn("_pos", F.col("_at").cast("double"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    aliases = [f"_k{i}" for i in range(len(keys))]
    renamed = [F.col(k).alias(a) for k, a in zip(keys, aliases)]
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, aliases)])
    hot = (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
        .where((F.col("_n") > F.greatest(F.lit(hot_rows).cast("double"), total / max_hot)) & (F.col("_hi") > F.col("_lo")))
        .select(*renamed)
    )
    fractions = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = (
        base.join(F.broadcast(hot), match).groupBy(*aliases)
        .agg(F.array_distinct(F.percentile_approx("_pos", fractions, 20 * SLICES)).alias("_cuts"))
    )
    sliced = base.join(F.broadcast(cuts), match, "left").withColumn(
        "_slice", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_pos"))))).drop(*aliases)
    return sliced, match, renamed, aliases


def split_rank(
    df: DataFrame,
    keys: list[str],
    position: Column,
    tiebreak: list[Column],
    name: str = "rn",
    hot_rows: int = 1_000_000,
    max_hot: int = 20_000,
) -> DataFrame:
    """Exact row_number per key that never sorts a hot group in one task.

    ``position`` is a numeric first order key. A group above the threshold is cut into ranges of ``position`` at its own
    approximate quantiles; each range is numbered alone and offset by the counts of the ranges
    before it. The cut depends only on the data, so a retried task reproduces it. The threshold is at least
    rows/max_hot, hence at most ``max_hot`` keys are hot and their side tables are bounded by construction.
    """
    sliced, match, renamed, aliases = _sliced(df, keys, position, hot_rows, max_hot)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.where(F.col("_cuts").isNotNull()).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_offset", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .select(*renamed, F.col("_slice").alias("_s"), "_offset")
    )
    local = W.partitionBy(*keys, "_slice").orderBy(F.col("_at"), *tiebreak)
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), match & (F.col("_slice") == F.col("_s")), "left")
        .withColumn(name, (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).cast("long"))
        .drop("_at", "_pos", "_cuts", "_slice", "_local", "_s", "_offset", *aliases)
    )


def split_previous(
    df: DataFrame,
    keys: list[str],
    position: Column,
    tiebreak: list[Column],
    value: Column,
    name: str,
    hot_rows: int = 1_000_000,
    max_hot: int = 20_000,
) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row of its key, with hot keys cut as in ``split_rank``.

    Inside a range it is a running window; what a range hands to the next ones is one value per range.
    """
    sliced, match, renamed, aliases = _sliced(df.withColumn("_value", value), keys, position, hot_rows, max_hot)
    local = W.partitionBy(*keys, "_slice").orderBy(F.col("_at"), *tiebreak).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        sliced.where(F.col("_cuts").isNotNull()).groupBy(*keys, "_slice")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at", *tiebreak))).alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .select(*renamed, F.col("_slice").alias("_s"), "_carry")
    )
    return (
        sliced.withColumn("_near", F.last("_value", ignorenulls=True).over(local))
        .join(F.broadcast(ends), match & (F.col("_slice") == F.col("_s")), "left")
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_value", "_at", "_pos", "_cuts", "_slice", "_near", "_s", "_carry", *aliases)
    )


GRID = 200


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], gather: int = 200_000) -> DataFrame:
    """Nearest-rank percentiles per key, one column per name of ``fractions``; NULL where a key has no value.

    A range of values that holds the rank is narrowed with mergeable sketches, a ``GRID``th of its rows per pass, until at most
    ``gather`` values of a key remain; those are counted by value and ranked exactly. No buffer grows with a key's rows.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(q).alias("_q")) for n, q in fractions.items()])
    state = durable(
        base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_w", F.explode(wanted)).select(
            *keys, "_lo", "_hi", "_w._name", F.col("_n").alias("_inside"),
            F.greatest(F.lit(1), F.ceil(F.col("_w._q") * F.col("_n") - 1e-9)).cast("long").alias("_rank")))

    def met(now: DataFrame) -> DataFrame:
        aliases = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
        return base.join(now.select(*aliases, "_name", "_lo", "_hi", "_rank"), same).drop(*[f"_k{i}" for i in range(len(keys))])

    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    below = F.count_if(F.col("_v") < F.col("_lo")).alias("_below")
    group = [*keys, "_name", "_lo", "_hi", "_rank"]
    while (state.where("_lo < _hi").agg(F.max("_inside")).first()[0] or 0) > gather:
        grid = F.percentile_approx(F.when(inside, F.col("_v")), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), 50 * GRID)
        seen = met(state).groupBy(*group).agg(below, F.count_if(inside).alias("_m"), grid.alias("_grid"))
        step = (F.col("_rank") - F.col("_below")) / F.col("_m") * GRID
        low = F.element_at("_grid", F.greatest(F.lit(1), F.floor(step)).cast("int"))
        high = F.element_at("_grid", F.least(F.lit(GRID + 1), F.ceil(step) + 2).cast("int"))
        narrow = seen.select(*keys, "_name", "_rank", F.greatest("_lo", low).alias("_lo"), F.least("_hi", high).alias("_hi"))
        counted = met(narrow).groupBy(*group).agg(F.count_if(inside).alias("_inside"))
        narrowed = durable(counted.select(*state.columns))
        if narrowed.agg(F.sum("_inside")).first()[0] >= state.agg(F.sum("_inside")).first()[0]:
            break  # only ties are left in the largest range
        state = narrowed
    ranges = met(state)
    before = ranges.groupBy(*group).agg(below)
    upto = F.sum("_c").over(W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    counts = ranges.where(inside).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto)
    named = [F.col(c).alias(f"_b{c}") for c in group]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in group])
    found = counts.join(before.select(*named, "_below"), same).where(F.col("_below") + F.col("_upto") >= F.col("_rank"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in fractions])


def grouped_list(value: Column, *order: Column, distinct: bool = False) -> Column:
    """Ordered list of a *bounded* group (per query, per document)."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    out = F.transform(rows, lambda r: r["v"])
    return F.array_distinct(out) if distinct else out
