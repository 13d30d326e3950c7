import math
import pathlib
import random

from pyspark.sql import functions as F

from answerloom.functions.scale import SLICES, _sliced, dealt_join, exact_percentiles, split_previous, split_rank, spread
from answerloom.operators import relational as rel


def test_slices_are_even_whatever_the_positions(spark):
    rows = [(1, float(i)) for i in range(20_000)] + [(1, 1e15), (2, 1.0)]
    df = spark.createDataFrame(rows, "k int, p double")
    sliced, *_ = _sliced(df, ["k"], F.col("p"), 1_000, 20_000)
    largest = sliced.where("k = 1").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 20_001 / SLICES
    ranked = split_rank(df, ["k"], F.col("p"), [F.col("p")], "rn", 1_000).orderBy("k", "rn").collect()
    assert [(r.k, r.p, r.rn) for r in ranked] == sorted([(1, float(i), i + 1) for i in range(20_000)] + [(1, 1e15, 20_001), (2, 1.0, 1)])


def test_positions_above_double_precision_keep_their_order(spark):
    rows = [(1, 2**60 + i) for i in range(500)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, p long")
    got = split_rank(df, ["k"], F.col("p"), [F.col("p")], "rn", 50).collect()
    assert all(r.rn == r.p - 2**60 + 1 for r in got)


def test_previous_value_across_slices(spark):
    rows = [(1, i, i if i % 100 == 0 else None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k int, p long, v long")
    got = split_previous(df, ["k"], F.col("p"), [F.col("p")], F.col("v"), "before", 100).collect()
    assert all(r.before == (None if r.p == 0 else (r.p - 1) // 100 * 100) for r in got)


def test_percentiles_equal_nearest_ranks(spark):
    rng = random.Random(4)
    groups = {"skewed": [rng.paretovariate(0.3) for _ in range(3001)], "tied": [1.0] * 900 + [2.0] * 100 + [3.0], "one": [7.5], "negative": [-rng.random() * 10 ** rng.randint(-9, 9) for _ in range(777)],
              None: [float(i) for i in range(20)], "equal": [4.0] * 2000}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("void", None), ("one", None)], "k string, v double").repartition(5)
    want = {k: tuple(sorted(vs)[max(1, math.ceil(q * len(vs) - 1e-9)) - 1] for q in (0.5, 0.95, 1.0, 0.0)) for k, vs in groups.items()}
    for gather in (10**6, 500, 20):
        got = exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 1.0, "d": 0.0}, gather)
        assert {r.k: (r.a, r.b, r.c, r.d) for r in got.collect()} == want
    assert exact_percentiles(df.where("k = 'one'"), [], "v", {"a": 0.5}).collect()[0].a == 7.5


def test_pairs_of_few_keys_are_dealt_over_tasks(spark):
    asks = spark.range(300).select(F.col("id").alias("q"), (F.col("id") % 2).alias("owner"))
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("owner"))
    want = sorted(map(tuple, asks.join(docs, "owner").select("q", "doc").collect()))
    for most in (1_000, 10):  # broadcast, and pieces against pieces
        got = dealt_join(asks, docs, ["owner"], 5_000, most)
        assert sorted(map(tuple, got.select("q", "doc").collect())) == want
        parts = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) >= 8 and max(parts) <= len(want) / 3


def test_owner_scope_is_not_one_task(spark, monkeypatch):
    from answerloom.functions import scale
    monkeypatch.setattr(scale.dealt_join, "__defaults__", (5_000, scale.BROADCAST_ROWS))
    asks = spark.range(300).select(F.col("id").alias("query_id"), F.lit("o").alias("owner"))
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("document_id"), F.lit("o").alias("owner"), F.lit("active").alias("document_status"))
    assert rel.owner_scope(docs, asks).rdd.getNumPartitions() >= 300 * 400 / 5_000


def test_dealt_pairs_are_those_of_a_join(spark):
    odd = [("a", i % 7, None if i % 5 == 0 else [str(i % 3)]) for i in range(900)] + [(None, 1, None)] * 50 + [("b", 5, ["x"])] * 400 + [("c", 0, None)]
    left = spark.createDataFrame(odd, "k string, n int, tags array<string>").repartition(4)
    right = spark.createDataFrame([("b", i, 1.5) for i in range(300)] + [("a", 9, float("nan"))] * 70 + [(None, 2, 0.0), ("d", 3, None)], "k string, m int, x double")
    want = left.join(right, "k")
    count = lambda df: {tuple(map(str, r)) for r in df.groupBy(*want.columns).count().collect()}
    for most in (10_000, 10):
        got = dealt_join(left, right, ["k"], 2_000, most)
        assert got.schema == want.schema and count(got) == count(want)
        assert dealt_join(left.where("n < 0"), right, ["k"], 2_000, most).count() == 0


def written(df, folder):
    """Bytes a row takes in Parquet files."""
    df.write.parquet(folder)
    return sum(f.stat().st_size for f in pathlib.Path(folder).rglob("*.parquet")) / df.sparkSession.read.parquet(folder).count()


def test_pairs_take_little_of_the_disk(spark, tmp_path):
    """Runs of one side and a short period of the other; in the order of a join the pairs took 3.0 (broadcast) and 0.28 bytes (pieces)."""
    asks = spark.range(20_000).select((F.col("id") * 7).alias("q"), (F.col("id") % 2).alias("owner"))
    docs = spark.range(600).select((F.col("id") * 11).alias("doc"), (F.col("id") % 2).alias("owner"))
    for most, limit in ((100_000, 0.5), (10, 0.2)):
        assert written(dealt_join(asks, docs, ["owner"], 1_000_000, most).select("q", "doc"), str(tmp_path / str(most))) < limit


def served_tables(spark):
    docs = spark.range(6).select(F.col("id").alias("document_id"), F.lit("o").alias("owner"), F.lit("0").alias("domain"), F.lit("active").alias("document_status"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("public"))).when(F.col("id") % 3 == 1, F.array(F.lit("public"), F.lit("vip"))).otherwise(F.lit(None)).alias("access_scope"))
    vers = spark.range(600).select(F.col("id").alias("version_id"), (F.col("id") % 6).alias("document_id"), F.lit("ready").alias("version_status"), F.lit(True).alias("is_current"))
    idx = spark.range(600).select(F.concat(F.lit("ix"), "id").alias("index_version_id"), F.col("id").alias("version_id"), F.lit("active").alias("index_status"), F.lit("c1").alias("collection"),
        F.when(F.col("id") % 4 == 0, "m-old").when(F.col("id") % 4 < 3, "m-new").alias("model"), F.lit(128).alias("dimension"))
    asks = spark.range(40).select(F.col("id").alias("query_id"), F.lit("o").alias("owner"), F.lit("0").alias("domain"), F.when(F.col("id") % 2 == 0, F.array(F.lit("public"))).otherwise(
        F.array(F.lit("vip"), F.lit("staff"))).alias("allowed_scopes"), F.element_at(F.array(F.lit("vector"), F.lit("bm25"), F.lit("hybrid"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("mode"))
    return asks, vers, docs, idx


def test_active_indexes_are_dealt_by_pairs(spark, monkeypatch):
    from answerloom.functions import scale
    monkeypatch.setattr(scale.dealt_join, "__defaults__", (500, scale.BROADCAST_ROWS))
    tables = served_tables(spark)
    got = rel.active_indexes(*tables)
    assert got.rdd.getNumPartitions() >= 12_000 / 500
    want = {(q, f"ix{i}") for q in range(40) for i in range(600) if (i % 3 in (0, 1) if q % 2 == 0 else i % 3 == 1)}
    assert sorted(map(tuple, got.select("query_id", "index_version_id").collect())) == sorted(want)


def test_active_indexes_take_little_of_the_disk(spark, monkeypatch, tmp_path):
    from answerloom.functions import scale
    monkeypatch.setattr(scale.dealt_join, "__defaults__", (500_000, scale.BROADCAST_ROWS))
    _, vers, docs, idx = served_tables(spark)
    asks = spark.range(9_000).select((F.col("id") * 7).alias("query_id"), F.lit("o").alias("owner"), F.lit("0").alias("domain"), F.array(F.lit("public")).alias("allowed_scopes"))
    got = rel.active_indexes(asks, vers, docs, idx).select("query_id", "index_version_id", "document_id")
    assert written(got, str(tmp_path / "pairs")) < 0.5  # in the order of a join 1.8 bytes
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 9_000 * 400


def test_compatible_counts_need_no_pairs(spark):
    tables = served_tables(spark)
    key = ["query_id", "mode", "compatible", "incompatible"]
    counts = rel.split_active(*tables, "c1", "m-new", 128)
    want = rel.split_compatible(rel.active_indexes(*tables), "c1", "m-new", 128)
    order = lambda df: sorted((r[0], str(r[1]), r[2], r[3]) for r in df.select(*key).collect())
    assert order(counts) == order(want) and len(order(counts)) == 40


def other_table(spark, tmp_path, name, frame):
    """A folder of the small tables in which one table is another."""
    import os

    from conftest import SMALL
    for file in os.listdir(SMALL):
        if file != f"{name}.parquet":
            os.symlink(f"{SMALL}/{file}", tmp_path / file)
    frame.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def agrees(spark, folder, name):
    from compare import compare, connect
    ok, message = compare(spark, connect(folder), name, folder)
    assert ok, message


def test_upserted_ids_may_meet_stored_ones(spark, tmp_path):
    from conftest import SMALL
    near = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    far = near.withColumn("vec_id", F.col("vec_id") + 100_000)
    agrees(spark, other_table(spark, tmp_path, "embeddings", near.unionByName(far)), "upsert_vectors")


def test_descriptions_may_begin_like_steps(spark, tmp_path):
    text = "\n".join(["56.187.231.175 is the address", "open it", "close it", "- a dash", "first", "second", "3. third", "x", "y"])
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    agrees(spark, other_table(spark, tmp_path, "documents", docs), "chunk_manual")


def plan_of(spark, name):
    from conftest import SMALL

    from answerloom.plans import QUERIES
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_once_for_their_evaluation(spark):
    assert "ArrowEvalPython" not in plan_of(spark, "chunk_cases")


def test_rules_run_once_for_published_texts(spark):
    assert "regexp_replace" not in plan_of(spark, "publish_text")


def test_slices_of_a_batch_are_all_that_is_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    from answerloom.functions.scale import by_slices

    texts = [None if i % 7 == 0 else [f"{i} " + "x" * 5000] * 2 for i in range(2000)]
    batch, kind = pa.array(texts), pa.list_(pa.string())
    want = pa.array([None if t is None else t[:1] for t in texts], kind)
    del texts
    tracemalloc.start()
    got = by_slices(batch, lambda t: t[:1], kind)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(want) and peak < 2_000_000  # all rows as objects take ten times as much
    assert len(by_slices(batch.slice(0, 0), lambda t: t, kind)) == 0


def test_spread_counts_rows_not_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    hot = spark.range(1000).repartition(4 * cores, F.lit(1))  # many partitions, all rows in one

    def most(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert most(hot) == 1000 and most(spread(hot, "id")) < 1000
    even = spark.range(0, 1000, 1, 4 * cores)
    assert spread(even, "id") is even and spread(hot.where("false"), "id").count() == 0
