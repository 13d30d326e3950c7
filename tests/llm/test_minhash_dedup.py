import random

import numpy as np
from cases import PROSE, awkward, documents
from pyspark.sql import functions as F

from answerloom.llm.minhash_dedup import LANES, components, drop_near, estimate, group_near, least_estimate, packed, shingles


def word_sets(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        words = (r["text"] or "").translate(table).encode().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def brute(rows):
    """(n_shingles, component) of every row by comparing all pairs."""
    sets, top = word_sets(rows), list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                top[root(i)] = root(j)
    names = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            names[root(i)] = min(names.get(root(i), r["doc_id"]), r["doc_id"])
    return [(len(s), names.get(root(i))) for i, s in enumerate(sets)]


def check(docs):
    rows = docs.collect()
    want = sorted(((r["doc_id"], n, c) for r, (n, c) in zip(rows, brute(rows))), key=str)
    got = group_near(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs)
    assert drop_near(docs).columns == docs.columns


def test_chains_and_stars_of_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, doc_id = [], 100
    for group in range(6):
        text = rng.sample(words, 120)
        for step in range(25):  # a chain in even groups, a star in odd ones
            copy = list(text)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((doc_id, " ".join(copy)))
            doc_id += rng.randint(1, 3)
            text = text if group % 2 else copy
    rows += [(i, " ".join(rng.sample(words, rng.randint(1, 60)))) for i in range(60)] + [(99, "one two"), (98, "One TWO"), (97, "one two three")]
    rng.shuffle(rows)
    check(documents(spark, rows, extra=True))


def test_estimate_is_close(spark):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(900)]
    rows = []
    for cut in (10, 60, 150, 400):
        other = base[:-cut] + [f"u{rng.random()}" for _ in range(cut)]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        rows.append((len(np.intersect1d(a, b)) / len(np.union1d(a, b)), packed(a).tolist(), packed(b).tolist()))
    names = [f"s{i}" for i in range(LANES)]
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>").select(
        "j", *(F.struct(*(F.col(c)[i].alias(n) for i, n in enumerate(names))).alias(c) for c in "ab"))
    for r in df.withColumn("e", estimate("a", "b")).collect():
        assert abs(r["j"] - r["e"]) < 0.07
    assert 0.65 < least_estimate() < 0.7


def test_components_of_a_long_path(spark):
    rng = random.Random(4)
    ids = [rng.randbytes(16) for _ in range(80)]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(ids, ids[1:])], "a binary, b binary")
    got = components(links).collect()
    assert len(got) == 80 and {bytes(r["comp"]) for r in got} == {min(ids)}


def test_empty_and_unlinked_tables(spark):
    assert group_near(documents(spark, [])).count() == 0
    assert group_near(documents(spark, [(1, None), (2, "a b"), (3, PROSE)])).filter("kept").count() == 3
