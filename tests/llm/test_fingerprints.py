import hashlib
import random
from collections import Counter

import numpy as np
from cases import PROSE, awkward, documents
from pyspark.sql import functions as F

from answerloom.llm import fingerprints as fp


def plain_set(text):
    """Shingles as plain strings."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows_in_order(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    tie = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    return sorted(rows, key=lambda r: (fp.LEAST if r[0] is None else r[0], tie[r[1]]), reverse=True)


def brute(spark, docs):
    out = Counter()
    rows = rows_in_order(spark, docs)
    for i, (doc_id, text) in enumerate(rows):
        half, following = len(text) // 2, rows[(i + 1) % len(rows)][1]
        edited = text[:len(text) - half] + following[:half]
        a, b, c = (fp.sketches([t])[0] for t in (text, edited, following))
        out[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c))] += 1
    return out


def test_every_row_agrees_with_brute_force(spark):
    docs = awkward(spark).unionByName(documents(spark, [(50 + i % 9, f"{PROSE} {i}") for i in range(60)] + [(None, f"void {i}") for i in range(40)]),
                                      allowMissingColumns=True)
    assert Counter(tuple(r) for r in fp.near_edited(docs).collect()) == brute(spark, docs)


def test_one_row_and_empty_table(spark):
    (row,) = fp.near_edited(documents(spark, [(5, PROSE)])).collect()
    assert row["near_next"] == 1 and row["n_chars"] == len(PROSE)
    assert fp.near_edited(documents(spark, [])).count() == 0


def test_sketches_hold_the_hashes_of_plain_shingles():
    rng = random.Random(3)
    texts = ["", " \n", "one", "a b c d", PROSE, "été naïve " * 7] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    every = {s for t in texts for s in plain_set(t)}
    code = {s: fp.sketches([s.decode()])[0][0] for s in every}
    assert len(set(code.values())) == len(every)
    for text, sketch in zip(texts, fp.sketches(texts)):
        assert sketch.tolist() == sorted(code[s] for s in plain_set(text))[:fp.K]


def test_parts_of_a_long_text_merge_to_its_sketch():
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    assert fp.sketches([text], part=700)[0].tolist() == fp.sketches([text])[0].tolist()
    assert fp.read(fp.written(fp.sketches([text])[0])).tolist() == fp.sketches([text])[0].tolist()


def test_estimates_are_close(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    texts = [" ".join(words), " ".join(words[:3000]), " ".join(words[2000:]), "", " ".join(words[:40])]
    docs = documents(spark, list(enumerate(texts)))
    a, b = (fp.fingerprints(docs).select(F.col("doc_id").alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    s, t = F.col("sa"), F.col("sb")
    rows = a.crossJoin(b).select("a", "b", fp.resemblance(s, t).alias("r"), fp.containment(s, t).alias("c"), fp.distinct_shingles(s).alias("n"), "sa", "sb").collect()
    sets = list(map(plain_set, texts))
    for r in rows:
        x, y = sets[r["a"]], sets[r["b"]]
        assert abs(r["r"] - (len(x & y) / len(x | y) if x | y else 1)) < 0.1
        assert r["r"] == fp.likeness(np.array(r["sa"], np.uint64), np.array(r["sb"], np.uint64))
        assert abs(r["n"] - len(x)) <= 0.2 * len(x)
        assert len(y) > 10 * len(x) or abs(r["c"] - (len(x & y) / len(x) if x else 1)) < 0.2


def test_merging_rows_gives_the_sketch_of_all(spark):
    texts = {(g, i): " ".join(f"g{g}w{i * 50 + j}" for j in range(60)) for g in (1, 2) for i in range(20)} | {(3, 0): ""}
    rows = spark.createDataFrame([(g, g * 100 + i, t) for (g, i), t in texts.items()], "g int, doc_id long, text string")
    prints = fp.fingerprints(rows).join(rows.select("g", "doc_id"), "doc_id")
    got = {r["g"]: r["sketch"] for r in fp.merge(prints, ["g"]).collect()}
    for g in (1, 2, 3):
        assert got[g] == fp.merged(fp.sketches([t for (h, _), t in texts.items() if h == g])).tolist()


def test_hot_ids_have_ranges_of_their_own():
    cuts = np.array([1, 5, 5, 5, 9])
    ids, ties = np.array([0, 1, 2, 5, 5, 5, 6, 9, 10]), np.array([0, 0, 0, -2**63, 0, 2**63 - 1, 0, 0, 0])
    assert fp.range_of(cuts, ids, ties).tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 5]
