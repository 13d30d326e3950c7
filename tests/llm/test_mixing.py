from collections import defaultdict

import pytest
from cases import awkward, documents

from answerloom.llm.mixing import draw, mix


def water_fill(sizes):
    """Share, cap, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(docs):
    mixed, m = mix(docs)
    rows = mixed.selectExpr("source", f"{m}.*").collect()
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water_fill(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and taken[s] == round(goal[s] + 1e-9) and all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    return rows


def test_targets_and_exact_budgets(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 50)), "en", f"s{i % 7 * i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, "hot word " * 30, "en", "hot") for i in range(300)]
    docs = documents(spark, rows).repartition(5)
    first = sorted(map(tuple, check(docs)), key=str)
    assert first == sorted(map(tuple, check(docs.repartition(3))), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert len(check(docs)) == docs.count()
    assert draw(docs).columns == docs.columns


def test_draw_takes_the_words_of_the_mix(spark):
    docs = documents(spark, [(i, f"  a{i} b{i}\nc{i}\t d{i} " * (i % 4 + 1), "en", "abc"[i % 3]) for i in range(60)])
    mixed, m = mix(docs)
    want = {r["doc_id"]: r["taken"] for r in mixed.selectExpr("doc_id", f"{m}.taken").collect() if r["taken"]}
    got, whole = defaultdict(int), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in draw(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert whole[r["doc_id"]].startswith(r["text"])
    assert dict(got) == want


def test_empty_table(spark):
    assert mix(documents(spark, []))[0].count() == 0 and draw(documents(spark, [])).count() == 0
