import hashlib
import random

from cases import PROSE, awkward, documents

from answerloom.llm.exact_dedup import drop_copies, grace_classes, group_copies


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    return groups


def test_groups_match_brute_force(spark):
    docs = awkward(spark)
    groups = brute(docs.collect())
    got = group_copies(docs).collect()
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_stage_keeps_one_row_of_each_group_and_its_columns(spark):
    docs = awkward(spark)
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r["text"] or "" for r in out.collect()) == sorted(brute(docs.collect()))


def test_rows_without_any_id(spark):
    docs = documents(spark, [(None, "a"), (None, "a"), (None, None)])
    assert sorted((r["kept"], r["group_size"]) for r in group_copies(docs).collect()) == [(False, 2), (True, 1), (True, 2)]


def test_empty_table(spark):
    assert group_copies(documents(spark, [])).count() == 0 and drop_copies(documents(spark, [])).count() == 0


def test_grace_spills_and_equal_hashes_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    rng = random.Random(5)
    texts = [f"{PROSE}{rng.randrange(400)}".encode() for _ in range(3000)]
    records = [(hash(t) % 7 * 2**61 % 2**64, t, 1, i) for i, t in enumerate(texts)]  # few hashes: many contents share one
    got = {t: (n, top) for _, t, n, top in grace_classes(records, limit=5_000)}
    want = {}
    for i, t in enumerate(texts):
        want[t] = (want.get(t, (0, 0))[0] + 1, i)
    assert got == want and not list(tmp_path.iterdir())
