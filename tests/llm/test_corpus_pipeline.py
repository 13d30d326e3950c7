"""The pipeline's rows against plain Python on the whole small table, stage by stage."""
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import zstandard
from cases import SMALL, awkward
from test_minhash_dedup import brute
from test_mixing import water_fill

from answerloom.llm.packing import CAPACITY, vocabulary
from answerloom.llm.quality_rules import measure


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        place = str(tmp_path_factory.mktemp("stage"))
        stage(spark, out[-1], SMALL).write.mode("overwrite").parquet(place)
        out.append(spark.read.parquet(place))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_and_dedup_stages(stages):
    docs, good, exact, near = stages[:4]
    z = zstandard.ZstdCompressor(level=3)
    assert rows(good) == Counter(tuple(r) for r in docs.collect() if measure(None, r["text"], z)[7])
    last = {}
    for r in good.collect():
        last[r["text"]] = max(last.get(r["text"], r), r, key=lambda x: x["doc_id"])
    assert rows(exact) == Counter(map(tuple, last.values()))
    before = exact.collect()
    assert rows(near) == Counter(tuple(r) for r, (_, comp) in zip(before, brute(before)) if r["doc_id"] == comp)


def test_mixing_stage(stages):
    near, mixed = stages[3:5]
    sizes, taken, text = defaultdict(int), defaultdict(int), {}
    for r in near.collect():
        sizes[r["source"]] += len(r["text"].split())
        text[r["doc_id"]] = r
    copies = defaultdict(int)
    for r in mixed.collect():
        whole = text[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
        copies[r["doc_id"]] += 1
        assert whole["text"].startswith(r["text"]) and r["source"] == whole["source"]
    assert all(n <= 2 for n in copies.values())
    assert {s: round(t) for s, t in water_fill(sizes).items() if round(t)} == dict(taken)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(vocabulary()), Counter()
    for r in stages[4].collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), CAPACITY):
            want[(r["doc_id"], at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + CAPACITY])))] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in stages[5].collect()) == want


def test_stages_stand_awkward_rows(spark):
    docs = awkward(spark, extra=False)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_run_gives_the_rows_of_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages[5].count()
