import zlib

import numpy as np
from cases import SMALL, awkward, documents

from answerloom.llm import language_id
from answerloom.llm.language_id import DIMENSIONS, GRAMS, features, fit, identify, letters


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    unseen = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(unseen) > 20 and np.mean(unseen) >= 0.95


def test_awkward_rows_and_no_letters(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    assert got[1] == got[2] == got[3] == "und" and all(v in ("und", "en", "xx") for v in got.values())
    assert identify(documents(spark, [(1, "12 + 3"), (2, "word")])).filter("lang_pred <> 'und'").count() == 0  # nothing to learn from
    assert identify(documents(spark, [])).count() == 0


def test_language_source_and_id_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    plain = {r["text"]: r for r in docs.collect()}
    texts = sorted(plain)[:40]
    again = identify(documents(spark, [(10_000 + i, t, "zz", "other") for i, t in enumerate(texts)]), model).collect()
    assert [r["lang_pred"] for r in sorted(again, key=lambda r: r["doc_id"])] == model.predict(texts)[0]


def test_features_count_every_gram_inside_the_text(monkeypatch):
    monkeypatch.setattr(language_id, "BATCH_BYTES", 7)
    raw = letters("Ein kurzer Text, écrit là.")
    want = np.zeros(DIMENSIONS)
    for n in range(GRAMS):
        for i in range(len(raw) - n):
            code = 0
            for k in range(n + 1):
                code = (code * 0x01000193 + raw[i + k] + k + 1) % 2**32
            want[((code ^ (code >> 15)) * 0x85EBCA6B % 2**32) >> 20] += 1
    assert np.allclose(features([raw])[0], np.sqrt(want / want.sum()), atol=1e-6)


def test_families_separate_before_languages():
    texts = ["the ship and the shore were here"] * 20 + ["das schiff und die see waren hier"] * 20 + ["le bateau et la mer sont ici"] * 20 + ["el barco y el mar son de aqui"] * 20
    model = fit(texts, ["en"] * 20 + ["de"] * 20 + ["fr"] * 20 + ["es"] * 20)
    assert model.families.names == ["germanic", "romance"] and model.within["romance"].names == ["es", "fr"]
    assert model.predict(["the shore", "die see", "la mer est", "el mar"])[0] == ["en", "de", "fr", "es"]


def test_long_text_is_read_to_its_end():
    model = fit(["aaa bbb ccc"] * 9 + ["xxx yyy zzz"] * 9, ["en"] * 9 + ["de"] * 9)
    assert model.predict(["aaa bbb " * 100 + "xxx yyy " * 200_000])[0] == ["de"]
