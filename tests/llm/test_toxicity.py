import random
import zlib

from cases import PROSE, awkward, documents

from answerloom.llm.toxicity import ToxicModel, nn_pu, features_of, toxicity, words_of


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def corpus(rng, n):
    words = [f"{a}{b}{c}" for a in "brst" for b in ("al", "en", "ir", "ot") for c in ("da", "me", "ni", "so", "tu")]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = rng.choices(words, k=rng.randint(8, 60))
        if toxic:
            for w in rng.sample(["vileword", "nastyterm", "foulname", "gunkier"], 2):
                text[rng.randrange(len(text))] = w
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return rows, labels, {i: any(w in t for w in ("vile", "nasty", "foul", "gunk")) for i, t in rows}


def test_held_out_recall_and_precision(spark):
    rows, labels, truth = corpus(random.Random(3), 1500)
    got = toxicity(documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    hits = [(r["predicted"] == 1, truth[r["doc_id"]]) for r in got if r["held_out"]]
    both = sum(a and b for a, b in hits)
    assert both >= 0.95 * sum(b for _, b in hits) and both >= 0.9 * sum(a for a, _ in hits)


def test_held_out_labels_are_not_read(spark):
    rows, labels, _ = corpus(random.Random(5), 400)
    docs = documents(spark, rows)
    turned = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    one, two = (sorted(map(tuple, toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert one == two


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (7, 0), (None, 1), (6, None), (999, 1)], "doc_id long, toxic int")
    assert toxicity(docs, labels).count() == docs.count()
    assert toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity(documents(spark, []), labels).count() == 0


def test_prior_keeps_unlabelled_positives_positive():
    rng = random.Random(8)
    rows, _, truth = corpus(rng, 3000)
    sets = [(features_of(words_of(t)), truth[i]) for i, t in rows]
    model = nn_pu([s for s, y in sets[:1500] if y], [s for s, _ in sets[1500:]], 0.15)
    scored = [(model.score(t), truth[i]) for i, t in rows[1500:]]
    assert sum(s >= 0.7 for s, y in scored if y) >= 0.95 * sum(y for _, y in scored)
    assert sum(s >= 0.7 for s, y in scored if not y) <= 0.05 * len(scored)


def test_scoring_equals_feature_margin():
    model = ToxicModel({"^foul1": 2.0, "^foul2": 1.0, "foulname$1": 0.5, "^keep4": -1.0}, -1.5, 2.0, 0.25)
    for text in ("foulname fouled", "keepa keepb keepc keepd foul fouls", "", PROSE):
        z = 2.0 * model.margin(features_of(words_of(text))) + 0.25
        assert abs(model.score(text) - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9
