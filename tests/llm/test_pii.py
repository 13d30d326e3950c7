import hashlib
import random
import re

import numpy as np
import pytest
from cases import awkward, documents
from pyspark.sql import functions as F

from answerloom.llm import pii
from answerloom.llm.pii import FEATURES, GENERATORS, HINT, KINDS, Boosted, Split, boost, calibrated, matches, personal_data, redact, train

# The base rules of the contract, written plainly.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    spans = [(m.start(), n, k, m.end()) for n, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if good(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


ODD = ["a@b.c._x@d.e", "x@y", "..a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111-1111 1111 and 4111 1111 1111 1112", "+1 (375) 555-4393.", "+12 ) . 3",
       "😀 é mail me: ann.lee+x@mail.example.co.uk, or +49 30 901820-00!", "4" * 400, "+" + "1 " * 300, "a" * 3000 + "@x.y" + "b" * 3000, "1." * 2000, "tel +1.375.555.4393 4539 1488 0343 6467",
       "a@b.c@d.e.f-g@h.i", "%%@-.-", "١٢٣.4.5.6 1.1.1.1"]


def check(spark, docs, models=None):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = personal_data(docs, models).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (rows[r["doc_id"]][:80], r["spans"], want)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(f"{k}:") for w in want) for k in KINDS]
        assert set(want) <= set(r["spans"].split(",")) or not want
    return got


NOTHING = {k: Boosted([]) for k in KINDS}


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(6)
    alphabet = "a.@-+ 0123456789()%_é"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(400)]
    check(spark, documents(spark, list(enumerate(texts))), NOTHING)


def test_base_spans_of_short_digit_groups(spark):
    rng = random.Random(8)

    def grouped(digits, between, most):
        out, at = [], 0
        while at < len(digits):
            n = rng.randint(1, most)
            out.append(digits[at:at + n])
            at += n
        return "".join(g + (rng.choice(between) if i + 1 < len(out) else "") for i, g in enumerate(out))

    texts = ["453 914 880 343 646 7", "+1 2 3 4 5 6 7 8 9 0"]
    for i in range(300):
        digits = "".join(rng.choices("0123456789", k=rng.randint(8, 20)))
        if i % 2:
            digits = next(digits[:-1] + d for d in "0123456789" if luhn(digits[:-1] + d))
        texts.append(rng.choice(["", "a ", "é+", "+"]) + grouped(digits, " -", rng.randint(1, 3)) + rng.choice(["", " b"]))
        texts.append("call +" + grouped(digits[:15], [" ", "-", ".", "(", ") "], rng.randint(1, 3)))
    got = check(spark, documents(spark, list(enumerate(texts))), NOTHING)
    assert sum(r["n_card"] for r in got) > 50 and sum(r["n_phone"] for r in got) > 50
    redacted = {r["doc_id"]: r["text"] for r in redact(documents(spark, list(enumerate(texts[:2]))), NOTHING).collect()}
    assert redacted == {0: "[card]", 1: "[phone]"}


def test_hints_let_every_proposal_through(spark):
    texts = ["+1 2 3 4 5 6 7 8", "+(1 2 3 4 5 6 7", "fe:ab:cd:ef", "abcd:ef::ab", "a [at] b.c", "é@b.c", "1.2.3.4:5", "(12) 34 567", "4539 14 88"]
    for kind in GENERATORS:
        for pattern in GENERATORS[kind]:
            docs = documents(spark, list(enumerate(texts)))
            r = docs.select(F.sum(F.size(matches("text", pattern, HINT[kind]))).alias("hinted"), F.sum(F.size(matches("text", pattern, ""))).alias("all")).first()
            assert r["hinted"] == r["all"] > 0, (kind, pattern, r)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert personal_data(docs).count() == docs.count()
    assert personal_data(documents(spark, [])).count() == 0
    assert redact(docs).columns == docs.columns


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(12)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"please phone +1 {number()} before noon, page {i} of {rng.randint(100, 999)} was read" for i in range(300)]
    texts += [f"release {rng.randint(10, 99)}.{rng.randint(10, 99)}/{rng.randint(100, 999)} and part {rng.randint(10, 99)} {rng.randint(100, 999)}/{rng.randint(10, 99)} of {i}" for i in range(300)]
    return train(documents(spark, list(enumerate(texts))))


def test_trees_add_spans_like_confirmed_ones_and_leave_others(spark, learnt):
    text = "please phone (375) 555-4393 before noon, release 11.22/333 and part 44 555/66 of 7"
    got = check(spark, documents(spark, [(1, text), (2, "nothing here")]), learnt)
    at = text.index("(375)")
    assert {r["doc_id"]: r["spans"] for r in got} == {1: f"phone:{at}:{at + 14}", 2: ""}


def test_shapes_that_base_rules_miss_are_found_however_common(spark):
    rng = random.Random(13)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    group = lambda: f"{rng.randint(0x1000, 0xffff):x}"
    texts = [f"please phone {'' if i % 3 == 0 else '+1 '}{number()} before noon" for i in range(300)]
    texts += [f"release {rng.randint(10, 99)}.{rng.randint(10, 99)}/{rng.randint(100, 999)} of {i}" for i in range(300)]
    texts += [f"server {':'.join(group() for _ in range(8))} and part {':'.join(f'{rng.randint(10, 99)}' for _ in range(4))}" for _ in range(150)]
    texts += [f"ask ann{i} [at] mail{i} [dot] org or x{i}@y" for i in range(150)]
    models = train(documents(spark, list(enumerate(texts))))
    text = "please phone (375) 555-4393 before noon, release 11.22/333, server 20fe:1db8:a1b2:c3d4:e5f6:1a2b:3c4d:5e6f and part 11:22:33:44, ask bob7 [at] mail5 [dot] org"
    spans = check(spark, documents(spark, [(1, text)]), models)[0]["spans"].split(",")
    assert [s.split(":")[0] for s in spans] == ["phone", "ip", "email"]


def test_every_proposal_shapes_trees_and_thresholds(spark):
    rng = random.Random(14)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"please phone {'+1 ' if rng.random() < 0.6 else ''}{number()} before noon {i}" for i in range(300)]
    texts += [f"lot {number()} of {i}, see 10.0.{i % 300}.7 or {'x' * 2000}{i}@y.org" for i in range(300)]
    docs = documents(spark, list(enumerate(texts + texts[:200])))
    rows = pii.proposals(docs).collect()
    assert sum(r.n for r in rows) == sum(r.n for r in pii.proposals(docs.dropDuplicates(["text"])).collect()) > 1200
    models = train(docs.repartition(7))
    assert models == train(docs.coalesce(1))
    for n, kind in enumerate(KINDS):
        halves = [[r for r in rows if r.kind == n and r.half == half] for half in (0, 1)]
        x, y = ([np.repeat(np.array([getattr(r, c) for r in part], float).reshape(-1, *tail), [r.n for r in part], 0) for part in halves] for c, tail in (("x", (len(FEATURES),)), ("y", ())))
        free = np.repeat([r.free for r in halves[1]], [r.n for r in halves[1]])
        plain = calibrated(boost(x[0], y[0]), x[1], y[1], free)
        assert np.allclose(plain.margin(x[1]), models[kind].margin(x[1]), atol=1e-4)
        assert (models[kind].margin(x[1]) >= models[kind].threshold).sum() == (plain.margin(x[1]) >= plain.threshold).sum()


def test_no_python_runs_on_the_executors(spark):
    rng = random.Random(15)
    docs = documents(spark, [(i, f"please phone +1 375 {rng.randint(200, 999)} {rng.randint(1000, 9999)} or 10.0.{i}.7, lot {i} 222 333 4444") for i in range(60)])
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    models = train(docs)
    assert models["phone"].trees
    personal_data(docs, models).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    count = store.executionsCount() - before
    run = store.executionsList()
    plans = [run.apply(i).physicalPlanDescription() for i in range(run.size() - count, run.size())]
    assert len(plans) > 4 and not [p for p in plans if re.search("InArrow|InPandas|EvalPython", p)]


def test_redaction(spark, learnt):
    docs = documents(spark, [(1, "é a@b.cd and 10.0.0.1!"), (2, None), (3, "clean")], extra=True)
    assert {r["doc_id"]: r["text"] for r in redact(docs, learnt).collect()} == {1: "é [email] and [ip]!", 2: None, 3: "clean"}


def test_boosting_learns_and_thresholds_hold():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (800, len(FEATURES))).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 3] <= 3)).astype(float)
    model = calibrated(boost(x[:400], y[:400]), x[400:], y[400:])
    assert np.isfinite(model.threshold) and y[400:][model.margin(x[400:]) >= model.threshold].mean() >= 0.98
    assert not np.isfinite(calibrated(boost(x, np.zeros(len(x))), x, np.zeros(len(x))).threshold)
    assert Split(1, 2.5, -1.0, Split(0, 0.5, 0.25, 1.0)).sql("f") == "CASE WHEN f[1] <= 2.5 THEN -1.0D ELSE CASE WHEN f[0] <= 0.5 THEN 0.25D ELSE 1.0D END END"


def test_numbers_that_nothing_confirms_are_left_alone(spark):
    """Numbers of a phone's shape in a corpus whose phones have a plus: nothing tells them apart but what stands around."""
    rng = random.Random(21)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    lots = [f"lot {number()} of timber" for _ in range(600)]
    for phones in ([f"please phone +1 {number()} before noon" for _ in range(300)], [f"reach us under +1 {number()} today" for _ in range(300)]):
        rows = personal_data(documents(spark, list(enumerate(lots))), train(documents(spark, list(enumerate(lots + phones))))).collect()
        assert sum(r["spans"] != "" for r in rows) <= 0.02 * len(lots)


def test_cards_that_fail_their_checksum_are_left_alone(spark):
    rng = random.Random(22)

    def card(valid, between):
        body = "".join(rng.choices("0123456789", k=15))
        digits = next(body + d for d in "0123456789" if luhn(body + d) == valid)
        return between.join(digits[i:i + 4] for i in range(0, 16, 4))

    models = train(documents(spark, [(i, f"paid by card {card(True, ' ')} at noon {i}") for i in range(400)]))
    texts = [f"paid by card {card(False, '.')} at noon" for _ in range(50)] + [f"paid by card {card(True, '.')} at noon" for _ in range(50)]
    got = {r["doc_id"]: r["spans"] for r in personal_data(documents(spark, list(enumerate(texts))), models).collect()}
    assert all(got[i] == "" for i in range(50)) and sum(got[i].startswith("card") for i in range(50, 100)) >= 45
