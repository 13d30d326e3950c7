import base64
import random
import string
from collections import Counter

from cases import PROSE, SMALL, awkward, documents

from answerloom.llm.quality_rules import BANDS, keep_good, quality, recoded, repeat_words


def brute_repeat(words):
    counts = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if counts[tuple(words[i:i + 5])] > 1 for k in range(5)})


def test_base_counts_against_brute_force(spark):
    docs = awkward(spark)
    got = quality(docs).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]]
        words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
        lines = text.split("\n")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_dup_lines"] == sum(line in lines[:i] for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r"))
        assert r["n_repeat_words"] == brute_repeat(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_repeat_words_random():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert repeat_words(words) == brute_repeat(words)


def test_bands_reject_noise_and_repetition_and_keep_prose(spark):
    rng = random.Random(7)
    noise = " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(300))
    loop = " ".join(f"row {i} of the same table again and" for i in range(900))
    prose = " ".join(" ".join(rng.sample(PROSE.split() + [f"{a}{b}" for a in "mern" for b in ("ol", "is", "atu", "end")], 40)) for _ in range(2))
    mixed = prose + noise[:9000]
    got = {r["doc_id"]: r["kept"] for r in quality(documents(spark, [(1, noise), (2, loop), (3, PROSE), (4, prose), (5, mixed)])).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}


HINDI = ("सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव "
         "करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आज़ादियों को प्राप्त करने का हक़ है और इस मामले में जाति, वर्ण, लिंग, भाषा, धर्म, राजनीति या अन्य विचार-प्रणाली, "
         "किसी देश या समाज विशेष में जन्म, सम्पत्ति या किसी प्रकार की अन्य मर्यादा आदि के कारण भेदभाव का विचार न किया जाएगा। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है।")
RUSSIAN = ("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
           "Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, "
           "пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения.")
KOREAN = ("모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. "
          "모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해, 민족적 또는 사회적 출신, 재산, 출생 또는 기타의 신분과 같은 어떠한 종류의 차별이 없이, "
          "이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다.")


def test_verdict_does_not_depend_on_the_script(spark):
    latin = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r["text"]]
    latin += [" ".join(latin[i:i + 12]) for i in range(0, len(latin), 12)]
    clean = {r["doc_id"] for r in quality(documents(spark, list(enumerate(latin)))).collect() if r["kept"]}
    assert len(clean) > 100
    other = {i: "".join(chr(at + ord(c)) if c.isascii() and c.isalpha() else c for c in latin[i]) for i in clean for at in (0x400, 0x10A0)[i % 2:i % 2 + 1]}
    natural = {-1: HINDI, -2: RUSSIAN, -3: KOREAN, -4: HINDI[:220], -5: RUSSIAN[:300], -6: KOREAN[:100], -7: f"{RUSSIAN} {PROSE}"}
    got = quality(documents(spark, [*other.items(), *natural.items()])).collect()
    assert [r["doc_id"] for r in got if not r["kept"]] == []
    rng = random.Random(5)
    noise = " ".join("".join(chr(rng.randint(0x410, 0x44F)) for _ in range(40)) for _ in range(90))
    loop = " ".join(f"строка {i} той же таблицы и снова" for i in range(400))
    assert not any(r["kept"] for r in quality(documents(spark, [(1, noise), (2, loop)])).collect())


def test_stretches_of_noise_and_the_tail_are_measured(spark):
    rng = random.Random(11)
    words = [w for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()[:60] if r["lang"] == "en" for w in (r["text"] or "").split()]

    def text(size, noise, where):
        clean = " ".join(rng.choices(words, k=size))[:size - noise]
        at = int(len(clean) * where)
        return clean[:at] + base64.b64encode(rng.randbytes(noise)).decode()[:noise] + clean[at:]

    cases = [(200_000, 45_000, 0.5), (40_000, 9_000, 0.5), (8_191, 2_040, 1.0), (40_000, 0, 0), (8_191, 0, 0), (2_048, 0, 0), (3_000, 0, 0)]
    got = {r["doc_id"]: r for r in quality(documents(spark, [(i, text(*c)) for i, c in enumerate(cases)])).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: True}
    assert (got[2]["n_chunks"], got[2]["n_low_chunks"], got[5]["n_chunks"], got[6]["n_chunks"]) == (4, 1, 1, 2)


def test_stage_filters_rows_only(spark):
    docs = awkward(spark)
    out = keep_good(docs)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"]) for r in quality(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in out.collect()) == kept and 5 in kept


def test_bands_cover_every_length():
    assert [b[0] for b in BANDS] == sorted(b[0] for b in BANDS) and BANDS[-1][0] > 10**12


def test_empty_table(spark):
    assert quality(documents(spark, [])).count() == 0 and keep_good(documents(spark, [])).count() == 0


def test_a_long_text_may_hold_a_table_an_index_and_a_listing(spark):
    rng = random.Random(3)
    words = [w for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()[:60] if r["lang"] == "en" for w in (r["text"] or "").split()]
    table = "\n".join(" | ".join(f"{rng.random() * 100:.2f}" for _ in range(8)) for _ in range(140))
    index = "\n".join(f"{rng.choice(words)}, see page {i}" for i in range(380))
    listing = "\n".join(f"    for (int i = 0; i < n{i % 7}; i++) total[i] += row[i] * {i};" for i in range(140))
    clean = " ".join(rng.choices(words, k=36_000))
    assert min(map(len, (table, index, listing))) > 6_000
    cases = [clean[:len(clean) // 2] + part + clean[len(clean) // 2:] for part in ("", table, index, listing)]
    cases += [clean[:60_000] + table + clean[60_000:120_000], table, listing * 2]
    got = {r["doc_id"]: r["kept"] for r in quality(documents(spark, list(enumerate(cases)))).collect()}
    assert [got[i] for i in range(5)] == [True] * 5 and not got[6]


def test_recoding_has_no_step_at_the_number_of_letters():
    rng = random.Random(2)
    letters = [chr(0x400 + i) for i in range(120)]
    words = ["".join(rng.choices(letters[:40], k=rng.randint(2, 9))) for _ in range(900)]
    text = " ".join(rng.choices(words, k=9000))
    sizes = [len(recoded(text + " " + "".join(chr(0x2500 + i) for i in range(n)))) for n in (80, 88, 89, 130)]
    assert max(sizes) - min(sizes) < 500
