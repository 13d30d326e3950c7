import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import awkward, documents

from answerloom.llm import token_alignment as ta


def brute(rows):
    """The contract, document by document, with plain sets; ids come from the libraries the vocabularies belong to."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(ta.vocabulary_a())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=ta.vocabulary_b())
    letters = ta.byte_of_letter()
    made = []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_tok.id_to_piece, b))]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == whole:
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
            where_a, where_b = ({int(e): i + 1 for i, e in enumerate(ends)} for ends in (ends_a, ends_b))
            i = j = 0
            for cut in sorted(where_a.keys() & where_b.keys()):
                groups.append((a[i:where_a[cut]], b[j:where_b[cut]]))
                i, j = where_a[cut], where_b[cut]
        made.append((doc_id, groups))
    counts = Counter(pair for _, groups in made for pair in {(x, y) for p, q in groups for x in p for y in q})
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    out = Counter()
    for doc_id, groups in made:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out[(doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
             sum(counts[k] == highest[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")] += 1
    return out


ODD = ["▁ a", "<s>x</s> <|endoftext|> <0x41><unk>", " leading", "two  spaces   three", "\x00nul", "été né", "日本語のテキスト 混ざった mixed",
       "😀😀😀👩‍👩‍👧 done", "a" * 777, " " * 333, "\n\n\t\t\n x", "١٢٣ ٤٥٦", "नमस्ते दुनिया", "1234567890" * 9, "aab" * 100]


@pytest.mark.parametrize("together", [ta.TOGETHER, 1])
def test_every_row_agrees_with_brute_force(spark, together, monkeypatch):
    monkeypatch.setattr(ta, "TOGETHER", together)  # 1: every text is a block
    docs = awkward(spark).unionByName(documents(spark, [(100 + i, t) for i, t in enumerate(ODD)]), allowMissingColumns=True).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in ta.alignment(docs).collect()) == brute(rows)


def test_groups_are_written_out(spark):
    docs = documents(spark, [(1, "tokens don't align"), (2, None)])
    got = {r["doc_id"]: r["groups"] for r in ta.align(docs).collect()}
    assert got[2] == "" and all(len(g.split("|")) == 2 for g in got[1].split(";"))
    assert hashlib.sha256(got[1].encode()).hexdigest() in {r[-1] for r in ta.alignment(docs).collect()}


def test_halving_finds_every_shared_cut():
    rng = random.Random(5)
    for _ in range(300):
        texts = [rng.randint(1, 60) for _ in range(rng.randint(1, 4))]
        ends_a, ends_b, docs_a, docs_b, want, low = [], [], [0], [0], [], 0
        for size in texts:
            a, b = ({low + size} | {low + x for x in range(1, size) if rng.random() < rng.choice([0.02, 0.3, 0.9])} for _ in range(2))
            cuts = sorted({low} | (a & b))[:-1]
            want += [(len(ends_a) + sum(x <= c for x in a), len(ends_b) + sum(x <= c for x in b)) for c in cuts]
            ends_a, ends_b, low = ends_a + sorted(a), ends_b + sorted(b), low + size
            docs_a.append(len(ends_a))
            docs_b.append(len(ends_b))
        first_a, first_b = ta.leaf_groups(*map(np.array, (ends_a, ends_b, docs_a, docs_b)))
        assert list(zip(first_a.tolist(), first_b.tolist())) == want


def test_large_groups_multiply_counts(monkeypatch):
    a, b, first = np.array([3, 3, 4, 5, 3]), np.array([7, 8, 7]), (np.array([0, 4]), np.array([0, 2]))
    plain = ta.linked_pairs(a, b, *first, np.array([0, 0]), 1 << 40)
    monkeypatch.setattr(ta, "SMALL_GROUP", 1)
    for x, y in zip(plain, ta.linked_pairs(a, b, *first, np.array([0, 0]), 1 << 40)):
        assert x.tolist() == y.tolist()
    assert plain[1].sum() == 9


def test_empty_table(spark):
    assert ta.alignment(documents(spark, [])).count() == 0
