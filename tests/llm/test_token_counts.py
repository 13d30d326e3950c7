import json
import random

from cases import awkward, documents

from answerloom.llm.packing import vocabulary
from answerloom.llm.token_counts import WORD_END, build, count_tokens, load, symbols_of, words_of


def greedy(pieces, word):
    """Longest match first by slicing; 1 if the word can't be spelt."""
    symbols, count = (*word, WORD_END), 0
    while symbols:
        n = next((n for n in range(len(symbols), 0, -1) if symbols[:n] in pieces), 0)
        if not n:
            return 1
        symbols, count = symbols[n:], count + 1
    return count


def test_random_vocabularies():
    rng = random.Random(9)
    for _ in range(150):
        pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + ((WORD_END,) if rng.random() < 0.4 else ()) for _ in range(rng.randint(2, 25))}
        pieces |= {(97,), (97, WORD_END)} if rng.random() < 0.7 else set()
        automaton = build(sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert automaton.walk(word) == greedy(pieces, word), (pieces, word)


def test_whole_vocabulary_against_slicing(spark):
    with open(vocabulary(), encoding="utf-8") as f:
        pieces = set(symbols_of(json.load(f)["model"]["vocab"]))
    docs = awkward(spark)
    want = {}
    for r in docs.collect():
        lengths = [greedy(pieces, w.encode()) for w in words_of(r["text"] or "")] if len(r["text"] or "") < 5000 else None
        want[r["doc_id"]] = lengths
    got = count_tokens(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None and want[r["doc_id"]] is not None:
            assert (r["n_words"], r["n_tokens"], r["longest_word_tokens"]) == (len(want[r["doc_id"]]), sum(want[r["doc_id"]]), max(want[r["doc_id"]], default=0))


def test_words_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    for text in ("It's 2024, don't! ΣΊΣΥΦΟΣ É́a ½", "x​y    z", "日本 text-with_all"):
        normal = tokenizer.normalizer.normalize_str(text)
        assert [normal[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)] == words_of(text)


def test_long_word_is_walked_once():
    automaton = load()
    assert automaton.walk(b"ab" * 200_000) > 1000


def test_empty_table(spark):
    assert count_tokens(documents(spark, [])).count() == 0
