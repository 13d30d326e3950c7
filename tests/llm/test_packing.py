import zlib
from collections import Counter, defaultdict

from cases import awkward, documents

from answerloom.llm.packing import CAPACITY, bin_patterns, fullest, pack, pattern_runs, run_blocks, vocabulary


def test_whole_table_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark)
    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), CAPACITY):
            part = ids[at:at + CAPACITY]
            want[(r["doc_id"], at // CAPACITY, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    rows = pack(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = gapless(rows)
    assert len(filled) <= -(-sum(filled.values()) // CAPACITY) + 1


def gapless(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return {k: sum(n for _, n in parts) for k, parts in bins.items()}


def test_special_tokens_and_white_space_inside_words(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b  c", "don't stop\x0b<|startoftext|>", "é ́x Σίσυφος'S", "  ", "1234 '' 'll"]
    tokenizer = Tokenizer.from_file(vocabulary())
    for r in pack(documents(spark, list(enumerate(texts)))).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_fullest_is_the_best_subset():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 60)
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts))) <= room)
        got = fullest(counts, room)
        assert sum(k * n for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_patterns_use_every_piece_once():
    histogram = {n: n * 7919 % 13 + 1 for n in range(1, 400, 3)} | {4096: 5}
    patterns = bin_patterns(histogram)
    used = Counter()
    for bins, chosen in patterns:
        assert sum(n * k for n, k in chosen.items()) <= CAPACITY
        for n, k in chosen.items():
            used[n] += bins * k
    assert used == histogram
    runs = pattern_runs(patterns)
    for length, total, blocks, block, own in run_blocks(runs):
        assert total == histogram[length]
        for n in range(total):
            if n * blocks // total == block:
                assert sum(first <= n < first + numbers for first, numbers, *_ in own) == 1


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0
