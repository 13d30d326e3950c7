"""Toxicity by non-negative positive-unlabelled learning.

A classifier is trained in numpy from confirmed toxic examples and unlabelled text. The share of toxic text (class prior)
corrects the risk: what the positives add to the unlabelled risk is taken off, and where the estimate of the negative
risk falls below zero the step goes the other way, so it can't be overfitted. Features are words (letters only, lower
case) and word beginnings that the positives have significantly more often, by how many different words of the text have
them; the score is a logistic margin, shifted so that 0.7 lies where recall squared over the share taken is best.

Positives are rows of ``labels`` with toxic = 1, unlabelled text is a hash sample of all learnable documents. Labels are
read only for rows whose remainder is not held out; the share of toxic ones among them is the class prior. Both samples
are drawn at a rate that a count gives for ``POSITIVES`` and ``UNLABELLED`` rows (documented bounds).

Null text counts as empty; a text without a known word gets the score of none. If there are no positives, every score
is 0. Repeated label rows count once, conflicting ones as toxic. Every document gives one row; an empty table gives an
empty result; other columns don't matter.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import learnable

MODULUS, HELD_OUT = 3, 1
POSITIVES, UNLABELLED = 2_000, 6_000
LEAST_DOCUMENTS = 5
"""Positives a feature must occur in."""
LEAST_Z = 4.0
VOCABULARY = 400
CACHED_WORDS = 200_000
SHARDS = 16
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def parts_of(word: str) -> list[str]:
    """The word itself and its beginnings of four to eight letters."""
    return [f"{word}$", *(f"^{word[:n]}" for n in range(4, min(len(word), 9)))]


def levels(counts: dict[str, int]) -> set[str]:
    """Features: a part occurs in one, two, or four and more different words of the text."""
    return {f"{part}{least}" for part, n in counts.items() for least in (1, 2, 4) if n >= least}


def features_of(words: set[str]) -> set[str]:
    return levels(Counter(part for word in words for part in parts_of(word)))


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.parts = {name[:-1] for name in self.weights}
        self.known: dict[str, tuple[str, ...]] = {}

    def margin(self, features: set[str]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features & self.weights.keys()))

    def score(self, text: str | None) -> float:
        counts: Counter[str] = Counter()
        for word in words_of(text):
            parts = self.known.get(word)
            if parts is None:
                if len(self.known) > CACHED_WORDS:
                    self.known.clear()
                parts = self.known[word] = tuple(p for p in parts_of(word) if p in self.parts)
            if parts:
                counts.update(parts)
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(levels(counts)) + self.shift, -40, 40))))


def scores(p: dict[str, int], u: dict[str, int], n_p: int, n_u: int) -> dict[str, float]:
    """z values of the features that occur significantly (LEAST_Z) and at least twice as often in the positives."""
    found = {}
    for name, n in p.items():
        if n >= LEAST_DOCUMENTS and n / n_p >= 2 * u.get(name, 0) / n_u:
            z = (n / n_p - u.get(name, 0) / n_u) / np.sqrt((n + u.get(name, 0)) / (n_p + n_u) * (1 / n_p + 1 / n_u))
            if z >= LEAST_Z:
                found[name] = z
    return found


def first_of(found: dict[str, float]) -> list[str]:
    return sorted(found, key=lambda f: (-found[f], f))[:VOCABULARY]


def select_features(positive: list[set[str]], unlabelled: list[set[str]]) -> list[str]:
    p, u = Counter(f for s in positive for f in s), Counter(f for s in unlabelled for f in s)
    return first_of(scores(p, u, len(positive), len(unlabelled)))


def restricted(positive: list[str], unlabelled: list[str]) -> tuple[list[set[str]], list[set[str]]]:
    """Feature sets of samples (distinct words, joined by spaces), reduced to the significant features.

    Words are counted by shards of their first letter, which all parts of a word share, so the counters stay small; of the
    unlabelled text only parts count that enough positives have."""
    found: dict[str, float] = {}
    for shard in range(SHARDS):
        own = [[w for w in words.split() if ord(w[0]) % SHARDS == shard] for words in positive]
        p = {f: n for f, n in Counter(f for words in own for f in features_of(set(words))).items() if n >= LEAST_DOCUMENTS}
        parts, u = {f[:-1] for f in p}, Counter()
        for words in unlabelled:
            counts = Counter(part for w in words.split() if ord(w[0]) % SHARDS == shard for part in parts_of(w) if part in parts)
            u.update(f for f in levels(counts) if f in p)
        found |= scores(p, u, len(positive), len(unlabelled))
    names = set(first_of(found))
    parts = {f[:-1] for f in names}

    def features(words: str) -> set[str]:
        return levels(Counter(part for w in words.split() for part in parts_of(w) if part in parts)) & names

    return [features(w) for w in positive], [features(w) for w in unlabelled]


def nn_pu(positive: list[set[str]], unlabelled: list[set[str]], prior: float, epochs: int = 60, batch: int = 500, penalty: float = 1e-3) -> ToxicModel:
    """Linear model under the non-negative risk with the logistic loss, by Adam over shuffled batches of both samples.

    risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]); a batch whose second part is negative
    descends on minus that part alone. Samples come as sets of features.
    """
    names = select_features(positive, unlabelled)
    at = {w: i for i, w in enumerate(names)}
    rows = [np.array(sorted(at[w] for w in s if w in at), np.int64) for s in positive + unlabelled]
    n_pos, rng = len(positive), np.random.default_rng(7)
    w, m, v = (np.zeros(len(names) + 1) for _ in range(3))  # the last entry is the bias

    def sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = np.concatenate([rows[i] for i in part]) if len(part) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
        return np.bincount(owner, w[index], len(part)) + w[-1], index, owner

    def gradient(index: np.ndarray, owner: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(index, by_row[owner], len(names)), by_row.sum())

    step = 0
    batches = max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        for pos, unl in zip(np.array_split(rng.permutation(n_pos), batches), np.array_split(rng.permutation(np.arange(n_pos, len(rows))), batches)):
            if not len(pos) or not len(unl):
                continue
            zp, ip, op = sums(pos)
            zu, iu, ou = sums(unl)
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_negative = gradient(iu, ou, su / len(unl)) - prior * gradient(ip, op, sp / len(pos))
            g = prior * gradient(ip, op, (sp - 1) / len(pos)) + g_negative if negative >= 0 else -g_negative
            g[:-1] += penalty * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = ToxicModel({name: float(x) for name, x in zip(names, w) if abs(x) > 1e-3}, float(w[-1]))
    return calibrate(model, positive, unlabelled, prior)


def calibrate(model: ToxicModel, positive: list[set[str]], unlabelled: list[set[str]], prior: float) -> ToxicModel:
    """Slope by the prior-corrected logistic risk; shift so that THRESHOLD lies at the cut with the greatest
    recall^2 / (share of unlabelled text above it), which is precision times recall up to the prior."""
    zp, zu = np.array([model.margin(s) for s in positive]), np.array([model.margin(s) for s in unlabelled])
    best = (np.inf, 1.0)
    for slope in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0):
        for shift in np.linspace(-10, 10, 81):
            p, u = slope * zp + shift, slope * zu + shift
            negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
            best = min(best, (prior * np.logaddexp(0, -p).mean() + max(0.0, negative), slope))
    cuts = np.unique(zp)
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts) / len(z)
    at = int((above(zp) ** 2 / np.maximum(above(zu), 1 / len(zu))).argmax())
    cut = (cuts[at] + max(zu[zu < cuts[at]], default=cuts[at])) / 2  # halfway to the next lower text
    return ToxicModel(model.weights, model.bias, best[1], float(np.log(THRESHOLD / (1 - THRESHOLD)) - best[1] * cut))


def _sampled(df: DataFrame, n: int) -> list[str]:
    """Distinct words, joined by spaces, of a hash sample of about n rows."""
    total = df.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = df.filter(place < n / max(1, total)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(words_of(t.as_py()))) for t in batch.column(0)], pa.string())], ["words"])

    return sorted(r["words"] for r in chosen.mapInArrow(run, "words string").collect())


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    known = labels.filter((learnable("doc_id", MODULUS) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return ToxicModel({}, -40.0)
    open_docs = docs.select("doc_id", "text").filter(learnable("doc_id", MODULUS) != HELD_OUT)
    toxic = open_docs.join(known.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    positive, unlabelled = _sampled(toxic, POSITIVES), _sampled(open_docs, UNLABELLED)
    if not positive or not unlabelled:
        return ToxicModel({}, -40.0)
    return nn_pu(*restricted(positive, unlabelled), min(0.95, float(share)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (learnable("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
