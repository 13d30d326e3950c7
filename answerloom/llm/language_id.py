"""Language ID by hierarchical discrimination.

Level one tells language families apart (one-versus-one linear support vector machines between families), level two runs
one-versus-one linear support vector machines among the languages of the chosen family only. Features are hashed byte
1- to 4-grams of the lower-cased letters of the whole text, as square roots of relative frequencies, so length plays no
part. The machines are trained in numpy on a sample and scored over all texts in Arrow batches.

The sample is drawn by a hash of the text at a rate of ``SAMPLE`` documents per language (a documented bound; the rate
follows from a count), and for every document a window of it joins as a second example, so short texts are met too.

Null text and text without a letter are ``und`` with score 0. So is everything if nothing was learnt. Rows without a
language are not learnt from; unknown language codes form a family of their own. Repeated rows give repeated results,
an empty table an empty result; other columns don't matter.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import learnable

SAMPLE = 500
"""Documents per language that the machines are fitted on, in expectation."""
DIMENSIONS = 4096
GRAMS = 4
MODULUS = 5
BATCH_BYTES = 1 << 21
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return FAMILY.get(re.split("[-_]", lang.lower())[0], f"own:{lang}")


def letters(text: str) -> bytes:
    return b" " + NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") + b" "


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of the shares of hashed byte n-grams that lie inside the text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, raw in enumerate(texts):
        total = np.zeros(DIMENSIONS, np.int64)
        for at in range(0, len(raw), BATCH_BYTES):
            codes = np.frombuffer(raw[at:at + BATCH_BYTES + GRAMS - 1], np.uint8).astype(np.uint32)
            starts = min(BATCH_BYTES, len(raw) - at)
            rolling = np.zeros(len(codes), np.uint32)
            for n in range(GRAMS):
                m = len(codes) - n
                if m <= 0:
                    break
                rolling = rolling[:m] * np.uint32(0x01000193) + codes[n:] + np.uint32(n + 1)
                kept = rolling[:min(m, starts)]
                mixed = (kept ^ (kept >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                total += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
        out[row] = np.sqrt(total / max(1, total.sum()))
    return out


@dataclass
class Machine:
    """Linear machine between two classes: positive margins speak for ``one``; ``slope`` turns margins into shares."""

    one: str
    two: str
    weights: np.ndarray
    bias: float
    slope: float


def fit_machine(one: str, two: str, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> Machine:
    """Squared hinge loss with classes weighed alike, by accelerated gradient descent."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (2.0 * (1.0 + 1.0) + penalty)  # rows have unit length, and the bias adds one
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for step in range(steps):
        slack = share * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = y * slack
        grad = penalty * v - 2 * np.append(pull @ x, pull.sum()).astype(np.float32)
        new = v - rate * grad
        v = new + step / (step + 3) * (new - w)
        w = new
    margins = np.abs(x @ w[:-1] + w[-1])
    return Machine(one, two, w[:-1], float(w[-1]), float(3.0 / max(1e-3, np.median(margins))))


@dataclass
class Discriminator:
    """Pairwise machines among names, and who is left when there is but one."""

    names: list[str]
    machines: list[Machine]

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes (then the greater sum of margins), and its mean share against the others."""
        votes, share = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for m in self.machines:
            for_one = 1 / (1 + np.exp(-np.clip(m.slope * (x @ m.weights + m.bias), -30, 30)))
            for name, part in ((m.one, for_one), (m.two, 1 - for_one)):
                at = self.names.index(name)
                votes[:, at] += part > 0.5
                share[:, at] += part / max(1, len(self.names) - 1)
        best = (votes + share / 2).argmax(1)
        return best, share[np.arange(len(x)), best] if self.machines else np.ones(len(x))


def fit_discriminator(x: np.ndarray, labels: np.ndarray) -> Discriminator:
    names = sorted(set(labels))
    machines = []
    for one, two in combinations(names, 2):
        rows = (labels == one) | (labels == two)
        machines.append(fit_machine(one, two, x[rows], np.where(labels[rows] == one, 1, -1).astype(np.float32)))
    return Discriminator(names, machines)


@dataclass
class LanguageModel:
    families: Discriminator
    within: dict[str, Discriminator]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.families.names else []
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            x = features([letters(texts[i]) for i in part])
            family, sure = self.families.choose(x)
            for f in np.unique(family):
                own = np.flatnonzero(family == f)
                inside = self.within[self.families.names[f]]
                lang, sure_inside = inside.choose(x[own])
                for k, code, s in zip(own, lang, sure[own] * sure_inside):
                    langs[part[k]], scores[part[k]] = inside.names[code], float(s)
        return langs, scores


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """Whole texts and, of each, a window of 20 to 80 letters from a place given by its hash."""
    cut = [letters(t) for t in texts]
    places = np.random.default_rng(1).random((len(cut), 2))
    windows = [c[(s := int(p * max(0, len(c) - 20))):s + 20 + int(60 * q)] for c, (p, q) in zip(cut, places)]
    x = features(cut + windows)
    labels = np.array(langs * 2, dtype=object)
    families = np.array([family_of(code) for code in labels], dtype=object)
    within = {f: fit_discriminator(x[families == f], labels[families == f]) for f in sorted(set(families))}
    return LanguageModel(fit_discriminator(x, families) if len(x) else Discriminator([], []), within)


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on a hash sample of the learnable rows. Only the counts per language and the sample reach the driver."""
    known = docs.select(F.col("doc_id").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & (learnable("doc_id", MODULUS) != 0))
    counts = known.groupBy("lang").count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(counts), "lang").filter((place < sample / F.col("count")) & F.col("text").rlike(r"\p{L}"))
    rows = sorted(chosen.select("lang", "text").distinct().collect())
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (learnable("doc_id", MODULUS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
