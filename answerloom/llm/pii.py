"""Personal data: base rules, and candidates that gradient boosting selects; DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are leftmost matches of fixed patterns that pass a check. Beside them, generous
generators propose overlapping spans of each kind (other separators, no plus sign, written-out at and dot, IPv6, ...).
Boosted trees of depth two score a proposal by format (lengths, digit groups, separators) and context (characters and words
around it, the kind's own check). They are fitted on the proposals of all texts, by sums of gradients that the tasks make, taking those on a base span of their
kind and those that pass a check and have no word that speaks against it (``confirmed``) as confirmed, and all others, also those that no
check decides, as not. They are calibrated on the other half of the texts: a kind's threshold is the lowest score from which on at least
PRECISION of the held-out proposals are confirmed, and as many of those that touch no base span, since only such are added. Trees and
thresholds then are SQL expressions. A proposal that passes, meets its kind's check (Luhn, octets or IPv6 groups, resolvable
address, number of digits) and touches no base span or better proposal is added.

Positions are code points. ``split`` on a pattern gives the text between its matches, so starts and ends are running sums
of lengths. Patterns are written without backtracking over long runs (same matches as the plain patterns).

Null text counts as empty and has no spans. Repeated rows give repeated results; an empty table gives an empty result;
other columns don't matter.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import fresh
from answerloom.session import durable

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"""[^\s@,;:<>()\[\]"']"""
GENERATORS = {
    "email": (rf"(?<!{TOKEN}){TOKEN}++@{TOKEN}++",
              rf"(?<!{LOCAL}){LOCAL}++ ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{{dot\}}) ?[A-Za-z0-9-]++)++"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9])",
           r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    "card": (r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,4}(?![0-9A-Za-z])",),
    "phone": (r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[ ./-]{1,2}(?:[0-9]{2,4}[ ./-]?){1,4}[0-9]{2,4}(?![0-9A-Za-z])",
              r"\+[0-9(][0-9 ()./-]{6,40}[0-9]"),
}
BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
"""A text without this can't have a valid base span of the kind (a card has 14 digits at least)."""
HINT = {"email": r"@|at[\])}]", "ip": r"[0-9]\.|:[0-9A-Fa-f]{0,4}:", "card": "[0-9]{4}", "phone": r"[0-9]{2}|\+[0-9(]"}
"""A text without this can't have a proposal of the kind."""
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Words before a span that tell its kind, in the languages of the corpus.
WORDS_BEFORE = {
    "contact": "tel|phone|call|mobil|fax|sms|whatsapp|telefon|téléphone|teléfono|handy",
    "mail": "mail|contact|write|courriel|correo|kontakt",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|konto|account",
    "net": "ip|host|server|addr|ping|gateway|dns",
    "code": "version|release|isbn|issn|doi|page|rev|build|section|fig|table|chapter|line|commit|id",
}
LARGEST = 1000
"""Features are numbers of characters or classes; trees do not tell larger ones apart."""
STEP = 1 / 1024
"""Thresholds are multiples of it; every held-out proposal counts towards them."""
UNIT = 1 << 26
"""Gradients are summed as multiples of 1 / UNIT, so no order of tasks changes a tree."""
PRECISION, LEAST_CONFIRMED = 0.98, 20
ROUNDS, RATE = 24, 0.3
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, hint: str) -> Column:
    """All matches as array of start, end, value, up to 24 code points before and 2 after (within the gap between matches)."""
    p = quoted(pattern)
    return F.expr(f"""
      CASE WHEN {text} RLIKE {quoted(hint)} AND {text} RLIKE {p} THEN aggregate(
        transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), slice(split({text}, {p}, -1), 2, 2147483647)),
                  z -> named_struct('gap', z['0'], 'value', z['1'], 'next', z['2'])),
        named_struct('at', 0, 'found', CAST(array() AS {SPAN})),
        (a, x) -> CASE WHEN x.value IS NULL THEN a ELSE named_struct(
          'at', a.at + length(x.gap) + length(x.value),
          'found', concat(a.found, array(named_struct('start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.value), 'value', x.value,
                                                      'before', right(x.gap, 24), 'after', left(x.next, 2))))) END,
        a -> a.found) ELSE CAST(array() AS {SPAN}) END""")


def passes(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return digits.between(10, 15)
    backwards = F.reverse(F.translate(value, " -", ""))
    doubled = F.array(*(F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    digit = lambda i: F.substring(backwards, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), digits), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.element_at(doubled, digit(i) + 1)).otherwise(digit(i)))
    return F.when(digits.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


FEATURES = ("length", "digits", "groups", "spaces", "dots", "dashes", "brackets", "letters", "first_group", "last_group", "longest_group", "char_before", "char_after", "check",
            *(f"word_{name}" for name in WORDS_BEFORE))


def char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).when(c.isin(".", ",", ";", ":", "!", "?"), 4).otherwise(5)


def word_before(before: Column, name: str) -> Column:
    return before.rlike(rf"(?:^|[^\p{{L}}])(?:{WORDS_BEFORE[name]})\p{{L}}*[^\p{{L}}]*$")


def check(kind: str, v: Column) -> Column:
    """What a span of the kind must meet under any separators."""
    if kind == "email":
        at = F.regexp_replace(F.regexp_replace(v, r" ?[\[({]at[\])}] ?", "@"), r" ?[\[({]dot[\])}] ?", ".")
        return at.rlike(r"^[^@\s]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}$")
    if kind == "ip":
        h = "[0-9A-Fa-f]{1,4}"
        short = v.rlike(rf"^(?:{h}(?::{h})*)?::(?:{h}(?::{h})*)?$") & F.size(F.regexp_extract_all(v, F.lit(f"({h})"))).between(1, 7)
        return passes("ip", F.regexp_replace(v, ":[0-9]{1,5}$", "")) | v.rlike(rf"^(?:{h}:){{7}}{h}$") | short
    return passes("card", F.translate(v, "./_", "")) if kind == "card" else passes("phone", v)


def features(kind: str, x: Column) -> Column:
    """Numbers in the order of FEATURES."""
    v, before = x["value"], F.lower(x["before"])
    groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    size = lambda n: F.coalesce(F.length(F.get(groups, n)), F.lit(0))
    without = lambda chars: F.length(v) - F.length(F.translate(v, chars, ""))
    columns = [F.length(v), F.length(F.regexp_replace(v, "[^0-9]", "")), F.size(groups), without(" "), without("."), without("-"), without("()[]{}"),
               F.length(F.regexp_replace(v, r"[^\p{L}]", "")), size(F.lit(0)), size(F.size(groups) - 1),
               F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), char_class(F.substring(before, -1, 1)), char_class(F.substring(x["after"], 1, 1)), check(kind, v),
               *(word_before(before, name).cast("int") for name in WORDS_BEFORE)]
    return F.array(*(c.cast("int") for c in columns))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def confirmed(kind: str, x: Column, base: str) -> Column:
    """Whether a proposal is of its kind: on a base span of it, or by its check; a phone's count of digits needs a word that
    tells as well. What nothing decides counts as not confirmed."""
    v, before = x["value"], F.lower(x["before"])
    on = lambda k: F.exists(f"{base}.{k}", lambda b: overlaps(x, b))
    if kind != "phone":
        return on(kind) | check(kind, v)
    other = word_before(before, "code") | word_before(before, "card") | word_before(before, "net") | on("card") | on("ip")
    return on(kind) | (check(kind, v) & ~other & word_before(before, "contact"))


@dataclass
class Split:
    feature: int
    at: float
    below: "Split | float"
    above: "Split | float"

    def sql(self, features: str) -> str:
        low, high = (s.sql(features) if isinstance(s, Split) else repr(float(s)) + "D" for s in (self.below, self.above))
        return f"CASE WHEN {features}[{self.feature}] <= {self.at} THEN {low} ELSE {high} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        low, high = (s.predict(x) if isinstance(s, Split) else s for s in (self.below, self.above))
        return np.where(x[:, self.feature] <= self.at, low, high)


@dataclass
class Boosted:
    trees: list[Split]
    threshold: float = np.inf

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, features: str) -> str:
        return " + ".join(f"({t.sql(features)})" for t in self.trees) or "0D"


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-RATE * g.sum() / (h.sum() + 1.0))


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Split | float:
    """Greatest second-order gain over all features and cuts between their values."""
    best = (1e-6, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values, inverse = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        gs, hs = (np.cumsum(np.bincount(inverse, s, len(values)))[:-1] for s in (g, h))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), f, (values[i] + values[i + 1]) / 2)
    if best[1] < 0:
        return leaf(g, h)
    low = x[:, best[1]] <= best[2]
    parts = [best_split(x[m], g[m], h[m], depth - 1) if depth > 1 else leaf(g[m], h[m]) for m in (low, ~low)]
    return Split(best[1], float(best[2]), *parts)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss with trees of depth two."""
    model, margin = Boosted([]), np.zeros(len(y))
    for _ in range(ROUNDS if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = best_split(x, p - y, p * (1 - p), 2)
        if not isinstance(tree, Split):
            break
        model.trees.append(tree)
        margin = margin + tree.predict(x)
    return model


def calibrated(model: Boosted, x: np.ndarray, y: np.ndarray, free: np.ndarray | None = None, times: np.ndarray | None = None) -> Boosted:
    """The lowest margin from which on PRECISION of the held-out proposals are confirmed, at least LEAST_CONFIRMED of them, and
    PRECISION of the ``free`` ones (those that touch no base span) too. ``x``: features, or margins if of one dimension; ``times``: how often each occurs."""
    margin = model.margin(x) if x.ndim > 1 else x
    free = np.ones(len(y), bool) if free is None else free.astype(bool)
    times = np.ones(len(y)) if times is None else times
    cuts, at = np.unique(margin, return_inverse=True)
    above = lambda w: np.cumsum(np.bincount(at, w * times, len(cuts))[::-1])[::-1]
    good, every, good_free, every_free = above(y), above(np.ones(len(y))), above(y * free), above(free.astype(float))
    fits = (good >= LEAST_CONFIRMED) & (good >= PRECISION * every) & (good_free >= PRECISION * every_free)
    return Boosted(model.trees, float(cuts[fits.argmax()])) if fits.any() else Boosted(model.trees)


def with_base(docs: DataFrame, text: str, base: str) -> DataFrame:
    """``base``: struct of the four arrays of base spans."""
    def valid(kind: str) -> Column:
        return F.filter(matches(text, BASE[kind], BASE_HINT[kind]), lambda x: passes(kind, x["value"]))

    return docs.withColumn(base, F.struct(*(valid(k).alias(k) for k in KINDS)))


def with_proposals(docs: DataFrame, text: str, proposed: str) -> DataFrame:
    """``proposed``: struct of the four arrays of proposals, overlapping ones included."""
    return docs.withColumn(proposed, F.struct(*(F.concat(*(matches(text, p, HINT[k]) for p in GENERATORS[k])).alias(k) for k in KINDS)))


def proposals(docs: DataFrame) -> DataFrame:
    """``kind, half, x, y, free, n``: features and label of every proposal of every different text, equal ones counted. Only they leave the texts' tasks."""
    texts = docs.select(F.col("text").alias("t")).filter(F.col("t").rlike("|".join(HINT.values())))
    found = with_proposals(with_base(texts, "t", "base"), "t", "proposed")

    def labelled(n: int, kind: str) -> Column:
        free = lambda x: ~F.exists(F.concat(*(F.col(f"base.{k}") for k in KINDS)), lambda b: overlaps(x, b))
        return F.transform(f"proposed.{kind}", lambda x: F.struct(
            F.lit(n).alias("kind"), F.transform(features(kind, x), lambda v: F.least(v, F.lit(LARGEST))).alias("x"),
            F.coalesce(confirmed(kind, x, "base"), F.lit(False)).alias("y"), free(x).alias("free")))

    rows = found.select(F.xxhash64("t").alias("h"), F.md5("t").alias("m"), F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2)).alias("half"),
                        F.concat(*(labelled(n, k) for n, k in enumerate(KINDS))).alias("cs")).filter(F.size("cs") > 0)
    once = rows.groupBy("h", "m", "half").agg(F.first("cs").alias("cs"))  # equal texts have equal proposals
    return once.select("half", F.explode("cs").alias("c")).groupBy("c.kind", "half", "c.x", "c.y", "c.free").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame) -> dict[str, Boosted]:
    """A calibrated model for each kind, from all proposals. They stay in the tasks; the driver gets sums by value of a feature
    (at most LARGEST + 1) or by step of the margin."""
    held = durable(proposals(docs))
    models = {kind: Boosted([]) for kind in KINDS}
    active = set(range(len(KINDS)))
    for _ in range(ROUNDS):
        roots = _cuts(held.filter("half = 0"), models, {n: None for n in active})
        active &= set(roots)
        if not active:
            break
        leaves = _cuts(held.filter("half = 0"), models, {n: roots[n] for n in active})
        for n in active:
            models[KINDS[n]].trees.append(leaves[n])
    for n, points in _margins(held.filter("half = 1"), models).items():
        models[KINDS[n]] = calibrated(models[KINDS[n]], *points)
    return models


def _by_kind(values: dict[int, str]) -> Column:
    """The SQL of a row's kind; null for kinds without one."""
    return F.expr("CASE kind " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + " END")


def _margin(held: DataFrame, models: dict[str, Boosted], kinds: Iterable[int]) -> DataFrame:
    """The proposals of ``kinds`` with their ``margin``. Trees are added up inside one array function, so no generated method grows with them."""
    def added(trees: list[Split]) -> str:
        return f"aggregate(array({', '.join(t.sql('x') for t in trees)}), 0D, (a, t) -> a + t)" if trees else "0D"

    return held.filter(F.col("kind").isin(*kinds)).withColumn("margin", _by_kind({n: added(models[KINDS[n]].trees) for n in kinds}))


def _cuts(held: DataFrame, models: dict[str, Boosted], roots: dict[int, Split | None]) -> dict[int, Split]:
    """The next tree of each kind of ``roots``: its first cut, or with a first cut given, both below it. Gradients are summed by
    side, feature and value in the tasks; kinds without a useful first cut are left out."""
    side = {n: "0" if r is None else f"CASE WHEN x[{r.feature}] <= {r.at} THEN 0 ELSE 1 END" for n, r in roots.items()}
    rows = _margin(held, models, roots).select("kind", _by_kind(side).alias("side"), "x", "n", F.col("y").cast("double").alias("y"),
                                               (1 / (1 + F.exp(-F.col("margin")))).alias("p"))
    units = lambda w: F.rint(w * UNIT).cast("long") * F.col("n")
    cells = rows.select("kind", "side", F.posexplode("x").alias("f", "value"), units(F.col("p") - F.col("y")).alias("g"), units(F.col("p") * (1 - F.col("p"))).alias("h"))
    total = cells.groupBy("kind", "side", "f", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    rows = sorted(map(tuple, total.collect()))
    parts: dict[int, dict[int, list]] = {}
    for kind, side, *cell in rows:
        parts.setdefault(kind, {}).setdefault(side, []).append(cell)
    trees = {}
    for kind, sides in parts.items():
        first = roots[kind]
        if first is None:
            found = _summed_split(sides[0])
            if isinstance(found, Split):
                trees[kind] = found
        else:
            trees[kind] = Split(first.feature, first.at, *(_summed_split(sides[s]) for s in (0, 1)))
    return trees


def _summed_split(cells: list) -> Split | float:
    """``best_split`` of depth one from (feature, value, gradient, curvature) in order."""
    f, value, g, h = (np.array(c, float) for c in zip(*cells))
    g, h = g / UNIT, h / UNIT
    whole = f == f[0]
    gt, ht = g[whole].sum(), h[whole].sum()
    best = (1e-6, -1, 0.0, 0.0, 0.0)
    for feature in np.unique(f).astype(int):
        m = f == feature
        gs, hs, values = np.cumsum(g[m])[:-1], np.cumsum(h[m])[:-1], value[m]
        gain = gs**2 / (hs + 1.0) + (gt - gs) ** 2 / (ht - hs + 1.0) - gt**2 / (ht + 1.0)
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), feature, float(values[i] + values[i + 1]) / 2, gs[i], hs[i])
    step = lambda a, b: float(-RATE * a / (b + 1.0))
    if best[1] < 0:
        return step(gt, ht)
    return Split(best[1], best[2], step(best[3], best[4]), step(gt - best[3], ht - best[4]))


def _margins(held: DataFrame, models: dict[str, Boosted]) -> dict[int, tuple[np.ndarray, ...]]:
    """Held-out proposals of each kind, counted by margin (in steps of STEP), label and freedom: margin, label, freedom, times."""
    at = F.floor(F.col("margin") / STEP)
    counted = _margin(held, models, range(len(KINDS))).groupBy("kind", at.alias("at"), F.col("y").cast("double").alias("y"), "free").agg(F.sum("n").cast("double").alias("n"))
    out: dict[int, list] = {}
    for kind, *point in sorted(map(tuple, counted.collect())):
        out.setdefault(kind, []).append(point)
    return {k: (np.array(at) * STEP, np.array(y), np.array(free, bool), np.array(n)) for k, points in out.items() for at, y, free, n in [zip(*points)]}


def kind_spans(spans: str, kind: int, *more: str) -> Column:
    """(start, kind, end, ...): the order of the structs is that of the result."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *(x[m].alias(m) for m in more)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, models: dict[str, Boosted]) -> tuple[DataFrame, str]:
    """All rows and columns, and a struct column (its name is returned) with ``base`` (spans by kind), ``plain`` (the base
    spans in order) and ``spans`` (all spans in order)."""
    text, base, proposed, plain, free, out = (fresh(n, docs.columns) for n in ("pii_text", "pii_base", "pii_proposed", "pii_plain", "pii_free", "pii"))
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))
    rows = with_proposals(with_base(rows, text, base), text, proposed)
    rows = rows.withColumn(plain, F.array_sort(F.concat(*(kind_spans(f"{base}.{k}", n) for n, k in enumerate(KINDS, 1)))))
    usable = [(n, k) for n, k in enumerate(KINDS, 1) if np.isfinite(models[k].threshold)]
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if usable:
        def alone(n: int, k: str) -> Column:
            fit = F.filter(kind_spans(f"{proposed}.{k}", n, "value", "before", "after"), lambda x: ~F.exists(plain, lambda b: overlaps(x, b)) & check(k, x["value"]))
            return F.transform(fit, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), features(k, x).alias("f")))

        rows = rows.withColumn(free, F.concat(*(alone(n, k) for n, k in usable)))
        margins = " ".join(f"WHEN {n} THEN {models[k].sql('x.f')} - ({models[k].threshold!r}D)" for n, k in usable)
        best = F.array_sort(F.filter(F.expr(f"transform({free}, x -> named_struct('less', -(CASE x.kind {margins} END), 'start', x.start, 'kind', x.kind, 'end', x.end))"),
                                     lambda x: x["less"] <= 0))
        added = F.aggregate(best, added, lambda a, x: F.when(F.exists(a, lambda b: overlaps(x, b)), a).otherwise(
            F.concat(a, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))))
    found = F.struct(F.col(base).alias("base"), F.col(plain).alias("plain"), F.array_sort(F.concat(F.col(plain), added)).alias("spans"))
    return rows.select(*[f"`{c}`" for c in docs.columns], found.alias(out)), out


def personal_data(docs: DataFrame, models: dict[str, Boosted] | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    rows, p = with_spans(docs.select("doc_id", "text"), models or train(docs))
    return rows.select("doc_id", *(F.size(f"{p}.base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                       F.sha2(joined(F.col(f"{p}.plain")).cast("binary"), 256).alias("base_sha256"), joined(F.col(f"{p}.spans")).alias("spans"))


def redact(docs: DataFrame, models: dict[str, Boosted] | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; other columns as they are."""
    rows, p = with_spans(docs, models or train(docs))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    whole = F.expr(f"""aggregate(filter({p}.spans, (s, i) -> i = 0 OR s.start >= array_max(transform(slice({p}.spans, 1, i), o -> o.end))),
      named_struct('at', 0, 'out', ''),
      (a, s) -> named_struct('at', s.end, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '[', {kinds}[s.kind - 1], ']')),
      a -> concat(a.out, substring(text, a.at + 1)))""")
    return rows.select(*[F.when(F.size(f"{p}.spans") > 0, whole).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
