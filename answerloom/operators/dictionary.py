"""Domain dictionary: normalisation, candidates, publication, term matching."""
from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import fits_broadcast, grouped_list, last_per_key
from ..functions.text import bind, fold, strip
from ..functions.tokens import char_bigrams


def normalize_terms(feed: DataFrame) -> DataFrame:
    """DIC-2: stripped term, folded aliases deduped in order without the term itself, and an error code per bad row."""
    term = strip("term")
    normal = fold(term)
    lowered = F.transform("aliases", lambda a: fold(strip(a)))
    aliases = F.filter(F.array_distinct(F.filter(lowered, lambda a: F.length(a) > 0)), lambda a: a != normal)
    bad_alias = F.exists(lowered, lambda a: F.rlike(a, F.lit("[\r\n]")) | (F.length(a) > 100))
    error = (
        F.when(F.length(term) == 0, "blank_term").when(F.rlike(term, F.lit("[\r\n]")), "multi_line_term")
        .when(F.length(term) > 100, "term_too_long").when(bad_alias, "bad_alias")
    )
    return feed.withColumns({"term": term, "normalized_term": normal, "aliases": aliases, "error_code": error})


def seed_terms(existing: DataFrame, feed: DataFrame) -> DataFrame:
    """DIC-1: feed rows whose (domain, folded term) is not stored yet."""
    rows = feed.withColumn("normalized_term", fold(strip("term")))
    return rows.join(existing.select("domain", "normalized_term"), ["domain", "normalized_term"], "left_anti")


def seed_conflicts(feed: DataFrame) -> DataFrame:
    """DIC-1: identities the feed repeats (the feed is rejected when any exist)."""
    return feed.groupBy("domain", fold(strip("term")).alias("normalized_term")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def render_dictionary(terms: DataFrame) -> DataFrame:
    """DIC-3: every approved surface once with its highest frequency, as dictionary lines in word order."""
    surfaces = F.explode(F.concat(F.array("term"), "aliases"))
    words = terms.where(F.col("status") == "approved").select(surfaces.alias("_s"), "frequency").select(
        fold(strip("_s")).alias("word"), "frequency").where(F.length("word") > 0)
    return words.groupBy("word").agg(F.max("frequency").alias("frequency")).withColumn(
        "line", F.concat_ws(" ", "word", F.col("frequency").cast("string"), F.lit("nz"))
    ).orderBy("word")


def _folded_order(c: str) -> Column:
    return fold(c)


def publish_dictionary(terms: DataFrame, versions: DataFrame) -> DataFrame:
    """DIC-4: one row: the artifact, its hash, the frozen manifest and whether a stored version already has that hash.

    The dictionary is reviewed by people and leaves as one artifact string, so its lines are gathered into one row here.
    """
    lines = render_dictionary(terms)
    artifact = lines.agg(
        F.array_join(grouped_list(F.col("line"), F.col("word")), "\n").alias("_text"), F.count(F.lit(1)).alias("term_count")
    ).select(F.concat("_text", F.lit("\n")).alias("artifact"), "term_count")
    entry = F.to_json(F.struct(
        F.col("aliases"), F.col("domain").alias("business_domain"), "frequency", "term", "term_type"))
    manifest = terms.where(F.col("status") == "approved").agg(
        F.concat(F.lit("["), F.array_join(grouped_list(entry, F.col("domain"), _folded_order("term")), ","), F.lit("]")).alias("manifest"))
    state = versions.agg(
        F.coalesce(F.max("version_number"), F.lit(0)).alias("_max"),
        F.max_by("artifact_hash", "version_number").alias("_active_hash"),
        F.max("version_number").alias("_active_number"),
    )
    one = artifact.withColumn("_one", F.lit(1)).join(manifest.withColumn("_one", F.lit(1)), "_one").join(
        state.withColumn("_one", F.lit(1)), "_one").drop("_one")
    digest = F.sha2(F.col("artifact"), 256)
    reused = F.coalesce(digest == F.col("_active_hash"), F.lit(False))
    return one.select(
        F.when(reused, F.col("_active_number")).otherwise(F.col("_max") + 1).alias("version_number"),
        digest.alias("artifact_hash"), reused.alias("reused"), "term_count", "artifact", "manifest",
        F.when(~reused, F.col("_active_number")).alias("supersedes"),
    )


def automata(surfaces: Iterable[tuple[str, str, object]]) -> dict[str, ahocorasick.Automaton]:
    """One Aho-Corasick automaton per domain from (domain, surface, payload); a surface's payloads are kept together."""
    payloads: dict[str, dict[str, set]] = {}
    for domain, surface, payload in surfaces:
        payloads.setdefault(domain, {}).setdefault(surface, set()).add(payload)
    out = {}
    for domain, own in payloads.items():
        out[domain] = ahocorasick.Automaton()
        for surface, kept in own.items():
            out[domain].add_word(surface, (len(surface), tuple(kept)))
        out[domain].make_automaton()
    return out


def hits(by_domain: dict[str, ahocorasick.Automaton], domain: str | None, folded: str | None) -> Iterator[tuple[int, int, tuple]]:
    """(start, stop, payloads) of every occurrence, overlapping ones too, in one walk over the text."""
    automaton = by_domain.get(domain)
    if automaton is not None and folded:
        for last, (size, payloads) in automaton.iter(folded):
            yield last + 1 - size, last + 1, payloads


def longest_apart(found: Iterable[tuple[int, int, str]]) -> list[str]:
    """Names of (start, stop, name) in text order: the longest first, ties by start and name, as long as they don't overlap."""
    starts: list[int] = []
    picked: list[tuple[int, str, int]] = []
    for start, stop, name in sorted(found, key=lambda h: (h[0] - h[1], h[0], h[2])):
        at = bisect.bisect_left(starts, start)
        if (at == 0 or picked[at - 1][2] <= start) and (at == len(starts) or starts[at] >= stop):
            starts.insert(at, start)
            picked.insert(at, (start, name, stop))
    return [name for _, name, _ in picked]


def match_terms(texts: DataFrame, entries: DataFrame, text: str = "text", key: str = "text_id", max_rows: int = 200_000) -> DataFrame:
    """DIC-5: canonical terms whose term or alias occurs in the folded text, in entry order.

    ``entries``: domain, position, term, aliases. A dictionary that fits becomes one automaton per domain, walked once per text
    however many surfaces there are. A larger one meets the texts by shared leading two characters.
    """
    surfaces = entries.select(
        "domain", "position", "term",
        F.filter(F.transform(F.concat(F.array("term"), "aliases"), fold), lambda s: F.length(s) > 0).alias("surfaces"))
    body = texts.withColumn("_folded", fold(text))
    if fits_broadcast(surfaces, max_rows):
        rows = surfaces.select("domain", F.struct("position", "term").alias("e"), F.explode("surfaces").alias("s")).toLocalIterator()
        shared = texts.sparkSession.sparkContext.broadcast(automata((r["domain"], r["s"], (r["e"]["position"], r["e"]["term"])) for r in rows))

        @F.pandas_udf("array<string>")
        def found_terms(domains: pd.Series, folded: pd.Series) -> pd.Series:
            return pd.Series([list(dict.fromkeys(t for _, t in sorted({e for _, _, es in hits(shared.value, d, s) for e in es}))) for d, s in zip(domains, folded)])

        return body.select(*texts.columns, found_terms(F.col("domain"), F.col("_folded")).alias("domain_terms"))
    grams = F.array_distinct(char_bigrams(F.col("_folded")))
    singles = F.array_distinct(F.split("_folded", ""))
    keyed = body.select(key, "domain", "_folded", F.explode(F.array_union(grams, singles)).alias("_gram"))
    probe = surfaces.select("domain", "position", "term", F.explode("surfaces").alias("_s")).withColumn(
        "_gram", F.substring("_s", 1, 2))
    found = keyed.join(probe, ["domain", "_gram"]).where(F.contains(F.col("_folded"), F.col("_s"))).groupBy(key).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("position", "term"))), lambda e: e["term"])).alias("_t"))
    return texts.join(found, key, "left").withColumn(
        "domain_terms", F.coalesce("_t", F.array().cast("array<string>"))).drop("_t")


def scan_column(text: Column, aliases: Column) -> Column:
    """DIC-6 inside a row: ``aliases`` is array<struct<canonical, surface>>; result is the canonical names in text order.

    All occurrences (overlapping starts too), then the longest first, ties by start and name, as long as they do not overlap.
    """
    def occurrences(folded: Column, a: Column) -> Column:
        size = F.length(a["surface"])
        pieces = F.split(folded, "")
        first = F.substring(a["surface"], 1, 1)
        heads = F.filter(F.transform(pieces, lambda ch, i: F.when(ch == first, i + 1)), lambda i: i.isNotNull())
        starts = F.filter(heads, lambda i: F.substring(folded, i, size) == a["surface"])
        spans = F.transform(starts, lambda i: F.struct(
            (-size).alias("neg"), i.alias("start"), a["canonical"].alias("canonical"), (i + size).alias("stop")))
        none = F.array().cast("array<struct<neg:int,start:int,canonical:string,stop:int>>")
        return F.when((size > 0) & F.contains(folded, a["surface"]), spans).otherwise(none)

    def choose(acc: Column, s: Column) -> Column:
        clash = F.exists(acc, lambda u: (s["start"] < u["stop"]) & (s["stop"] > u["start"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(
            s["start"].alias("start"), s["canonical"].alias("canonical"), s["stop"].alias("stop")))))

    spans = bind(fold(text), lambda folded: F.array_sort(F.flatten(F.transform(aliases, lambda a: occurrences(folded, a)))))
    picked = F.aggregate(spans, F.array().cast("array<struct<start:int,canonical:string,stop:int>>"), choose)
    return F.transform(F.array_sort(picked), lambda s: s["canonical"])


def alias_list(registry: dict[str, tuple[str, ...]]) -> Column:
    rows = [F.struct(F.lit(name).alias("canonical"), F.lit(s.casefold()).alias("surface")) for name, al in registry.items() for s in al]
    return F.array(*rows)


def scan_aliases(texts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """DIC-6 with an alias table (domain, canonical, surface): one automaton per domain finds all occurrences in one walk. An alias table
    that doesn't fit travels as one list per domain."""
    if fits_broadcast(aliases):
        rows = aliases.select("domain", "canonical", fold("surface").alias("surface")).where("length(surface) > 0 and canonical is not null").toLocalIterator()
        shared = texts.sparkSession.sparkContext.broadcast(automata((r["domain"], r["surface"], r["canonical"]) for r in rows))

        @F.pandas_udf("array<string>")
        def names(domains: pd.Series, folded: pd.Series) -> pd.Series:
            return pd.Series([longest_apart((a, b, n) for a, b, ns in hits(shared.value, d, s) for n in ns) for d, s in zip(domains, folded)])

        return texts.select(*texts.columns, names(F.col("domain"), fold(text)).alias("names"))
    lists = aliases.select("domain", "canonical", fold("surface").alias("surface")).groupBy("domain").agg(
        F.array_sort(F.collect_set(F.struct("canonical", "surface"))).alias("_aliases"))
    empty = F.array().cast("array<string>")
    return texts.join(lists, "domain", "left").withColumn(
        "names", F.when(F.col("_aliases").isNull(), empty).otherwise(scan_column(F.col(text), F.col("_aliases")))).drop("_aliases")


def list_terms(terms: DataFrame, domain: str | None = None, status: str | None = None) -> DataFrame:
    """DIC-7: optional filters, ordered by domain and term."""
    out = terms
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if status is not None:
        out = out.where(F.col("status") == status)
    return out.orderBy("domain", "normalized_term")


def active_entries(terms: DataFrame) -> DataFrame:
    """Entries in publication order, numbered per domain."""
    order = W.partitionBy("domain").orderBy("normalized_term", "term")
    return terms.where(F.col("status") == "approved").withColumn("position", F.row_number().over(order))


def newest_version(versions: DataFrame) -> DataFrame:
    return last_per_key(versions.withColumn("_k", F.lit(1)), ["_k"], [F.col("version_number")]).drop("_k")
