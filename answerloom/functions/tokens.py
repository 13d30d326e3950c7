"""Tokenizers as column expressions; any Column -> array<string> function can take their place."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lex
from .text import bind, fold, string_array

SPAN = "[a-zA-Z0-9_]+|[一-鿿]+"
UNIT = "[a-zA-Z0-9_]+|[一-鿿]"


def char_bigrams(span: Column) -> Column:
    """All adjacent character pairs, in one pass (a substring per position would rescan the text each time)."""
    return bind(F.split(span, ""), lambda ch: F.zip_with(
        F.slice(ch, F.lit(1), F.greatest(F.size(ch) - 1, F.lit(0))), F.slice(ch, F.lit(2), F.greatest(F.size(ch) - 1, F.lit(0))),
        lambda a, b: F.concat(a, b)))


def bigram_tokenizer(terms=lex.DOMAIN_TERMS):
    """TOK-1: words, and for every CJK run its domain terms (longest first) plus the single char or all bigrams."""
    known = sorted({t.strip().casefold() for t in terms if t.strip()}, key=lambda t: (-len(t), t))

    def tokenize(c: Column) -> Column:
        def expand(span: Column) -> Column:
            found = F.filter(string_array(known), lambda t: F.contains(span, t))
            grams = F.when(F.length(span) == 1, F.array(span)).otherwise(char_bigrams(span))
            return F.when(F.octet_length(span) == F.length(span), F.array(span)).otherwise(F.concat(found, grams))

        def split(text: Column) -> Column:
            mixed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)), expand))
            return F.when(F.rlike(text, F.lit("[一-鿿]")), mixed).otherwise(F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0)))

        return bind(fold(c), split)

    return tokenize


def word_tokenizer(c: Column) -> Column:
    """ASCII words only: the bigram tokenizer for text without CJK, without the per-span branch."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9_]+"), F.lit(0))


def tokenize_unigram(c: Column) -> Column:
    """TOK-2: words plus single CJK characters (embedding features)."""
    return F.transform(F.regexp_extract_all(c, F.lit(UNIT), F.lit(0)), fold)


def semantic_tokens(c: Column) -> Column:
    """TOK-3: distinct bigrams over all CJK characters joined across punctuation, plus words."""
    text = fold(c)
    none = F.array().cast("array<string>")
    grams = bind(F.regexp_replace(text, "[^一-鿿]+", ""), lambda cjk: F.when(F.length(cjk) > 1, char_bigrams(cjk)).otherwise(none))
    return F.array_distinct(F.concat(grams, F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))
