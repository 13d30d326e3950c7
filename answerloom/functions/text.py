"""Column helpers for text whose Unicode behaviour must not depend on ASCII-only JVM defaults."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, and the line separators besides the newline.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = ("\r\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
# Characters whose case fold differs from their lower-case form.
FOLD_PAIRS = (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬁ", "fi"), ("ﬂ", "fl"))

_WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE) + "]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times (higher-order functions do not share sub-expressions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(c: Column | str) -> Column:
    """Case fold (``lower`` alone keeps ß and final sigma)."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), FOLD_PAIRS, F.lower(col(c)))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: Column | str, chars: str = WHITESPACE) -> Column:
    return F.rtrim(col(c), F.lit(chars))


SENTENCE_MARKS = "。！？!?；;\n"
CUT = "\ufdd0"  # a Unicode noncharacter, never part of interchanged text


def split_after(c: Column | str, marks: str = SENTENCE_MARKS) -> Column:
    """Split behind every mark, keeping it. Literal replaces and a one-character split avoid the regex engine."""
    marked = reduce(lambda acc, m: F.replace(acc, F.lit(m), F.lit(m + CUT)), marks, col(c))
    return F.split(marked, CUT)


def squeeze(c: Column | str) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.trim(F.regexp_replace(col(c), _WS_CLASS + "+", " "))


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def split_lines(c: Column | str) -> Column:
    return F.split(reduce(lambda acc, b: F.replace(acc, F.lit(b), F.lit("\n")), LINE_BREAKS, col(c)), "\n")


def clip(c: Column | str, n: int) -> Column:
    """First n characters."""
    return F.substring(col(c), 1, n)


def contains_any(c: Column | str, words) -> Column:
    """True when any of a fixed word list occurs; one codegen expression, no array scan."""
    value = col(c)
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words], F.lit(False))


def first_in(c: Column | str, words) -> Column:
    """First word of an ordered list that occurs in the text, else NULL."""
    value = col(c)
    return F.coalesce(*[F.when(F.contains(value, F.lit(w)), F.lit(w)) for w in words])


def string_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def ordered_union(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def ratio(num: Column, den: Column, empty: float) -> Column:
    """num/den with the convention for an empty denominator stated by the caller."""
    return F.when(den == 0, F.lit(float(empty))).otherwise(num / den)
