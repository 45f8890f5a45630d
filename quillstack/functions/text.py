"""Column expressions for cleaning, tokenising and re-joining text, all evaluated in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that is a token of its own, stutter words, filler words, citation patterns in the
# order in which they are applied.
PUNCTUATION = (",", ".", "?", "!", ";", ":", "(", ")", "[", "]", "{", "}", '"')
STUTTERS = ("um", "uh", "oh", "er", "ah")
FILLERS = ("very", "really", "highly", "like", "just", "totally", "literally", "seriously")
CITATIONS = (
    r"\[\d+\]",
    r"\(\d+\)",
    r"\[[^\]]*et al\.[^\]]*\]",
    r"\([A-Z][A-Za-z]+,\s*\d{4}\)",
    r"\([A-Z][A-Za-z]+\s+et al\.,\s*\d{4}\)",
)

# Fixed value: what counts as a symbol.
WEIRD = r"""[^A-Za-z0-9\s,.?!;:()\[\]{}"']"""
TOKEN = r"""[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[,.?!;:()\[\]{}"]|\n"""
WORD = r"[\p{L}\p{N}]+"
EDGES = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(x, EDGES, "")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str]:
    """Characters whose compatibility decomposition keeps one ASCII character, those characters, and those that keep more."""
    ones, to, many = [], [], []
    for code in range(128, sys.maxunicode + 1):
        if not unicodedata.decomposition(chr(code)):
            continue  # what it decomposes to, if to anything (Hangul), isn't ASCII
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            ones.append(chr(code)), to.append(kept)
        elif kept:
            many.append(chr(code))
    return "".join(ones), "".join(to), "".join(many)


def _fold_many(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts.to_pylist()], pa.string())


def fold_ascii(x: Column) -> Column:
    """Compatibility decomposition without what is not ASCII.

    One-to-one folds are a ``translate``. Only texts with a character that unfolds to several reach Python, which
    shows by what a second ``translate`` takes out.
    """
    ones, to, many = _folds()
    rare = x.rlike(r"[^\x00-\x7F]") & (F.length(F.translate(x, many, "")) != F.length(x))
    unfolded = F.arrow_udf(_fold_many, "string")(F.when(rare, x))
    return F.when(~x.rlike(r"[^\x00-\x7F]"), x).otherwise(F.coalesce(unfolded, F.regexp_replace(F.translate(x, ones, to), r"[^\x00-\x7F]", "")))


def _bracketed(x: Column) -> Column:
    """Every citation has a bracket, most texts have none."""
    return x.contains("[") | x.contains("(")


def drop_citations(x: Column) -> Column:
    out = x
    for pattern in CITATIONS:
        out = F.regexp_replace(out, pattern, " ")
    return F.when(_bracketed(x), out).otherwise(x)


def citations(x: Column) -> Column:
    """What ``drop_citations`` drops: all hits of the first pattern, then of the second in what is left, and so on."""
    found, rest = [], x
    for pattern in CITATIONS:
        found.append(F.regexp_extract_all(rest, F.lit(pattern), 0))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.when(_bracketed(x), F.concat(*found)).otherwise(F.array().cast("array<string>"))


def drop_symbols(x: Column) -> Column:
    return F.regexp_replace(x, WEIRD, " ")


def _is_mark(t: Column) -> Column:
    return t.isin(*PUNCTUATION, "\n")


def closers(tokens: Column) -> Column:
    """The brackets that are still open after ``tokens``, closed innermost first; a closer that fits none is passed over."""
    opened = F.aggregate(
        tokens,
        F.lit(""),
        lambda s, t: F.when(t.isin("(", "[", "{"), F.concat(t, s)).when((F.length(s) > 0) & (F.translate(F.substring(s, 1, 1), "([{", ")]}") == t), F.substring(s, 2, 2**31 - 1)).otherwise(s),
    )
    return F.filter(F.split(F.translate(opened, "([{", ")]}"), ""), lambda c: c != "")


def tokens(x: Column) -> Column:
    """Words (apostrophes inside them included), punctuation marks and line breaks; open brackets are closed at the end."""
    # Bound to a name by a lambda, so that the text is matched once for both.
    return F.get(F.transform(F.array(F.regexp_extract_all(x, F.lit(TOKEN), 0)), lambda found: F.concat(found, closers(found))), F.lit(0))


def drop_bad(t: Column) -> Column:
    """Keeps marks, and ASCII words that have a letter."""
    return F.filter(t, lambda w: _is_mark(w) | (w.rlike("^[A-Za-z0-9']+$") & w.rlike("[A-Za-z]")))


def drop_words(t: Column, words: Sequence[str]) -> Column:
    listed = [w.lower() for w in words]
    return F.filter(t, lambda w: _is_mark(w) | ~F.lower(w).isin(*listed)) if listed else t


def drop_repeats(t: Column) -> Column:
    """A word right after itself goes, whatever its case; marks and line breaks separate."""
    return F.filter(t, lambda w, i: (i == 0) | _is_mark(w) | (F.lower(w) != F.lower(F.get(t, i - 1))))


def join_tokens(t: Column) -> Column:
    """Text from tokens. What stands before a token depends on it and the two before it."""

    def spaced(w, i):
        p, q = F.get(t, i - 1), F.get(t, i - 2)
        first = (i == 0) | (p == "\n")
        opens = (i == 1) | q.isin("\n", "(", "[", "{", ",", ";", ":")
        bare = w.isin("\n", ",", ".", "?", "!", ";", ":", ")", "]", "}") | first | p.isin("(", "[", "{")
        space = (
            F.when(bare, F.lit(False))
            .when(w.isin("(", "[", "{"), F.lit(True))
            .when(w == '"', p.isin(",", ";", ":"))
            .otherwise((p != '"') | ~opens)
        )
        return F.concat(F.when(space, F.lit(" ")).otherwise(F.lit("")), w)

    return F.array_join(F.transform(t, spaced), "")


def count_words(x: Column) -> Column:
    """Runs of letters and digits; an apostrophe separates."""
    return F.regexp_count(x, F.lit(WORD))
