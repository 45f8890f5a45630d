"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger stores its measurements and one long of failure
bits, bit k for the k-th rule of ``RULES``. A policy is a versioned mask of rules; applying one, or comparing
policies and leaving rules out (ablations), reads the ledger's bits and never a text.

The measurements need no shuffle: repeated windows are found inside a row, by sorting the hashes of its
5-word windows, and only in rows whose hashes are not all distinct.

``long_words`` and ``few_words`` count words between spaces, so policies that have them reject texts in scripts that
write none.

Defined results: a null or empty text has no words and fails ``few_words``; very long texts are measured
whole; a null or repeated doc_id is carried through, one result for each row; extra columns are ignored; an
empty table gives no rows (and ablations of zero documents).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_GAP = " \t\n\x0b\f\r"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words."""
    df = texts(docs)
    df = df.select("doc_id", "text", F.filter(F.split("text", r"[\x20\t-\r]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\t-\r]")).alias("lines"))
    n = F.size("words")
    df = df.select(
        "doc_id",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_capitals"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*(F.try_element_at("words", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # Starts of the windows whose hash another window of the row has, in order.
    pairs = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("pairs", pairs)
    at = F.filter("pairs", lambda x, i: (x["h"] == F.get("pairs", i - 1)["h"]) | (x["h"] == F.get("pairs", i + 1)["h"]))
    df = df.withColumn("starts", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate("starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])
    # The measurements leave through a one-row generator: a filter on them would else be pushed through the projections
    # above, which puts whole arrays inside the lambdas that read them and evaluates those for every element.
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines")
    row = F.struct(*(F.col(c).cast("long").alias(c) for c in names), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.select("doc_id", F.inline(F.array(row)))


#: Name and failing condition over the measurements; a rule's place is its bit, so new ones go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
    ("repeated_lines", "n_lines > 0 and 10 * n_dup_lines > 3 * n_lines"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
#: Versions stay as they were once published.
POLICIES = [BASE, Policy("v1", (*BASE.rules, "many_words", "short_words", "long_words", "symbols", "capitals")), Policy("v2", (*BASE.rules, "many_words", "short_words", "long_words", "symbols", "capitals", "repeated_lines"))]


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``."""
    bits = None
    for k, (_, fails) in enumerate(RULES):
        bit = F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs).withColumn("fail_bits", bits)


def fails(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply(of_ledger: DataFrame, policy: Policy) -> DataFrame:
    """``base_failed`` by the base policy, ``kept`` by that and ``policy``."""
    return of_ledger.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy), "policy": F.lit(policy.version)})


def ablations(of_ledger: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, that fail it alone, and that the policy rejects.

    ``n_only`` is what leaving the rule out would bring back. One pass: the ledger is first counted by bit
    pattern, of which there are at most 2 ** len(RULES).
    """
    patterns = of_ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for p in (policies or POLICIES) for r in p.rules]
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.select("fail_bits", "n", F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(F.sum(F.when(hit.bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"))
    )
