"""Cleaning and its measurements as DataFrame transforms over (doc_id, text).

Defined results: a null text is an empty one; rows that repeat a doc_id are each cleaned; ``folded``, ``citations``,
``tokens`` and ``cleaned_text`` are results, and replace columns of these names that the table has (``clean`` leaves a
``folded`` alone); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as T


def normalise(df: DataFrame, config: CleanConfig | None = None, column: str = "text", to: str = "folded") -> DataFrame:
    """Adds ``to``: the text after Unicode folding, null as empty, line ends as \\n."""
    config = config or CleanConfig()
    raw = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\r\n?", "\n")
    return df.withColumn(to, T.fold_ascii(raw) if config.unicode else raw)


def clean(df: DataFrame, config: CleanConfig | None = None, column: str = "text") -> DataFrame:
    """Adds tokens, citations and cleaned_text. The order of the steps is part of the contract."""
    config = config or CleanConfig()
    out = normalise(df, config, column, "__folded")
    body = F.col("__folded")
    out = out.withColumn("citations", T.citations(body) if config.citations else F.array().cast("array<string>"))
    body = T.drop_citations(body) if config.citations else body
    body = T.drop_symbols(body) if config.symbols else body
    out = out.withColumn("__all", T.tokens(body))
    kept = F.col("__all") if config.keep_numbers else T.drop_bad(F.col("__all"))
    words = (*(config.stutter_list if config.stutters else ()), *(config.filler_list if config.fillers else ()))
    out = out.withColumn("__kept", T.drop_words(kept, words))
    out = out.withColumn("tokens", T.drop_repeats(F.col("__kept")) if config.repeats else F.col("__kept"))
    return out.withColumn("cleaned_text", T.join_tokens(F.col("tokens"))).drop("__folded", "__all", "__kept")


def clean_metrics(df: DataFrame, config: CleanConfig | None = None) -> DataFrame:
    """raw_chars, raw_words, cleaned_chars, cleaned_words, removed_citations, n_tokens for each document."""
    out = clean(df, config)
    return out.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("raw_chars"), T.count_words(F.coalesce("text", F.lit(""))).cast("long").alias("raw_words"), F.length("cleaned_text").cast("long").alias("cleaned_chars"),
        T.count_words(F.col("cleaned_text")).cast("long").alias("cleaned_words"), F.size("citations").cast("long").alias("removed_citations"), F.size("tokens").cast("long").alias("n_tokens"),
    )


def word_histogram(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, word, n: lower-cased runs of letters and digits."""
    return df.select("doc_id", F.explode(F.regexp_extract_all(F.lower(column), F.lit(T.WORD), 0)).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
