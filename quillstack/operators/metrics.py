"""Throughput of a run and totals of its documents.

Defined results: a null text counts nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words


def totals(chunks: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, chars, words, chunks."""
    return chunks.groupBy(key).agg(F.sum(F.length(column)).cast("long").alias("chars"), F.sum(count_words(F.col(column))).cast("long").alias("words"), F.count(F.lit(1)).alias("chunks"))


def throughput(df: DataFrame) -> DataFrame:
    """Adds chars, words and chunks a second of (elapsed_seconds, input_chars, input_words, chunk_count); no time counts as a microsecond."""
    seconds = F.when(F.col("elapsed_seconds") <= 0, F.lit(1e-6)).otherwise(F.col("elapsed_seconds"))
    return df.withColumns({"chars_per_second": F.col("input_chars") / seconds, "words_per_second": F.col("input_words") / seconds, "chunks_per_second": F.col("chunk_count") / seconds})
