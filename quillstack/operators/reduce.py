"""From chunk summaries to one summary for each document, and from those to one for the stack.

Defined results: null summaries are left out of joined texts; ties of a key are ordered by text; rows of one doc_id are one
document, so ids have to be unique; a null doc_id is a document of its own; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig, ReduceConfig, SummaryConfig
from ..functions.text import strip
from ..storage import materialize
from .chunk import chunk
from .order import ordered, section_name
from .summarize import Summarizer, summarise

#: Logged stages of a reduction.
SECTION, RECHUNK, FINAL, LAST = "section-reduction", "paper-rechunk-reduction", "paper-final-reduction", "paper-max-round-final-reduction"
_PIECES = "array<struct<key:string,text:string>>"
LOG = f"doc_id long, stage string, round int, name string, n_inputs long, inputs {_PIECES}, input_text string, outputs {_PIECES}, output_text string, seconds double"
#: Documents that are merged into one text; a larger stack is first reduced by ranges of so many.
RANGE = 1000


def _pieces(key: str, text: str, order: str) -> Column:
    """The texts with their keys, in order, as the log has them."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("key"), F.col(text).alias("text"))))
    return F.transform(rows, lambda r: F.struct(r["key"].alias("key"), r["text"].alias("text")))


def _entry(df: DataFrame, stage: Column, number: Column, name: Column, n_inputs: Column, inputs: Column, given: str, outputs: Column, made: str) -> DataFrame:
    return df.select("doc_id", stage.alias("stage"), number.alias("round"), name.alias("name"), n_inputs.cast("long").alias("n_inputs"), inputs.cast(_PIECES).alias("inputs"), F.col(given).alias("input_text"), outputs.cast(_PIECES).alias("outputs"), F.col(made).alias("output_text"), "seconds")


def _one(key: Column, text: str) -> Column:
    return F.array(F.struct(key.alias("key"), F.col(text).alias("text")))


def _in_order(order: str, text: str = "summary") -> Column:
    """The stripped texts in order, a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), strip(F.col(text)).alias("t"))))
    return strip(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n"))


def combine_sections(summaries: DataFrame) -> DataFrame:
    """doc_id, section, seq (of its first piece), n_pieces, text: pieces in lexicographic order of their keys."""
    return _combined(summaries)


def _combined(summaries: DataFrame, *more: Column) -> DataFrame:
    return summaries.withColumn("section", section_name(F.col("chunk_key"))).groupBy("doc_id", "section").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_pieces"), _in_order("chunk_key").alias("text"), *more)


def multi_part(summaries: DataFrame) -> DataFrame:
    """doc_id, multi: whether any section has several pieces."""
    return combine_sections(summaries).groupBy("doc_id").agg((F.max("n_pieces") > 1).alias("multi"))


def merge_all(summaries: DataFrame) -> DataFrame:
    """doc_id, text: all summaries in their order."""
    return summaries.groupBy("doc_id").agg(_in_order("seq").alias("text"))


def _summary_config(config: ReduceConfig, base: SummaryConfig | None) -> SummaryConfig:
    return replace(base or SummaryConfig(), sentences=config.sentences, max_tokens=config.max_tokens)


def reduce_sections(summaries: DataFrame, backend: Callable[[], Summarizer] | None = None, config: ReduceConfig | None = None, summary: SummaryConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries by section, and the log. A section of one piece keeps its summary and costs no call."""
    config = config or ReduceConfig()
    # Both tables are kept: several readers would each summarise what comes before once more.
    combined = _cut_lineage(_combined(summaries, _pieces("chunk_key", "summary", "chunk_key").alias("inputs")))
    single = combined.where("n_pieces = 1").select("doc_id", "section", "seq", F.col("inputs")[0]["text"].alias("summary"))
    several = _cut_lineage(summarise(combined.where("n_pieces > 1"), backend, _summary_config(config, summary)))
    log = _entry(several, F.lit(SECTION), F.lit(1), F.col("section"), F.col("n_pieces"), F.col("inputs"), "text", _one(F.col("section"), "summary"), "summary")
    out = single.select("doc_id", "seq", "section", "summary").unionByName(several.select("doc_id", "seq", "section", "summary"))
    return out.withColumnRenamed("section", "chunk_key"), log


def reduce_paper(summaries: DataFrame, backend: Callable[[], Summarizer] | None = None, config: ReduceConfig | None = None, summary: SummaryConfig | None = None, drop_front: bool = True) -> tuple[DataFrame, DataFrame]:
    """doc_id, paper, and the log. All documents go through a round together; those whose text fits leave it.

    Each round cuts by paragraphs what doesn't fit, and with ``drop_front`` leaves out what stands before the
    first paragraph, in every round. Rounds are cut off by intermediate tables, so that no model call is repeated.
    """
    config = config or ReduceConfig()
    options = _summary_config(config, summary)
    cuts = ChunkConfig(config.char_limit, "paragraph", config.percent, config.overlap)
    pending, ready, logs = _cut_lineage(merge_all(summaries)), [], []

    def finish(texts: DataFrame, stage: str, number: int) -> None:
        ready.append(texts.select("doc_id", "text", F.lit(stage).alias("stage"), F.lit(number).alias("round")))

    for number in range(1, config.rounds + 1):
        fits = F.length("text") <= config.char_limit
        finish(pending.where(fits), FINAL, number)
        pending = pending.where(~fits)
        if pending.isEmpty():
            break
        parts = ordered(chunk(pending, cuts))
        if drop_front:
            parts = parts.where(~F.col("chunk_key").isin("title", "front front"))
        parts = parts.withColumn("seq", F.col("position"))
        parts = parts.withColumn("key", F.concat(F.lit("paper."), F.col("position").cast("string")))
        merged = summarise(parts, backend, options).groupBy("doc_id").agg(
            _in_order("seq").alias("text"), F.count(F.lit(1)).alias("n_inputs"), _pieces("key", "text", "seq").alias("inputs"), _pieces("key", "summary", "seq").alias("outputs"), F.sum("seconds").alias("seconds")
        )
        after = pending.select("doc_id", F.col("text").alias("input_text")).join(merged, "doc_id", "left")
        after = _cut_lineage(after.withColumns({"text": F.coalesce("text", F.lit("")), "n_inputs": F.coalesce("n_inputs", F.lit(0)), "seconds": F.coalesce("seconds", F.lit(0.0))}))
        logs.append(_entry(after, F.lit(RECHUNK), F.lit(number), F.lit("paper"), F.col("n_inputs"), F.col("inputs"), "input_text", F.col("outputs"), "text"))
        pending = after.select("doc_id", "text")
    else:
        finish(pending, LAST, config.rounds + 1)
    # The last summaries of all rounds are made together, in one job.
    final = _cut_lineage(summarise(_union(ready), backend, options))
    last = _entry(final, F.col("stage"), F.col("round"), F.lit("paper"), F.lit(1), _one(F.lit("paper"), "text"), "text", _one(F.lit("paper"), "summary"), "summary")
    return final.select("doc_id", F.col("summary").alias("paper")), _union([*logs, last])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def reduce_all(summaries: DataFrame, backend: Callable[[], Summarizer] | None = None, config: ReduceConfig | None = None, summary: SummaryConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Section summaries, papers and the whole log."""
    sections, log = reduce_sections(summaries, backend, config, summary)
    papers, more = reduce_paper(sections, backend, config, summary)
    return sections, papers, log.unionByName(more)


def synthesise(papers: DataFrame, backend: Callable[[], Summarizer] | None = None, config: ReduceConfig | None = None, summary: SummaryConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """One summary of a stack (papers: ordinal, name, paper). One document's own is the stack's and costs no call.

    Its documents' summaries are one ordered text. A stack of more than ``RANGE`` documents is first reduced by ranges of
    neighbours, so that no task has more of them.
    """
    named = papers.select(F.lit(0).cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("seq"), F.concat(F.lit("document"), F.col("ordinal").cast("string")).alias("chunk_key"), F.concat(F.lit("Document: "), "name", F.lit("\n\n"), strip(F.col("paper"))).alias("summary"), "paper")
    if papers.limit(2).count() < 2:
        return named.select("doc_id", "paper"), papers.sparkSession.createDataFrame([], LOG)
    logs = []
    while named.limit(RANGE + 1).count() > RANGE:
        made, log = reduce_paper(named.withColumn("doc_id", F.floor(F.col("seq") / RANGE)), backend, config, summary)
        logs.append(log)
        named = made.select(F.lit(0).cast("long").alias("doc_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("range"), F.col("doc_id").cast("string")).alias("chunk_key"), F.col("paper").alias("summary"))
    out, log = reduce_paper(named.select("doc_id", "seq", "chunk_key", "summary"), backend, config, summary)
    return out, _union([*logs, log])


def _cut_lineage(df: DataFrame) -> DataFrame:
    """The table, written once and read back: what made it doesn't run again, and Parquet keeps it smaller than a checkpoint's rows."""
    return materialize(df, "reduce")
