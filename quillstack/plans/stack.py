"""A whole run: documents, clean text, chunks, summaries, one summary each, one for the stack, and the report."""

from __future__ import annotations

import logging
import os
import sys
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StackConfig, load_settings, parse
from ..functions import guards
from ..functions.text import count_words
from ..operators.chunk import chunk, drop_front
from ..operators.clean import clean
from ..operators.metrics import throughput
from ..operators.order import ordered
from ..operators.reduce import _cut_lineage, reduce_all, reduce_paper, synthesise
from ..operators.summarize import Lead, Summarizer, summarise
from ..sinks import evaluation
from ..sinks.report import context_text, export
from ..sources.documents import read_files

LOG = logging.getLogger("quillstack")
#: Characters of a cleaned text that the log shows.
PREVIEW = 500
# Fixed value: the title of a report on several documents.
TITLE = "Multi File Survey Report"
INTRODUCTION = {True: "This report summarises one document.", False: "This report summarises several documents."}
CONCLUSION = {True: "This ends the summary of the document.", False: "This ends the summary of the documents."}


def log_to(path: str) -> None:
    """Sends the log to a file that starts anew; earlier files of it are closed."""
    for handler in list(LOG.handlers):
        LOG.removeHandler(handler)
        handler.close()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handler = logging.FileHandler(path, mode="w", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s", "%Y-%m-%d %H:%M:%S"))
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    LOG.propagate = False


def prepare(docs: DataFrame, config: StackConfig | None = None) -> DataFrame:
    """doc_id, text -> chunks in reading order, with ``position``; no model takes part."""
    config = config or StackConfig()
    return ordered(chunk(clean(docs, config.clean), config.chunk, "cleaned_text"), config.chunk.order)


def summarise_stack(docs: DataFrame, config: StackConfig | None = None, backend: Callable[[], Summarizer] | None = None) -> dict[str, DataFrame]:
    """chunks, summaries, sections, papers and log of documents (doc_id, text)."""
    config = config or StackConfig()
    chunks = prepare(docs, config)
    return {"chunks": chunks} | _summarised(chunks, config, backend)


def _summarised(chunks: DataFrame, config: StackConfig, backend: Callable[[], Summarizer] | None) -> dict[str, DataFrame]:
    used = drop_front(chunks).withColumn("seq", F.col("position"))
    summaries = _cut_lineage(summarise(used, backend, config.summary))
    sections, papers, log = reduce_all(summaries.select("doc_id", "seq", "chunk_key", "summary"), backend, config.reduce, config.summary)
    return {"summaries": summaries, "sections": sections, "papers": papers, "log": log}


def report_context(papers: DataFrame, combined: DataFrame) -> DataFrame:
    """doc_id (0), text: the stack's summary and every document's, labelled. papers: ordinal, name, paper; combined: paper."""
    stack = combined.select(F.col("paper").alias("__combined")).limit(1)
    joined = papers.select("ordinal", "name", "paper").join(F.broadcast(stack))
    return joined.groupBy(F.lit(0).cast("long").alias("doc_id")).agg(context_text(F.max("__combined")).alias("text"))


def paragraph(context: DataFrame, prompt: str, config: StackConfig, backend: Callable[[], Summarizer]) -> tuple[DataFrame, DataFrame]:
    """doc_id, paper: a paragraph on a context (doc_id, text), which is reduced first where it is too long; and the log."""
    one = context.select("doc_id", F.lit(0).alias("seq"), F.lit("report").alias("chunk_key"), F.col("text").alias("summary"))
    options = replace(config.reduce, sentences=config.report.section_sentences, max_tokens=config.report.section_max_tokens)
    return reduce_paper(one, backend, options, replace(config.summary, prompt=prompt))


def _metrics(rows: DataFrame) -> DataFrame:
    return throughput(rows).select("ordinal", "run_name", "input_path", "elapsed_seconds", "input_chars", "input_words", "chunk_count", "output_chars", "output_words", "chars_per_second", "words_per_second", "chunks_per_second")


def document_metrics(docs: DataFrame, summaries: DataFrame, papers: DataFrame, log: DataFrame) -> DataFrame:
    """Throughput of each document over the model's own time: what went in, what came out."""
    of = summaries.groupBy("doc_id").agg(
        F.sum("seconds").alias("s"), F.sum(F.length("text")).alias("input_chars"), F.sum(count_words(F.col("text"))).alias("input_words"), F.count(F.lit(1)).alias("chunk_count"),
        F.sum(F.length("summary")).alias("oc"), F.sum(count_words(F.col("summary"))).alias("ow"),
    )
    later = log.groupBy("doc_id").agg(F.sum("seconds").alias("more"))
    joined = docs.select("doc_id", "ordinal", "path").join(of, "doc_id").join(papers.select("doc_id", "paper"), "doc_id", "left").join(later, "doc_id", "left")
    paper = F.coalesce("paper", F.lit(""))
    return _metrics(joined.select("ordinal", F.lit("document-summary").alias("run_name"), F.col("path").alias("input_path"), (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("elapsed_seconds"), "input_chars", "input_words", "chunk_count", (F.col("oc") + F.length(paper)).alias("output_chars"), (F.col("ow") + count_words(paper)).alias("output_words")))


def _run_metrics(spark: SparkSession, name: str, source: str, given: DataFrame, made: str, log: DataFrame, count: int) -> DataFrame:
    """Throughput of a step of the stack; given: text."""
    size = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("input_chars"), F.coalesce(F.sum(count_words(F.col("text"))), F.lit(0)).cast("long").alias("input_words"))
    spent = log.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("elapsed_seconds"))
    own = {"ordinal": F.lit(2**31 - 1), "run_name": F.lit(name), "input_path": F.lit(source), "chunk_count": F.lit(count).cast("long"), "output_chars": F.lit(len(made)).cast("long"), "output_words": count_words(F.lit(made)).cast("long")}
    return _metrics(size.join(spent).withColumns(own))


def run(spark: SparkSession, paths: list[str], config: StackConfig | None = None, backend: Callable[[], Summarizer] | None = None) -> list[str]:
    """Reads the files, summarises them and writes the run's files; returns their paths."""
    config = config or StackConfig()
    options, one = config.report, len(paths) == 1
    backend = backend or (lambda: Lead(config.summary.sentences))
    log_to(os.path.join(options.output, "run.log"))
    began = time.time()
    docs = _cut_lineage(read_files(spark, paths))
    cleaned = _cut_lineage(clean(docs.select("doc_id", "text"), config.clean).select("doc_id", "text", "cleaned_text", F.size("citations").alias("removed_citations")))
    for r in docs.select("doc_id", "ordinal", "path").join(cleaned.select("doc_id", F.substring("cleaned_text", 1, PREVIEW).alias("head")), "doc_id").orderBy("ordinal").toLocalIterator():
        LOG.info("cleaned %s: %s", r.path, r.head)
    chunks = _cut_lineage(ordered(chunk(cleaned, config.chunk, "cleaned_text"), config.chunk.order))
    LOG.info("%d chunks", chunks.count())
    made = _summarised(chunks, config, backend)
    made = made | {k: _cut_lineage(made[k]) for k in ("papers", "log")}
    papers = docs.join(made["papers"], "doc_id", "left").select("ordinal", F.col("display").alias("name"), F.coalesce("paper", F.lit("")).alias("paper"))
    stack, stack_log = synthesise(papers, backend, config.reduce, replace(config.summary, prompt=options.survey_prompt or guards.SURVEY))
    stack = _cut_lineage(stack)
    combined = stack.first()["paper"] or ""
    LOG.info("summarised after %.1f s", time.time() - began)

    context = _cut_lineage(report_context(papers, stack))
    logs, steps = [made["log"].join(docs.select("doc_id", "ordinal", "display"), "doc_id"), stack_log.withColumns({"ordinal": F.lit(0), "display": F.lit("The stack")})], []
    if not one:
        steps.append(_run_metrics(spark, "stack-summary", "all documents", papers.select(F.col("paper").alias("text")), combined, stack_log, len(paths)))

    def written(given: str | None, wanted: bool, prompt: str, label: str, fallback: str) -> str:
        text = given
        if text is None and wanted:
            out, log = paragraph(context, prompt, config, backend)
            text = _cut_lineage(out).first()["paper"]
            logs.append(log.withColumns({"ordinal": F.lit(0), "display": F.lit(label)}))
            steps.append(_run_metrics(spark, label, "report context", context, text, log, 1))
        return text if text and text.strip() else fallback

    introduction = written(options.introduction, options.generate_introduction, options.introduction_prompt or guards.INTRODUCTION, "generated-introduction", INTRODUCTION[one])
    conclusion = written(options.conclusion, options.generate_conclusion, options.conclusion_prompt or guards.CONCLUSION, "generated-conclusion", CONCLUSION[one])

    first = docs.orderBy("ordinal").select("name", "display").first()
    base, title = options.name or first["name"], options.title or (first["display"] if one else TITLE)
    # The report prints every document's summary: this is the one place where they come together.
    sections = [("paper", combined), *([] if one else ((r.name, r.paper) for r in papers.orderBy("ordinal").toLocalIterator()))]
    at = lambda name: os.path.join(options.output, name)
    out = [evaluation.write_text(at(f"{base}_final.txt"), [combined])]
    for kind in (k.lower() for k in options.types):
        if kind in ("txt", "docx", "pdf"):
            out.append(at(f"{base}_survey.{kind}"))
            export(out[-1], kind, title, options.author, introduction, sections, conclusion, abstract=options.abstract)
    out += [p for p in evaluation.write_documents(evaluation.document_files(docs, cleaned, chunks, made["summaries"], made["papers"]), options.output) if p != out[0]]

    metrics = document_metrics(docs, made["summaries"], made["papers"], made["log"])
    for more in steps:
        metrics = metrics.unionByName(more)
    sizes = F.array_sort(F.collect_list(F.struct("position", F.col("chunk_key").alias("key"), "n_chars")))
    cleaning = docs.select("doc_id", "ordinal", "display", "path").join(
        cleaned.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("raw_chars"), count_words(F.coalesce("text", F.lit(""))).alias("raw_words"), F.length("cleaned_text").alias("cleaned_chars"), count_words(F.col("cleaned_text")).alias("cleaned_words"), "removed_citations"), "doc_id"
    ).join(chunks.groupBy("doc_id").agg(sizes.alias("chunks")), "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<position:int,key:string,n_chars:int>>")))
    pairs = made["summaries"].join(docs.select("doc_id", "ordinal", "display"), "doc_id").select("ordinal", "display", "position", "chunk_key", "text", "summary")
    log = None
    for one_log in logs:
        named = evaluation.log_entries(one_log).join(one_log.select("doc_id", "stage", "round", "name", "ordinal", "display").distinct(), ["doc_id", "stage", "round", "name"])
        log = named if log is None else log.unionByName(named)
    settings = [("Model", config.summary.model), ("Output", options.output), ("Input files", len(paths)), ("Devices", config.summary.devices), ("Character limit", config.chunk.char_limit), ("Sections", config.chunk.section), ("Order", config.chunk.order)]
    parts = evaluation.data_file(settings, metrics, cleaning, pairs, log, [("Summary", combined), ("Introduction", introduction), ("Conclusion", conclusion)])
    out.append(evaluation.write_text(at(options.data_file), parts))
    LOG.info("finished after %.1f s", time.time() - began)
    return out


def main(argv: list[str] | None = None) -> None:
    load_settings(".env")
    paths, config = parse(sys.argv[1:] if argv is None else argv)
    backend = None
    if config.summary.model:
        from ..backends.local_model import LocalModel as backend
    for path in run(SparkSession.builder.getOrCreate(), paths, config, backend):
        print(path)


if __name__ == "__main__":
    main()
