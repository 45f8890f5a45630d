"""What a run leaves beside its report: text files for each document, and the data file for an evaluator.

Rows come to the driver a partition at a time and go straight into their file, so nothing is held for longer.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words, strip
from .report import RULE, key_blocks

WIDE, THIN = "=" * 80, "-" * 80


def write_text(path: str, parts: Iterable[str]) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts)
    return path


def document_files(docs: DataFrame, cleaned: DataFrame, chunks: DataFrame, summaries: DataFrame, papers: DataFrame) -> DataFrame:
    """ordinal, file, text of each document's cleaned text, chunks, summaries and final summary. docs: doc_id, ordinal, name."""
    kinds = [
        (cleaned.select("doc_id", F.col("cleaned_text").alias("text")), "cleaned"),
        (chunks.groupBy("doc_id").agg(key_blocks("chunk_key", "text", "position").alias("text")), "chunks"),
        (summaries.groupBy("doc_id").agg(key_blocks("chunk_key", "summary", "seq").alias("text")), "summaries"),
        (papers.select("doc_id", F.col("paper").alias("text")), "final"),
    ]
    out = None
    for rows, kind in kinds:
        named = docs.select("doc_id", "ordinal", "name").join(rows, "doc_id", "left")
        one = named.select("ordinal", F.concat("name", F.lit(f"_{kind}.txt")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def write_documents(files: DataFrame, folder: str) -> list[str]:
    return [write_text(os.path.join(folder, r.file), [r.text]) for r in files.orderBy("ordinal", "file").toLocalIterator()]


def logged(label: str, text: Column) -> Column:
    """A text with its size, under a label."""
    return F.concat(F.lit(f"{label}\n{RULE}\nCharacters: "), F.length(text).cast("string"), F.lit("\nWords: "), count_words(text).cast("string"), F.lit("\n"), strip(text), F.lit("\n\n"))


def logged_pieces(label: str, pieces: Column) -> Column:
    """Named texts with their sizes, under a label."""
    each = F.transform(pieces, lambda p: F.concat(F.lit("Entry: "), p["key"], F.lit("\nCharacters: "), F.length(p["text"]).cast("string"), F.lit("\nWords: "), count_words(p["text"]).cast("string"), F.lit("\n"), strip(p["text"]), F.lit("\n\n")))
    return F.concat(F.lit(f"{label}\n{RULE}\n"), F.when(F.coalesce(F.size(pieces), F.lit(0)) <= 0, F.lit("No entries recorded.\n\n")).otherwise(F.array_join(each, "")))


def log_entries(log: DataFrame) -> DataFrame:
    """doc_id, stage, round, name and ``entry``: a reduction's text form."""
    entry = F.concat(
        F.lit("Stage: "), "stage", F.lit("\nRound: "), F.col("round").cast("string"), F.lit("\nName: "), "name", F.lit("\nSeconds: "), F.format_number("seconds", 4), F.lit("\n\n"),
        logged_pieces("Before", F.col("inputs")), logged("Input", F.coalesce("input_text", F.lit(""))), logged_pieces("After", F.col("outputs")), logged("Output", F.coalesce("output_text", F.lit(""))), F.lit(WIDE + "\n\n"),
    )
    return log.select("doc_id", "stage", "round", "name", entry.alias("entry"))


def metric_lines(m) -> str:
    return (
        f"Run: {m['run_name']}\nInput: {m['input_path']}\nElapsed seconds: {m['elapsed_seconds']:.4f}\nInput characters: {m['input_chars']}\nInput words: {m['input_words']}\nChunks: {m['chunk_count']}\n"
        f"Output characters: {m['output_chars']}\nOutput words: {m['output_words']}\n{m['chars_per_second']:.2f} chars/s, {m['words_per_second']:.2f} words/s, {m['chunks_per_second']:.4f} chunks/s\n\n"
    )


def data_file(settings: Iterable[tuple[str, object]], metrics: DataFrame, cleaning: DataFrame, pairs: DataFrame, log: DataFrame, texts: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The data file's parts, in order.

    metrics: as ``metric_lines`` reads them, with ordinal; cleaning: ordinal, display, path, raw_chars, raw_words,
    cleaned_chars, cleaned_words, removed_citations, chunks (array of key, n_chars); pairs: ordinal, display, position,
    chunk_key, text, summary; log: ordinal (0: the stack's), display, and ``log_entries``; texts: the report's own.
    """
    yield f"Evaluation data\n{WIDE}\n\nRun configuration\n{THIN}\n" + "".join(f"{k}: {v}\n" for k, v in settings) + "\n"
    yield f"Throughput\n{THIN}\n"
    for m in metrics.orderBy("ordinal", "run_name").toLocalIterator():
        yield metric_lines(m)
    yield f"Cleaning and chunks\n{WIDE}\n\n"
    for r in cleaning.orderBy("ordinal").toLocalIterator():
        yield f"Document: {r.display}\nInput: {r.path}\nCharacters before and after cleaning: {r.raw_chars}, {r.cleaned_chars}\nWords before and after cleaning: {r.raw_words}, {r.cleaned_words}\nRemoved citations: {r.removed_citations}\nChunks: {len(r.chunks)}\n"
        yield "".join(f"- {c.key}: {c.n_chars} characters\n" for c in r.chunks) + "\n"
    yield f"Chunks before and after summarising\n{WIDE}\n\n"
    for r in pairs.orderBy("ordinal", "position").toLocalIterator():
        yield f"Document: {r.display}\nChunk: {r.chunk_key}\nCharacters: {len(r.text)}, {len(r.summary)}\n\nBefore\n{RULE}\n{r.text.strip()}\n\nAfter\n{RULE}\n{r.summary.strip()}\n\n{WIDE}\n\n"
    yield f"Reductions\n{WIDE}\n\n"
    last, some = None, False
    for r in log.orderBy("ordinal", "doc_id", "round", "stage", "name").toLocalIterator():
        if r.display != last:
            yield f"{r.display}\n{THIN}\n\n"
        last, some = r.display, True
        yield r.entry
    if not some:
        yield "No reductions recorded.\n\n"
    for label, text in texts:
        yield f"{label}\n{WIDE}\n{text.strip()}\n\n"
