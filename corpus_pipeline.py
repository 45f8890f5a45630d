"""The corpus pipeline: documents to packed training sequences.

STAGES run in order; each reads the table that the one before has written, and works on all of it. All but the
last return the columns of ``documents``; the last returns packed pieces. SQL can express none of them (learned
models, links between texts, a vocabulary), so ORACLE_SQL is None and the tests compare with plain Python.

Defined results of every stage: rows come out with all their columns, whatever their names, and repeated rows as often as
they came in; very long texts are worked on whole; an empty table gives an empty one. A row without doc_id is never
a copy or contaminated, as it can't be named; a null text is an empty one to every decision and stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontam, packing, secrets, sketch_dedup, toxicity
from quillstack.llm.common import materialize, table

ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ``ids``."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go. The model learns from the stage's documents that have a label and aren't held out.

    A null or empty text has the score of the bias alone; without labels to learn from every score is 0 and all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = toxicity.scorer(model)(F.coalesce("text", F.lit("")))
    return docs.where(score < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the rows of the smallest doc_id stay.

    Texts without words are no copies and all stay; rows that repeat a doc_id go or stay together.
    """
    return _without(docs, sketch_dedup.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows of their doc_id; without benchmark items all stay."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text is replaced by its kind in brackets, and n_chars follows. A null text stays as it is."""
    out = docs.withColumn("text", F.arrow_udf(secrets.masker(secrets.trained()), "string")("text"))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids; a null or empty text is one piece, of the end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
