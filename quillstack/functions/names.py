"""File, display and unique names of documents.

Defined results: a null path has null names, and in ``unique_names`` the name ``document``; an empty table stays empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges by which ``unique_names`` counts.
RANGES = 64


def base_name(path: Column) -> Column:
    """The last part of a path without its extension; dots that the name begins with are none."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def safe_name(path: Column) -> Column:
    """Letters, digits, - and _ of the base name; ``document`` if none is left."""
    name = F.regexp_replace(F.regexp_replace(base_name(path), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("document"))


def _title(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.title() for t in texts.to_pylist()], pa.string())


def title_case(x: Column) -> Column:
    """A capital after every character that is no letter; initcap knows spaces only, so a text is cut at them, and one that is not ASCII goes to Python."""
    simple = x.rlike(r"^[\x00-\x7F]*$")
    words = F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z]+|[^A-Za-z]+"), 0), F.initcap)
    return F.when(simple, F.array_join(words, "")).otherwise(F.arrow_udf(_title, "string")(F.when(~simple, x)))


def display_name(path: Column) -> Column:
    return title_case(F.translate(base_name(path), "_-", "  "))


def unique_names(df: DataFrame, path: str = "path", order: str = "ordinal") -> DataFrame:
    """``name``: the safe name, with _n for its n-th repetition. A ``name`` that the table has is replaced; ``order`` is a number.

    A name that very many files have is counted by ranges of ``order``: each range numbers its own, after the counts of
    those before it.
    """
    named = df.withColumn("name", safe_name(F.col(path)))
    cuts = [c for c in df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / RANGES for k in range(1, RANGES)], 0.01) if c is not None]
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(order)))
    named = named.withColumn("__part", part)
    counts = named.groupBy(F.col("name").alias("__name"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__name").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__name", "__of", before.alias("__before"))
    local = F.row_number().over(Window.partitionBy("name", "__part").orderBy(order)) - 1
    named = named.withColumn("__nth", local).join(counts, (F.col("name") == F.col("__name")) & (F.col("__part") == F.col("__of")))
    nth = F.col("__nth") + F.col("__before")
    return named.withColumn("name", F.when(nth == 0, F.col("name")).otherwise(F.concat_ws("_", "name", nth.cast("string")))).drop("__nth", "__part", "__name", "__of", "__before")
