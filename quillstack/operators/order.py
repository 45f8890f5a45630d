"""Reading orders of chunks, from their keys.

Defined results: a null key is ordered as one of no number; ties keep their ``seq``; ``position`` replaces a column of that
name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"^(\d+)(?:\.(\d+))?$"
_ROMAN = r"^([IVXLC]+)(?:\.(\d+))?$"
# Fixed values of Roman digits.
_ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman_to_int(x: Column) -> Column:
    """A digit smaller than the one after it counts negative; nothing checks that the numeral is well-formed."""
    value = lambda c: F.coalesce(*(F.when(c == d, v) for d, v in _ROMAN_VALUES.items()), F.lit(0))
    digits = F.reverse(F.filter(F.split(x, ""), lambda c: c != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(digits, start, lambda s, c: F.struct((s["total"] + F.when(value(c) < s["last"], -value(c)).otherwise(value(c))).alias("total"), value(c).alias("last")), lambda s: s["total"])


def parse_key(x: Column) -> Column:
    """struct(label_type, main_number, sub_number, has_sub, sort_text)."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    several = F.size(words) >= 2
    part = F.when(several, F.get(words, F.lit(1))).otherwise("0")
    number, roman = part.rlike(_NUMBER), part.rlike(_ROMAN)
    sub = F.when(number | roman, F.nullif(F.regexp_extract(part, r"\.(\d+)$", 1), F.lit("")).cast("int"))
    return F.struct(
        F.when(several, F.get(words, F.lit(0))).otherwise("chunk").alias("label_type"),
        F.when(number, F.regexp_extract(part, _NUMBER, 1).cast("int")).when(roman, roman_to_int(F.regexp_extract(part, _ROMAN, 1))).otherwise(0).alias("main_number"),
        F.coalesce(sub, F.lit(0)).alias("sub_number"),
        sub.isNotNull().alias("has_sub"),
        F.when(number | roman, "").otherwise(F.lower(part)).alias("sort_text"),
    )


def ordered(chunks: DataFrame, order: str = "firstToLast", key: str = "doc_id") -> DataFrame:
    """``position`` of each chunk in its document, from 1. An unknown order is the first one."""
    k = F.col("__k")
    place = [F.when(k["sort_text"] == "front", -1).when(k["sort_text"] == "chunk", 9999).otherwise(0), k["main_number"], k["sub_number"]]
    by = {
        "lastToFirst": [*(c.desc() for c in place), F.col("seq")],
        "lastToFirstBySection": [k["sort_text"].desc(), k["main_number"].desc(), k["sub_number"], F.col("seq")],
        "firstToLastByTop": [F.when(k["has_sub"] & (k["sub_number"] != 1), 1).otherwise(0), *place, F.col("seq")],
    }.get(order, [*place, F.col("seq")])
    return chunks.withColumn("__k", parse_key(F.col("chunk_key"))).withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*by))).drop("__k")


def section_name(x: Column) -> Column:
    """``chapter 3`` of ``chapter 3.2``; a key of one word stays as it is."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    name = F.get(words, F.lit(1))
    return F.when((F.size(words) >= 2) & name.contains("."), F.concat_ws(" ", F.get(words, F.lit(0)), F.substring_index(name, ".", 1))).otherwise(x)
