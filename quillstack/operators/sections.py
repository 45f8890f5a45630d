"""Headings: which lines of a text are ones, and what a text's first lines name.

Defined results: a null or empty text has none; rows that repeat a doc_id have to be one text, as lines are told apart by
doc_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The patterns that make a stripped line a heading, in order of precedence, with the kind of each.
HEADINGS = (
    ("chapter", r"(?i)^chapter\s+([A-Za-z0-9]+)"),
    ("chapter", r"(?i)^part\s+([A-Za-z0-9]+)"),
    ("chapter", r"^([IVXLC]+)\s+[A-Z][A-Z'?!,\-\s]+$"),
    ("page", r"(?i)^page\s+(\d+)"),
    ("page", r"^(\d+)$"),
)


#: Where a line ends, as the chunker's ``str.splitlines`` has it after \r\n has become \n.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def headings(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, line, start (offset of the line), kind, name of every heading line.

    A line that is no heading by its words is a paragraph's if it is indented or follows a blank line; its name
    counts the headings up to it.
    """
    lines = df.select("doc_id", F.posexplode(F.split(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), LINE_END)).alias("line", "raw"))
    order = Window.partitionBy("doc_id").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bare = strip(F.col("raw"))
    lines = lines.withColumns({"bare": bare, "start": F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)), "gap": F.coalesce(strip(F.lag("raw").over(order)) == "", F.lit(False))})
    kind, name = F.when(F.col("bare") == "", None), F.when(F.col("bare") == "", None)
    for label, pattern in HEADINGS:
        kind = kind.when(F.col("bare").rlike(pattern), label)
        name = name.when(F.col("bare").rlike(pattern), F.regexp_extract("bare", pattern, 1))
    kind = kind.when(F.col("raw").startswith("    ") | F.col("raw").startswith("\t") | F.col("gap"), "paragraph")
    found = lines.withColumns({"kind": kind, "name": name}).where("kind is not null")
    nth = F.row_number().over(order)
    return found.select("doc_id", "line", F.col("start").cast("long").alias("start"), "kind", F.coalesce("name", nth.cast("string")).alias("name"))


def first_section(x: Column, section: str) -> Column:
    """struct(kind, name) that the first three lines with text name, null if none does. Looser than ``headings``: a name is the second word as it stands."""
    lines = F.slice(F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != ""), 1, 3)
    second = lambda s: F.get(F.split(s, r"\s+"), F.lit(1))
    pair = lambda name: F.struct(F.lit(section).alias("kind"), name.alias("name"))
    if section == "chapter":
        roman = HEADINGS[2][1]
        found = F.transform(lines, lambda s: F.when(F.lower(s).startswith("chapter ") | F.lower(s).startswith("part "), pair(second(s))).when(s.rlike(roman), pair(F.regexp_extract(s, roman, 1))))
    elif section == "page":
        found = F.transform(lines, lambda s: F.when(F.lower(s).startswith("page "), pair(second(s))).when(s.rlike(r"^\d+$"), pair(s)))
    else:
        return F.when(F.size(lines) > 0, pair(F.lit("1")))
    return F.get(F.filter(found, lambda p: p["name"].isNotNull()), F.lit(0))
