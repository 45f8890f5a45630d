"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. Numbers, names (capitalised words inside a sentence) and
units become typed placeholders, so a question that was only re-parameterised keeps its template. Windows of
template tokens are hashed and joined; for every (document, item, alignment) that shares a window the whole
item is then laid against the document. It is contaminated by the item if a run of at least ``PASSAGE`` consecutive
template tokens agrees (the whole item, if that is shorter, but for its first token, which may or may not stand
inside a sentence where it is quoted) and the slots in the run are consistent: equal slot
values of the item stand for equal values in the document, and different ones for different ones. Where a slot is
not consistent with those before it, a new run begins after the slot that it contradicts, so the longest consistent run is
found wherever it is. ``PASSAGE`` consecutive tokens that agree verbatim, slot values included, are enough whatever
the run around them holds. Items of at most ``LEAST`` tokens say too little as templates: they are looked up whole and
verbatim.

Every item window is indexed, but only each ``STRIDE``-th of a document's: a run of PASSAGE tokens holds
WINDOW-token windows at STRIDE consecutive places, so one of those is looked up and no such run is missed.
Items shorter than that are looked up whole at every place. Alignments are laid by document and stretch of
``STRETCH`` tokens, so a text is split into tokens once for all items that it shares windows with there.

The index of windows is broadcast only while its counted size stays under ``BROADCAST_ROWS``, and so are the
alignments; beyond, both joins are shuffled, where equal hashes may be split between tasks.

Defined results: a null text is empty and matches nothing; an item without an id or without a token
is not searched; a document without an id can't be named and is not reported; rows that repeat a doc_id
or an item_id are reported once under it; very long texts are searched whole; extra columns are ignored; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

PASSAGE, WINDOW = 13, 8
STRIDE = PASSAGE - WINDOW + 1
LEAST = 5
STRETCH = 1024
#: Of a row of at most three numbers each: a few tens of MB.
BROADCAST_ROWS = 500_000

UNITS = (
    "mm cm km meter meters metre metres mile miles kilometer kilometers kilometre kilometres feet inch inches yard yards kg gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres ml gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent mph kph kmh watt watts volt volts joule joules degree degrees celsius fahrenheit"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
_MARK = ""


def tokens(text: Column) -> Column:
    """Lower-cased tokens; one that stands capitalised inside a sentence has a mark before it."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu}\p{Ll})", _MARK)
    return F.filter(F.split(F.lower(marked), rf"[^\p{{L}}\p{{N}}{_MARK}]+"), lambda w: w != "")


def _code(w: Column) -> Column:
    """A token's code: its placeholder's, or its hash."""
    first = F.ascii(w)
    return F.when(first.between(48, 57), F.lit(NUMBER)).when(first == ord(_MARK), F.lit(NAME)).when(w.isin(UNITS), F.lit(UNIT)).otherwise(F.xxhash64(w)).cast("long")


def template(words: Column) -> Column:
    """A code for each token."""
    return F.transform(words, _code)


def windows(codes: str, size: int, stride: int) -> Column:
    """struct(hash, pos) of the windows at every ``stride``-th place."""
    n = F.size(codes)
    cut = lambda i: F.struct(F.xxhash64(F.lit(size), *(F.get(F.col(codes), i + k) for k in range(size))).alias("hash"), i.alias("pos"))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size, F.lit(stride)), cut))


def _quoted(words: Column, shift: Column, item_tokens: Column) -> Column:
    """The document's words at the item's places, null where it has none."""
    before = F.greatest(-shift, F.lit(0))
    return F.concat(F.array_repeat(F.lit(None).cast("string"), before), F.slice(words, F.greatest(shift, F.lit(0)) + 1, item_tokens - before))


def _laid(quoted: Column) -> Column:
    """For each token of the item: its code and word, the document's word at its place, and whether the codes agree."""
    pair = lambda item, w: F.struct(item["item_codes"].alias("kind"), item["item_words"].alias("of"), w.alias("value"), (w.isNotNull() & (_code(w) == item["item_codes"])).alias("same"))
    return F.zip_with(F.arrays_zip("item_codes", "item_words"), quoted, pair)


def _passage(laid: Column) -> Column:
    """struct(run_tokens, n_slots, exact) of the longest passage, null if there is none.

    One pass over the item: ``start`` is where the run of equal codes and consistent slots up to here begins, ``same`` where
    the verbatim one does; ``slots`` are the run's. A run is judged where it ends.
    """
    slots_type = "array<struct<at:int,kind:bigint,of:string,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("same"), F.array().cast(slots_type).alias("slots"), F.lit(None).cast("struct<run_tokens:int,n_slots:int,exact:boolean>").alias("best"))
    passage = lambda size, n_slots, exact: F.struct(size.alias("run_tokens"), n_slots.alias("n_slots"), exact.alias("exact"))

    def run(s):
        slots, size = s["slots"], s["at"] - s["start"]
        exact = F.forall(slots, lambda x: x["of"] == x["value"])
        return F.when((size >= F.col("need")) & (exact | (size - F.size(slots) >= LEAST)), passage(size, F.size(slots), exact))

    def verbatim(s):
        size = s["at"] - s["same"]
        return F.when(size >= F.col("need"), passage(size, F.size(F.filter(s["slots"], lambda x: x["at"] >= s["same"])), F.lit(True)))

    def step(s, p):
        slot, after = p["same"] & p["kind"].between(NUMBER, UNIT), s["at"] + 1
        this = F.struct(s["at"].alias("at"), p["kind"].alias("kind"), p["of"].alias("of"), p["value"].alias("value"))
        # The last slot of the run that this one contradicts: one of them has an equal and one a different value.
        against = F.when(slot, F.coalesce(F.array_max(F.transform(F.filter(s["slots"], lambda x: (x["kind"] == p["kind"]) & ((x["of"] == p["of"]) != (x["value"] == p["value"]))), lambda x: x["at"])), F.lit(-1))).otherwise(F.lit(-1))
        start = F.when(p["same"], F.greatest(s["start"], against + 1)).otherwise(after)
        ends = F.when(~p["same"] | (against >= 0), F.greatest(s["best"], run(s), verbatim(s))).when(p["of"] != p["value"], F.greatest(s["best"], verbatim(s))).otherwise(s["best"])
        kept = F.when(against >= 0, F.filter(s["slots"], lambda x: x["at"] > against)).otherwise(s["slots"])
        return F.struct(
            after.alias("at"),
            start.alias("start"),
            F.when(p["same"] & (p["of"] == p["value"]), s["same"]).otherwise(after).alias("same"),
            F.when(~p["same"], F.array().cast(slots_type)).when(slot, F.concat(kept, F.array(this))).otherwise(s["slots"]).alias("slots"),
            # Of a shorter item only what reaches its end counts.
            F.when(F.col("need") == PASSAGE, ends).otherwise(s["best"]).alias("best"),
        )

    return F.aggregate(laid, zero, step, lambda s: F.greatest(s["best"], run(s), verbatim(s)))


def _verbatim(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """The pairs of documents and items of at most ``LEAST`` tokens that they hold; None where there are no such items."""
    bare = lambda words: F.transform(words, lambda w: F.translate(w, _MARK, ""))
    short = items.where(F.size("item_words").between(1, LEAST)).select("item_id", F.size("item_words").alias("item_tokens"), F.size(F.filter(template(F.col("item_words")), lambda c: c.between(NUMBER, UNIT))).alias("n_slots"), F.array_join(bare(F.col("item_words")), " ").alias("phrase"))
    sizes = sorted(r[0] for r in short.select("item_tokens").distinct().collect())
    if not sizes:
        return None
    words = docs.select("doc_id", F.inline(F.array(F.struct(bare(tokens(F.col("text"))).alias("words")))))
    cut = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.concat_ws(" ", *(F.get("words", i + k) for k in range(n)))))
    phrases = words.select("doc_id", F.explode(F.concat(*(F.coalesce(cut(n), F.array().cast("array<string>")) for n in sizes))).alias("phrase"))
    small = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = phrases.join(F.broadcast(short) if small else short, "phrase").groupBy("doc_id", "item_id").agg(F.max(F.struct("item_tokens", "n_slots")).alias("of"))
    return hits.select("doc_id", "item_id", "of.item_tokens", F.col("of.item_tokens").alias("run_tokens"), "of.n_slots", F.lit(True).alias("exact"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_tokens, run_tokens, n_slots, exact (all slot values equal): one row for each pair that is contaminated."""
    items = texts(benchmark, "item_id").where("item_id is not null").withColumn("item_words", tokens(F.col("text"))).drop("text")
    named = texts(docs).where("doc_id is not null")
    verbatim = _verbatim(named, items)
    items = items.where(F.size("item_words") > LEAST).withColumn("item_codes", template(F.col("item_words"))).withColumn("item_tokens", F.size("item_words"))
    items = items.select("item_id", "item_words", "item_codes", "item_tokens", F.least(F.col("item_tokens") - 1, F.lit(PASSAGE)).alias("need"))

    # Long items by their windows, and one group for each of the few lengths below PASSAGE.
    short = sorted(r[0] for r in items.where(F.col("need") < PASSAGE).select("need").distinct().collect())
    forms = [(WINDOW, STRIDE), *((n, 1) for n in short)]
    index = None
    for k, (size, _) in enumerate(forms):
        part = items.where(F.col("need") == (PASSAGE if k == 0 else size)).select("item_id", "item_tokens", F.explode(windows("item_codes", size, 1)).alias("w")).select("item_id", "item_tokens", "w.hash", F.col("w.pos").alias("item_pos")).where(F.lit(k == 0) | (F.col("item_pos") == 1))
        index = part if index is None else index.unionByName(part)
    index = index.distinct()

    coded = named.select("doc_id", template(tokens(F.col("text"))).alias("codes"))
    looked = F.explode(F.concat(*(F.coalesce(windows("codes", *form), F.array().cast("array<struct<hash:bigint,pos:int>>")) for form in forms)))
    found = coded.select("doc_id", looked.alias("w")).select("doc_id", "w.hash", "w.pos")
    small = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = found.join(F.broadcast(index) if small else index, "hash")
    aligned = hits.select("doc_id", "item_id", "item_tokens", (F.col("pos") - F.col("item_pos")).alias("shift"))
    aligned = aligned.groupBy("doc_id", F.floor(F.col("shift") / STRETCH).alias("stretch")).agg(F.collect_set(F.struct("item_id", "item_tokens", "shift")).alias("alignments"))
    aligned = materialize(aligned.drop("stretch"), "aligned")
    few = aligned.agg(F.coalesce(F.sum(F.size("alignments")), F.lit(0))).first()[0] <= BROADCAST_ROWS

    # Through a one-row generator the words are made before the lambda that reads them for each alignment.
    laid = named.join(F.broadcast(aligned) if few else aligned, "doc_id").select("doc_id", "alignments", F.inline(F.array(F.struct(tokens(F.col("text")).alias("words")))))
    laid = laid.select("doc_id", F.explode(F.transform("alignments", lambda a: F.struct(a["item_id"].alias("item_id"), _quoted(F.col("words"), a["shift"], a["item_tokens"]).alias("quoted")))).alias("a")).select("doc_id", "a.*")
    laid = laid.join(F.broadcast(items) if small else items, "item_id")
    # Alignments without a passage are dropped after the aggregate: a filter here would be pushed through the
    # projection and evaluate its arrays again.
    laid = laid.select("doc_id", "item_id", "item_tokens", _passage(_laid(F.col("quoted"))).alias("best"))
    best = laid.groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.max("best").alias("best")).where("best is not null")
    out = best.select("doc_id", "item_id", "item_tokens", "best.run_tokens", "best.n_slots", "best.exact")
    return out if verbatim is None else out.unionByName(verbatim)
