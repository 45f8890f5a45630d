"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct word shingles; its sketch is the ``K`` smallest of their hashes. Two documents
are linked if the Jaccard similarity of their sets reaches ``percent`` hundredths.

1. Documents of equal sets are one class, which its smallest doc_id stands for from here on.
2. Inverted lists of retained values generate candidates. Linked documents share at least ``least_shared`` of the
   retained values (but for a chance below one in a million at the threshold), or nearly all of a small set.
   So it is enough to list a document under the rarest of its values, as many as could all be missing from a
   linked one, plus one; passages that many documents have in common stay out of the lists.
3. A list's members are first compared with one member, of the highest counts of retained values, which lists of one
   group mostly agree on. Candidates pass if the similarity that the union's sketch estimates is not clearly too low,
   and are verified on the full sets. Members of one component, as far as links are known, share a label.
4. In what is left only members of different labels are still compared. Lists of up to ``LIST`` members are joined
   with themselves. In longer ones members are compared by their differences from the list's hub (``_differences``):
   two members of which one is not linked to the hub must share a part of both's differences that can be counted, so
   it is enough to meet under the rarest of those. That is a prefix filter on the full sets, and exact.

Nothing here gathers a list in one task: picks are aggregates, and lists meet themselves in joins that Spark
may split. Exact copies are never expanded into pairs, and labels only spare comparisons inside of a component.

Defined results: a null or empty text has an empty set, which is linked with nothing; texts of fewer words than
a shingle are one shingle; a null doc_id takes no part, its component is null and it is kept; rows that repeat
a doc_id get the same result; very long texts are used whole; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, blocks, byte_codes, materialize, scramble, texts, trimmed, utf8, word_hashes
from .components import components

K = 32
#: The chance that two documents at the threshold share fewer retained values than ``least_shared``.
MISS = 1e-6
LIST = 64
BLOCK_BYTES = 1 << 19
#: Of two longs each.
BROADCAST_ROWS = 500_000
#: Differences of one group that are counted together.
PART = 1 << 15
#: Bits that bound how many differences two members share.
BITS = 512

_CODES = byte_codes(6)
_MIX = np.uint64(0x9E6C63D0676A9A99)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = utf8(column)
    out = []
    for a, b in blocks(at, BLOCK_BYTES):
        h, _, _, first = word_hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a], SPACES, _CODES)
        rolled = h[: max(0, len(h) - width + 1)].copy()
        for k in range(1, width):
            rolled = rolled * _MIX + h[k : len(h) - width + 1 + k]
        rolled = scramble(rolled)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= width:
                out.append(np.unique(rolled[i : j - width + 1]))
            elif j > i:
                one = np.array([j - i], np.uint64)
                for k in range(i, j):
                    one = one * _MIX + h[k]
                out.append(scramble(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sketch"])

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["rep", "set"])

    return run


def least_shared(percent: int) -> int:
    """How many of the union's ``K`` retained values documents at the threshold share, but for a chance below ``MISS``: 16 at 85, 13 at 80. Holds from 36 up."""
    p, total = percent / 100, 0.0
    for n in range(K + 1):
        total += math.comb(K, n) * p**n * (1 - p) ** (K - n)
        if total >= MISS:
            return max(1, n)
    return K


def _estimated(least: int):
    """a, b and their sketches as bytes -> the pairs of whose union's sketch at least so many are shared."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:] == both[:-1]
                distinct = len(both) - int(twice.sum())
                if distinct > K:
                    union = np.unique(both)[:K]
                    shared = int((both[1:][twice] <= union[-1]).sum())
                    keep.append(shared >= least)
                else:
                    keep.append(int(twice.sum()) * K >= least * distinct)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(percent: int):
    """a, b and their sets as bytes -> the pairs that are linked."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(percent: int) -> Column:
    """Whether the threshold admits sets of these sizes, n and na."""
    return 100 * F.least("n", "na") >= percent * F.greatest("n", "na")


class _Verifier:
    """Checks pairs by estimate and then by full set; ``sets`` has rep and set of every document in a list."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b), as they are given, none twice."""
        short = self.sets.select("rep", F.substring("set", 1, 8 * K).alias("sketch"))
        likely = pairs.select("a", "b").distinct().join(short.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(short.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        likely = likely.select("a", "b", "sa", "sb").mapInArrow(_estimated(least_shared(self.percent)), "a long, b long")
        full = likely.join(self.sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(self.sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
        return materialize(full.select("a", "b", "sa", "sb").mapInArrow(_verified(self.percent), "a long, b long"), "links")


def _labelled(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries with ``label``: the component of ``rep`` as far as links have been found."""
    of = found.select(F.col("node").alias("__node"), F.col("component").alias("label"))
    return entries.join(of, F.col("rep") == F.col("__node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("__node")


def _mixed(entries: DataFrame, *keys: str) -> DataFrame:
    """The keys of the lists of more than one label."""
    return entries.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*keys)


def _difference(percent: int):
    """hub, rep, label, set, the hub's set -> with sizes, whether they are linked, and what only one of them has, also as ``BITS`` bits with the number of those that clash."""

    def run(batches):
        for batch in batches:
            n, of, linked, delta, bits, clash = [], [], [], [], [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                d = np.setxor1d(x, y, assume_unique=True)
                shared = (len(x) + len(y) - len(d)) // 2
                n.append(len(x)), of.append(len(y)), delta.append(d.view(np.int64))
                linked.append(100 * shared >= percent * (shared + len(d)))
                table = np.zeros(BITS, bool)
                table[d % np.uint64(BITS)] = True
                bits.append(np.packbits(table).view(np.int64)), clash.append(len(d) - int(table.sum()))
            numbers = [pa.array(x, pa.int64()) for x in (n, of)], [pa.array(x, pa.list_(pa.int64())) for x in (delta, bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *numbers[0], pa.array(linked, pa.bool_()), *numbers[1], pa.array(clash, pa.int64())], ["hub", "rep", "label", "n", "nh", "linked", "delta", "bits", "clash"])

    return run


def _differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, rep, label, n, nh, linked, delta, bits, clash: each member's shingles that its hub has not, and the other way round."""
    of = lambda name: sets.select(F.col("rep").alias(name), F.col("set").alias(f"set_{name}"))
    pairs = groups.join(of("rep"), "rep").join(of("hub"), "hub").select("hub", "rep", "label", "set_rep", "set_hub")
    return pairs.mapInArrow(_difference(percent), "hub long, rep long, label long, n long, nh long, linked boolean, delta array<long>, bits array<long>, clash long")


def _split(batches):
    """hub, rep, parts, delta -> each member's differences as an array for each part of its group; a value is always of the same part."""
    for batch in batches:
        hubs, numbers, reps, values = [], [], [], []
        for hub, rep, parts, delta in zip(*batch.columns, strict=True):
            v = delta.values.to_numpy(zero_copy_only=False)
            of = v.view(np.uint64) % np.uint64(parts.as_py())
            order = np.argsort(of, kind="stable")
            present, first = np.unique(of[order], return_index=True)
            for part, run in zip(present.tolist(), np.split(v[order], first[1:]), strict=False):
                hubs.append(hub.as_py()), numbers.append(part), reps.append(rep.as_py()), values.append(run)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (hubs, numbers, reps)), pa.array(values, pa.list_(pa.int64()))], ["hub", "part", "rep", "values"])


def _counted(group: pa.Table) -> pa.Table:
    """One part of a group -> for each member the values that others have too, with the number of members that have them."""
    lists = group["values"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    times = times[place]
    held = times > 1
    ends = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(lengths)])]
    values = pa.StructArray.from_arrays([pa.array(times[held], pa.int64()), pa.array(flat[held], pa.int64())], ["times", "value"])
    out = pa.table({"hub": group["hub"], "rep": group["rep"], "values": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})
    return out.filter(pa.array(np.diff(ends) > 0))


def _rarest(deltas: DataFrame, percent: int) -> DataFrame:
    """hub, value, rep, label, n, linked, d, bits, clash, shared, rank, strong: each member under the rarest of its differences from the hub.

    Let x and y differ from the hub in dx and dy shingles, o of them the same ones. They are linked if and only if
    dx + dy - 2 o <= c (nx + ny), where c = (100 - percent) / (100 + percent). If x is not linked to the hub,
    dx > c (nx + nh), and so 2 o > dy - c (ny - nh) for its partner y (``strong``), and o >= (dx - c (nx + nh)) / (1 + c)
    for x itself. Of d differences in one order for all, the d - o + 1 first ones contain a common one. A difference
    that no other member has can't be common, so it takes its place, the first, but has no entry. They are counted as
    arrays, in parts of about ``PART`` values (and what a value has that very many members share), not as a row each.
    """
    parts = deltas.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("delta")) / PART)).alias("parts"))
    split = deltas.join(parts, "hub").select("hub", "rep", "parts", "delta").mapInArrow(_split, "hub long, part long, rep long, values array<long>")
    counted = split.groupBy("hub", "part").applyInArrow(_counted, "hub long, rep long, values array<struct<times:long,value:long>>")
    ranked = counted.groupBy("hub", "rep").agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("values"))
    c, k = 100 - percent, 100 + percent
    d, shared = F.size("delta").cast("long"), F.size("values").cast("long")
    strong = F.floor((k * d - c * (F.col("n") - F.col("nh"))) / (2 * k)) + 1
    weak = F.greatest(F.lit(1), F.ceil((k * d - c * (F.col("n") + F.col("nh"))) / (c + k)))
    held = deltas.join(ranked, ["hub", "rep"]).select("hub", "rep", "label", "n", "linked", "bits", "clash", d.alias("d"), shared.alias("shared"), (shared - strong + 1).alias("first"), F.when(F.col("linked"), shared - strong + 1).otherwise(shared - weak + 1).alias("last"), "values")
    taken = F.slice("values", F.lit(1), F.greatest(F.lit(0), F.greatest("first", "last")).cast("int"))
    kept = ["rep", "label", "n", "linked", "d", "bits", "clash", "shared"]
    return held.select("hub", *kept, "first", F.posexplode(taken).alias("rank", "v")).select("hub", "v.value", *kept, "rank", (F.col("rank") < F.col("first")).alias("strong"))


def _needed(percent: int) -> Column:
    """2 (100 + percent) times the differences from one hub that members must have in common to be linked."""
    return (100 + percent) * (F.col("d") + F.col("da")) - (100 - percent) * (F.col("n") + F.col("na"))


def _may_share(percent: int) -> Column:
    """Whether members may have them: common differences set common bits, or fewer by as many as clash in one of the two. Exact, and sharp up to some 300 differences."""
    both = reduce(Column.__add__, (F.bit_count(F.col("bits")[k].bitwiseAND(F.col("bitsa")[k])) for k in range(BITS // 64)))
    return 2 * (100 + percent) * (both + F.least("clash", "clasha")) >= _needed(percent)


def _meetings(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs that are listed under one difference and may be linked: one not linked to the hub, the other by its strong ones.

    The first difference that they have in common is among those they are listed under, and all others come after it in both.
    """
    names = {"rep": "a", "label": "la", "n": "na", "linked": "linkeda", "d": "da", "bits": "bitsa", "clash": "clasha", "shared": "shareda", "rank": "ranka", "strong": "stronga"}
    other = entries.where("strong").select("hub", "value", *(F.col(x).alias(y) for x, y in names.items()))
    room = 2 * (100 + percent) * F.least(F.col("shared") - F.col("rank"), F.col("shareda") - F.col("ranka")) >= _needed(percent)
    once = F.col("linkeda") | (F.col("strong") & (F.col("rep") < F.col("a")))
    met = entries.where("not linked").join(other, ["hub", "value"]).where((F.col("label") != F.col("la")) & once & room & _alike(percent) & _may_share(percent))
    return met.select(F.col("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    base = texts(docs)
    rows = materialize(base.mapInArrow(trimmed(_sketches(width)), "doc_id long, n long, digest binary, sketch array<long>"), "sketches")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = materialize(classes, "classes")
    entries = _lists(rows, classes, percent)

    wanted = entries.select(F.explode(F.array("rep", "hub")).alias("doc_id")).distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = base.join(F.broadcast(wanted) if few else wanted, "doc_id")
    sets = materialize(sets.select("doc_id", "text").mapInArrow(trimmed(_full_sets(width)), "rep long, set binary").dropDuplicates(["rep"]), "sets")
    verify = _Verifier(sets, percent)

    links = [verify(entries.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))]
    # Lists whose members are all of one label have nothing left to find.
    entries = _labelled(entries, components(links[0]))
    left = materialize(entries.join(_mixed(entries, "value"), "value", "left_semi"), "mixed")
    large = left.where(F.col("size") > LIST).select("hub", "rep", "label").distinct()
    several = not large.isEmpty()
    if several:
        deltas = materialize(_differences(large, sets, percent), "differences")
        links.append(deltas.where("linked and hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    small = left.where(F.col("size") <= LIST)
    other = small.select("value", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    pairs = small.join(other, "value").where((F.col("a") < F.col("rep")) & (F.col("label") != F.col("la")) & _alike(percent)).select("a", F.col("rep").alias("b"))
    if not several:
        links.append(verify(pairs))
    else:
        met = _rarest(deltas.join(_mixed(deltas, "hub"), "hub", "left_semi"), percent)
        met = materialize(met.join(_mixed(met, "hub", "value"), ["hub", "value"], "left_semi"), "met")
        # Again each list's members are first compared with one, the nearest to the hub.
        nearest = met.groupBy("hub", "value").agg(F.min_by(F.struct(*(F.col(x).alias(y) for x, y in (("rep", "a"), ("n", "na"), ("label", "la"), ("d", "da"), ("bits", "bitsa"), ("clash", "clasha")))), F.struct("d", "rep")).alias("p")).select("hub", "value", "p.*")
        picks = met.join(nearest, ["hub", "value"]).where((F.col("label") != F.col("la")) & _alike(percent) & _may_share(percent)).select("a", F.col("rep").alias("b"))
        links.append(verify(pairs.unionByName(picks)))
        met = _labelled(met.drop("label"), components(reduce(DataFrame.unionByName, links)))
        links.append(verify(_meetings(materialize(met.join(_mixed(met, "hub", "value"), ["hub", "value"], "left_semi"), "met"), percent)))
    found = components(reduce(DataFrame.unionByName, links))

    out = rows.select("doc_id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _lists(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """value, rep, n, size, hub: each class under the rarest of its retained values, lists of one left out.

    hub is a document to compare the list's members with: of a short list the member of the highest counts, of a long
    one the anchor that most members agree on. It need not be a member.
    """
    reps = rows.join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("d")), "doc_id").where("digest = d").select(F.col("doc_id").alias("rep"), "n", "sketch").dropDuplicates(["rep"])
    flat = reps.select("rep", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    common = flat.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    held = flat.join(common, "value").groupBy("rep").agg(F.max("n").alias("n"), F.max("kept").alias("kept"), F.sum("times").alias("weight"), F.collect_list(F.struct("times", "value")).alias("values"))
    # All but least_shared of the retained values (of a small set: of what a linked one must have) and one more.
    needed = F.least(F.lit(least_shared(percent)), F.ceil(F.col("n") * percent / 100).cast("int"))
    room = F.col("kept") - needed + 1 - (F.col("kept") - F.size("values"))
    # A document's anchor is the one of the highest counts among those with the same most frequent value.
    held = materialize(held.withColumn("top", F.array_max("values")["value"]), "held")
    anchors = held.groupBy("top").agg(F.max_by("rep", F.struct("weight", F.xxhash64("rep"))).alias("anchor"))
    listed = held.where(room > 0).join(anchors, "top").select("rep", "n", "weight", "anchor", F.explode(F.slice(F.sort_array("values"), F.lit(1), F.greatest(F.lit(0), room))).alias("v")).select("rep", "n", "weight", "anchor", "v.value")
    listed = materialize(listed, "listed")
    votes = listed.groupBy("value", "anchor").agg(F.count(F.lit(1)).alias("votes"), F.max(F.struct("weight", F.xxhash64("rep"), "rep")).alias("best"))
    several = votes.groupBy("value").agg(F.sum("votes").alias("size"), F.max("best")["rep"].alias("own"), F.max_by("anchor", F.struct("votes", "anchor")).alias("main")).where("size > 1")
    several = several.select("value", "size", F.when(F.col("size") > LIST, F.col("main")).otherwise(F.col("own")).alias("hub"))
    return materialize(listed.join(several, "value").select("value", "rep", "n", "size", "hub"), "lists")
