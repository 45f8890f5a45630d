"""Removal of repeated byte strings by bucket-pointer refinement, over the whole corpus.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier, in a document of smaller
doc_id or earlier in the same one. Texts are UTF-8 bytes and strings never cross documents.

Suffixes start in buckets by their first q-gram, and buckets are refined by the identifiers that later offsets
already have: the identifier of 2k bytes at p follows from those of k bytes at p and p + k, so each round
reuses the last (``identifiers``). An identifier is a 64-bit name that depends on the string alone; every
executor gives equal strings equal names, and buckets are formed by sorting names, not by ranks that one
machine would have to hand out.

Only what can still matter goes on to the next refinement:

1. Of the strings that start at neighbouring places, those that have their smallest Q-gram in common form a
   run. One row a run is bucketed, by that Q-gram's name: about one place in 27. A bucket of one is done.
2. Buckets are refined by the name of the run's whole content. A run whose content is also found earlier is
   repeated as a whole. The first run of each content is refined further only where its bucket holds other
   contents.
3. Each string of those runs is bucketed by the name of all its bytes.

Every bucket is read as a sorted stream with constant state, whatever its size. Before rows move, each batch
of documents settles what repeats inside it, so a string that a third of all documents have is sent once
a batch. Nothing is sampled: a document's smallest Q-grams depend on its text alone.

Defined results: a null or empty text has no bytes; a null doc_id takes no part and is kept whole; rows that
repeat a doc_id are one document that is listed again, each getting the removals of that id (rows of one id
are meant to have one text); very long texts are cut into overlapping segments inside a worker; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_codes, materialize, squeezed, texts, unsqueezed, utf8

LENGTH = 100
Q = 48
BLOCK_BYTES = 1 << 20
#: Places inside a segment take so many bits of the value whose minimum is sought; the rest are the name's.
_PLACE_BITS = 23
SEGMENT = (1 << _PLACE_BITS) - 1

_CODES = byte_codes(5)
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))
_R29, _R32 = np.uint64(29), np.uint64(32)

#: What is known of a run or a string.
SINGLE, REPEATED, OPEN = range(3)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two strings one after the other, from theirs."""
    h = a * _A
    h += b
    h ^= h >> _R29
    h *= _B
    h ^= h >> _R32
    return h


def identifiers(raw: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Names of the strings of each of these sizes at every place, by doubling; a size is composed of its binary digits."""
    names = {1: _CODES[raw]}
    k = 1
    while 2 * k <= max(sizes):
        names[2 * k] = _join(names[k][:-k] if k < len(names[k]) else names[k][:0], names[k][k:])
        k *= 2
    out = []
    for size in sizes:
        have, done = None, 0
        for bit in sorted((k for k in names if size & k), reverse=True):
            have = names[bit] if have is None else _join(have[: max(0, len(raw) - done - bit + 1)], names[bit][done:])
            done += bit
        out.append(have)
    return out


class Runs:
    """The runs of a block of documents: row, first place (in the row), number of strings, names."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, length: int, q: int):
        self.length, self.q = length, q
        parts = []
        if len(at) == 2 and len(raw) > SEGMENT:
            step = SEGMENT - length + 1
            for s in range(0, len(raw) - length + 1, step):
                piece = raw[s : s + SEGMENT]
                parts.append((s, self._of(piece, np.array([0, len(piece)]))))
        else:
            parts.append((0, self._of(raw, at)))
        join = lambda k, move=False: np.concatenate([p[k] + s if move else p[k] for s, p in parts])
        self.row, self.lo, self.n = join(0), join(1, True), join(2)
        self.gram, self.content = join(3), join(4)
        self.starts = at[:-1]
        self.names = parts[0][1][5] if len(parts) == 1 else None
        self.raw = raw

    def _of(self, raw, at):
        length, q = self.length, self.q
        count = len(raw) - length + 1
        if count <= 0:
            z = np.zeros(0, np.int64)
            return z, z, z, z.view(np.uint64), z.view(np.uint64), None
        gram, half, whole = identifiers(raw, (q, 64, length)) if length > 64 else (*identifiers(raw, (q, q, length)),)
        w = length - q + 1
        # The smallest name in each window of w places; its low bits are its place, so the first of equal ones is taken.
        low = np.uint64((1 << _PLACE_BITS) - 1)
        v = gram | low
        v ^= low
        v |= np.arange(len(v), dtype=np.uint64)
        padded = np.full(-(-len(v) // w) * w, np.uint64(2**64 - 1))
        padded[: len(v)] = v
        cells = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(cells[:, ::-1], 1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(cells, 1).ravel()
        place = (np.minimum(ahead[:count], behind[w - 1 : w - 1 + count]) & low).astype(np.int64)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:count]
        valid = np.flatnonzero(np.arange(count) + length <= at[1:][row])
        place, row = place[valid], row[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        lo = valid[first]
        n = np.diff(np.append(first, len(valid)))
        content = _join(_join(whole[lo], whole[lo + n - 1]), n.astype(np.uint64))
        return row[first], lo - at[row[first]], n, gram[place[first]], content, (half, whole)

    def strings(self, state: np.ndarray):
        """Row, place in the row, name and check of the strings in open runs."""
        pick = np.flatnonzero(state == OPEN)
        n = self.n[pick]
        run = np.repeat(pick, n)
        place = self.lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        block = place + self.starts[self.row[run]]
        if self.names is not None:
            half, whole = self.names
            return self.row[run], place, whole[block], self._check(half[block], half[block + self.length - 64] if self.length > 64 else half[block])
        names, checks = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
        for i, b in enumerate(block.tolist()):
            half, whole = identifiers(self.raw[b : b + self.length], (64 if self.length > 64 else self.q, self.length))
            names[i], checks[i] = whole[0], self._check(half[:1], half[self.length - 64 :][:1] if self.length > 64 else half[:1])[0]
        return self.row[run], place, names, checks

    @staticmethod
    def _check(a, b):
        return ((a ^ b * _C) * _B) >> _R32


def _pack(place, n, state):
    return (place.astype(np.int64) << 10) | (np.asarray(n, np.int64) << 2) | state


def _settle(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows repeat an earlier one of the same keys within a batch."""
    order = np.lexsort((place, doc, *reversed(keys)))
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    same &= (doc[order][1:] != doc[order][:-1]) | (place[order][1:] != place[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def _emit_runs(length: int, q: int):
    """doc_id, text -> bucket, content, doc_id, code. A settled run's bucket is its content's, so that these spread out."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = utf8(batch.column(1))
            parts = []
            for a, b in blocks(at, BLOCK_BYTES):
                r = Runs(raw[at[a] : at[b]], at[a : b + 1] - at[a], length, q)
                parts.append((keys[r.row + a], r.lo, r.n, r.gram, r.content))
            if not parts:
                continue
            doc, lo, n, gram, content = (np.concatenate(x) for x in zip(*parts, strict=True))
            settled = _settle([gram, content], doc, lo)
            bucket = np.where(settled, content * _C + doc.astype(np.uint64), gram)
            code = _pack(lo, n, np.where(settled, REPEATED, OPEN))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket.view(np.int64), content.view(np.int64), doc, code)], ["bucket", "content", "doc_id", "code"])

    return run


def _refine_runs(batches):
    """Sorted by bucket, content, doc_id, code -> doc_id, code of the runs that are repeated or still open.

    Only a bucket's first run waits for what follows it; its state is all that is carried on.
    """
    last = head = None  # the row before, as a tuple; the open bucket's first run
    kinds = 0

    def close():
        if head is not None and kinds > 1:
            yield head[2], (head[3] & ~3) | OPEN

    for batch in batches:
        bucket, content, doc, code = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        settled = (code & 3) == REPEATED
        out_doc, out_code = [doc[settled]], [code[settled]]
        bucket, content, doc, code = (x[~settled] for x in (bucket, content, doc, code))
        if len(bucket):
            before = [np.concatenate(([0 if last is None else last[k]], x[:-1])) for k, x in enumerate((bucket, content, doc, code))]
            new_bucket = bucket != before[0]
            new_bucket[0] |= last is None
            new_content = new_bucket | (content != before[1])
            again = ~new_content & (doc == before[2]) & (code >> 2 == before[3] >> 2)
            last = (bucket[-1], content[-1], doc[-1], code[-1])
            bucket, content, doc, code, new_bucket, new_content = (x[~again] for x in (bucket, content, doc, code, new_bucket, new_content))
        if len(bucket):
            heads = np.flatnonzero(new_bucket)
            inner = ~new_bucket
            out_doc.append(doc[inner])
            out_code.append((code[inner] & ~3) | np.where(new_content[inner], OPEN, REPEATED))
            stop = heads[0] if len(heads) else len(bucket)
            kinds += int(new_content[:stop].sum())
            if len(heads):
                for d, c in close():
                    out_doc.append(np.array([d]))
                    out_code.append(np.array([c]))
                contents = np.add.reduceat(new_content.astype(np.int64), heads)
                done = (contents[:-1] > 1).nonzero()[0]
                out_doc.append(doc[heads[done]])
                out_code.append((code[heads[done]] & ~3) | OPEN)
                head = tuple(x[heads[-1]] for x in (bucket, content, doc, code))
                kinds = int(contents[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_code))], ["doc_id", "code"])
    rest = list(close())
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rest], pa.int64()), pa.array([x[1] for x in rest], pa.int64())], ["doc_id", "code"])


def _by_row(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of a list column's values."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    rows = codes.value_parent_indices() if hasattr(codes, "value_parent_indices") else None
    rows = pa.compute.list_parent_indices(codes) if rows is None else rows
    return rows.to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_flatten(codes).to_numpy(zero_copy_only=False).astype(np.int64)


def _emit_strings(length: int, q: int):
    """doc_id, text, codes -> name, doc_id, code, check of the strings still open."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = unsqueezed(batch.column(1))
            of, code = _by_row(batch.column(2))
            parts = []
            for a, b in blocks(at, BLOCK_BYTES):
                r = Runs(raw[at[a] : at[b]], at[a : b + 1] - at[a], length, q)
                mine = (of >= a) & (of < b)
                spot = (of[mine] - a) << 40 | code[mine] >> 10
                order = np.argsort(spot)
                spot, state = spot[order], (code[mine] & 3)[order]
                have = r.row << 40 | r.lo
                k = np.minimum(np.searchsorted(spot, have), max(0, len(spot) - 1))
                states = np.where(spot[k] == have, state[k], SINGLE) if len(spot) else np.full(len(have), SINGLE)
                row, place, name, check = r.strings(states)
                parts.append((keys[row + a], place, name, check))
            if not parts:
                continue
            doc, place, name, check = (np.concatenate(x) for x in zip(*parts, strict=True))
            settled = _settle([name, check], doc, place)
            # Settled strings at consecutive places go on as one row (of up to 128, for code's sake), under a name that spreads them out.
            joined = np.zeros(len(place), bool)
            joined[1:] = settled[1:] & settled[:-1] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + 1) & (place[1:] & 127 != 0)
            first = np.flatnonzero(~joined)
            n = np.diff(np.append(first, len(place)))
            doc, place, name, check, settled = (x[first] for x in (doc, place, name, check, settled))
            name = np.where(settled, name * _C + doc.astype(np.uint64), name)
            code = _pack(place, n, np.where(settled, REPEATED, OPEN))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), check.view(np.int64), doc, code)], ["name", "check", "doc_id", "code"])

    return run


def _refine_strings(batches):
    """Sorted by name, check, doc_id, code -> doc_id, code of the strings that are not their bucket's first."""
    last = None
    for batch in batches:
        name, check, doc, code = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        settled = (code & 3) == REPEATED
        out_doc, out_code = doc[settled], code[settled]
        name, check, doc, code = (x[~settled] for x in (name, check, doc, code))
        if len(name):
            first = last or (name[0], ~check[0], doc[0], code[0])
            before = [np.concatenate(([first[k]], x[:-1])) for k, x in enumerate((name, check, doc, code))]
            same = (name == before[0]) & (check == before[1])
            # A row that repeats the one before is no other place; neither is it the bucket's first if that is not.
            other = (doc != before[2]) | (code != before[3])
            hit = same & other
            last = (name[-1], check[-1], doc[-1], code[-1])
            out_doc, out_code = np.concatenate([out_doc, doc[hit]]), np.concatenate([out_code, (code[hit] & ~3) | REPEATED])
        yield pa.RecordBatch.from_arrays([pa.array(out_doc), pa.array(out_code)], ["doc_id", "code"])


def _cut(length: int):
    """doc_id, text, codes of what repeats -> the result's rows."""

    def run(batches):
        for batch in batches:
            raw, at = unsqueezed(batch.column(1))
            of, code = _by_row(batch.column(2))
            a = code >> 10
            b = np.minimum(a + (code >> 2 & 255) - 1 + length, np.diff(at)[of]) if len(of) else a
            order = np.lexsort((a, of))
            of, a, b = of[order], a[order], b[order]
            bounds = np.searchsorted(of, np.arange(len(at)))
            data = raw.tobytes()
            removed, spans, digests = [], [], []
            for i in range(len(at) - 1):
                sha, done, gone, runs = hashlib.sha256(), 0, 0, 0
                base = int(at[i])
                for x, y in zip(a[bounds[i] : bounds[i + 1]].tolist(), b[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                    if y <= done and runs:
                        continue
                    if x > done or not runs:
                        sha.update(data[base + done : base + x])
                        runs += 1
                        done = x
                    gone += y - done
                    done = y
                sha.update(data[base + done : int(at[i + 1])])
                removed.append(gone), spans.append(runs), digests.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_places(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc_id, code: every run of strings that also start earlier; code holds first place << 10, number << 2."""
    if not 2 <= q <= length <= q + 254:
        raise ValueError("length has to be between q and q + 254")
    base = texts(docs).where("doc_id is not null")
    runs = base.mapInArrow(_emit_runs(length, q), "bucket long, content long, doc_id long, code long")
    runs = materialize(runs.repartition("bucket").sortWithinPartitions("bucket", "content", "doc_id", "code").mapInArrow(_refine_runs, "doc_id long, code long"), "runs")
    asked = runs.groupBy("doc_id").agg(F.collect_list("code").alias("codes"), F.max(F.col("code").bitwiseAND(3) == OPEN).alias("any")).where("any").select("doc_id", "codes")
    strings = squeezed(base).join(asked, "doc_id").select("doc_id", "text", "codes").mapInArrow(_emit_strings(length, q), "name long, check long, doc_id long, code long")
    strings = materialize(strings.repartition("name").sortWithinPartitions("name", "check", "doc_id", "code").mapInArrow(_refine_strings, "doc_id long, code long"), "strings")
    return runs.where(F.col("code").bitwiseAND(3) == REPEATED).unionByName(strings)


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    places = repeated_places(docs, length, q).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    rows = squeezed(texts(docs)).join(places, "doc_id", "left").select("doc_id", "text", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"))
    return rows.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
