"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are the set of its lower-cased words (runs of letters, digits and non-ASCII bytes), its
pairs of neighbouring words, its pairs with one word between (skip-grams), and words cut to their first
``PREFIX`` bytes, each hashed to one of ``SLOTS`` coordinates. Per-coordinate rates and the L1 term leave few
coordinates with a weight, so the model that travels to the executors is small (``Model.most`` bounds it).

Only text is ever read for a score. The fit reads at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of their id, none of them held out, and in that order no more than have ``TRAIN_SLOTS`` features together;
scoring covers all rows and moves none of them.

Defined results: a null or empty text scores the bias alone; very long texts are scored whole; a null or
repeated doc_id is carried through, one score for each row (a null id counts as the empty text in the
held-out rule); a table of labels without training rows gives the score 0; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_codes, give_back, scramble, texts, trim, trimmed, utf8, word_hashes

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: The largest number of labelled documents that a fit reads.
TRAIN_ROWS = 12_000
#: The most features, of four bytes each, that these may have together; far more than 12,000 common documents have.
TRAIN_SLOTS = 50_000_000
PREFIX = 4
BLOCK_BYTES = 1 << 19

_CODES = byte_codes(20)
_BREAKS = np.ones(256, bool)
for _range in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAKS[slice(*_range)] = False
_PAIR, _SKIP, _CUT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _slots(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the rows of a block and the row of each, not yet distinct."""
    h, a, b, first = word_hashes(raw, at, _BREAKS, _CODES)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    size = np.minimum(b - a, PREFIX)
    cut = size.astype(np.uint64)
    for k in range(PREFIX):
        byte = np.where(size > k, raw[np.minimum(a + k, len(raw) - 1)] if len(raw) else 0, 0)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        cut = cut * _CUT + byte.astype(np.uint64)
    parts, rows = [h, scramble(cut ^ _CUT)], [row, row]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        parts.append(scramble(h[:-gap][same] * salt + h[gap:][same]))
        rows.append(row[gap:][same])
    slots = np.concatenate(parts) >> np.uint64(64 - SLOT_BITS)
    return slots.astype(np.int64), np.concatenate(rows)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    #: A model has at most so many weights: one for each slot.
    most = SLOTS

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float32)
        out[self.slots] = self.weights
        return out


def scores(column: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    raw, at = utf8(column)
    out = np.full(len(at) - 1, bias)
    for first, last in blocks(at, BLOCK_BYTES):
        slots, row = _slots(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        w = dense[slots]
        hit = np.flatnonzero(w)
        pairs = np.unique(row[hit] << SLOT_BITS | slots[hit])
        out[first:last] += np.bincount(pairs >> SLOT_BITS, dense[pairs & (SLOTS - 1)], last - first)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.2, beta: float = 1.0, l1: float = 6.0, l2: float = 0.5, epochs: int = 4) -> Model:
    """FTRL-proximal with per-coordinate rates over sets of slots.

    ``l1`` is for 12,000 rows; a coordinate's noise grows with the root of the rows, so it is scaled by that.
    """
    l1 *= (len(rows) / 12_000) ** 0.5
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    zb = nb = 0.0
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-min(40.0, max(-40.0, bias + w.sum()))))
            g = p - labels[k]
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - s * w
            n[i] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    slots = np.flatnonzero(np.abs(z) > l1)
    weights = -(z[slots] - np.sign(z[slots]) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2)
    return Model(slots, weights.astype(np.float32), -zb / ((beta + nb**0.5) / alpha))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_slots: int = TRAIN_SLOTS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out rows are never read; rows without an id or a label teach nothing."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )

    def extract(batches):
        for batch in batches:
            raw, at = utf8(batch.column(1))
            out = []
            for first, last in blocks(at, BLOCK_BYTES):
                slots, row = _slots(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                pairs = np.unique(row << SLOT_BITS | slots)
                cuts = np.searchsorted(pairs, np.arange(last - first + 1) << SLOT_BITS)
                slots = (pairs & (SLOTS - 1)).astype("<u4")
                out += [slots[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "slots", "toxic"])

    # At most train_rows short rows: their number is the bound that lets them be broadcast.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(trimmed(extract), "doc_id long, slots binary, toxic int")
    # A partition at a time comes to the driver, so what it holds is bounded however long the documents are.
    kept, slots = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        slots += len(r.slots) // 4
        if slots > train_slots and kept:
            break
        kept.append((r.doc_id, r.toxic, np.frombuffer(bytes(r.slots), "<u4")))
    if not kept:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -40.0)
    kept.sort(key=lambda r: r[0])
    model = ftrl([r[2] for r in kept], np.array([r[1] for r in kept], float))
    del kept
    give_back()
    return model


def scorer(model: Model):
    """An Arrow function from texts to scores."""
    made: list[np.ndarray] = []

    def run(column: pa.Array) -> pa.Array:
        if not made:
            made.append(model.dense())
        out = pa.array(scores(column, made[0], model.bias))
        trim()
        return out

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches):
        dense = model.dense()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), dense, model.bias))], ["doc_id", "score"])

    out = texts(docs).mapInArrow(trimmed(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
