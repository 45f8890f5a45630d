"""Packing into training sequences by power-of-two decomposition.

A document of T tokens is cut into ``T // max_tokens`` full pieces and one piece for each set bit of the
remainder, longest first. Every piece is a sequence of its own: its length is a power of two, so it needs
no padding, and no sequence holds two documents. Pieces of equal length share a bucket (``bucket`` is the
binary logarithm), which is what a loader batches by. Nothing is shuffled: a document's pieces depend on
that document alone.

Defined results: a null text is an empty one, which still has the end token and so one piece of length 1;
a null or repeated doc_id is carried through, each row giving its own sequences; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, trimmed, utf8

MAX_TOKENS = 2048
#: Chunks and words whose ids a worker keeps for good; frequent ones come early. As many as CACHE_YOUNG later ones
#: are kept until they are full, so a worker's memory is bounded.
CACHE_CHUNKS, CACHE_YOUNG = 300_000, 80_000
#: Longer chunks are encoded each time and never kept.
CACHE_BYTES = 48

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's pattern never matches across ASCII white space and drops it, so a text's ids are those
    of its white-space separated chunks, one after another. A chunk of letters and trailing punctuation is
    two matches, each encoded for itself; the letters that a text has anew are encoded in one call and told
    apart by the vocabulary's end-of-word marks, or by their places where they aren't all ASCII: other letters may
    become several words, or none. Only texts that may spell a special token, which could span
    chunks, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.seen: dict[bytes, bytes] = {}  # words and punctuation as well: they are chunks themselves
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._ids(text).tobytes()
        chunks, seen = text.split(), self.seen
        try:
            return b"".join([seen[c] for c in chunks])
        except KeyError:
            pass
        self._learn(set(chunks))
        return b"".join([seen[c] if c in seen else self._ids(c).tobytes() for c in chunks])

    def _learn(self, chunks: set[bytes]) -> None:
        """Puts the ids of all chunks but the long ones among the seen."""
        if len(self.seen) > CACHE_CHUNKS + CACHE_YOUNG:
            for c in list(self.seen)[CACHE_CHUNKS:]:
                del self.seen[c]
        chunks = chunks.difference(self.seen)
        parts, fresh = [], {}
        for c in chunks:
            if len(c) <= CACHE_BYTES:
                core = c.rstrip(b".,!?;:")
                key = c if (key := core.lower()) == c else key
                # Some letters are none any more once they are normalised, and would run on into the punctuation.
                if core and (core.isalpha() if core.isascii() else unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower().isalpha()):
                    parts.append((c, key, c[len(core) :]))
                    if key not in self.seen:
                        fresh[key] = None
                else:
                    self.seen[c] = self._ids(c).tobytes()
        plain = [key for key in fresh if key.isascii()]
        if plain:
            ids = self._ids(b" ".join(plain))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                a = 0
                for key, b in zip(plain, cuts.tolist(), strict=True):
                    self.seen[key] = ids[a:b].tobytes()
                    a = b
            else:
                for key in plain:
                    self.seen[key] = self._ids(key).tobytes()
        if len(plain) < len(fresh):
            others = [key for key in fresh if not key.isascii()]
            texts = [key.decode("utf-8", "replace") for key in others]
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids, cuts = np.array(found.ids, "<u4"), np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts)
            for key, a, b in zip(others, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.seen[key] = ids[a:b].tobytes()
        for c, key, tail in parts:
            if tail and tail not in self.seen:
                self.seen[tail] = self._ids(tail).tobytes()
            self.seen[c] = self.seen[key] + self.seen[tail] if tail else self.seen[key]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """The worker's encoder, with what it has seen in earlier tasks."""
    return ChunkEncoder(path)


def piece_lengths(tokens: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Full pieces, then the binary digits of what is left, longest first."""
    full, rest = divmod(tokens, max_tokens)
    return [max_tokens] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``with_ids`` adds its token ids (``ids``, binary, little-endian 32-bit).

    ``max_tokens`` has to be a power of two. ``sequence_id`` is unique and ``offset`` is always 0.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens has to be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            keys = batch.column(0)
            raw, at = utf8(batch.column(1))
            raw = raw.tobytes()
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i in range(len(keys)):
                code = encoder.encode(raw[at[i] : at[i + 1]]) + end
                n, k = len(code) // 4, 0
                for size in piece_lengths(n, max_tokens):
                    part = code[4 * k : 4 * (k + size)]
                    row.append(i), start.append(k), length.append(size), crc.append(zlib.crc32(part)), total.append(n)
                    if with_ids:
                        ids.append(part)
                    k += size
            size = np.array(length, np.int64)
            out = [keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.frexp(size)[1].astype(np.int32) - 1)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if with_ids:
                out.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    pieces = texts(docs).mapInArrow(trimmed(cut), PIECES + (", ids binary" if with_ids else ""))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
