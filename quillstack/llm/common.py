"""What the operators of this subpackage share: table access, intermediate tables, Arrow buffers."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import bound_batches, trim
from ..storage import materialize, read_parquet  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the document operators read; a null text counts as empty."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def give_back() -> None:
    """The same after a fit, whose parts may hold each other."""
    gc.collect()
    trim()


def trimmed(run):
    """An Arrow function whose worker is small again after each task: workers live on, several on an executor."""

    def of(batches):
        yield from run(batches)
        trim()

    return of


def discard(*tables: DataFrame) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column, and the offsets of the values in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return utf8(column.cast(pa.large_string()))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        return utf8(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def squeezed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text`` as Zstandard bytes, for moving whole texts: half of what the shuffle's own codec leaves."""
    names = docs.columns
    kinds = ", ".join(f"`{n}` binary" if n == text else f"`{n}` {t}" for n, t in docs.dtypes)
    place = names.index(text)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, at = utf8(batch.column(place))
            data = raw.tobytes()
            column = pa.array([pack.compress(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([column if k == place else batch.column(k) for k in range(len(names))], names)

    return docs.mapInArrow(run, kinds)


def unsqueezed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``utf8`` returns, from squeezed texts."""
    unpack = zstandard.ZstdDecompressor()
    parts = [unpack.decompress(x.as_py()) if len(x.as_py()) else b"" for x in column]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in parts], dtype=np.int64)])


def blocks(offsets: np.ndarray, most: int):
    """Cuts rows into runs (first, last) of at most ``most`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), in place."""
    h ^= h >> _S
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def byte_codes(seed: int) -> np.ndarray:
    """256 odd random 64-bit numbers, one for each byte value, the same in every process."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, codes: np.ndarray):
    """Words of each row: maximal runs of bytes that ``breaks`` doesn't mark, with A-Z lower-cased.

    Returns 64-bit hashes of the words, their first bytes, their ends, and for each row the number of
    words before it. A word never crosses rows.
    """
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~breaks[raw]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] |= inside[first + 1]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= inside[last + 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[_LOWER[raw]] * up[:n], out=sums[1:])
    h = scramble((sums[b] - sums[a]) * down[a])
    return h, a, b, np.searchsorted(a, offsets)


#: The separators of the word contracts: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
