"""Cutting documents into section-aware chunks of bounded size.

The cut is greedy and depends on what is left, so it is one Arrow function from a text to its chunks. Lines are
classified once for a document; a cut moves an offset forward and never copies or rescans what is left.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import bound_batches, slices, trim
from ..config import ChunkConfig
from .sections import HEADINGS

_PATTERNS = [(kind, re.compile(pattern)) for kind, pattern in HEADINGS]
CHUNKS = "array<struct<seq:int,chunk_key:string,text:string,truncated:boolean>>"
FIELDS = {"seq": pa.int32(), "chunk_key": pa.string(), "text": pa.string(), "truncated": pa.bool_()}


@dataclass(slots=True)
class _Line:
    start: int
    raw: str
    bare: str
    kind: str | None
    name: str | None
    gap: bool


def _heading(bare: str) -> tuple[str | None, str | None]:
    return next(((kind, m[1]) for kind, p in _PATTERNS if (m := p.match(bare))), (None, None))


class _Document:
    def __init__(self, text: str, section: str):
        self.text, self.section = text.replace("\r\n", "\n").strip(), section
        self.lines, at, gap = [], 0, False
        for raw in self.text.splitlines():
            bare = raw.strip()
            self.lines.append(_Line(at, raw, bare, *_heading(bare), gap))
            at += len(raw) + 1
            gap = bare == ""
        self.starts = [x.start for x in self.lines]

    def skip(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def rest(self, at: int):
        """Offset, stripped line and line of what starts at ``at``; the first line may be the tail of one."""
        k = bisect_right(self.starts, at) - 1
        first = self.lines[k]
        yield 0, first.raw[at - first.start :].strip(), None
        for line in self.lines[k + 1 :]:
            yield line.start - at, line.bare, line

    def wanted(self, at: int, limit: int):
        """The first two headings of the wanted kind within ``limit``; a cut needs no others."""
        found, total = [], 0
        for offset, bare, line in self.rest(at):
            if offset > limit:
                break
            if bare == "":
                continue
            kind, name = _heading(bare) if line is None else (line.kind, line.name)
            if kind is None and line is not None and (line.raw.startswith(("    ", "\t")) or line.gap):
                kind, name = "paragraph", str(total + 1)
            if kind is None:
                continue
            total += 1
            if kind == self.section:
                found.append((offset, kind, name))
                if len(found) == 2:
                    break
        return found

    def named(self, at: int) -> tuple[str, str] | None:
        """What the first three lines with text name."""
        seen = 0
        for _, bare, _ in self.rest(at):
            if bare == "":
                continue
            seen += 1
            if seen > 3:
                return None
            if self.section == "paragraph":
                return "paragraph", "1"
            low, words = bare.lower(), bare.split()
            starts = ("chapter ", "part ") if self.section == "chapter" else ("page ",)
            if low.startswith(starts) and len(words) > 1:
                return self.section, words[1]
            if self.section == "page" and bare.isdigit():
                return "page", bare
            if self.section == "chapter" and (m := _PATTERNS[2][1].match(bare)):
                return "chapter", m[1]
        return None

    def limit_cut(self, at: int, limit: int, percent: float, overlap: int) -> tuple[int, int]:
        """End of the first part and start of the second, as offsets of the document."""
        text, size = self.text, len(self.text) - at
        split = int(limit * percent)
        if split >= size:
            return len(text), len(text)
        best = text.rfind(".", at + 1, at + split + 1) + 1
        if not best:
            best = next((k for k in range(at + split, at, -1) if text[k].isspace()), at + split)
        inside = lambda k: at < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
        while inside(best):
            best -= 1
        start = max(at, best - overlap)
        while inside(start):
            start -= 1
        return best, start


def cut(text: str, config: ChunkConfig | None = None) -> list[tuple[str, str, bool]]:
    """(key, text, truncated) of the chunks in order; truncated marks a last chunk after which a tail was given up."""
    config = config or ChunkConfig()
    limit, doc = config.char_limit, _Document(text, config.section)
    out: list[tuple[str, str, bool]] = []
    used: dict[str, int] = {}
    current: tuple[str, str] | None = None
    at, end = 0, len(doc.text)

    def emit(label: tuple[str, str] | None, part: str) -> None:
        base = "chunk" if label is None else f"{label[0]} {label[1]}"
        n = used[base] = used.get(base, -1) + 1
        out.append((f"{base}.{n}" if n else base, part, False))

    while at < end:
        found = doc.wanted(at, limit)
        if found and 0 < found[0][0] <= limit:
            edge, label, following = found[0][0], current or ("front", "front"), found[0]
        elif len(found) == 2 and found[1][0] <= limit:
            edge, label, following = found[1][0], found[0][1:], found[1]
        else:
            edge = 0
        if edge:
            emit(label, doc.text[at : at + edge].strip())
            current = following[1:]
            at = doc.skip(at + edge)
            continue
        current = doc.named(at) or current
        if end - at <= limit:
            emit(current, doc.text[at:])
            break
        stop, start = doc.limit_cut(at, limit, config.percent, config.overlap)
        part, start = doc.text[at:stop].strip(), doc.skip(start)
        if not part or start <= at:
            force = int(limit * config.percent)
            force = force if 0 < force < end - at else limit
            part, start = doc.text[at : at + force].strip(), doc.skip(at + max(0, force - config.overlap))
        emit(current, part)
        if start <= at:
            out[-1] = (*out[-1][:2], True)
            break
        at = start
    return out


def chunk(df: DataFrame, config: ChunkConfig | None = None, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, seq, chunk_key, text, n_chars, truncated: one row for each chunk. A null or blank text has none."""
    config = config or ChunkConfig()
    bound_batches(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        # A slice's chunks are Arrow's again before the next is cut.
        done = [pa.array([], kind)]
        for part in slices(texts):
            cuts = [cut(t, config) for t in part]
            ends = np.cumsum([0, *map(len, cuts)])
            columns = [pa.array(column, t) for column, t in zip(([k for c in cuts for k in range(len(c))], *([x[i] for c in cuts for x in c] for i in range(3))), FIELDS.values(), strict=True)]
            done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(FIELDS))))
            del cuts, columns
        out = pa.concat_arrays(done)
        del done
        trim()
        return out

    kind = pa.list_(pa.struct(list(FIELDS.items())))
    cuts = df.select(key, F.explode(F.arrow_udf(run, CHUNKS)(column)).alias("c"))
    return cuts.select(key, "c.seq", "c.chunk_key", "c.text", F.length("c.text").alias("n_chars"), "c.truncated")


def drop_front(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without title and front matter, unless a document has nothing else."""
    # In one pass: what a join reads a second time would be cut, or summarised, a second time.
    front = F.col("chunk_key").isin("title", "front front")
    others = F.coalesce(F.max(~front).over(Window.partitionBy(key)), F.lit(False)) & F.col(key).isNotNull()
    return chunks.withColumn("__others", others).where(~front | (front & ~F.col("__others"))).drop("__others")
