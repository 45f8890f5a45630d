"""Chunks and reductions against plain Python that works on what is left of a text, a document at a time."""

import random
import re

import pytest

from conftest import DATA
from quillstack.config import ChunkConfig, ReduceConfig
from quillstack.operators import chunk as C
from quillstack.operators import reduce as R
from quillstack.operators.order import ordered
from quillstack.operators.sections import HEADINGS
from quillstack.operators.summarize import Lead, clean_edges, summarise


def plain_headings(rest, section):
    out, at, total, gap = [], 0, 0, False
    for k, raw in enumerate(rest.splitlines()):
        bare = raw.strip()
        if bare:
            hit = next(((kind, m[1]) for kind, p in HEADINGS if (m := re.match(p, bare))), None)
            if not hit and k and (raw.startswith((" " * 4, "\t")) or gap):
                hit = ("paragraph", str(total + 1))
            if hit:
                total += 1
                if hit[0] == section:
                    out.append((at, *hit))
        at, gap = at + len(raw) + 1, not bare
    return out


def plain_name(rest, section):
    for bare in [x.strip() for x in rest.splitlines() if x.strip()][:3]:
        words = bare.split()
        if section == "paragraph":
            return section, "1"
        if words[0].lower() in (("chapter", "part") if section == "chapter" else ("page",)) and len(words) > 1 and bare[len(words[0])] == " ":
            return section, words[1]
        if section == "page" and bare.isdigit():
            return section, bare
        if section == "chapter" and (m := re.match(HEADINGS[2][1], bare)):
            return section, m[1]
    return None


def plain_chunks(text, limit, section, percent, overlap):
    rest, label, out, used = text.replace("\r\n", "\n").strip(), None, [], {}

    def emit(name, part):
        base = " ".join(name) if name else "chunk"
        used[base] = used.get(base, -1) + 1
        out.append((f"{base}.{used[base]}" if used[base] else base, part))

    while rest:
        marks = [m for m in plain_headings(rest, section) if m[0] <= limit][:2]
        if marks and (marks[0][0] or len(marks) == 2):
            first = marks[0][0] == 0
            edge, then = marks[first][0], marks[first][1:]
            emit(marks[0][1:] if first else label or ("front", "front"), rest[:edge].strip())
            label, rest = then, rest[edge:].lstrip()
            continue
        label = plain_name(rest, section) or label
        if len(rest) <= limit:
            emit(label, rest)
            break
        size = int(limit * percent)
        head = rest[: size + 1]
        cut = head.rfind(".", 1) + 1 or max((k for k in range(1, size + 1) if rest[k].isspace()), default=size)
        word = lambda k: 0 < k < len(rest) and rest[k - 1].isalnum() and rest[k].isalnum()
        while word(cut):
            cut -= 1
        again = max(0, cut - overlap)
        while word(again):
            again -= 1
        part, left = rest[:cut].strip(), rest[again:].lstrip()
        if not part or len(left) >= len(rest):
            part, left = rest[:size].strip(), rest[max(0, size - overlap) :].lstrip()
        emit(label, part)
        if len(left) >= len(rest):
            break
        rest = left
    return out


@pytest.mark.parametrize("section", ["chapter", "page", "paragraph"])
def test_chunks(section):
    r = random.Random(section)
    pieces = ["CHAPTER I", "Chapter 2 on", "part two x", "IV THE END", "Page 3", "12", "  page 4 more", "plain words here. And more", "    indented text", "\ttab", "", "", " ", "w" * 30, "one two three four five six seven"]
    for k in range(1500):
        text = "".join(r.choice(pieces) + r.choice(("\n", "\n", " ", "\r\n", ". ")) for _ in range(r.randrange(25)))
        limit, overlap = r.choice((20, 45, 90)), r.choice((0, 5, 12))
        assert [c[:2] for c in C.cut(text, ChunkConfig(limit, section, 0.9, overlap))] == plain_chunks(text, limit, section, 0.9, overlap), (k, text, limit, overlap)


def lead(text, n):
    return clean_edges("".join(re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", text)[:n]))


def plain_paper(summaries, limit, overlap, rounds):
    """summaries: (seq, key, text) of one document. The paper, and (stage, round, name, inputs) of what was reduced."""
    log, sections = [], {}
    for seq, key, text in summaries:
        words = key.split()
        name = f"{words[0]} {words[1].partition('.')[0]}" if len(words) > 1 and "." in words[1] else key
        sections.setdefault(name, []).append((key, text, seq))
    made = []
    for name, parts in sections.items():
        if len(parts) > 1:
            log.append((R.SECTION, 1, name, len(parts)))
        text = lead("\n\n".join(t.strip() for _, t, _ in sorted(parts)).strip(), 2) if len(parts) > 1 else parts[0][1]
        made.append((min(p[2] for p in parts), text))
    text = "\n\n".join(t.strip() for _, t in sorted(made)).strip()
    for n in range(1, rounds + 1):
        if len(text) <= limit:
            log.append((R.FINAL, n, "paper", 1))
            return lead(text, 2), log
        chunks = [c for c in plain_chunks(text, limit, "paragraph", 0.9, overlap) if c[0] not in ("title", "front front")]
        number = lambda key: tuple(int(x) for x in (key.split() + ["0"])[1].split(".")) if key.startswith("paragraph") else (0,)
        chunks = sorted(chunks, key=lambda c: number(c[0]) + (0,) * (2 - len(number(c[0]))))
        text = "\n\n".join(lead(c[1], 2).strip() for c in chunks).strip()
        log.append((R.RECHUNK, n, "paper", len(chunks)))
    log.append((R.LAST, rounds + 1, "paper", 1))
    return lead(text, 2), log


def test_papers(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("length(text) > 500").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('CHAPTER I\\n', text) ELSE text END AS text")
    chunks = ordered(C.chunk(docs, ChunkConfig(400, "chapter", 0.9, 30))).withColumn("seq", C.F.col("position"))
    summaries = summarise(chunks, lambda: Lead(2)).select("doc_id", "seq", "chunk_key", "summary").cache()
    _, papers, log = R.reduce_all(summaries, lambda: Lead(2), ReduceConfig(char_limit=150, overlap=10, rounds=2))
    by = {}
    for r in summaries.orderBy("doc_id", "seq").collect():
        by.setdefault(r.doc_id, []).append((r.seq, r.chunk_key, r.summary))
    expected = {i: plain_paper(rows, 150, 10, 2) for i, rows in by.items()}
    assert {r.doc_id: r.paper for r in papers.collect()} == {i: p for i, (p, _) in expected.items()}
    got = {}
    for r in log.collect():
        got.setdefault(r.doc_id, []).append((r.stage, r.round, r.name, r.n_inputs))
        assert r.n_inputs == len(r.inputs) and r.seconds >= 0
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, (_, x) in expected.items()}
    assert {s for x in got.values() for s, *_ in x} == {R.SECTION, R.RECHUNK, R.FINAL, R.LAST}
