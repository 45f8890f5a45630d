"""Sections, chunks, orders, reduction, sources, sinks and the stream."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillstack.config import ChunkConfig, ReduceConfig, ReportConfig, StackConfig, SummaryConfig
from quillstack.operators import chunk as C
from quillstack.operators import order as O
from quillstack.operators import reduce as R
from quillstack.operators import sections as S
from quillstack.operators.summarize import Lead, summarise, summarise_batch
from quillstack.plans.stack import run
from quillstack.sinks import report
from quillstack.sources import documents as D
from quillstack.streaming.documents import stream_chunks, stream_files


def test_headings(spark):
    text = "Intro\nCHAPTER I\nx\n\npara\n    indented\nPage 3\n12\nPart Two of\nIV THE END\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.start, r.kind, r.name) for r in S.headings(df).orderBy("line").collect()]
    assert got == [(6, "chapter", "I"), (19, "paragraph", "2"), (24, "paragraph", "3"), (37, "page", "3"), (44, "page", "12"), (47, "chapter", "Two"), (59, "chapter", "IV")]
    assert all(text[a:].split("\n")[0] for a, _, _ in got)


def test_headings_are_the_chunkers(spark):
    r = random.Random(4)
    pieces = ["CHAPTER I", "part two x", "IV THE END", "Page 3", "12", "  page 4", "plain", "    indented", "\ttab", "", "", " "]
    texts = ["".join(r.choice(pieces) + r.choice(("\n", "\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\x1d")) for _ in range(r.randrange(12))).strip() for _ in range(300)]
    got = {}
    for x in S.headings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "line").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.kind, x.name))
    for k, text in enumerate(texts):
        expected, total = [], 0
        for line in C._Document(text, "chapter").lines:
            kind, name = line.kind, line.name
            if kind is None and line.bare and (line.raw.startswith(("    ", "\t")) or line.gap):
                kind, name = "paragraph", str(total + 1)
            if kind:
                total += 1
                expected.append((line.start, kind, name))
        assert got.get(k, []) == expected, text


def test_first_section(spark):
    df = spark.createDataFrame([("\n CHAPTER I. x",), ("a\nb\nc\nchapter 4",), ("7\nx",)], "text string")
    assert [r[0] and tuple(r[0]) for r in df.select(S.first_section(F.col("text"), "chapter")).collect()] == [("chapter", "I."), None, None]
    assert [r[0] and r[0].name for r in df.select(S.first_section(F.col("text"), "page")).collect()] == [None, None, "7"]


@pytest.mark.parametrize(
    ("text", "config", "expected"),
    [
        ("Intro line\nCHAPTER I\nX", ChunkConfig(50, overlap=0), [("front front", "Intro line"), ("chapter I", "CHAPTER I\nX")]),
        ("A\n\nB\n\nC", ChunkConfig(50, "paragraph", overlap=0), [("front front", "A"), ("paragraph 1", "B"), ("paragraph 1.1", "C")]),
        ("Hello world. This is a test.", ChunkConfig(20, overlap=0), [("chunk", "Hello world."), ("chunk.1", "This is a test.")]),
        ("Hello world. This is a test.", ChunkConfig(20, overlap=5), [("chunk", "Hello world."), ("chunk.1", "world. This is a t"), ("chunk.2", "s a test.")]),
        ("Chapter 1 a\nx\nChapter 2 b\ny", ChunkConfig(20, overlap=0), [("chapter 1", "Chapter 1 a\nx"), ("chapter 2", "Chapter 2 b\ny")]),
        ("", ChunkConfig(), []),
        ("  \n ", ChunkConfig(), []),
    ],
)
def test_cut(text, config, expected):
    assert [c[:2] for c in C.cut(text, config)] == expected


def test_cut_covers_everything():
    text = " ".join(f"word{i}." if i % 7 == 0 else f"word{i}" for i in range(900)) + " " + "z" * 300
    parts = C.cut(text, ChunkConfig(120, overlap=0))
    assert "".join("".join(t.split()) for _, t, _ in parts) == "".join(text.split())
    assert all(len(t) <= 120 for _, t, _ in parts) and len({k for k, _, _ in parts}) == len(parts)
    assert C.cut("x" * 100, ChunkConfig(10, overlap=9))[-1][2]  # no progress: the tail is given up, and said so


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "Hello world. This is a test."), (2, None)], "doc_id long, text string")
    assert rows(C.chunk(df, ChunkConfig(20, overlap=0)), "doc_id", "seq", "chunk_key", "n_chars") == [(1, 0, "chunk", 12), (1, 1, "chunk.1", 15)]


KEYS = ["chapter II", "chapter I.1", "chapter I", "chapter I.2", "front front", "chapter One"]


@pytest.mark.parametrize(
    ("order", "expected"),
    [
        ("firstToLast", "front front, chapter One, chapter I, chapter I.1, chapter I.2, chapter II"),
        ("other", "front front, chapter One, chapter I, chapter I.1, chapter I.2, chapter II"),
        ("lastToFirst", "chapter II, chapter I.2, chapter I.1, chapter I, chapter One, front front"),
        ("lastToFirstBySection", "chapter One, front front, chapter II, chapter I, chapter I.1, chapter I.2"),
        ("firstToLastByTop", "front front, chapter One, chapter I, chapter I.1, chapter II, chapter I.2"),
    ],
)
def test_orders(spark, order, expected):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(KEYS)], "doc_id long, seq int, chunk_key string")
    assert ", ".join(r.chunk_key for r in O.ordered(df, order).orderBy("position").collect()) == expected


def test_order_keeps_ties(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["chunk", "chunk.1", "chunk.2"])], "doc_id long, seq int, chunk_key string")
    assert [r.chunk_key for r in O.ordered(df, "lastToFirst").orderBy("position").collect()] == ["chunk", "chunk.1", "chunk.2"]


def test_sections_of_summaries(spark):
    df = spark.createDataFrame([(1, 0, "chapter 1.10", "c"), (1, 1, "chapter 1.2", " b "), (1, 2, "chapter 1", "a"), (2, 0, "chunk.1", "x")], "doc_id long, seq int, chunk_key string, summary string")
    assert rows(R.combine_sections(df), "doc_id", "section", "n_pieces", "text") == [(1, "chapter 1", 3, "a\n\nc\n\nb"), (2, "chunk.1", 1, "x")]
    assert rows(R.multi_part(df)) == [(1, True), (2, False)]
    assert rows(R.merge_all(df)) == [(1, "c\n\nb\n\na"), (2, "x")]


class Echo:
    """Counts its calls; answers with the text itself."""

    def generate(self, batch, max_tokens):
        return [m[-1]["content"].partition("Text:\n")[2].rpartition("\n\nSummary:")[0] for m in batch]


def test_reduce_paper_drops_the_first_paragraph(spark):
    df = spark.createDataFrame([(1, i, f"chapter {i}", f"S{i} " + "w" * 20 + ".") for i in (1, 2, 3)] + [(2, 1, "chapter 1", "Short.")], "doc_id long, seq int, chunk_key string, summary string")
    papers, log = R.reduce_paper(df, Echo, ReduceConfig(char_limit=60, overlap=0))
    got = dict(rows(papers))
    assert "S1" not in got[1] and "S2" in got[1] and "S3" in got[1] and got[2] == "Short."
    assert rows(log, "doc_id", "stage", "round", "n_inputs") == [(1, R.FINAL, 2, 1), (1, R.RECHUNK, 1, 2), (2, R.FINAL, 1, 1)]


def test_reduce_stops_after_its_rounds(spark):
    df = spark.createDataFrame([(1, i, f"chapter {i}", "w" * 50 + ".") for i in range(6)], "doc_id long, seq int, chunk_key string, summary string")
    _, log = R.reduce_paper(df, Echo, ReduceConfig(char_limit=60, overlap=0, rounds=1), drop_front=False)
    assert [r.stage for r in log.orderBy("round").collect()] == [R.RECHUNK, R.LAST]


def test_retries_and_repair():
    class Stubborn:
        calls = 0

        def generate(self, batch, max_tokens):
            self.calls += len(batch)
            return ["漢字" if "bad" in m[-1]["content"] and self.calls < 5 else "fine" for m in batch]

    backend = Stubborn()
    assert summarise_batch(["good", "bad"], backend, SummaryConfig(retries=2)) == ["fine", "fine"] and backend.calls == 5


def test_han_can_fail_a_run(spark):
    class Han:
        def generate(self, batch, max_tokens):
            return ["漢"] * len(batch)

    df = spark.createDataFrame([("x",)], "text string")
    assert summarise(df, Han).first().han
    with pytest.raises(Exception, match="not English"):
        summarise(df, Han, SummaryConfig(fail_on_han=True)).collect()


def test_report_files():
    parts = ("T", "A", "Hi (you).", [("paper", "One."), ("item two", "Two & <three>.")], "Bye.")
    assert report.survey_text(*parts, abstract="Ab") == "T\nA\n\nAbstract\nAb\n\nIntroduction\nHi (you).\n\nSurvey Summary\nOne.\n\nItem Two\nTwo & <three>.\n\nConclusion\nBye.\n"
    made = report.docx_bytes(*parts)
    assert D.docx_text(made).split("\n")[:4] == ["T", "A", "Introduction", "Hi (you)."] and "Two & <three>." in D.docx_text(made)
    assert zipfile.ZipFile(io.BytesIO(made)).testzip() is None
    pdf = report.pdf_bytes("T", "A", "word " * 2000, [], "Bye.")
    assert pdf.startswith(b"%PDF") and pdf.count(b"/Type /Page ") > 2 and b"(Bye.)" in pdf
    with pytest.raises(ValueError):
        report.export("x", "odt", *parts)


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    from quillstack import storage

    spark.range(5000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(f"{tmp_path}/one")
    assert storage.read_parquet(spark, f"{tmp_path}/one").rdd.getNumPartitions() == 1  # too small to matter
    monkeypatch.setattr(storage, "DEAL_BYTES", (1000, 1 << 20))
    dealt = storage.read_parquet(spark, f"{tmp_path}/one")
    assert dealt.rdd.getNumPartitions() == 4 and dealt.count() == 5000
    plan = dealt.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    spark.range(5000).repartition(4).write.parquet(f"{tmp_path}/many")
    assert "Exchange" not in storage.read_parquet(spark, f"{tmp_path}/many")._jdf.queryExecution().executedPlan().toString()


def test_pdf_text(monkeypatch):
    import sys
    import types

    class Reader:
        def __init__(self, file):
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in file.read().decode().split("|")]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert D.pdf_text(b"one||two") == "one\ntwo\n"
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pypdf"):
        D.pdf_text(b"")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 \x80")
    (tmp_path / "c.docx").write_bytes(report.docx_bytes("T", "", "", [], ""))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in D.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "é\nb" and got["b.txt"] == "café €" and got["c.docx"].startswith("T\n")
    (tmp_path / "d.rtf").write_text("x")
    with pytest.raises(Exception, match="Unsupported file type"):
        D.read_files(spark, [str(tmp_path / "d.rtf")]).collect()


def test_the_report_hears_its_prompts(spark, tmp_path):
    class Parrot:
        """Answers with the first words of what it is asked."""

        def configure(self, config):
            self.top_p = config.top_p

        def generate(self, batch, max_tokens):
            return [f"{m[-1]['content'].partition(chr(10))[2][:9]} {max_tokens} {self.top_p}." for m in batch]

    (tmp_path / "a.txt").write_text("One.")
    (tmp_path / "b.txt").write_text("Two.")
    options = ReportConfig(output=str(tmp_path / "out"), types=("TXT",), survey_prompt="SurveyXXX now", introduction_prompt="BeginXXXX now", conclusion="  ", title="T", name="n")
    run(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], StackConfig(report=options, summary=SummaryConfig(top_p=0.5)), Parrot)
    text = (tmp_path / "out" / "n_survey.txt").read_text()
    assert "SurveyXXX 220 0.5." in text and "Introduction\nBeginXXXX 260 0.5." in text and "This ends the summary of the documents." in text


def test_polish_and_repair_are_edits():
    asked = []

    class Editor:
        def generate(self, batch, max_tokens):
            asked.extend(m[0]["content"] for m in batch)
            return ["" if "grammar, spelling" in m[-1]["content"] and "keep" in m[-1]["content"] else "edited" if "editor" in m[0]["content"] else "漢" if "bad" in m[-1]["content"] else m[-1]["content"].partition("Text:\n")[2][:4] for m in batch]

    assert summarise_batch(["good", "keep", "bad"], Editor(), SummaryConfig(retries=1, polish=True)) == ["edited", "keep", "edited"]
    assert sum("editor" in a for a in asked) == 3


def test_local_model_options():
    from quillstack.backends import local_model as M

    class Old:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt):
            return f"{len(messages)} {tokenize} {add_generation_prompt}"

    assert M.render(Old(), [{}]) == "1 False True" and M.device_of((3, 4)) == 3
    assert "top_p" not in M.sampling(SummaryConfig(), 5) and M.sampling(SummaryConfig(sample=True, top_p=0.4), 5)["top_p"] == 0.4
    with pytest.raises((RuntimeError, ValueError)):
        M.LocalModel().generate([[]], 5)


def test_large_stacks_are_reduced_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 3)
    papers = spark.createDataFrame([(k, f"n{k}", f"P{k}.") for k in range(10)], "ordinal int, name string, paper string")
    out, log = R.synthesise(papers, Echo, ReduceConfig(char_limit=10_000))
    text = out.first()["paper"]
    assert [text.index(f"P{k}.") for k in range(10)] == sorted(text.index(f"P{k}.") for k in range(10)) and log.count() == 4 + 2 + 1


def test_many_files_are_one_scan(spark, tmp_path):
    names = [f"{k}/same.txt" for k in range(5)] + ["b c.txt"]
    for k, n in enumerate(names):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(f"text {k}")
    df = D.read_files(spark, [str(tmp_path / n) for n in [*names, names[0]]])
    assert [(r.ordinal, r.name, r.text) for r in df.orderBy("ordinal").collect()] == [(k + 1, f"same_{k}" if k else "same", f"text {k}") for k in range(5)] + [(6, "b_c", "text 5"), (7, "same_5", "text 0")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("binaryFile") <= 3  # the scan, and the ranges' counts of it


def test_own_columns_survive(spark):
    from quillstack.operators.clean import clean

    df = spark.createDataFrame([(1, "Um, a. a", "mine", 7)], "doc_id long, text string, folded string, other int")
    got = clean(df).first()
    assert got.folded == "mine" and got.other == 7 and got.cleaned_text == ", a. a"
    assert clean(df.limit(0)).count() == 0


def test_cut_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"plain words in line {k}" for k in range(n))
        began = time.perf_counter()
        C.cut(text, ChunkConfig())
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0]


def test_run_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("CHAPTER One\nThe cat sat. It slept. Then it ran.\nCHAPTER Two\nThe dog barked. It ate.")
    (folder / "two.txt").write_text("Birds fly south. They rest in marshes.")
    out = run(spark, [str(folder / "one.txt"), str(folder / "two.txt")], StackConfig(report=ReportConfig(output=str(tmp_path / "out"), types=("txt", "docx", "pdf"))), lambda: Lead(2))
    text = open(next(p for p in out if p.endswith("_survey.txt"))).read()
    assert "Survey Summary" in text and "Two\nBirds fly south" in text and text.startswith("Multi File Survey Report")
    data = open(next(p for p in out if p.endswith("data.txt"))).read()
    assert "chunks/s" in data and "Input files: 2" in data and "Words before and after cleaning: 17, 17" in data and "- chapter One: 47 characters" in data and "Run: generated-conclusion" in data
    assert data.index("Before\n" + "-" * 40 + "\nCHAPTER One") < data.index("Reductions\n") < data.index("Stage: paper-final-reduction") < data.rindex("Conclusion\n")
    own = {os.path.basename(p) for p in out}
    assert {f"{n}_{k}.txt" for n in ("one", "two") for k in ("cleaned", "chunks", "summaries")} | {"one_final.txt", "two_final.txt", "data.txt"} <= own
    assert (tmp_path / "out" / "two_cleaned.txt").read_text() == "Birds fly south. They rest in marshes." and "chapter Two\n" + "-" * 40 in (tmp_path / "out" / "one_chunks.txt").read_text()
    assert "cleaned" in (tmp_path / "out" / "run.log").read_text()

    stream = stream_chunks(stream_files(spark, str(folder)), cutting=ChunkConfig(60, overlap=0))
    going = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).start()
    going.processAllAvailable()
    going.stop()
    assert {"chapter One", "chapter Two", "chunk"} <= {r.chunk_key for r in spark.table("arrived").collect()}
