"""Workers stay small however many texts come at once, and no step runs twice."""

import os
import tracemalloc
import uuid

import pyarrow as pa

from conftest import rows
from quillstack.arrow import slices
from quillstack.config import ChunkConfig, ReduceConfig, SummaryConfig
from quillstack.operators import chunk as C
from quillstack.operators import reduce as R
from quillstack.operators.summarize import Lead, summarise

BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_slices():
    assert list(slices(pa.array(["abc", None, "é", "x" * 9, "", "y"]), 5)) == [["abc", "", "é"], ["x" * 9], ["", "y"]]
    assert list(slices(pa.array([], pa.string()))) == [] and list(slices(pa.array(["ab", "cd"])[1:])) == [["cd"]]


def test_chunks_of_a_batch_are_not_all_python_objects(spark, monkeypatch):
    made, real = [], C.F.arrow_udf
    monkeypatch.setattr(C.F, "arrow_udf", lambda f, kind: made.append(f) or real(f, kind))
    spark.conf.unset(BATCHES)
    given = [(1, None), (2, " "), (3, "One. Two."), (4, "word. " * 3000)]
    got = C.chunk(spark.createDataFrame(given, "doc_id long, text string"), ChunkConfig())
    assert int(spark.conf.get(BATCHES)) <= 8 << 20
    assert rows(got, "doc_id", "seq", "chunk_key", "text", "truncated") == sorted(((i, k, *c) for i, t in given for k, c in enumerate(C.cut(t or "", ChunkConfig()))), key=repr)
    texts = pa.array([f"{k} " + "word. " * 2000 for k in range(2000)])
    tracemalloc.start()
    out = made[0](texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and out.type.value_type.field("text").type == pa.string()
    assert [c["text"] for c in out[1999].as_py()] == [c[1] for c in C.cut(texts[1999].as_py(), ChunkConfig())]
    assert peak < 12 << 20, peak


class Counted:
    """Answers with the text's first sentences; writes down the size of every call and its texts."""

    def __init__(self, folder: str):
        self.folder, self.lead = folder, Lead(2)

    def generate(self, batch, max_tokens):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{len(batch)} {sum(len(m[-1]['content']) for m in batch)}")
        return self.lead.generate(batch, max_tokens)


def calls(folder) -> list[tuple[int, int]]:
    return [tuple(map(int, p.read_text().split())) for p in folder.iterdir()]


def test_every_text_is_summarised_once(spark, tmp_path):
    keys = ["chapter 1", "chapter 1.1", "chapter 2", "page 3"]
    given = [(d, k, key, f"Text {d} {key}. " + "It goes on. " * 9) for d in (1, 2, 3, None) for k, key in enumerate(keys)]
    summaries = spark.createDataFrame(given, "doc_id long, seq int, chunk_key string, summary string")
    sections, log = R.reduce_sections(summaries, lambda: Counted(str(tmp_path)), ReduceConfig(sentences=2))
    assert rows(log, "doc_id", "name", "n_inputs") == [(1, "chapter 1", 2), (2, "chapter 1", 2), (3, "chapter 1", 2), (None, "chapter 1", 2)]
    assert rows(sections.where("doc_id IS NULL OR doc_id = 2"), "doc_id", "seq", "chunk_key") == [(d, k, key) for d in (2, None) for k, key in ((0, "chapter 1"), (2, "chapter 2"), (3, "page 3"))]
    assert sum(n for n, _ in calls(tmp_path)) == 4


def test_a_model_gets_slices(spark, tmp_path):
    df = spark.createDataFrame([(k, "One. Two. Three. " * 1000) for k in range(300)], "doc_id long, text string").coalesce(1)
    got = summarise(df, lambda: Counted(str(tmp_path)), SummaryConfig(sentences=2)).select("doc_id", "summary").collect()
    assert sorted(got) == [(k, "One. Two.") for k in range(300)]
    assert sum(n for n, _ in calls(tmp_path)) == 300 and max(size for _, size in calls(tmp_path)) < 1.1 * (1 << 20)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_without_front_are_cut_once(spark):
    keyed = [(1, 0, "title"), (1, 1, "chapter 1"), (2, 0, "front front"), (None, 0, "title"), (None, 1, "page 1"), (3, 0, None), (3, 1, "title")]
    df = spark.createDataFrame(keyed, "doc_id long, seq int, chunk_key string")
    assert rows(C.drop_front(df)) == [(1, 1, "chapter 1"), (2, 0, "front front"), (3, 1, "title"), (None, 0, "title"), (None, 1, "page 1")]
    assert plan(C.drop_front(C.chunk(df.selectExpr("doc_id", "chunk_key AS text")))).count("ArrowEvalPython ") == 1


def test_rounds_and_ranges_are_read_back_as_parquet(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 10)
    papers = spark.createDataFrame([(k, f"n{k}", f"Paper {k}. It says so. ") for k in range(35)], "ordinal long, name string, paper string")
    out, log = R.synthesise(papers, lambda: Lead(2), ReduceConfig(char_limit=200, overlap=5, rounds=2))
    assert "ExistingRDD" not in plan(out) + plan(log) and "FileScan parquet" in plan(out)
    assert out.count() == 1 and log.where("doc_id > 0").select("doc_id").distinct().count() == 3
