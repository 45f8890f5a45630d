"""The queries on whole texts see what stands beyond the first characters."""

from hashlib import md5

from quillstack.plans.queries import _KEYS, QUERIES
from quillstack.sinks import report


def test_whole_texts(spark, tmp_path):
    texts = [f"Text {k} begins. " + "It goes on. " * 20 + f"Tail {k}." for k in range(13)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    digest = lambda s: md5(s.encode()).hexdigest()
    assert run("merge_all")[0].text == digest("\n\n".join(texts))
    assert run("chunk_files")[0].file == digest("".join(f"{k}\n{report.RULE}\n{t}\n\n" for k, t in zip(_KEYS, texts, strict=True)))
    assert run("survey_text")[0].body == digest("\n\n".join(f"{f'Item {k}' if k else report.SURVEY}\n{t}" for k, t in enumerate(texts)))
    combined = {r.section: r for r in run("section_combine")}
    assert combined["chapter I"].n_pieces == 4 and combined["chapter I"].text == digest("\n\n".join(texts[k] for k in (2, 11, 1, 3)))
    reduced = {r.chunk_key: r.summary for r in run("reduce_sections")}
    assert reduced["page 12"] == digest(texts[10]) and reduced["chapter I"] == digest("Text 2 begins. It goes on.")

