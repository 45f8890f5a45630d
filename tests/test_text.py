"""The text contracts on literals, and the expressions against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillstack.config import CleanConfig, load_settings, parse, to_bool, to_ints, to_list
from quillstack.functions import guards as G
from quillstack.functions import names as N
from quillstack.functions import text as T
from quillstack.operators import clean as K


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def lists(spark, given, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t array<string>")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_tokens_and_closers(spark):
    assert values(spark, ["He's at [4], isn't he? 'no'", "a (b [c", "x ) (y}", ""], T.tokens) == [
        ["He's", "at", "[", "4", "]", ",", "isn't", "he", "?", "no"], ["a", "(", "b", "[", "c", "]", ")"], ["x", ")", "(", "y", "}", ")"], []]


def test_fold_is_nfkd(spark):
    r = random.Random(3)
    texts = ["≠ ½ ﬁ ß é", "plain", "—a“b”", None] + ["".join(chr(r.choice((r.randrange(32, 0x3000), r.randrange(0xF900, 0xFFFF), r.randrange(0x1D400, 0x1D7FF)))) for _ in range(40)) for _ in range(300)]
    assert values(spark, texts, T.fold_ascii) == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_citations(spark):
    text = "One [3] two (4) three [Roe et al. 2001] four (Smith, 2020) five (Doe et al., 1999)."
    assert values(spark, [text], T.citations) == [["[3]", "(4)", "[Roe et al. 2001]", "(Smith, 2020)", "(Doe et al., 1999)"]]
    assert values(spark, [text], T.drop_citations)[0].split() == "One two three four five .".split()


def spec_join(t):
    out = ""
    for i, w in enumerate(t):
        p, q = (t[i - 1] if i else None), (t[i - 2] if i > 1 else None)
        if w in set(",.?!;:)]}\n") or p in (None, "\n", "(", "[", "{"):
            sep = ""
        elif w in "([{":
            sep = " "
        elif w == '"':
            sep = " " if p in (",", ";", ":") else ""
        elif p == '"':
            sep = "" if q in (None, "\n", "(", "[", "{", ",", ";", ":") else " "
        else:
            sep = " "
        out += sep + w
    return out


def test_list_expressions_against_python(spark):
    r = random.Random(5)
    given = [[r.choice([*T.PUNCTUATION, "\n", "a", "A", "b", "er", "12", "x9", "é"]) for _ in range(r.randrange(12))] for _ in range(2000)]
    assert lists(spark, given, T.join_tokens) == [spec_join(t) for t in given]
    marks = {*T.PUNCTUATION, "\n"}
    assert lists(spark, given, T.drop_repeats) == [[w for i, w in enumerate(t) if i == 0 or w in marks or w.lower() != t[i - 1].lower()] for t in given]
    assert lists(spark, given, T.drop_bad) == [[w for w in t if w in marks or (w.isascii() and any(c.isalpha() for c in w))] for t in given]


def test_clean_worked_example(spark):
    df = spark.createDataFrame([(1, "Um, the the “cat” [3] ran—fast (Smith, 2020). 12 3rd"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in K.clean(df).collect()}
    assert got[1].cleaned_text == ", the cat ranfast. 3rd" and got[1].citations == ["[3]", "(Smith, 2020)"]
    assert got[2].tokens == [] and got[3].cleaned_text == ""
    kept = K.clean(df, CleanConfig(keep_numbers=True)).where("doc_id = 1").first()
    assert kept.cleaned_text == ", the cat ranfast. 12 3rd"


def test_word_counts(spark):
    assert values(spark, ["don't stop. É1", ""], T.count_words) == [4, 0]


def test_guards(spark):
    assert values(spark, ["abc", "漢", "かな"], G.has_han) == [False, True, False]
    assert values(spark, ["<THINK>a\nb</think>c <think>d"], G.drop_thinking) == [" c  "]
    assert values(spark, ["Summary: Final summary: in the U.S. ( ok ) .", "Summary:Final summary: x"], G.clean_edges) == ["Final summary: in the U. S. (ok).", "x"]
    assert values(spark, ["3"], lambda x: G.prompt(x.cast("int")))[0].endswith("fewer than 3 sentences.")
    assert values(spark, ["own"], lambda x: G.prompt(5, x)) == ["own"]
    df = spark.createDataFrame([([("system", " a "), ("user", "b"), ("user", "c /no_think"), ("assistant", "d")],)], "m array<struct<role:string,content:string>>")
    assert [m.content for m in df.select(G.prepare_messages(F.col("m"))).first()[0]] == ["a /no_think", "/no_think\nb", "c /no_think", "d"]


def test_names(spark):
    assert values(spark, ["/a/b c.d.txt", "x/???.pdf", "plain"], N.safe_name) == ["b_c_d", "document", "plain"]
    assert values(spark, ["/a/o'neil_and-co.txt", "/x/two words.pdf"], N.display_name) == ["O'Neil And Co", "Two Words"]
    df = spark.createDataFrame([(1, "a.txt"), (2, "b/a.pdf"), (3, "a_1.txt")], "ordinal int, path string")
    assert [r.name for r in N.unique_names(df).orderBy("ordinal").collect()] == ["a", "a_1", "a_1"]


def test_config(tmp_path):
    assert to_bool("Yes") and not to_bool("0") and to_list(" none ") is None and to_list("a, b") == ("a", "b") and to_ints("0,1") == (0, 1)
    file = tmp_path / "settings"
    file.write_text("# c\nexport A='x y'\nB=1 # note\nC=2\n\nbroken\n")
    assert load_settings(str(file), {"C": "0"}) == {"A": "x y", "B": "1", "C": "0"}
    paths, config = parse(["one.txt", "--chunk-char-limit", "500", "--clean-fillers", "no", "--report-types", "txt,pdf"])
    assert paths == ["one.txt"] and config.chunk.char_limit == 500 and not config.clean.fillers and config.report.types == ("txt", "pdf")
    with pytest.raises(ValueError):
        parse(["x", "--chunk-section", "verse"])
