"""The registered queries of the text pipeline, and the same in SQL for DuckDB.

Tables without headings, chunk keys or model answers are given them by both sides in the same way; the limits
that a query uses are its parameters, never a part of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig, CleanConfig, ReduceConfig, SummaryConfig
from ..functions import guards as G
from ..functions import names as N
from ..functions import text as T
from ..operators import chunk as C
from ..operators import clean as K
from ..operators import metrics as M
from ..operators import order as O
from ..operators import reduce as R
from ..operators import sections as S
from ..operators.summarize import Lead, summarise
from ..sinks import report
from ..storage import read_parquet

QUERIES: dict = {}
SQL: dict[str, str] = {}

# SQL for the shared expressions.
_q = lambda s: s.replace("'", "''")


class _Sql(str):
    """An expression with § where its argument stands; braces are the patterns' own."""

    def format(self, x: str) -> str:
        return self.replace("§", x)


_FOLD = _Sql(r"regexp_replace(strip_accents(§), '[^\x00-\x7f]', '', 'g')")


def _cite(x: str) -> str:
    for pattern in T.CITATIONS:
        x = f"regexp_replace({x}, '{_q(pattern)}', ' ', 'g')"
    return x


_SYMBOLS = _Sql(f"regexp_replace(§, '{_q(T.WEIRD)}', ' ', 'g')")
_TOKENS = _Sql(f"regexp_extract_all(§, '{_q(T.TOKEN)}')")
_MARKS = "('" + "','".join([*T.PUNCTUATION, "\n"]) + "')"
_CLOSERS = _Sql(
    "list_filter(string_split(translate(list_reduce(§, lambda a, x: CASE WHEN x IN ('(','[','{') THEN x || a WHEN length(a) > 0 AND translate(substr(a,1,1), '([{', ')]}') = x THEN substr(a, 2) ELSE a END, ''), '([{', ')]}'), ''), lambda c: c <> '')"
)
_BAD = _Sql(f"list_filter(§, lambda w: w IN {_MARKS} OR (regexp_full_match(w, '[A-Za-z0-9'']+') AND regexp_matches(w, '[A-Za-z]')))")
_STOP = "('" + "','".join([*T.STUTTERS, *T.FILLERS]) + "')"
_FILL = _Sql(f"list_filter(§, lambda w: w IN {_MARKS} OR lower(w) NOT IN {_STOP})")
_REPEAT = _Sql(f"list_filter(§, lambda w, i: i = 1 OR w IN {_MARKS} OR lower(w) <> lower(§[i-1]))")
_JOIN = _Sql(
    "array_to_string(list_transform(§, lambda w, i: CASE WHEN w IN (chr(10), ',', '.', '?', '!', ';', ':', ')', ']', '}') OR i = 1 OR §[i-1] IN (chr(10), '(', '[', '{') THEN '' "
    "WHEN w IN ('(', '[', '{') THEN ' ' WHEN w = '\"' THEN CASE WHEN §[i-1] IN (',', ';', ':') THEN ' ' ELSE '' END "
    "WHEN §[i-1] <> '\"' THEN ' ' WHEN i = 2 OR §[i-2] IN (chr(10), '(', '[', '{', ',', ';', ':') THEN '' ELSE ' ' END || w), '')"
)
_STRIP = _Sql(r"regexp_replace(§, '^\s+|\s+$', '', 'g')")
_WORDS = _Sql(rf"len(regexp_extract_all(§, '{T.WORD}'))")


def _edges(x: str) -> str:
    x = _STRIP.format(x)
    x = f"regexp_replace(regexp_replace({x}, '(?is)<think>.*?</think>', ' ', 'g'), '(?is)<think>.*', ' ', 'g')"
    for pattern, to in G.EDGE_STEPS:
        x = f"regexp_replace({x}, '{_q(pattern)}', '{to.replace('$', chr(92))}', 'g')"
    return _STRIP.format(x)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return read_parquet(spark, f"{d}/documents.parquet").select("doc_id", "text", *more)


def _chats(spark: SparkSession, d: str) -> DataFrame:
    return read_parquet(spark, f"{d}/conversations.parquet")


# Cleaning ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_WORDS.format('text')} AS n_words FROM documents")
def word_count_raw(spark, d):
    return _docs(spark, d).select("doc_id", T.count_words(F.col("text")).cast("long").alias("n_words"))


@query(rf"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS word FROM documents) GROUP BY word")
def word_histogram(spark, d):
    return K.word_histogram(_docs(spark, d)).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def unicode_ascii(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.fold_ascii(F.col("text"))).alias("folded"))


_CITED = "concat('[7] ', text, ' (Smith, 2020) [see Lee et al. 1999](12)', ' (Moore et al., 2001)')"


@query(f"SELECT doc_id, md5({_cite(_CITED)}) AS without FROM documents")
def citations_removed(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.drop_citations(F.expr(_CITED))).alias("without"))


def _cite_list(x: str) -> str:
    found = []
    for pattern in T.CITATIONS:
        found.append(f"regexp_extract_all({x}, '{_q(pattern)}')")
        x = f"regexp_replace({x}, '{_q(pattern)}', ' ', 'g')"
    return "list_concat(" + ", ".join(found) + ")" if len(found) == 2 else " || ".join(found)


@query(f"SELECT doc_id, array_to_string({_cite_list(_CITED)}, '|') AS citations FROM documents")
def citation_list(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.citations(F.expr(_CITED)), "|").alias("citations"))


@query(f"SELECT doc_id, md5({_SYMBOLS.format('text')}) AS plain FROM documents")
def symbols_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.drop_symbols(F.col("text"))).alias("plain"))


_BRACKETS = "translate(text, 'qvwkz', '([{)]')"


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS tokens FROM (SELECT doc_id, t || {_CLOSERS.format('t')} AS t FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents))")
def tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens"))


@query(f"SELECT token, count(*) AS n, sum(pos) AS places FROM (SELECT unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT {_TOKENS.format('text')} AS t FROM documents)) GROUP BY token")
def token_long(spark, d):
    long = _docs(spark, d).select(F.posexplode(F.regexp_extract_all("text", F.lit(T.TOKEN), 0)).alias("pos", "token"))
    return long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(f"SELECT doc_id, array_to_string({_CLOSERS.format('t')}, '') AS closers FROM (SELECT doc_id, {_TOKENS.format(_BRACKETS)} AS t FROM documents)")
def bracket_closers(spark, d):
    t = _docs(spark, d).select("doc_id", F.regexp_extract_all(F.expr(_BRACKETS), F.lit(T.TOKEN), 0).alias("t"))
    return t.select("doc_id", F.array_join(T.closers(F.col("t")), "").alias("closers"))


def _tokens_of(spark, d) -> DataFrame:
    return K.normalise(_docs(spark, d)).select("doc_id", F.regexp_extract_all("folded", F.lit(T.TOKEN), 0).alias("t"))


_TOKENS_OF = f"(SELECT doc_id, {_TOKENS.format(_FOLD.format('text'))} AS t FROM documents)"


def _md5_list(df: DataFrame, t) -> DataFrame:
    return df.select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens"))


def _md5_sql(x: str, source: str = _TOKENS_OF) -> str:
    return f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS tokens FROM (SELECT doc_id, {x} AS t FROM {source})"


@query(_md5_sql(_BAD.format("t")))
def bad_tokens(spark, d):
    return _md5_list(_tokens_of(spark, d), T.drop_bad(F.col("t")))


@query(_md5_sql(_FILL.format("t")))
def filler_filter(spark, d):
    return _md5_list(_tokens_of(spark, d), T.drop_words(F.col("t"), (*T.STUTTERS, *T.FILLERS)))


@query(_md5_sql(_REPEAT.format("t")))
def repeat_filter(spark, d):
    return _md5_list(_tokens_of(spark, d), T.drop_repeats(F.col("t")))


@query(f"SELECT doc_id, md5({_JOIN.format('t')}) AS joined FROM {_TOKENS_OF}")
def join_tokens(spark, d):
    return _tokens_of(spark, d).select("doc_id", F.md5(T.join_tokens(F.col("t"))).alias("joined"))


_CLEANED = (
    f"WITH a AS (SELECT doc_id, text, {_FOLD.format('text')} AS f FROM documents), b AS (SELECT doc_id, text, {_cite_list('f')} AS cites, {_TOKENS.format(_SYMBOLS.format(_cite('f')))} AS t0 FROM a), "
    f"c AS (SELECT doc_id, text, cites, {_FILL.format(_BAD.format('(t0 || ' + _CLOSERS.format('t0') + ')'))} AS t1 FROM b), e AS (SELECT doc_id, text, cites, {_REPEAT.format('t1')} AS t FROM c), "
    f"g AS (SELECT doc_id, text, cites, t, {_JOIN.format('t')} AS cleaned FROM e) "
)


@query(_CLEANED + "SELECT doc_id, md5(cleaned) AS cleaned FROM g")
def clean_text(spark, d):
    return K.clean(_docs(spark, d)).select("doc_id", F.md5("cleaned_text").alias("cleaned"))


@query(
    _CLEANED
    + f"SELECT doc_id, length(text) AS raw_chars, {_WORDS.format('text')} AS raw_words, length(cleaned) AS cleaned_chars, {_WORDS.format('cleaned')} AS cleaned_words, len(cites) AS removed_citations, len(t) AS n_tokens FROM g"
)
def clean_metrics(spark, d):
    return K.clean_metrics(_docs(spark, d))


# Sections and chunks --------------------------------------------------------------------------------------

_SECTIONED = r"concat('Preface', chr(10), 'CHAPTER ', doc_id % 7, ' opens', chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), 'Page ', doc_id, chr(10), doc_id, chr(10), 'Part Two of it', chr(10), 'IV THE END', chr(10), 'It ends.')"


def _sectioned(spark, d) -> DataFrame:
    # Spark's chr and || agree with DuckDB's here; % needs the same types on both sides.
    return _docs(spark, d).select("doc_id", F.expr(_SECTIONED).alias("text"))


def _heading_case(what: dict[str, str]) -> str:
    return "CASE WHEN bare = '' THEN NULL " + " ".join(f"WHEN regexp_matches(bare, '{_q(p)}') THEN {what[k] if k in what else what['*'].replace('§', _q(p))}" for k, p in S.HEADINGS)


@query(
    f"""WITH t AS (SELECT doc_id, {_SECTIONED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM t),
m AS (SELECT doc_id, line, raw, {_STRIP.format('raw')} AS bare, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
coalesce({_STRIP.format('lag(raw) OVER (PARTITION BY doc_id ORDER BY line)')} = '', false) AS gap FROM l),
k AS (SELECT *, {_heading_case({'chapter': "'chapter'", 'page': "'page'"})} WHEN starts_with(raw, '    ') OR starts_with(raw, chr(9)) OR gap THEN 'paragraph' END AS kind, {_heading_case({'*': "regexp_extract(bare, '§', 1)"})} END AS name FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM k WHERE kind IS NOT NULL)
SELECT doc_id, line, CAST(start AS BIGINT) AS start, kind, coalesce(name, CAST(nth AS VARCHAR)) AS name FROM n"""
)
def line_headings(spark, d):
    return S.headings(_sectioned(spark, d)).withColumn("line", F.col("line").cast("long"))


@query(
    f"""WITH t AS (SELECT doc_id, {_SECTIONED} AS text FROM documents), l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_STRIP.format('s')}), lambda s: s <> '')[1:3] AS l FROM t),
p AS (SELECT doc_id, list_filter(list_transform(l, lambda s: CASE WHEN starts_with(lower(s), 'chapter ') OR starts_with(lower(s), 'part ') THEN regexp_split_to_array(s, '\\s+')[2] WHEN regexp_matches(s, '{_q(S.HEADINGS[2][1])}') THEN regexp_extract(s, '{_q(S.HEADINGS[2][1])}', 1) END), lambda s: s IS NOT NULL)[1] AS name FROM l)
SELECT doc_id, CASE WHEN name IS NULL THEN NULL ELSE 'chapter' END AS kind, name FROM p"""
)
def first_section_name(spark, d):
    return _sectioned(spark, d).select("doc_id", S.first_section(F.col("text"), "chapter").alias("s")).select("doc_id", "s.kind", "s.name")


def _chunked(spark, d, section: str, limit: int = 500, overlap: int = 40) -> DataFrame:
    out = C.chunk(_sectioned(spark, d), ChunkConfig(limit, section, 0.9, overlap))
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "chunk_key", F.col("n_chars").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "truncated")


# A cut at the last full stop within 7200 characters, else at the last space, else there; 200 characters are taken again, from
# the beginning of a word on. For texts without headings, which the table's are.
_CHUNK_LIMIT = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_STRIP.format("replace(text, chr(13) || chr(10), chr(10))")} AS text FROM documents),
c AS (SELECT doc_id, text, -1 AS seq, 0 AS pos, '' AS part, false AS over FROM t WHERE text <> ''
UNION ALL SELECT doc_id, text, seq + 1, CASE WHEN whole THEN pos ELSE again + length(regexp_extract(substr(text, again + 1, 200), '^\\s*')) END, CASE WHEN whole THEN substr(text, pos + 1) ELSE {_STRIP.format("substr(text, pos + 1, best - pos)")} END, whole
FROM (SELECT *, CASE WHEN regexp_matches(substr(text, back + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN back - length(regexp_extract(substr(text, pos + 1, back - pos), '[\\p{{L}}\\p{{N}}]*$')) ELSE back END AS again
FROM (SELECT *, greatest(pos, best - 200) AS back
FROM (SELECT *, pos + CASE WHEN stop > 0 THEN 7200 - stop + 2 WHEN gap > 0 THEN 7200 - gap + 1 ELSE 7200 - CASE WHEN regexp_matches(substr(text, pos + 7201, 1), '[\\p{{L}}\\p{{N}}]') THEN length(regexp_extract(substr(text, pos + 2, 7199), '[\\p{{L}}\\p{{N}}]*$')) ELSE 0 END END AS best
FROM (SELECT *, length(text) - pos <= 8000 AS whole, strpos(reverse(substr(text, pos + 2, 7200)), '.') AS stop, strpos(reverse(regexp_replace(substr(text, pos + 2, 7200), '\\s', ' ', 'g')), ' ') AS gap FROM c WHERE NOT over)))))
SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = 0 THEN 'chunk' ELSE 'chunk.' || seq END AS chunk_key, CAST(length(part) AS INTEGER) AS n_chars, md5(part) AS text_md5, false AS truncated FROM c WHERE seq >= 0
"""


@query(_CHUNK_LIMIT)
def chunk_limit(spark, d):
    return C.chunk(_docs(spark, d), ChunkConfig()).select("doc_id", "seq", "chunk_key", "n_chars", F.md5("text").alias("text_md5"), "truncated")


@query()
def chunk_chapter(spark, d):
    return _chunked(spark, d, "chapter")


@query()
def chunk_page(spark, d):
    return _chunked(spark, d, "page")


@query()
def chunk_paragraph(spark, d):
    return _chunked(spark, d, "paragraph")


# Chunk keys -----------------------------------------------------------------------------------------------

_KEYS = ("chapter II", "chapter I.1", "chapter I", "chapter I.2", "front front", "chapter One", "chunk", "chunk.1", "chapter 2.10", "chapter 2.2", "page 12", "chapter I.", "chapter IV")
_KEYED = f"SELECT doc_id // 13 AS doc_id, CAST(doc_id % 13 AS INTEGER) AS seq, ['{_q(chr(7).join(_KEYS)).replace(chr(7), chr(39) + ',' + chr(39))}'][doc_id % 13 + 1] AS chunk_key, text AS summary FROM documents"


def _keyed(spark, d) -> DataFrame:
    """Whole texts stand for summaries."""
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % 13 + 1).cast("int"))
    return _docs(spark, d).select(F.floor(F.col("doc_id") / 13).alias("doc_id"), (F.col("doc_id") % 13).cast("int").alias("seq"), key.alias("chunk_key"), F.col("text").alias("summary"))


_PARTS = f"""k AS ({_KEYED}), w AS (SELECT *, list_filter(regexp_split_to_array(chunk_key, '\\s+'), lambda x: x <> '') AS ws FROM k), p AS (SELECT *, CASE WHEN len(ws) >= 2 THEN ws[2] ELSE '0' END AS part FROM w),
z AS (SELECT *, regexp_full_match(part, '\\d+(\\.\\d+)?') AS is_num, regexp_full_match(part, '[IVXLC]+(\\.\\d+)?') AS is_rom FROM p),
s AS (SELECT *, CASE WHEN is_num THEN CAST(regexp_extract(part, '^\\d+') AS INTEGER) WHEN is_rom THEN list_reduce(list_reverse(string_split(regexp_extract(part, '^[IVXLC]+'), '')), lambda a, c: struct_pack(t := a.t + CASE WHEN v(c) < a.l THEN -v(c) ELSE v(c) END, l := v(c)), struct_pack(t := 0, l := 0)).t ELSE 0 END AS main_number,
CASE WHEN is_num OR is_rom THEN TRY_CAST(regexp_extract(part, '\\.(\\d+)$', 1) AS INTEGER) END AS sub0, CASE WHEN is_num OR is_rom THEN '' ELSE lower(part) END AS sort_text FROM z),
r AS (SELECT *, coalesce(sub0, 0) AS sub_number, CASE sort_text WHEN 'front' THEN -1 WHEN 'chunk' THEN 9999 ELSE 0 END AS k1 FROM s)"""
_VALUE = "(CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 ELSE 0 END)"
_PARTS = "WITH " + _PARTS.replace("v(c)", _VALUE)


def _order(name: str, order: str, by: str) -> None:
    def run(spark, d):
        return O.ordered(_keyed(spark, d), order).select("doc_id", "chunk_key", F.col("position").cast("long").alias("position"))

    run.__name__ = name
    query(_PARTS + f" SELECT doc_id, chunk_key, row_number() OVER (PARTITION BY doc_id ORDER BY {by}) AS position FROM r")(run)


_order("order_first_last", "firstToLast", "k1, main_number, sub_number, seq")
_order("order_last_first", "lastToFirst", "k1 DESC, main_number DESC, sub_number DESC, seq")
_order("order_by_section", "lastToFirstBySection", "sort_text DESC, main_number DESC, sub_number, seq")
_order("order_by_top", "firstToLastByTop", "CASE WHEN sub0 IS NOT NULL AND sub0 <> 1 THEN 1 ELSE 0 END, k1, main_number, sub_number, seq")

_NUMERAL = "translate(substr(md5(text), 1, 5), '0123456789abcdef', 'IVXLCIVXLCIVXLCI')"


@query(f"SELECT doc_id, list_reduce(list_reverse(string_split({_NUMERAL}, '')), lambda a, c: struct_pack(t := a.t + CASE WHEN {_VALUE} < a.l THEN -{_VALUE} ELSE {_VALUE} END, l := {_VALUE}), struct_pack(t := 0, l := 0)).t AS value FROM documents")
def roman_to_int(spark, d):
    return _docs(spark, d).select("doc_id", O.roman_to_int(F.expr(_NUMERAL)).alias("value"))


@query(f"WITH k AS ({_KEYED}), n AS (SELECT *, count(*) FILTER (chunk_key NOT IN ('title', 'front front')) OVER (PARTITION BY doc_id) AS others FROM k) SELECT doc_id, seq, chunk_key FROM n WHERE chunk_key NOT IN ('title', 'front front') OR others = 0")
def front_filter(spark, d):
    return C.drop_front(_keyed(spark, d)).select("doc_id", "seq", "chunk_key")


_SECTION = "CASE WHEN len(ws) >= 2 AND contains(ws[2], '.') THEN ws[1] || ' ' || split_part(ws[2], '.', 1) ELSE chunk_key END"
_COMBINED = f"{_PARTS}, x AS (SELECT *, {_SECTION} AS section FROM r), y AS (SELECT doc_id, section, CAST(min(seq) AS INTEGER) AS seq, count(*) AS n_pieces, {_STRIP.format('string_agg(' + _STRIP.format('summary') + ', chr(10) || chr(10) ORDER BY chunk_key, summary)')} AS text FROM x GROUP BY doc_id, section)"


@query(f"{_PARTS} SELECT doc_id, chunk_key, {_SECTION} AS section FROM r")
def section_name(spark, d):
    return _keyed(spark, d).select("doc_id", "chunk_key", O.section_name(F.col("chunk_key")).alias("section"))


@query(f"{_COMBINED} SELECT doc_id, section, seq, n_pieces, md5(text) AS text FROM y")
def section_combine(spark, d):
    return R.combine_sections(_keyed(spark, d)).withColumn("text", F.md5("text"))


@query(f"{_COMBINED} SELECT doc_id, max(n_pieces) > 1 AS multi FROM y GROUP BY doc_id")
def multi_part(spark, d):
    return R.multi_part(_keyed(spark, d))


@query(f"WITH k AS ({_KEYED}) SELECT doc_id, md5({_STRIP.format('string_agg(' + _STRIP.format('summary') + ', chr(10) || chr(10) ORDER BY seq)')}) AS text FROM k GROUP BY doc_id")
def merge_all(spark, d):
    return R.merge_all(_keyed(spark, d)).withColumn("text", F.md5("text"))


# Around the model -----------------------------------------------------------------------------------------

_ANSWER = "concat('  Summary:Final summary: <THINK> well', chr(10), '</think>', text, ' ( in U.S. ) .Then 漢', CASE WHEN turn % 2 = 0 THEN '<think> open' ELSE '' END)"


@query(r"SELECT conv_id, turn, regexp_matches(a, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') AS han FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '漢' ELSE text END AS a FROM conversations)")
def cjk_flag(spark, d):
    return _chats(spark, d).select("conv_id", "turn", G.has_han(F.expr("CASE WHEN turn % 3 = 0 THEN concat(text, '漢') ELSE text END")).alias("han"))


@query(f"SELECT conv_id, turn, md5(regexp_replace(regexp_replace({_ANSWER}, '(?is)<think>.*?</think>', ' ', 'g'), '(?is)<think>.*', ' ', 'g')) AS answer FROM conversations")
def strip_thinking(spark, d):
    return _chats(spark, d).select("conv_id", "turn", F.md5(G.drop_thinking(F.expr(_ANSWER))).alias("answer"))


@query(f"SELECT conv_id, turn, md5({_edges(_ANSWER)}) AS answer FROM conversations")
def edge_clean(spark, d):
    return _chats(spark, d).select("conv_id", "turn", F.md5(G.clean_edges(F.expr(_ANSWER))).alias("answer"))


@query(f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN text ELSE replace('{_q(G.PROMPT)}', '{{limit}}', CAST(turn + 1 AS VARCHAR)) END AS prompt FROM conversations")
def prompt_build(spark, d):
    return _chats(spark, d).select("conv_id", "turn", G.prompt(F.col("turn") + 1, F.when(F.col("role") == "system", F.col("text"))).alias("prompt"))


@query(
    f"SELECT conv_id, turn, role, md5(CASE WHEN contains(text, '/no_think') THEN text WHEN role = 'system' THEN {_STRIP.format('text')} || ' /no_think' WHEN role = 'user' THEN '/no_think' || chr(10) || text ELSE text END) AS content FROM conversations"
)
def no_think_messages(spark, d):
    return _chats(spark, d).select("conv_id", "turn", "role", F.md5(G.without_thinking(F.col("role"), F.col("text"))).alias("content"))


def _lead_sql(x: str, n: int) -> str:
    return _edges(f"array_to_string(regexp_extract_all({x}, '[^.!?]+[.!?]+|[^.!?]+$')[1:{n}], '')")


@query(f"SELECT doc_id, md5({_lead_sql('text', 3)}) AS summary FROM documents")
def summarize_lead(spark, d):
    return summarise(_docs(spark, d), lambda: Lead(3), SummaryConfig(sentences=3)).select("doc_id", F.md5("summary").alias("summary"))


@query(f"{_COMBINED} SELECT y.doc_id, y.section AS chunk_key, y.seq, md5(CASE WHEN n_pieces = 1 THEN x.summary ELSE {_lead_sql('y.text', 2)} END) AS summary FROM y JOIN x ON y.doc_id = x.doc_id AND y.seq = x.seq")
def reduce_sections(spark, d):
    out, _ = R.reduce_sections(_keyed(spark, d), lambda: Lead(2), ReduceConfig(sentences=2))
    return out.select("doc_id", "chunk_key", "seq", F.md5("summary").alias("summary"))


def _reduced(spark, d):
    chunks = C.drop_front(C.chunk(_sectioned(spark, d), ChunkConfig(800, "chapter", 0.9, 40)))
    summaries = summarise(chunks, lambda: Lead(2)).select("doc_id", "seq", "chunk_key", "summary")
    return R.reduce_all(summaries, lambda: Lead(2), ReduceConfig(char_limit=400, overlap=20, rounds=3))


@query()
def reduce_paper(spark, d):
    return _reduced(spark, d)[1].select("doc_id", F.md5("paper").alias("paper"))


@query()
def reduction_log(spark, d):
    return _reduced(spark, d)[2].select("doc_id", "stage", "round", "name", "n_inputs", F.length("input_text").alias("input_chars"), F.length("output_text").alias("output_chars"))


@query()
def stack_synthesis(spark, d):
    """All documents' final summaries as one stack."""
    papers = _reduced(spark, d)[1].select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("document "), F.col("doc_id")).alias("name"), "paper")
    return R.synthesise(papers, lambda: Lead(2), ReduceConfig(char_limit=20_000, overlap=20))[0].select("doc_id", "paper")


@query(
    f"""WITH p AS (SELECT doc_id // 13 AS stack, string_agg('document ' || doc_id || ':' || chr(10) || {_STRIP.format("text")}, chr(10) || chr(10) ORDER BY doc_id) AS papers FROM documents GROUP BY 1)
SELECT stack AS doc_id, md5({_STRIP.format("'Survey Synthesis:' || chr(10) || 'Stack ' || stack || chr(10) || chr(10) || 'Individual Document Summaries:' || chr(10) || papers")}) AS context FROM p"""
)
def report_context(spark, d):
    """The context of stacks of 13 documents each."""
    stack = F.floor(F.col("doc_id") / 13)
    rows = _docs(spark, d).select(stack.alias("stack"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("document "), F.col("doc_id")).alias("name"), F.col("text").alias("paper"))
    context = report.context_text(F.concat(F.lit(" Stack "), F.max("stack").cast("string")))
    return rows.groupBy("stack").agg(F.md5(context).alias("context")).withColumnRenamed("stack", "doc_id")


@query(
    f"WITH t AS (SELECT doc_id, CAST(doc_id % 5 AS DOUBLE) / 4 AS elapsed_seconds, length(text) AS input_chars, {_WORDS.format('text')} AS input_words, 1 AS chunk_count FROM documents), s AS (SELECT *, CASE WHEN elapsed_seconds <= 0 THEN 1e-6 ELSE elapsed_seconds END AS e FROM t) "
    "SELECT doc_id, round(input_chars / e, 2) AS chars_per_second, round(input_words / e, 2) AS words_per_second, round(chunk_count / e, 4) AS chunks_per_second FROM s"
)
def throughput_metrics(spark, d):
    given = M.totals(_docs(spark, d)).select("doc_id", ((F.col("doc_id") % 5).cast("double") / 4).alias("elapsed_seconds"), F.col("chars").alias("input_chars"), F.col("words").alias("input_words"), F.col("chunks").alias("chunk_count"))
    return M.throughput(given).select("doc_id", F.round("chars_per_second", 2).alias("chars_per_second"), F.round("words_per_second", 2).alias("words_per_second"), F.round("chunks_per_second", 4).alias("chunks_per_second"))


# Names and reports ----------------------------------------------------------------------------------------

_BASE = r"regexp_replace(list_last(string_split(url, '/')), '^(\.*[^.].*)\.[^.]*$', '\1', 's')"
_SAFE = f"coalesce(nullif(regexp_replace(regexp_replace({_BASE}, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'document')"


@query(f"SELECT page_id, {_SAFE} AS name FROM pages")
def safe_names(spark, d):
    return read_parquet(spark, f"{d}/pages.parquet").select("page_id", N.safe_name(F.col("url")).alias("name"))


@query(f"WITH n AS (SELECT page_id, {_SAFE} AS name FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS nth FROM n) SELECT page_id, CASE WHEN nth = 0 THEN name ELSE name || '_' || nth END AS name FROM r")
def unique_names(spark, d):
    return N.unique_names(read_parquet(spark, f"{d}/pages.parquet").select("page_id", "url"), "url", "page_id").select("page_id", "name")


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(translate({_BASE}, '_-', '  ')), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS name FROM pages")
def display_names(spark, d):
    return read_parquet(spark, f"{d}/pages.parquet").select("page_id", N.display_name(F.col("url")).alias("name"))


_BLOCK = f"chunk_key || chr(10) || '{report.RULE}' || chr(10) || summary || chr(10) || chr(10)"


@query(f"WITH k AS ({_KEYED}) SELECT doc_id, md5(string_agg({_BLOCK}, '' ORDER BY seq)) AS file FROM k GROUP BY doc_id")
def chunk_files(spark, d):
    return _keyed(spark, d).groupBy("doc_id").agg(F.md5(report.key_blocks("chunk_key", "summary", "seq")).alias("file"))


@query(f"WITH k AS ({_KEYED}), b AS (SELECT doc_id, string_agg(CASE WHEN seq = 0 THEN '{report.SURVEY}' ELSE 'Item ' || seq END || chr(10) || {_STRIP.format('summary')}, chr(10) || chr(10) ORDER BY seq) AS body FROM k GROUP BY doc_id) SELECT doc_id, md5({_STRIP.format('body')}) AS body FROM b")
def survey_text(spark, d):
    keys = _keyed(spark, d).withColumn("key", F.when(F.col("seq") == 0, "paper").otherwise(F.concat(F.lit("item "), F.col("seq"))))
    return keys.groupBy("doc_id").agg(F.md5(report.survey_body("key", "summary", "seq")).alias("body"))
