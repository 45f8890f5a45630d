"""The registered queries of this subpackage, op1 to op10 over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, pii, rules, secrets, sketch_dedup, suffix_dedup, toolcalls, toxicity
from .common import table
from .packing import pack
from .warc import archive_round_trip


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no explicit calls: a user's turn calls for the reply that follows it, and cites the user's turn before."""
    return toolcalls.link(table(spark, sf_dir, "conversations"), implied=True)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(rules.ledger(table(spark, sf_dir, "documents")), rules.POLICIES[1])


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and what leaving it out would bring back, from the ledger's bits."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pii, op3_decontaminate, op4_tool_calls, op5_suffix_dedup, op6_sketch_dedup, op7_rules, op8_toxicity, op9_warc, op10_pack, rule_ablations)}


#: What DuckDB can express. The others are tested against plain Python: op1, op2 and op5 need places of matches or
#: of all bytes, op3 lays templates side by side, op8 learns, op10 has a vocabulary.
SQL: dict[str, str] = {}

SQL["op4_tool_calls"] = """
WITH RECURSIVE u AS (SELECT DISTINCT conv_id, turn, NOT starts_with(coalesce(text, ''), '{') AS plain FROM conversations WHERE role = 'user'),
f AS (SELECT DISTINCT x.conv_id, x.turn FROM u x JOIN u y ON x.conv_id = y.conv_id AND x.turn = y.turn + 2 AND y.plain),
v AS (SELECT conv_id, turn, 0 AS level FROM u ANTI JOIN f USING (conv_id, turn) UNION ALL SELECT f.conv_id, f.turn, v.level + 1 FROM v JOIN f ON v.conv_id = f.conv_id AND f.turn = v.turn + 2),
c AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS key FROM conversations),
i AS (SELECT conv_id, key, min(turn) FILTER (kind = 'call') AS call_turn, min(turn) FILTER (kind = 'result') AS result_turn, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results FROM c WHERE key IS NOT NULL GROUP BY ALL)
SELECT c.conv_id, c.turn, 0 AS part, c.role, kind, 't' || c.key AS call_id, CASE WHEN kind = 'call' THEN 'reply' END AS tool,
CASE kind WHEN 'call' THEN result_turn IS NOT NULL WHEN 'result' THEN call_turn IS NOT NULL END AS linked, CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS partner_turn,
v.level, coalesce(CASE WHEN kind = 'result' THEN call_turn END, c.turn) AS sort_turn, CASE kind WHEN 'result' THEN 2 WHEN 'call' THEN 1 ELSE 0 END AS sort_rank, CASE WHEN kind = 'call' THEN text <> '' END AS valid,
nullif(concat_ws('; ', CASE WHEN kind = 'call' AND text = '' THEN '$.text: minLength' END, CASE WHEN kind = 'call' AND calls > 1 OR kind = 'result' AND results > 1 THEN 'duplicate id' END, CASE WHEN kind = 'result' AND call_turn IS NULL THEN 'no call' END,
CASE WHEN kind = 'call' AND result_turn IS NULL THEN 'no result' END), '') AS problem,
CASE kind WHEN 'call' THEN '{"arguments":{' || CASE WHEN f.turn IS NULL THEN '' ELSE '"after":{"$ref":"t' || (c.turn - 2) || '"},' END || '"text":' || to_json(text) || '},"id":"t' || c.key || '","name":"reply"}' WHEN 'result' THEN '{"content":' || to_json(text) || ',"role":"assistant","tool_call_id":"t' || c.key || '"}' ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM c LEFT JOIN i ON c.conv_id = i.conv_id AND c.key = i.key LEFT JOIN f ON c.conv_id = f.conv_id AND c.turn = f.turn AND kind = 'call' LEFT JOIN v ON c.conv_id = v.conv_id AND c.turn = v.turn AND kind = 'call'
"""

SQL["op6_sketch_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM r LEFT JOIN n ON r.a = n.doc_id GROUP BY a
"""

# The rules and the policies' masks are written out here, so that the operator's own are compared with something.
_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\t-\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\t-\r]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 5 > n_words THEN 2 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN word_chars < n_words + n_words THEN 8 ELSE 0 END
+ CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN n_symbols * 10 > n_words * 3 THEN 32 ELSE 0 END + CASE WHEN n_capitals * 5 > word_chars * 2 THEN 64 ELSE 0 END + CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 128 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
"""

SQL["op7_rules"] = _LEDGER + "SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits & 127 = 0 AS kept, 'v1' AS policy FROM b"

SQL["rule_ablations"] = _LEDGER + """, r(k, rule) AS (VALUES (0, 'few_words'), (1, 'repeated_windows'), (2, 'many_words'), (3, 'short_words'), (4, 'long_words'), (5, 'symbols'), (6, 'capitals'), (7, 'repeated_lines')),
p2(policy, mask) AS (VALUES ('base', 3), ('v1', 127), ('v2', 255))
SELECT policy, rule, CAST(count(*) FILTER (fail_bits & mask & (1 << k) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits & mask = (1 << k)) AS BIGINT) AS n_only, CAST(count(*) FILTER (fail_bits & mask <> 0) AS BIGINT) AS n_rejected
FROM b, p2, r WHERE mask & (1 << k) <> 0 GROUP BY policy, rule
"""

SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS leader FROM h)
SELECT page_id, payload_bytes, upper(array_to_string(list_transform(range(0, 8), lambda k: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) >> s) & 31) + 1, 1)), lambda a, x: a || x)), '')) AS payload_digest,
CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to FROM g
"""
