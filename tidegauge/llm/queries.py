"""Queries of the training-data operators over the whole documents, benchmark, labels, pages and conversations tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer file by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.source_mix import mixed_report

    return mixed_report(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.line_dedup import dedup_report

    return dedup_report(_read(spark, sf_dir, "documents")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.quality_rules import quality_report

    return quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.token_store import store_documents

    return store_documents(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.jaccard_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.chat_format import format_conversations, read_back
    from tidegauge.llm.common import materialize

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select -1L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    return read_back(materialize(format_conversations(turns.unionByName(probe)), "chats"))


def op7_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.fm_index import digest, occurrences

    found = digest(occurrences(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))
    return found.withColumn("spans", F.array_join(F.zip_with("begins", "ends", lambda b, e: F.concat_ws("-", b, e)), ",")).drop("begins", "ends")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.ordinal import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.warc import derivatives

    return derivatives(_read(spark, sf_dir, "pages"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.lattice_lm import lattice_scores

    return lattice_scores(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.token_align import alignment_report

    return alignment_report(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.exact_dedup import dedup_report

    return dedup_report(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.conversation_repair import damage, repair_report

    return repair_report(damage(_read(spark, sf_dir, "conversations")), lost_col="lost")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mix, op2_line_dedup, op3_quality_rules, op4_token_store, op5_jaccard_join, op6_chat_format, op7_fm_decontaminate, op8_ordinal_quality, op9_warc_derivatives, op10_lattice_lm, op11_token_align, op12_exact_dedup, op13_conversation_repair)}

#: Raking, multinomials by Spark's hash, tokenisation, fitted models and WARC bytes are beyond SQL; the tests hold
#: those against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS key, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT key, unnest(range(0, len(l) - 2)) AS pos, l FROM d WHERE len(l) >= 3),
v AS (SELECT key, pos, l[pos + 1] AS a, l[pos + 2] AS b, l[pos + 3] AS c FROM w),
f AS (SELECT *, first_value(key) OVER o AS k0, first_value(pos) OVER o AS p0 FROM v WHERE regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]') WINDOW o AS (PARTITION BY a, b, c ORDER BY key, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT key, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM f WHERE (key, pos) > (k0, p0) GROUP BY key)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END AS text
FROM d LEFT JOIN g USING (key)""",
    "op5_jaccard_join": """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS t FROM d),
u AS (SELECT doc_id, len(t) AS n, list_sort(t) AS t, hash(list_sort(t)) AS h FROM s),
c AS (SELECT h, t, n, min(doc_id) AS rep, count(*) AS copies FROM u WHERE n > 0 GROUP BY h, t, n),
e AS (SELECT rep, n, unnest(t) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (n - common) UNION SELECT b, a FROM p WHERE 100 * common >= 80 * (n - common)),
r AS (SELECT rep AS v, rep AS to_ FROM c UNION SELECT r.v, l.b FROM r JOIN l ON r.to_ = l.a),
m AS (SELECT v, min(to_) AS component_id FROM r GROUP BY v)
SELECT u.doc_id, u.n AS n_shingles, coalesce(m.component_id, u.doc_id) AS component_id, coalesce(c.copies, 1) AS copies
FROM u LEFT JOIN c ON u.h = c.h AND u.t = c.t LEFT JOIN m ON m.v = c.rep""",
    "op6_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, coalesce(lag(role) OVER w, 'begin') AS prev, row_number() OVER w - 1 AS i, lead(role) OVER w IS NULL AS last, length(text) + length(text) - length(translate(text, '~<[|', '')) AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 11 + length(role) + length(role) - length(translate(role, '~<[|', '')) END AS marks,
  CASE role WHEN 'system' THEN prev = 'begin' WHEN 'user' THEN prev IN ('begin', 'system', 'assistant') WHEN 'assistant' THEN prev = 'user' ELSE FALSE END AS legal FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + marks)::BIGINT AS formatted_chars, min(i) FILTER (NOT legal) AS wrong, bool_or(last AND role <> 'assistant') AS bad_end FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, wrong IS NULL AND NOT bad_end AS valid, coalesce(wrong, CASE WHEN bad_end THEN n_turns END)::BIGINT AS fault FROM g""",
    "op7_fm_decontaminate": """
WITH norm AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT id, len(x) AS n, array_to_string(x, ' ') AS p FROM (SELECT id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) ELSE [w] END) AS x FROM item WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM q),
v AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM norm, k WHERE len(w) >= n),
o AS (SELECT v.id, v.i, v.n, q.id AS item FROM (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM v) v JOIN q USING (n, p)),
h AS (SELECT id, list_sort(list_distinct(flatten(list(range(i, i + n))))) AS pos, list_sort(list_distinct(list(item::VARCHAR))) AS items FROM o GROUP BY id),
b AS (SELECT *, list_filter(pos, lambda x: NOT list_contains(pos, x - 1)) AS first, list_filter(pos, lambda x: NOT list_contains(pos, x + 1)) AS final FROM h)
SELECT norm.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, pos IS NOT NULL AS contaminated,
  coalesce(array_to_string(list_transform(list_zip(first, final), lambda z: (z[1] - 1) || '-' || z[2]), ','), '') AS spans
FROM norm LEFT JOIN b ON norm.id = b.id""",
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, FALSE) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
