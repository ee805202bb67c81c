"""One thin query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.chat import CONTROL, chat_report, through_records
from tidemark.llm.licenses import BASE, COVER, TEMPLATES, scan_licenses
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mix_report
from tidemark.llm.near import near_classes
from tidemark.llm.packing import packed
from tidemark.llm.quality import quality_rules
from tidemark.llm.suffix import suffix_report
from tidemark.llm.tokens import token_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cut.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


#: Said by the user and the assistant of conversation -7.
PROBE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_report(through_records(rows.unionByName(probe)))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_ann": op7_ann,
    "op8_chat": op8_chat,
    "op9_token_ids": op9_token_ids,
    "op10_mixing": op10_mixing,
}

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _escaped(column: str) -> str:
    found = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        found = f"replace({found}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return found


_OP8 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *, length(replace({_escaped("role")}, chr(10), '\n')) + length({_escaped("text")}) + 16 AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

def _op4() -> str:
    """Every alignment of every template is counted here; the method looks up rare words only."""
    words, keys, base = [], [], []
    for t, template in enumerate(TEMPLATES):
        parts, key = template.text.split(), template.key.split()
        at = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
        words += [f"({t}, {k}, '{w}', {int(at <= k < at + len(key))})" for k, w in enumerate(parts)]
        keys.append(f"({t}, '{template.label}', {len(parts)}, {len(key)})")
    for b, (phrase, label) in enumerate(BASE.items()):
        base += [f"({b}, {k}, '{w}', '{label}', {len(phrase.split())})" for k, w in enumerate(phrase.split())]
    return rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs
), tw(t, k, word, in_key) AS (VALUES {", ".join(words)}), tk(t, label, size, key_size) AS (VALUES {", ".join(keys)}),
bw(b, k, word, label, size) AS (VALUES {", ".join(base)}),
base AS (
  SELECT doc_id, pos - k AS start, label FROM words JOIN bw ON words.word = bw.word
  GROUP BY doc_id, pos - k, b, label, size HAVING count(*) = size
), met AS (
  SELECT doc_id, tw.t, pos - k AS d, count(*) AS n, sum(in_key) AS in_key FROM words JOIN tw ON words.word = tw.word GROUP BY doc_id, tw.t, pos - k
), more AS (
  SELECT doc_id, label, n::DOUBLE / size AS share FROM met JOIN tk ON met.t = tk.t WHERE in_key = key_size AND n::DOUBLE / size >= {COVER}
), b AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM more) GROUP BY doc_id
), m AS (SELECT doc_id, max(share) AS share FROM more GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM docs d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


ORACLE: dict[str, str] = {"op2_line_dedup": _OP2, "op4_licenses": _op4(), "op8_chat": _OP8}
