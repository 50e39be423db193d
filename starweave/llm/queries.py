"""One query per operator, over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starweave.llm.align import alignment_report
from starweave.llm.ann import search
from starweave.llm.compact_windows import near_duplicate_passages
from starweave.llm.fim import fim_report
from starweave.llm.langid import identify
from starweave.llm.lm import score_documents
from starweave.llm.minhash import near_duplicates
from starweave.llm.packing import pack
from starweave.llm.pieces import encoding_report
from starweave.llm.quality import STOP_SET, quality_report
from starweave.llm.secret_scan import secret_report
from starweave.llm.suffix_dedup import repeated_bytes
from starweave.llm.warc import archive_report

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents")).drop("digest")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_report(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_SET)
#: Per document: words in order (w), lines that hold a word (ln) and the base counts.
QUALITY_SIGNALS_SQL = f"""
q_words AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln
  FROM (SELECT doc_id, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents)),
q_pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words WHERE len(w) >= 3),
q_win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM q_pos),
q_rep AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM q_win WHERE n > 1)
  GROUP BY doc_id),
q_counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words, len(ln) AS n_lines
  FROM q_words d LEFT JOIN q_rep r ON r.doc_id = d.doc_id),
q_signals AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
         CASE WHEN n_words > 0 THEN word_chars / n_words END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbols_per_word,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS dup_line_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM q_counts),
q_report AS (
  SELECT *, NOT base_failed AND coalesce(mean_word_chars BETWEEN 2.5 AND 12, true)
            AND coalesce(symbols_per_word <= 0.25, true) AND n_stop_words >= 2
            AND coalesce(dup_line_ratio <= 0.5, true) AS kept,
         CASE WHEN n_words < 50 THEN 'enough_words'
              WHEN 100 * n_repeat_words > 50 * n_words THEN 'few_repeated_windows'
              WHEN NOT coalesce(mean_word_chars BETWEEN 2.5 AND 12, true) THEN 'mean_word_length'
              WHEN NOT coalesce(symbols_per_word <= 0.25, true) THEN 'few_symbols'
              WHEN n_stop_words < 2 THEN 'has_stop_words'
              WHEN NOT coalesce(dup_line_ratio <= 0.5, true) THEN 'few_repeated_lines' END AS failed_rule
  FROM q_signals)"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DUPLICATES_SQL = f"""
n_words AS (
  SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
n_shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM n_words WHERE len(w) > 0)),
n_size AS (SELECT doc_id, count(*) AS n FROM n_shingle GROUP BY doc_id),
n_common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM n_shingle a JOIN n_shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
n_link AS (
  SELECT a, b FROM n_common JOIN n_size x ON x.doc_id = a JOIN n_size y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
n_reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION SELECT q.a, e.b FROM n_reach q JOIN n_link e ON e.a = q.r),
n_report AS (
  SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(q.r) AS component_id,
         d.doc_id = min(q.r) AS kept
  FROM documents d JOIN n_reach q ON q.a = d.doc_id LEFT JOIN n_size z ON z.doc_id = d.doc_id GROUP BY d.doc_id)"""

FIM_SQL = """
f_text AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
f_hash AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
         ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM f_text),
f_cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM f_hash),
f_parts AS (
  SELECT *, substring(t, 1, lo) AS prefix, substring(t, lo + 1, hi - lo) AS middle, substring(t, hi + 1) AS suffix FROM f_cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f_parts"""

#: Base32 of a hexadecimal digest: five of its digits are four of the result.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || h[{5 * j + 1}:{5 * j + 5}])::BIGINT >> {15 - 5 * k}) & 31)::INT, 1)"
    for j in range(8) for k in range(4))
WARC_SQL = f"""
w_page AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
w_first AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
         min(page_id) OVER (PARTITION BY t) AS f FROM w_page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM w_first"""

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_secret_scans, op2_sentencepiece, op3_minhash, op4_nearest_neighbours, op5_suffix_array, op6_compact_windows,
        op7_language_id, op8_quality_rules, op9_lm_scoring, op10_packing, op11_fill_in_middle, op12_tokenizer_alignment,
        op13_warc)}
ORACLE: dict[str, str] = {
    "op3_minhash": f"WITH RECURSIVE {NEAR_DUPLICATES_SQL} SELECT * FROM n_report",
    "op8_quality_rules": f"WITH {QUALITY_SIGNALS_SQL} SELECT * FROM q_report",
    "op11_fill_in_middle": f"WITH {FIM_SQL}",
    "op13_warc": f"WITH {WARC_SQL}",
}
