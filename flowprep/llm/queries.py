"""Registered queries of the training-data operators, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, quality_classifier, sentencepiece, simhash
from . import queries_corpus as corpus
from . import queries_text as more
from .common import held_out_fold, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = line_dedup.dedup_lines(docs, counts=True)
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_copies").alias("n_copies"),
                      F.col("__n_near").alias("n_near"))


# Lines within one edit of an earlier line are found here through their halves: an edit leaves one half as it is.
ORACLE_SQL["op1_line_dedup"] = """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS no
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, no, lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS norm
  FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
firsts AS (SELECT norm, min((doc_id, no)) AS place, length(norm) AS n FROM lines GROUP BY norm),
long_ones AS (SELECT * FROM firsts WHERE n >= 20),
pairs AS (
  SELECT DISTINCT s.norm AS a, l.norm AS b, s.place AS pa, l.place AS pb, s.n AS na, l.n AS nb
  FROM long_ones s JOIN long_ones l ON (l.n = s.n OR l.n = s.n + 1) AND left(s.norm, s.n // 2) = left(l.norm, s.n // 2)
  WHERE s.norm <> l.norm
  UNION
  SELECT DISTINCT s.norm, l.norm, s.place, l.place, s.n, l.n
  FROM long_ones s JOIN long_ones l
    ON (l.n = s.n OR l.n = s.n + 1) AND right(s.norm, s.n - s.n // 2) = right(l.norm, s.n - s.n // 2)
  WHERE s.norm <> l.norm),
edits AS (
  SELECT * FROM pairs
  WHERE (na = nb AND len(list_filter(range(1, na + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1)
     OR (nb = na + 1 AND len(list_filter(range(0, na + 1), lambda i:
           left(a, i) = left(b, i) AND substr(a, i + 1) = substr(b, i + 2))) > 0)),
near AS (SELECT b AS norm FROM edits WHERE pa < pb UNION SELECT a FROM edits WHERE pb < pa),
kept AS (SELECT place.unnest AS x FROM (SELECT 1 AS unnest) place WHERE false),
places AS (
  SELECT f.place[1] AS doc_id, f.place[2] AS no, f.norm IN (SELECT norm FROM near) AS near FROM firsts f),
marked AS (
  SELECT r.doc_id, r.no, r.line, regexp_matches(r.line, '[^\\x20\\x09-\\x0D]') AS word, p.near
  FROM raw r LEFT JOIN places p ON p.doc_id = r.doc_id AND p.no = r.no),
made AS (
  SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (near) AS n_near,
         count(*) FILTER (word AND near IS NULL) AS n_copies,
         count(*) FILTER (word AND near IS NOT NULL AND NOT near) AS n_kept,
         string_agg(line, chr(10) ORDER BY no) FILTER (NOT word OR (near IS NOT NULL AND NOT near)) AS body
  FROM marked GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL WHEN m.n_lines > 0 AND m.n_kept = 0 THEN ''
            ELSE coalesce(m.body, '') END AS text,
       coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_copies, 0) AS n_copies, coalesce(m.n_near, 0) AS n_near
FROM documents d LEFT JOIN made m ON m.doc_id = d.doc_id
""".replace("kept AS (SELECT place.unnest AS x FROM (SELECT 1 AS unnest) place WHERE false),\n", "")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(read_table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", (held_out_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                         F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


ORACLE_SQL["op5_benchmark_decontamination"] = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM benchmark),
held AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                               ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
wanted AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                                ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n_item FROM wanted GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN wanted USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared * 5 >= n_item * 4
"""


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


for _f in (more.op3_warc, more.op6_toxicity, more.op8_quality_rules, more.op9_language_model, more.op10_secret_scan,
           corpus.op11_phrase_mining, corpus.op12_byte_bpe, corpus.op13_merkle_manifest):
    query(_f)
ORACLE_SQL["op3_warc"] = more.OP3_SQL
ORACLE_SQL["op8_quality_rules"] = more.OP8_SQL
ORACLE_SQL["op11_phrase_mining"] = corpus.OP11_SQL
ORACLE_SQL["op13_merkle_manifest"] = corpus.OP13_SQL
