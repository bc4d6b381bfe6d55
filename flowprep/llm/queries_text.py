"""Queries of the archive, scoring and scanning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, quality_rules, secrets, toxicity, warc
from .common import held_out_fold, read_table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.drop("rules")


# Written on its own: same rules and grid, binomial tails by log-gamma instead of a running product.
OP8_SQL = """
WITH body AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM body),
win AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS s
        FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k.k) AS n FROM win JOIN twice USING (r, s), range(0, 5) k(k) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT line) AS own
       FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM body)
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT b.r, b.doc_id, b.lang, len(w.ws) AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals,
             coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.own, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM body b JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN covered c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (SELECT r, lang, doc_id, base_failed, unnest([
        {'rule': 0, 'x': n_symbols / n_words}, {'rule': 1, 'x': n_exclaims / n_words},
        {'rule': 2, 'x': n_capitals / greatest(word_chars, 1)}, {'rule': 3, 'x': n_dup_lines / greatest(n_lines, 1)},
        {'rule': 4, 'x': n_repeat_words / n_words}, {'rule': 5, 'x': word_chars / n_words},
        {'rule': 6, 'x': 0 - word_chars / n_words}]) AS q FROM f WHERE n_words > 0),
grid AS (SELECT rule, unnest(cs) AS cutoff FROM (VALUES
        (0, [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]), (1, [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]),
        (2, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]), (3, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]::DOUBLE[]),
        (4, [0.02, 0.05, 0.08, 0.11, 0.14, 0.17]::DOUBLE[]), (5, [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]::DOUBLE[]),
        (6, [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5]::DOUBLE[])) g(rule, cs)),
tried AS (SELECT v.lang, v.q.rule AS rule, v.q.x AS x, l.quality = 1 AS good
          FROM v JOIN labels l USING (doc_id) WHERE NOT v.base_failed AND l.quality IS NOT NULL),
cells AS (SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND x > cutoff) AS k,
                 count(*) FILTER (NOT good AND x > cutoff) AS bad
          FROM tried JOIN grid USING (rule) GROUP BY lang, rule, cutoff),
tails AS (SELECT *, CASE WHEN k >= n * (0.05 / 7) THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 7) + (n - i) * ln(1 - 0.05 / 7)))) END AS p
          FROM cells),
used AS (SELECT lang, rule, cutoff FROM tails
         WHERE p <= 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM tried)) * 54) AND bad > k
         QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - k DESC, cutoff) = 1),
broken AS (SELECT DISTINCT v.r FROM v JOIN used u ON v.lang IS NOT DISTINCT FROM u.lang AND v.q.rule = u.rule AND v.q.x > u.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM broken) AS kept
FROM f
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, root = warc.archive_pages(read_table(spark, sf_dir, "pages"))
    return warc.read_captures(manifest.select("key", "page_id"), root).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.5)
    return scored.select("doc_id", (held_out_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_scores(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))
