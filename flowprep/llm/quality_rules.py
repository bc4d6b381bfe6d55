"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a value of a document and a fixed grid of cutoffs; a document is
rejected if a rule's value is above the cutoff chosen for its stratum (its
language).  The cutoffs are chosen on labelled rows, none of which shaped the
grid, so all of them are holdouts:

* For each stratum, rule and cutoff the label-1 rows that the cutoff would
  reject are counted.  If the false rejection rate were above ``risk / rules``,
  so few would be rejected with a probability of at most
  ``P(Binomial(n, risk / rules) <= rejected)``, the exact binomial p-value.
* A cutoff is admitted if its p-value is at most ``doubt`` divided by the number
  of (stratum, rule, cutoff) tests (Bonferroni): with probability 1 - ``doubt``,
  *all* admitted cutoffs hold their limit, so any choice among them does, and the
  rules of a stratum together reject at most ``risk`` of its good documents.
* Of the admitted cutoffs of a rule the one is used that rejects most label-0
  rows net of label-1 rows (the loosest of equals), if that is above zero.

Documents that fail the base rules are not kept whatever the cutoffs, and take
no part in the tests.

Defined results: null text has no words (all counts 0, base failed).  A null
language is a stratum of its own.  Rows may repeat.  Labels that are null or of
no document are left out; a stratum without enough labels has no cutoff, and its
documents are kept unless they fail the base rules.  Several labels of one id
count each.  Other columns are ignored, whatever their names.

Windows of five words are compared by a 64-bit hash within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fits_broadcast, let, stored

RISK, DOUBT = 0.05, 0.05
#: Fixed rules: (name, value as SQL over the base columns, ascending cutoffs: reject above).
RULES = [
    ("symbols", "n_symbols / nullif(n_words, 0)", [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    ("exclamations", "n_exclaims / nullif(n_words, 0)", [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    ("capitals", "n_capitals / greatest(word_chars, 1)", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    ("copied lines", "n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]),
    ("repeated words", "n_repeat_words / nullif(n_words, 0)", [0.02, 0.05, 0.08, 0.11, 0.14, 0.17]),
    ("long words", "word_chars / nullif(n_words, 0)", [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
    ("short words", "0 - word_chars / nullif(n_words, 0)", [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5]),
]
N_CUTOFFS = sum(len(c) for _, _, c in RULES)
_STRATA_ROWS = 100_000


def _count_of(text: Column, kept: str) -> Column:
    """Characters of a class, as what is left without all others."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeated_words(hashes: Column) -> Column:
    """Words in 5-word windows (given by their hashes, in order) that occur twice or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        twins = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s)),
                           lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def covered(p):
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return let(placed, lambda s: let(starts(s), covered))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, stratum, base counts, base_failed) per row of ``docs``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(body, SPACE_CLASS + "+"), "")

    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))

    def repeated(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeated_words(h))

    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) < 6, 0).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: let(windows(hw), repeated))).alias("repeated")))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("stratum"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))).alias("l"),
        counts.alias("w"),
        F.length(F.regexp_replace(body, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        _count_of(body, "#*$%&|<>").alias("n_symbols"), _count_of(body, "!").alias("n_exclaims"),
        _count_of(body, "A-Z").alias("n_capitals"))
    rows = rows.select(
        "doc_id", "stratum", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.own")).cast("long").alias("n_dup_lines"),
        F.col("w.repeated").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"),
        "n_exclaims", "n_capitals")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed in logs; 1 where k is at or above the mean (no test passes there)."""
    odds, none = math.log(rate) - math.log1p(-rate), math.log1p(-rate)

    def add(state, i):
        term = state["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(state["sum"], term) - high))).alias("sum"))

    start = F.struct((n * none).alias("term"), (n * none).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda s: s["sum"])))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT,
                   doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, good, good_rejected, bad_rejected, p_value): the cutoff in use per stratum and rule."""
    rated = (labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull())
             .select(F.col(f"`{doc_id}`").alias("doc_id"), (F.col(f"`{label}`") == 1).alias("good")))
    levels = F.array(*[F.struct(F.lit(i).alias("rule"), sum(
        (F.expr(value) > F.lit(c)).cast("int") for c in cutoffs).alias("level")) for i, (_, value, cutoffs) in enumerate(RULES)])
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(j + 1).alias("at"), F.lit(c).alias("cutoff"))
                               for i, (_, _, cutoffs) in enumerate(RULES) for j, c in enumerate(cutoffs)])).alias("g")
    tried = measured.where(~F.col("base_failed")).join(rated, "doc_id")
    # strata x rules x levels rows from here on
    counts = stored(tried.select("stratum", "good", F.explode(levels).alias("x"))
                    .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level"))
                    .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "rule-counts")
    strata = counts.select("stratum").distinct()
    tests = strata.agg((F.count(F.lit(1)) * N_CUTOFFS).alias("tests"))
    cells = strata.select("stratum", grid).select("stratum", "g.rule", "g.at", "g.cutoff")
    above = (cells.join(counts.withColumnRenamed("rule", "r").withColumnRenamed("stratum", "s"),
                        F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")))
             .groupBy("stratum", "rule", "at", "cutoff")
             .agg(F.sum("good").alias("good"), F.sum(F.when(F.col("level") >= F.col("at"), F.col("good")).otherwise(0)).alias("good_rejected"),
                  F.sum(F.when(F.col("level") >= F.col("at"), F.col("bad")).otherwise(0)).alias("bad_rejected")))
    tested = (above.withColumn("p_value", _binomial_tail(F.col("good_rejected"), F.col("good"), risk / len(RULES)))
              .join(F.broadcast(tests))  # one row
              .where(F.col("p_value") <= doubt / F.col("tests")).where("bad_rejected > good_rejected"))
    gain = F.struct((F.col("bad_rejected") - F.col("good_rejected")).alias("gain"), F.col("at").alias("at"))
    return (tested.groupBy("stratum", "rule")
            .agg(F.max_by(F.struct("cutoff", "good", "good_rejected", "bad_rejected", "p_value"), gain).alias("c"))
            .select("stratum", "rule", "c.*"))


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT, doc_id: str = "doc_id",
                text: str = "text", lang: str = "lang", label: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules) per row."""
    measured = stored(measure(docs, doc_id, text, lang), "measured")
    chosen = stored(choose_cutoffs(measured, labels, risk, doubt, "doc_id", label), "cutoffs")
    per = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"c{i}")
                                          for i in range(len(RULES))]).withColumnRenamed("stratum", "s")
    per = F.broadcast(per) if fits_broadcast(chosen, _STRATA_ROWS) else per
    broken = F.array(*[F.when(F.expr(value) > F.col(f"c{i}"), F.lit(name)) for i, (name, value, _) in enumerate(RULES)])
    return (measured.join(per, F.col("stratum").eqNullSafe(F.col("s")), "left")
            .withColumn("rules", F.filter(broken, lambda x: x.isNotNull()))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules"))
