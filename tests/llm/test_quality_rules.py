import math
import random
import re

import pytest
from pyspark.sql import functions as F

from flowprep.llm import quality_rules

from .conftest import ODD


def slow(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts(make, texts):
    rng = random.Random(3)
    rows = texts[:40] + [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)] + ODD
    rows.append((5000, "a b c " * 20_000))
    got = quality_rules.measure(make(rows)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted((str(d), *slow(t)) for d, t in rows if d != 5000) + [("5000", 60_000, 60_000, 0, 0, 60_000)]
    assert sorted((str(r.doc_id), *(r[f] for f in fields)) for r in got) == sorted(want)


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 500, 20_000) for k in (0, 1, 3, 30, 90) if k <= n]
    df = spark.createDataFrame(rows, "k bigint, n bigint").withColumn("p", quality_rules._binomial_tail(F.col("k"), F.col("n"), 0.005))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) * 0.005**i * 0.995**(r.n - i) for i in range(r.k + 1)) if r.n <= 500 else math.fsum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log(0.995))
            for i in range(r.k + 1))
        assert r.p == (1.0 if r.k >= r.n * 0.005 else pytest.approx(exact, rel=1e-8))


def test_false_rejections_stay_below_the_risk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").where("not base_failed and quality is not null")
    got = {r.quality: (r.n, r.kept) for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    print("rules", got)
    assert got[1][1] >= (1 - quality_rules.RISK) * got[1][0] and got[0][1] < got[0][0]


def test_odd_rows(spark, make):
    labels = spark.createDataFrame([(None, 1), (4, None), (6, 1), (99, 0)], "doc_id bigint, quality int")
    rows = quality_rules.apply_rules(make([(*r, None) for r in ODD] + [(7, "word " * 5 + "other thing is here now today", "de")]), labels).collect()
    assert len(rows) == len(ODD) + 1 and [r.doc_id for r in rows if r.kept] == [7]
    none = quality_rules.apply_rules(make([]), labels)
    assert none.count() == 0
    wide = make(ODD).withColumn("n_words", F.lit("x")).withColumn("s", F.lit("x")).withColumn("rule", F.lit(1)).withColumn("c0", F.lit(0))
    assert quality_rules.apply_rules(wide, labels.limit(0)).count() == len(ODD)
