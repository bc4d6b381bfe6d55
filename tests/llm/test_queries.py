"""Every registered query with SQL matches it; the pipeline runs and each stage keeps its contract."""

import math

import pytest

import __spark_entry__ as E
import corpus_pipeline
from flowprep.llm import quality_classifier, sentencepiece
from flowprep.llm.queries import ORACLE_SQL, QUERIES

from . import test_decontaminate, test_line_dedup, test_simhash
from .conftest import SF


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def test_registered():
    names = E.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sdf.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=key)
    d = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert s == d


def test_pipeline_matches_brute_force(spark, docs, texts):
    """run() against the stages done one after the other by plain Python (the classifier's verdicts as given)."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdicts = quality_classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), threshold=0.3).collect()
    good = {r.doc_id for r in verdicts if r["__predicted"]}
    rows = [(d, t) for d, t in texts if d in good]
    lines = test_line_dedup.brute(rows)
    rows = [(d, lines[d]) for d, t in rows if lines[d].strip(" \t\n\v\f\r") or not t.strip(" \t\n\v\f\r")]
    groups = test_simhash.brute([d for d, _ in rows], [test_simhash.slow_fingerprint(t) for _, t in rows])
    rows = [r for r, g in zip(rows, groups) if r[0] == g]
    leaked = {d for d, _ in test_decontaminate.brute(rows, items)}
    codec = sentencepiece.Codec(sentencepiece.read_model())
    want = {d: codec.encode(t).tolist() for d, t in rows if d not in leaked}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want)
    assert 0 < len(want) < len(rows) < len(lines) < len(texts) and all(r.round_trip for r in got)


def test_stages_keep_the_columns(spark, docs, clashing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup",
                                                      "benchmark decontamination", "sentencepiece"]
    wide = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and 0 < out.count() <= wide.count()


def test_pipeline_on_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
