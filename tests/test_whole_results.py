"""Nothing is lost or changed by NULLs, header order, file splitting, empty cells or repeated runs."""

import os

import pytest
from pyspark.sql import functions as F

from flowprep.operators import metrics, split, stats
from flowprep.plans import jobs
from flowprep.sources import io


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_split_keeps_rows_without_a_key(spark):
    rows = [(None if i < 10 else i, "a" if i % 2 else None) for i in range(50)]
    out = split.stratified_split(spark.createDataFrame(rows, "k long, label string"), "label", "k").collect()
    sizes = {(r.label, r.split): sum(x == r for x in out) and sum((x.label, x.split) == (r.label, r.split) for x in out) for r in out}
    assert len(out) == 50 and sizes == {(c, s): n for c in ("a", None) for s, n in (("train", 15), ("val", 5), ("test", 5))}


@pytest.mark.parametrize("rows_per_prefix", [1, 250_000])
def test_split_is_the_same_for_any_prefix_length(spark, monkeypatch, rows_per_prefix):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("label"))
    want = {r.id: r.split for r in split.stratified_split(df, "label", "id", [0.5, 0.0, 0.3, 0.2], ["a", "b", "c", "d"]).collect()}
    monkeypatch.setattr(split, "PREFIX_ROWS", rows_per_prefix)
    again = split.stratified_split(df, "label", "id", [0.5, 0.0, 0.3, 0.2], ["a", "b", "c", "d"])
    assert {r.id: r.split for r in again.collect()} == want and set(want.values()) == {"a", "c", "d"}
    assert sorted(r.id for r in split.hash_sample(df, "id", 700).collect()) == sorted(
        r.id for r in df.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("-42"))), "id").limit(700).collect())


def test_sample_larger_than_its_table_fails(spark):
    with pytest.raises(ValueError):
        split.hash_sample(spark.range(5), "id", 10)
    assert split.hash_sample(spark.range(5), "id", 5).count() == 5


def test_csv_columns_are_united_by_name(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.csv"), "x,y,Label\n1,2,a\n")
    b = _write(os.path.join(tmpdir_path, "b.csv"), "y,x,z,Label\n2,1,9,b\n")
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    c = _write(os.path.join(tmpdir_path, "sub", "a.csv"), "x,y,Label\n5,6,c\n")
    rows = io.read_csv(spark, [a, b, c]).collect()
    assert {(r.Label, r.x, r.y, r.z) for r in rows} == {("a", "1", "2", None), ("b", "1", "2", "9"), ("c", "5", "6", None)}
    assert len({r.file_key for r in rows}) == 3


def test_preparation_does_not_depend_on_the_scan(spark, tmpdir_path):
    header = "Dst Port,Flow Bytes/s,Label\n"
    paths = [_write(os.path.join(tmpdir_path, f"{k}.csv"), header + "".join(
        f"{i % 50},{i * 1.5},{'BENIGN' if i % 3 else 'DDoS'}\n" for i in range(k, 4000, 3))) for k in range(3)]
    got = []
    for name, size in (("whole", "128m"), ("cut", "8k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            out = jobs.prepare_ids17(spark, paths, os.path.join(tmpdir_path, name))
            got.append(sorted((r.row_id, r.split, r.label, *r.features) for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 4000


def test_dense_matrices(spark):
    scored = spark.createDataFrame([("normal", "zz"), ("dos", "dos"), ("dos", "normal")], "y_true string, y_pred string")
    conf = metrics.confusion(scored)
    dense = {(r.y_true, r.y_pred): r.n for r in metrics.dense_confusion(conf).collect()}
    assert len(dense) == 9 and dense["normal", "zz"] == 1 and dense["zz", "zz"] == 0
    two = {(r.y_true, r.y_pred): r.n for r in metrics.binary_confusion(conf, "normal").collect()}
    assert two == {("attack", "attack"): 1, ("attack", "normal"): 1, ("normal", "attack"): 1, ("normal", "normal"): 0}
    wide = io.confusion_wide(conf.withColumn("split", F.lit("t")))
    assert sorted(wide.columns) == ["dos", "normal", "split", "y_true", "zz"] and wide.count() == 3


def test_histogram_with_empty_bins_and_nan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (float("nan"),), (None,)], "x double")
    assert [(r.bin, r.n) for r in stats.histogram(df, "x", 5).orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_report_is_replaced_by_a_rerun(spark, tmpdir_path):
    t = spark.createDataFrame([(1,)], "x int")
    for run in ("a", "b", "a"):
        io.write_report({"t": t}, tmpdir_path, run)
    assert sorted(r.run for r in spark.read.parquet(os.path.join(tmpdir_path, "t")).collect()) == ["a", "b"]


def test_label_with_two_values_fails(spark):
    from flowprep.operators import labels
    df = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    table = spark.createDataFrame([("a", "x"), ("a", "x")], "key string, value string")
    assert sorted(str(r.label) for r in labels.map_labels(df, "label", table).collect()) == ["None", "b", "x"]
    with pytest.raises(Exception, match="two values for the label a"):
        labels.map_labels(df, "label", table.union(spark.createDataFrame([("a", "y")], table.schema))).collect()


def test_small_helpers(spark):
    from flowprep.operators import clean
    from flowprep.session import cluster_conf
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, Label string")
    assert clean.drop_label(df).columns == ["x"]
    p = clean.profile(df, 2)
    assert p["rows"] == 3 and len(p["head"]) == 2 and p["schema"] == "struct<x:int,Label:string>"
    conf = cluster_conf(100)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 1024 * 1024 // 256


def test_pca_decode(spark):
    import numpy as np
    from flowprep.operators import models
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6)) + 3.0  # a plane in six dimensions
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(flat)], "id int, features array<double>")
    centre, pca = models.fit_pca(df, 2)
    for r in models.pca_reconstruct(df, centre, pca).collect():
        assert np.allclose(r.recon, r.features, atol=1e-8) and len(r.encoded) == 2
