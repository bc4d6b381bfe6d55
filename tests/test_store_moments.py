"""Keyed store, mergeable statistics, file order and bitmap fetch."""

import math
import re
import threading

import pytest
from pyspark.sql import functions as F

from flowprep.operators import scale, sequence, split
from flowprep.operators.moments import ScalerState, as_scaler, column_moments, merge_moments, with_deviation
from flowprep.operators.position import with_position
from flowprep.sources import file_order, io
from flowprep.sources.store import KeyedStore, KeyInStore


@pytest.fixture()
def rows(spark):
    return spark.range(100).select("id", F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("file_key"),
                                   F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_append_again_changes_nothing(spark, rows, tmpdir_path):
    store = KeyedStore(spark, f"{tmpdir_path}/s", partition_by=["split"])
    assert store.committed() is None
    with pytest.raises(ValueError):
        store.read()
    assert store.append(rows.where("file_key in ('f0', 'f1')")) == 2
    assert store.append(rows) == 2 and store.append(rows) == 0
    again = KeyedStore(spark, f"{tmpdir_path}/s")
    assert ids(again.read()) == list(range(100)) and len(again.attempts()) == 2
    assert {tuple(r) for r in again.committed().collect()} == {(f"f{i}", 25) for i in range(4)}
    assert ids(again.read(split="train", file_key="f1")) == [i for i in range(100) if i % 4 == 1 and i % 3 == 0]
    with pytest.raises(KeyInStore):
        store.append(rows.where("file_key = 'f3'"), existing="refuse")


def test_unpublished_rows_are_not_seen(spark, rows, tmpdir_path):
    store = KeyedStore(spark, f"{tmpdir_path}/s")
    store.append(rows.where("file_key = 'f0'"))
    late = store.write_attempt(rows.where("file_key in ('f0', 'f1')"))
    assert ids(store.read()) == list(range(0, 100, 4))
    with pytest.raises(KeyInStore):      # f0 has come in before
        store.publish(late)
    store.append(rows.where("file_key in ('f0', 'f1')"))
    assert ids(store.read()) == sorted([*range(0, 100, 4), *range(1, 100, 4)])


def test_writers_at_one_time(spark, rows, tmpdir_path):
    """Of writers of one key one is published, the others are refused; those of other keys all are."""
    store = KeyedStore(spark, f"{tmpdir_path}/s")
    keys = ["f0", "f0", "f1", "f2"]
    attempts = [store.write_attempt(rows.where(F.col("file_key") == k)) for k in keys]
    outcome = []

    def go(a):
        try:
            outcome.append(KeyedStore(spark, f"{tmpdir_path}/s").publish(a))
        except KeyInStore:
            outcome.append("refused")

    threads = [threading.Thread(target=go, args=(a,)) for a in attempts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, outcome)) == ["1", "1", "1", "refused"]
    assert ids(store.read()) == [i for i in range(100) if i % 4 != 3]


def test_columns_by_name_and_odd_keys(spark, tmpdir_path):
    store = KeyedStore(spark, f"{tmpdir_path}/s")
    store.append(spark.createDataFrame([("007", 1, "x")], "file_key string, id long, a string"))
    store.append(spark.createDataFrame([("a/b=c d", 2, 0.5)], "file_key string, id long, b double"))
    got = {tuple(r) for r in store.read().select("file_key", "id", "a", "b").collect()}
    assert got == {("007", 1, "x", None), ("a/b=c d", 2, None, 0.5)}
    with pytest.raises(ValueError, match="without file_key"):
        store.append(spark.createDataFrame([(None, 3, "x")], "file_key string, id long, a string"))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("z", "t", "x")], "file_key string, id string, a string"))
        store.read()


def test_merge_is_exact_for_far_off_values(spark):
    """Means of 1e9 with deviations of 1: sums of squares would lose every digit (a mean of 1e9 has seven places)."""
    df = spark.range(4000).select((F.lit(1e9) + F.col("id") % 7).alias("x"), (F.col("id") % 13).alias("part"),
                                  F.when(F.col("id") % 2 == 0, F.col("id")).alias("with nulls"), F.lit(None).cast("double").alias("none"))
    columns = ["x", "with nulls", "none"]
    merged = {r["column"]: r for r in with_deviation(merge_moments(column_moments(df, columns, ["part"]).drop("part"))).collect()}
    want = {r["column"]: r for r in with_deviation(column_moments(df, columns)).collect()}
    for c in columns:
        assert merged[c]["n"] == want[c]["n"] and merged[c]["min"] == want[c]["min"] and merged[c]["max"] == want[c]["max"]
        for k in ("mean", "std_pop"):
            assert (merged[c][k] is None) == (want[c][k] is None)
            assert merged[c][k] is None or math.isclose(merged[c][k], want[c][k], rel_tol=1e-7)
    assert merged["none"]["n"] == 0 and merged["x"]["std_pop"] == pytest.approx(2.0, abs=0.01)


def test_state_knows_its_files(spark, rows, tmpdir_path):
    df = rows.withColumn("v", F.col("id").cast("double"))
    state = ScalerState(spark, f"{tmpdir_path}/m")
    assert state.files() is None
    state.add(df.where("file_key = 'f0'"), ["v"], F.col("split") == "train")
    with pytest.raises(KeyInStore):
        state.add(df, ["v"])
    again = ScalerState(spark, f"{tmpdir_path}/m")
    assert again.add(df, ["v"], F.col("split") == "train", existing="skip") == 3
    assert sorted(r[0] for r in again.files().collect()) == ["f0", "f1", "f2", "f3"]
    st = again.scaler()
    want = scale.fit_scaler(df, ["v"], F.col("split") == "train").first()
    assert st["mean_v"] == pytest.approx(want["mean_v"]) and st["std_v"] == pytest.approx(want["std_v"])
    assert st["min_v"] == 0 and st["max_v"] == 99
    assert as_scaler(column_moments(df, ["v"]))["mean_v"] == pytest.approx(49.5)


@pytest.fixture()
def index(spark, tmpdir_path):
    """1,000 rows in files of several blocks, in an order that is not that of the values."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    df = spark.range(1000).select(((F.col("id") * 377) % 1000).alias("v"), "id", F.md5(F.col("id").cast("string")).alias("t"))
    df = df.repartitionByRange(4, "id").sortWithinPartitions("id")
    df.write.option("parquet.block.size", 2048).option("parquet.page.size", 512).option("parquet.page.size.row.check.min", 10) \
        .option("parquet.block.size.row.check.min", 10).parquet(f"{tmpdir_path}/d")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield file_order.FileIndex(spark, f"{tmpdir_path}/d")
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_positions(index):
    assert index.n_blocks > 4 and index.total == 1000
    got = index.positions().collect()
    assert len(got) == 1000 and all(r["pos"] == r["id"] for r in got)
    assert sorted(r["id"] for r in index.every_kth(0.3).collect()) == list(range(0, 1000, 4))


@pytest.mark.parametrize("length", [1, 7, 32, 400, 1000, 1001])
def test_sequences_like_the_ordered_ones(spark, index, length):
    got = {r["seq"]: [tuple(s) for s in r["steps"]] for r in index.sequences(length, ["id", "t"]).collect()}
    want = sequence.flow_sequences(index.positions(), ["pos"], length, ["id", "t"]).collect()
    assert got == {r["seq"]: [tuple(s) for s in r["steps"]] for r in want}


@pytest.mark.parametrize("k", [1, 3, 10, 999])
def test_folds_and_chunks_like_the_ordered_ones(index, k):
    df = index.positions()
    for got, want, name in ((index.folds(k), sequence.with_folds(df, ["pos"], k), "fold"), (index.chunks(k), sequence.with_chunks(df, ["pos"], k), "chunk")):
        assert {(r["id"], r[name]) for r in got.collect()} == {(r["id"], r[name]) for r in want.collect()}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\+- Exchange|:  +Exchange|Exchange (?:hash|range|Single|RoundRobin)\w*", plan)


def test_wide_rows_are_not_moved(index):
    parts = ["train", "val", "test"]
    manifest = file_order.scan(index.spark, index.paths).select("_file", "_row", F.when(F.col("_row") % 3 == 0, "train").otherwise("test").alias("split"))
    for df in (index.positions(), index.every_kth(0.2), index.folds(10), file_order.fetch(index, manifest, parts)):
        assert exchanges(df) == [] and "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_bytes", [64 << 20, 100, 1])
def test_fetch_by_bitmaps(index, max_bytes):
    """Equal to a join; rows that the manifest does not name stay out, in one scan or many."""
    parts = ["train", "val", "test"]
    rows = file_order.scan(index.spark, index.paths)
    manifest = rows.where("id % 5 < 4").select("_file", "_row", F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    got = {(r["id"], r["v"], r["split"]) for r in file_order.fetch(index, manifest, parts, max_bytes=max_bytes).collect()}
    want = rows.join(manifest, ["_file", "_row"]).select("id", "v", "split").collect()
    assert got == {tuple(r) for r in want} and len(got) == 800
    assert file_order.fetch(index, manifest.limit(0), parts).count() == 0


def test_manifest_split_end_to_end(index):
    manifest = file_order.scan(index.spark, index.paths).select("_file", "_row", "id", (F.col("v") % 3).cast("string").alias("label"))
    parted = split.stratified_split(manifest, "label", ["id"], [0.6, 0.2, 0.2])
    got = file_order.fetch(index, parted, ["train", "val", "test"])
    assert {(r["id"], r["split"]) for r in got.collect()} == {(r["id"], r["split"]) for r in parted.collect()}


def test_changed_files_are_an_error(spark, index):
    spark.range(5).select("id", F.col("id").alias("v"), F.lit("t").alias("t")).write.mode("append").parquet(index.paths)
    with pytest.raises(Exception, match="not in the index"):
        index.positions().collect()


def test_staging_parses_text_once(spark, tmpdir_path, monkeypatch):
    """F1-F3: the range partitioning reads its input twice and filters are pushed below what they name: neither may reach the CSV text."""
    import os

    from pyspark.sql import functions as F

    from flowprep.plans import jobs
    lines = ["Timestamp,Dst Port,Rate,Label", "02/01/2018,80,1.5,a", "01/01/2018,81,1_0,b", "01/01/2018,Dst Port,3,a", "01/01/2018,80,Infinity,a",
             "01/01/2018,80,,b", "01/01/2018,80,nan,b"]
    os.makedirs(f"{tmpdir_path}/in")
    with open(f"{tmpdir_path}/in/d.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    plans, place = [], jobs.group_position

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return place(df, *args, **kw)

    monkeypatch.setattr(jobs, "group_position", seen)
    store = jobs.stage_ids18(spark, [f"{tmpdir_path}/in"], f"{tmpdir_path}/store", key=F.lit("d"))
    assert len(plans) == 1 and "csv" not in plans[0].lower() and "rlike" not in plans[0].lower()
    got = sorted((r["idx"], r["Dst Port"], r["Rate"], r["label"]) for r in store.read().collect())
    assert got == [(0, 81.0, 10.0, "b"), (1, 80.0, 1.5, "a")]
