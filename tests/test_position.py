"""Order-dependent helpers: position, folds, sequences, chunks, segmented scans."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowprep.operators.position import segmented_scan, with_position
from flowprep.operators.sequence import flatten_sequences, flow_sequences, with_chunks, with_folds


def test_position_matches_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    p = with_position(ev, ["ts", "event_id"], num_partitions=5)
    w = p.withColumn("rn", F.row_number().over(Window.orderBy("ts", "event_id")) - 1)
    assert w.where("rn != pos").count() == 0
    assert p.agg(F.min("pos"), F.max("pos")).first() == (0, 9999)


def test_folds_23(spark):
    df = spark.range(23)
    sizes = [r["count"] for r in with_folds(df, ["id"], 10).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_folds_fewer_rows_than_folds(spark):
    sizes = [r["count"] for r in with_folds(spark.range(4), ["id"], 10).groupBy("fold").count().collect()]
    assert sorted(sizes) == [1, 1, 1, 1]


def test_seq_tail(spark):
    df = spark.range(70).withColumn("lab", (F.col("id") % 3).cast("string"))
    seqs = flow_sequences(df, ["id"], 32, ["id", "lab"])
    assert seqs.count() == 2
    flat = flatten_sequences(seqs)
    assert flat.count() == 64
    assert flat.agg(F.max("id")).first()[0] == 63
    first = seqs.where("seq = 0").first()["steps"]
    assert [s["id"] for s in first] == list(range(32))


def test_seq_shorter_than_length(spark):
    assert flow_sequences(spark.range(5), ["id"], 32, ["id"]).count() == 0


def test_chunks(spark):
    ch = with_chunks(spark.range(20), ["id"], 3)
    sizes = [r["count"] for r in ch.groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [7, 7, 6]


def test_segmented_scan_matches_window_on_hot_group(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    g = ev.withColumn("grp", F.when(F.col("value") < 60, F.lit(0)).otherwise(F.col("user_id")))
    pos = with_position(g, ["grp", "ts", "event_id"], "p", num_partitions=8, keep_partition=True)
    s = segmented_scan(pos, "grp", "p", "value", "min", "preceding", "prev_min")
    s = segmented_scan(s, "grp", "p", "value", "max", "following", "next_max")
    wp = Window.partitionBy("grp").orderBy("p")
    ref = (s.withColumn("r1", F.min("value").over(wp.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("r2", F.max("value").over(wp.rowsBetween(1, Window.unboundedFollowing))))
    assert ref.where("NOT (prev_min <=> r1) OR NOT (next_max <=> r2)").count() == 0
    # the hot group really spans several range partitions
    assert pos.where("grp = 0").select("_pid").distinct().count() > 1


def test_group_position_hot_and_null_groups(spark):
    from flowprep.operators.position import group_position
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    g = ev.withColumn("grp", F.when(F.col("value") < 50, F.lit(None).cast("long"))
                      .when(F.col("value") < 90, F.lit(0)).otherwise(F.col("user_id")))
    gp = group_position(g, "grp", ["ts", "event_id"], "gpos")
    assert gp.count() == ev.count()
    w = Window.partitionBy("grp").orderBy("ts", "event_id")
    ref = gp.withColumn("rn", F.row_number().over(w))
    assert ref.where("rn != gpos").count() == 0


def test_sequences_by_group_match_per_group(spark):
    from flowprep.operators.sequence import flow_sequences_by
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 70, "a").otherwise("b"))
    by = flow_sequences_by(df, "g", ["id"], 8, ["id"])
    got = {(r["g"], r["seq"]): [s["id"] for s in r["steps"]] for r in by.collect()}
    assert len([k for k in got if k[0] == "a"]) == 8 and len([k for k in got if k[0] == "b"]) == 3
    assert got[("a", 0)] == list(range(8)) and got[("b", 2)] == list(range(86, 94))


def test_sequences_by_null_group_kept(spark):
    from flowprep.operators.sequence import flow_sequences_by
    df = spark.range(20).withColumn("g", F.when(F.col("id") < 10, F.lit(None).cast("string")).otherwise("x"))
    by = flow_sequences_by(df, "g", ["id"], 5, ["id"])
    assert by.where("g IS NULL").count() == 2 and by.where("g = 'x'").count() == 2
