"""Encoding, scaling, statistics and histories (ENC, SCL, AGG-12/13/16/19/21, WIN-5..7)."""

import pytest
from pyspark.sql import functions as F

from flowprep.operators import encode, history, scale, stats
from flowprep.operators.position import with_position


def test_scale_const(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double")
    st = scale.fit_scaler(df, ["x", "k"])
    std = [tuple(r) for r in scale.apply_scaler(df, st, ["x", "k"], "standard").collect()]
    assert [r[0] for r in std] == pytest.approx([-1.0690450, -0.2672612, 1.3363062], abs=1e-7)
    assert [r[1] for r in std] == [0.0, 0.0, 0.0]
    mm = [tuple(r) for r in scale.apply_scaler(df, st, ["x", "k"], "min_max").collect()]
    assert [r[0] for r in mm] == pytest.approx([0.0, 1 / 3, 1.0])
    assert [r[1] for r in mm] == [0.0, 0.0, 0.0]


def test_scaled_train_mean_zero_std_one(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    cols = ["l_quantity", "l_tax"]
    out = scale.fit_and_scale(li, cols, F.col("l_returnflag") == "A")
    tr = out.where("l_returnflag = 'A'").agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    assert list(tr) == pytest.approx([0.0, 0.0, 1.0, 1.0], abs=1e-9)


def test_label_codes_roundtrip_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    codes = encode.fit_label_codes(df)
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    coded = encode.encode_labels(df, codes)
    back = encode.decode_labels(coded, codes)
    assert back.where("label <> label_decoded").count() == 0
    oh = encode.onehot_labels(coded, codes).where("label = 'b'").first()["onehot"]
    assert oh == [0, 1, 0]
    with pytest.raises(Exception):
        encode.encode_labels(spark.createDataFrame([("zz",)], "label string"), codes).collect()
    assert encode.fit_label_codes(df, start=1).agg(F.min("code")).first()[0] == 1


def test_dummies_missing_all_zero(spark):
    tr = spark.createDataFrame([(1, "tcp"), (2, None)], "k int, proto string")
    te = spark.createDataFrame([(3, "udp")], "k int, proto string")
    a, b = encode.one_hot_encode([tr, te], ["proto"])
    assert a.columns == ["k", "proto_tcp", "proto_udp"]
    assert [tuple(r) for r in a.orderBy("k").collect()] == [(1, 1, 0), (2, 0, 0)]
    assert [tuple(r) for r in b.collect()] == [(3, 0, 1)]


@pytest.mark.parametrize("t,p", [(0.0, 1.0), (1.0, 0.3305649), (2.100922, 0.05)])
def test_ttest_pvalue(spark, t, p):
    from flowprep.functions.exprs import student_t_two_sided_p
    got = spark.range(1).select(student_t_two_sided_p(F.lit(t), F.lit(18))).first()[0]
    assert got == pytest.approx(p, abs=2e-6)


def test_ttest_table(spark):
    folds = spark.createDataFrame([(i, 0.8 + 0.01 * (i % 3), 0.78 + 0.01 * (i % 4)) for i in range(10)],
                                  "fold int, acc1 double, acc2 double")
    r = stats.ttest_independent(folds).first()
    import statistics as st
    a = [0.8 + 0.01 * (i % 3) for i in range(10)]
    b = [0.78 + 0.01 * (i % 4) for i in range(10)]
    sp = ((9 * st.variance(a) + 9 * st.variance(b)) / 18) ** 0.5
    assert r["t"] == pytest.approx((st.mean(a) - st.mean(b)) / (sp * (0.2 ** 0.5)))
    assert r["df"] == 18 and 0 < r["p"] < 1


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r["bin"]: r["n"] for r in stats.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_fingerprint_duplicates_do_not_cancel(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    b = spark.createDataFrame([(2,), (2,)], "x int")
    assert stats.fingerprint(a).first()["fp"] != stats.fingerprint(b).first()["fp"]
    assert stats.fingerprint(a).first()["fp"] != stats.fingerprint(a.limit(1)).first()["fp"]


def _hist(spark, run, losses):
    return spark.createDataFrame([(run, i + 1, float(v)) for i, v in enumerate(losses)], "run string, ts int, val_loss double")


def test_early_stop_best_plus_patience(spark):
    # best at epoch 4, no later improvement; patience 3 -> stop at 7 (of 10)
    a = _hist(spark, "a", [5, 4, 3, 1, 2, 2, 2, 2, 2, 2])
    # keeps improving: never stops
    b = _hist(spark, "b", [9, 8, 7, 6, 5])
    # improvement within patience restarts the wait: best at 4, stop at 4 + 3
    c = _hist(spark, "c", [5, 4, 4.5, 3.9, 4.1, 4, 4, 4, 4])
    h = history.number_epochs(a.unionByName(b).unionByName(c), "run", ["ts"], keep_partition=True)
    got = {r["run"]: (r["n_epochs"], r["stop_epoch"]) for r in history.early_stop_epoch(h, "run", 3).collect()}
    assert got == {"a": (10, 7), "b": (5, None), "c": (9, 7)}
    best = {r["run"]: r["best_epoch"] for r in history.best_epoch(h.drop("_pid", "_gpos"), "run").collect()}
    assert best == {"a": 4, "b": 5, "c": 4}
    goal = {r["run"]: r["goal_epoch"] for r in history.goal_epoch(h, "run", "val_loss", 5.0).collect()}
    assert goal == {"a": 1, "b": 1, "c": 1}
    none = {r["run"]: r["stop_epoch"] for r in history.early_stop_epoch(h, "run", 0).collect()}
    assert set(none.values()) == {None}


def test_best_epoch_first_of_ties(spark):
    h = history.number_epochs(_hist(spark, "r", [3, 1, 2, 1]), "run", ["ts"])
    assert history.best_epoch(h, "run").first()["best_epoch"] == 2


def test_position_helper_with_expression_order(spark):
    df = spark.range(10).withColumn("k", (F.col("id") * 7) % 10)
    p = with_position(df, [F.col("k")], "pos")
    assert [r["k"] for r in p.orderBy("pos").collect()] == list(range(10))


def test_dotted_dummy_names_scale_and_pack(spark):
    from flowprep.plans.jobs import pack_features
    df = spark.createDataFrame([(1, "1.5", 2.0), (2, "2", 4.0), (3, "1.5", 6.0)], "row_id int, cat string, x double")
    (enc,) = encode.one_hot_encode([df], ["cat"])
    assert enc.columns == ["row_id", "x", "cat_1.5", "cat_2"]
    scaled = scale.fit_and_scale(enc, ["x", "cat_1.5", "cat_2"], F.lit(True))
    packed = pack_features(scaled, ["x", "cat_1.5", "cat_2"])
    assert packed.count() == 3 and len(packed.first()["features"]) == 3
