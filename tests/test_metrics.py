"""Evaluation identities and edge cases (FIXTURES §4)."""

import pytest
from pyspark.sql import functions as F

from flowprep.operators import metrics


def _scored(spark):
    rows = ([("normal", "normal")] * 50 + [("normal", "dos")] * 5 + [("dos", "dos")] * 30 + [("dos", "probe")] * 4
            + [("probe", "probe")] * 8 + [("probe", "normal")] * 3 + [("u2r", "normal")] * 2 + [("r2l", "r2l")] * 1)
    return spark.createDataFrame(rows, "y_true string, y_pred string").withColumn("split", F.lit("test"))


def test_identities(spark):
    t = metrics.evaluate(_scored(spark), normal="normal")
    am = {(r["granularity"], r["avg_type"]): r for r in t["average_metrics"].collect()}
    micro, weighted, macro = am[("multi", "micro")], am[("multi", "weighted")], am[("multi", "macro")]
    n, correct = 103, 50 + 30 + 8 + 1
    acc = correct / n
    assert micro["acc"] == pytest.approx(acc)
    assert micro["ppv"] == pytest.approx(acc) and micro["tpr"] == pytest.approx(acc)
    assert weighted["tpr"] == pytest.approx(acc)
    assert macro["fnr"] == pytest.approx(1 - macro["tpr"])
    k = 5
    assert micro["fpr"] == pytest.approx((1 - acc) / (k - 1))
    cm = t["class_metrics"].where("granularity = 'multi'")
    assert cm.agg(F.sum("support")).first()[0] == n
    u2r = cm.where("label = 'u2r'").first()
    assert (u2r["ppv"], u2r["tpr"], u2r["f1"]) == (0.0, 0.0, 0.0)
    binary = t["confusion"].where("granularity = 'binary'")
    assert binary.agg(F.sum("n")).first()[0] == n
    assert {r["y_true"] for r in binary.collect()} == {"normal", "attack"}


def test_label_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "zz")], "y_true string, y_pred string")
    cm = {r["label"]: r for r in metrics.class_metrics(metrics.confusion(df)).collect()}
    assert cm["zz"]["support"] == 0 and cm["zz"]["ppv"] == 0.0 and cm["zz"]["fp"] == 1


def test_binary_two_normals_fails(spark):
    df = spark.createDataFrame([("normal", "abnormal"), ("abnormal", "normal")], "y_true string, y_pred string")
    conf = metrics.confusion(df)
    with pytest.raises(Exception):
        metrics.binary_confusion(conf, "normal").collect()


def test_accuracy_report_and_multilabel(spark):
    t = metrics.class_metrics(metrics.confusion(_scored(spark), by=["split"]), ["split"])
    rep = {r["label"]: r for r in metrics.accuracy_report(t, ["split"]).collect()}
    assert rep["accuracy"]["precision"] == pytest.approx(89 / 103)
    ml = spark.createDataFrame([([1, 0], [0.9, 0.2]), ([0, 1], [0.6, 0.4]), ([1, 0], [0.1, 0.1])],
                               "y array<int>, p array<double>")
    f1 = metrics.multilabel_f1(ml, "y", "p").first()[0]
    # class 0: tp 1, fp 1, fn 1 -> f1 0.5, support 2; class 1: tp 0, fn 1 -> 0, support 1
    assert f1 == pytest.approx(0.5 * 2 / 3)
    assert metrics.exact_match(ml, "y", "p").first()[0] == pytest.approx(1 / 3)


def test_reconstruction(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    e = metrics.reconstruction_error(df, "a", "b")
    assert [r["sq_error_sum"] for r in e.collect()] == [4.0, 25.0]
    s = metrics.reconstruction_summary(e).first()
    assert s["mse"] == 14.5 and s["rmse"] == pytest.approx(14.5 ** 0.5)
