"""Cleaning, filters and label tables (FLT, CLN, CHK, AGG-1/2/18, FN-4/6/8)."""

import pytest
from pyspark.sql import functions as F

from flowprep.functions.exprs import argmax, is_number_text, parse_number, split_list
from flowprep.operators import clean, labels

NUMBERS = ["inf", "-inf", "Infinity", "NaN", "nan", "1_000", " 12 ", "abc", "1e3", "1.0d", "0x1p3", None]


def test_numbers_text(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x string")
    kept = {r["x"] for r in clean.keep_numeric_text(df, ["x"]).collect()}
    assert kept == {"inf", "-inf", "Infinity", "NaN", "nan", "1_000", " 12 ", "1e3", None}
    parsed = clean.keep_numeric_text(df, ["x"]).withColumn("v", parse_number("x"))
    after = clean.drop_invalid_rows(parsed.select("i", "v"), ["v"])
    assert sorted(r["v"] for r in after.collect()) == [12.0, 1000.0, 1000.0]


def test_invalid_rows_and_report(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, float("nan")), (4, None), (5, -float("inf"))],
                               "k int, x double")
    out = clean.drop_invalid_rows(df)
    assert [r["k"] for r in out.collect()] == [1]
    rep = clean.quality_report([("input", df), ("drop_invalid", out)]).collect()
    assert [(r["stage"], r["rows_before"], r["rows_after"], r["removed"]) for r in rep] == [("drop_invalid", 5, 1, 4)]


def test_drop_classes_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "lab string")
    assert clean.drop_classes(df, "lab", ["a"]).count() == 2


def test_unseen_classes(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "lab string")
    te = spark.createDataFrame([("a",), ("c",), (None,)], "lab string")
    assert [r["lab"] for r in clean.drop_unseen_classes(tr, te, "lab").collect()] == ["a"]


def test_label_text_cleaning(spark):
    df = spark.createDataFrame([("Web Attack – XSS",), ("a  b",), (None,)], "lab string")
    out = [r[0] for r in df.select(clean.clean_label_text("lab")).collect()]
    assert out == ["Web Attack XSS", "a b", None]


def test_strict_cast_fails_on_bad_text(spark):
    df = spark.createDataFrame([("1.5",), ("bad",)], "x string")
    with pytest.raises(Exception):
        clean.cast_columns_strict(df, ["x"]).collect()


def test_label_counts_null_class(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "lab string")
    got = {r["label"]: (r["n"], r["frac"]) for r in labels.label_counts(df, "lab").collect()}
    assert got == {"a": (2, 0.5), None: (1, 0.25), "b": (1, 0.25)}


def test_family_map_with_dotted_keys(spark):
    fam = labels.add_suffixed_keys(labels.KDD_FAMILY_MAP, ".")
    assert len(labels.KDD_FAMILY_MAP) == 39 and len(fam) == 78
    df = spark.createDataFrame([("smurf.",), ("neptune",), ("normal.",), ("guess_passwd.",)], "lab string")
    out = [r["lab"] for r in labels.map_labels(df, "lab", fam).collect()]
    assert out == ["dos", "dos", "normal.", "r2l"]
    tbl = labels.mapping_table(spark, fam)
    out2 = [r["lab"] for r in labels.map_labels(df, "lab", tbl).orderBy("lab").collect()]
    assert sorted(out2) == sorted(out)


def test_binary_labels(spark):
    df = spark.createDataFrame([("normal.",), ("smurf.",), ("NORMAL",), (None,)], "lab string")
    out = [r[0] for r in df.select(labels.to_binary_labels("lab", "normal")).collect()]
    assert out == ["normal.", "attack.", "attack.", None]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "lab string")
    got = {r["label"]: r["weight"] for r in labels.class_weights(df, "lab").collect()}
    assert got == pytest.approx({"a": 4 / 6, "b": 2.0})


def test_scalar_functions(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7], "64,32,", "relu")], "p array<double>, s string, t string")
    r = df.select(argmax("p").alias("a"), split_list("s").alias("l"), split_list("t").alias("m")).first()
    assert r["a"] == 1 and r["l"] == ["64", "32"] and r["m"] == ["relu"]
    assert df.select(is_number_text(F.lit("1_0.5e-3"))).first()[0] is True


def test_filter_report_one_scan_matches_stagewise(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("inf"), "b"), (3, 2.0, "A"), (4, None, "c"), (5, 3.0, None)],
                               "k int, x double, f string")
    rep = clean.filter_report(df, [("drop_invalid", clean.valid_row(["x"])),
                                   ("drop_rare", F.col("f").isNull() | ~F.col("f").isin("A"))]).collect()
    assert [tuple(r) for r in rep] == [("drop_invalid", 5, 3, 2), ("drop_rare", 3, 2, 1)]
    valid = clean.drop_invalid_rows(df, ["x"])
    staged = clean.quality_report([("input", df), ("drop_invalid", valid),
                                   ("drop_rare", clean.drop_classes(valid, "f", ["A"]))]).collect()
    assert [tuple(r) for r in staged] == [tuple(r) for r in rep]


def test_all_infinity_column(spark):
    df = spark.createDataFrame([(1, float("inf"), 1.0), (2, float("-inf"), 2.0)], "k int, bad double, ok double")
    assert clean.drop_invalid_rows(df).count() == 0
    # only the listed columns decide
    assert clean.drop_invalid_rows(df, ["ok"]).count() == 2
