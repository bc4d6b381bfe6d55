"""Networks fitted in tasks: gradients, fits, early stop, restart, saving, odd rows."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowprep.operators import history, models, neural


def _numeric(layers, flat, x, target, weight):
    value = lambda p: float((layers.losses(layers.forward(p, x)[-1], target) * weight).sum() / weight.sum())
    out = np.zeros_like(flat)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        out[i] = (value(flat + step) - value(flat - step)) / 2e-6
    return out


@pytest.mark.parametrize("acts", [["relu", "softmax"], ["tanh", "sigmoid", "softmax"], ["tanh", "linear"], ["relu", "linear", "sigmoid"]])
def test_gradient_is_the_slope_of_the_loss(acts):
    rng = np.random.default_rng(3)
    layers = neural.Layers([4, 5, 3, 4][: len(acts)] + [4], acts)
    x, weight = rng.normal(size=(7, 4)), rng.uniform(0.5, 2, 7)
    target = rng.integers(0, 4, 7) if acts[-1] == "softmax" else x
    flat = layers.start(1) + rng.normal(scale=0.1, size=len(layers.start(1)))
    loss, grad = layers.gradient(flat, x, target, weight, None)
    assert np.allclose(grad, _numeric(layers, flat, x, target, weight), atol=1e-6)
    assert np.isclose(loss, (layers.losses(layers.forward(flat, x)[-1], target) * weight).sum())


def test_masked_units_pass_no_gradient():
    layers = neural.Layers([3, 6, 2], ["relu", "softmax"], dropout=0.5)
    x, target = np.abs(np.random.default_rng(1).normal(size=(1, 3))), np.array([1])
    flat = layers.start(2)
    hidden = layers.forward(flat, x, np.random.default_rng(9))[1]
    _, grad = layers.gradient(flat, x, target, np.ones(1), np.random.default_rng(9))
    assert (layers.parts(grad)[0][1][hidden[0] == 0] == 0).all()


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no straight line parts; every fifth row is a validation row."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (1200, 2))
    y = ((x**2).sum(axis=1) > 0.6).astype(float)
    rows = [(i, [float(a) for a in r], float(c), i % 5 == 0) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, features array<double>, label_idx double, is_val boolean").repartition(4, "id")
    return models.with_vector(df)


def test_classifier_learns_and_survives_saving(spark, rings, tmpdir_path):
    net = models.create_model("relu_ann", hidden=[16], epochs=30, batch_size=16, rate=0.01)
    model = net.fit(rings)
    assert len(model.history) == 30 and model.history[-1]["val_loss"] < 0.5 * model.history[0]["val_loss"]
    path = os.path.join(tmpdir_path, "net")
    model.write().overwrite().save(path)
    again = models.load_model(path)
    out = model.transform(rings).join(again.transform(rings).select("id", F.col("pred_idx").alias("p2")), "id")
    n, right, same = out.agg(F.count("*"), F.sum((F.col("pred_idx") == F.col("label_idx")).cast("int")),
                             F.sum((F.col("pred_idx") == F.col("p2")).cast("int"))).first()
    assert n == 1200 and same == 1200 and right > 0.95 * n


def test_early_stop_follows_the_rule_and_keeps_the_best(spark, rings):
    model = models.create_model("relu_ann", hidden=[8], epochs=40, batch_size=8, rate=0.3, patience=2).fit(rings)
    val = [h["val_loss"] for h in model.history]
    hist = history.history_frame(spark, "r", [h["train_loss"] for h in model.history], val)
    numbered = history.number_epochs(hist.drop("epoch").withColumn("at", F.monotonically_increasing_id()), "run", ["at"], keep_partition=True)
    stop = history.early_stop_epoch(numbered, "run", 2).first()["stop_epoch"]
    assert stop == len(val) < 40
    table = neural._table(rings, None, "label_idx")
    layers, flat = model.nets[0]
    held = table.where("val").toPandas()
    out = layers.forward(flat, np.stack(held["x"]))[-1]
    assert np.isclose(layers.losses(out, held["y"].to_numpy()).mean(), min(val))


def test_fit_goes_on_after_its_last_epoch(spark, rings, tmpdir_path):
    table = neural._table(rings, None, "label_idx")
    layers = neural.Layers([2, 6, 2], ["relu", "softmax"])
    whole, told = neural.fit_layers(table, layers, epochs=5, batch_size=64)
    path = os.path.join(tmpdir_path, "epochs")
    neural.fit_layers(table, layers, epochs=2, batch_size=64, path=path)
    rest, again = neural.fit_layers(table, layers, epochs=5, batch_size=64, path=path)
    assert np.allclose(whole, rest) and [h["epoch"] for h in again] == [1, 2, 3, 4, 5]
    assert np.allclose([h["val_loss"] for h in told], [h["val_loss"] for h in again])


def test_sums_are_the_same_in_one_group_and_in_a_tree(spark, rings, monkeypatch):
    table = neural._table(rings.repartition(9, "id"), None, "label_idx")
    layers = neural.Layers([2, 4, 2], ["relu", "softmax"])
    flat, _ = neural.fit_layers(table, layers, epochs=2)
    monkeypatch.setattr(neural, "FAN", 2)
    tree, _ = neural.fit_layers(table, layers, epochs=2)
    assert np.allclose(flat, tree)


def test_autoencoder_and_pretraining(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(-1, 1, 1500)
    x = np.stack([t, t**2, np.sin(3 * t), np.abs(t)], axis=1)  # a curve: one number tells the row
    rows = [(i, [float(a) for a in r], float(t[i] > 0), "unsup" if i % 2 else "sup", i % 10 == 0) for i, r in enumerate(x)]
    df = models.with_vector(spark.createDataFrame(rows, "id long, features array<double>, label_idx double, role string, is_val boolean"))
    df = df.repartition(4, "id")
    ae = models.create_model("ae", encoder=[16, 1], decoder=[16], epochs=40, batch_size=16, rate=0.01).fit(df.drop("role"))
    gap = F.aggregate(F.zip_with("features", "recon", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    error = ae.transform(df).agg(F.avg(gap)).first()[0]
    centre, pca = models.fit_pca(df, 1)
    linear = models.pca_reconstruct(df.drop("fvec"), centre, pca).agg(F.avg(gap)).first()[0]
    assert error < 0.5 * linear
    both = models.create_model("relu_ae_ann", encoder=[16, 1], decoder=[16], hidden=[8], ae_epochs=30, epochs=30, batch_size=16, rate=0.01)
    scored = both.fit(df).transform(df)
    assert scored.where("pred_idx = label_idx").count() > 0.9 * 1500


def test_odd_rows(spark):
    schema = "features array<double>, label_idx double"
    net = neural.NetworkClassifier([4], epochs=1)
    with pytest.raises(ValueError, match="no rows"):
        net.fit(models.with_vector(spark.createDataFrame([], schema)))
    rows = spark.createDataFrame([([1.0, 2.0], 0.0), (None, 1.0), ([2.0, 1.0], 1.0), ([2.0, 1.0], 1.0)], schema)
    df = rows.withColumn("fvec", F.when(F.col("features").isNotNull(), array_to_vector("features")))
    model = net.fit(df)
    out = model.transform(df).collect()
    assert [r["pred_idx"] is None for r in out] == [False, True, False, False] and out[1]["prob"] is None
    uneven = models.with_vector(spark.createDataFrame([([1.0, 2.0], 0.0), ([1.0], 1.0)], schema))
    with pytest.raises(Exception, match="2 numbers"):
        net.fit(uneven)
    with pytest.raises(ValueError, match="unknown activations"):
        neural.Layers([2, 2], ["step"])


def test_large_tables_are_dealt_evenly(spark, monkeypatch):
    """an epoch is as long as its longest task; rows that lie in one file go to files of like size."""
    monkeypatch.setattr(neural, "ROWS_EACH", 50, raising=False)
    uneven = spark.range(380).coalesce(1).union(spark.range(380, 400).coalesce(1))
    df = models.with_vector(uneven.select("id", F.array(F.col("id").cast("double")).alias("features")))
    table = neural._table(df, None, None)
    files = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert len(files) == 8 and max(files) <= 60
    assert sorted(r["x"][0] for r in table.collect()) == list(range(400))


def test_fits_read_partitions_of_bounded_size(spark, monkeypatch):
    """a large partition is dealt over several, and only the columns of the fit are kept."""
    monkeypatch.setattr(models, "ROWS_EACH", 50, raising=False)
    df = spark.range(400).coalesce(1).select("id", F.array(F.col("id").cast("double")).alias("features"), (F.col("id") > 200).cast("double").alias("label_idx"))
    seen = []

    class Forest(type(models.random_forest())):
        def _fit(self, dataset):
            seen.append((dataset.columns, [r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()]))
            return super()._fit(dataset)

    forest = Forest(numTrees=2, seed=1, featuresCol="fvec", labelCol="label_idx", predictionCol="pred_idx")
    model, _ = models.train(forest, models.with_vector(df))
    columns, sizes = seen[0]
    assert sorted(columns) == ["fvec", "label_idx"] and len(sizes) == 8 and max(sizes) <= 60 and sum(sizes) == 400
    assert model.transform(models.with_vector(df)).where("pred_idx = label_idx").count() > 380
