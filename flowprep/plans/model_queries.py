"""Model-backed registered queries (ML-1..10).

The targets are rules over the driver columns that a model can learn, so that a
broken model is seen: a query returns what SQL can state (parts, labels, support)
and whether the model reached a stated accuracy on what it was fitted on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encode, history, metrics, models, scale, split
from ..session import cut_lineage
from .driver_queries import LINE_KEYS, SCALE_COLS, SEED, table

ACCURACY_FLOOR = 0.8


def _embeddings(spark, sf) -> DataFrame:
    """Target: the sign of the first component."""
    em = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("embedding")[0] > 0, "pos").otherwise("neg").alias("label"))
    return split.stratified_split(em, "label", "vec_id", [0.6, 0.2, 0.2], seed=SEED)


def _lineitem(spark, sf) -> DataFrame:
    """Target: three bands of the quantity."""
    band = F.when(F.col("l_quantity") < 15, "low").when(F.col("l_quantity") < 35, "mid").otherwise("high")
    li = table(spark, sf, "lineitem").select(*LINE_KEYS, *SCALE_COLS, band.alias("label"))
    li = models.assemble(li, SCALE_COLS).drop(*SCALE_COLS)
    keyed = li.withColumn("_key", F.concat_ws("-", *[F.col(k).cast("string") for k in LINE_KEYS]))
    return split.stratified_split(keyed, "label", "_key", [0.8, 0.2], ("train", "test"), seed=SEED)


def _report(tables: dict, floor: float | None = ACCURACY_FLOOR) -> DataFrame:
    """(split, granularity, label, support, counts_add_up, fits): ``fits``: train accuracy of at least ``floor``."""
    acc = tables["average_metrics"].where("split = 'train' and avg_type = 'micro'").first()["acc"]
    whole = tables["class_metrics"].where(F.col("support") > 0)
    add_up = F.col("tp") + F.col("fn") == F.col("support")
    return whole.select("split", "granularity", "label", "support", add_up.alias("counts_add_up"),
                        F.lit(floor is None or acc >= floor).alias("fits"))


def q_forest_eval(spark, sf):
    """ML-1/2/7/8: forest of 100 trees on embeddings, report per split."""
    data = cut_lineage(_embeddings(spark, sf))
    codes = encode.fit_label_codes(data)
    prepared = models.prepare_labelled(data, codes)
    model, _ = models.train(models.random_forest(num_trees=100, max_depth=8, feature_subset="onethird"),
                            prepared.where(F.col("split") == "train"))
    return _report(models.test_classifier(model, prepared, codes))


def q_mlp_eval(spark, sf):
    """ML-3: multilayer perceptron on embeddings; the input is as wide as the data."""
    data = cut_lineage(_embeddings(spark, sf))
    codes = encode.fit_label_codes(data)
    prepared = models.prepare_labelled(data, codes)
    k = codes.count()  # number of classes: the output layer width (one small action)
    width = data.select(F.size("features").alias("d")).first()["d"]
    model, _ = models.train(models.mlp(width, [32], k, max_iter=100), prepared.where(F.col("split") == "train"))
    return _report(models.test_classifier(model, prepared, codes))


def q_pca_reconstruct(spark, sf):
    """ML-4 + AGG-11: centred PCA fitted on train; the error of every row is what the code leaves of its length."""
    data = cut_lineage(_embeddings(spark, sf))
    centre, pca = models.fit_pca(data.where(F.col("split") == "train"), 8)
    rec = models.pca_reconstruct(data, centre, pca)
    err = metrics.reconstruction_error(rec, "features", "recon")
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)
    left = square(models.vector_to_array("cvec")) - square("encoded")
    return err.select("vec_id", "split", (F.abs(F.col("sq_error_sum") - left) < 1e-6).alias("error_is_rest"),
                      (F.size("encoded") == 8).alias("code_width_ok"))


def q_encode_classify(spark, sf):
    """ML-5 + SPL-4: PCA on the unlabelled quarter of train, classifier on the labelled rest."""
    data = cut_lineage(_embeddings(spark, sf))
    train = data.where(F.col("split") == "train").drop("split")
    roles = cut_lineage(split.two_part_roles(train, "label", "vec_id", 0.25, seed=SEED))
    centre, pca = models.fit_pca(roles.where(F.col("role") == "unsup"), 8)
    codes = encode.fit_label_codes(data)
    encoded = pca.transform(centre.transform(models.with_vector(data))) \
        .withColumn("features", models.vector_to_array("code_vec")).drop("fvec", "cvec", "code_vec")
    prepared = models.prepare_labelled(encoded, codes)
    sup_ids = roles.where(F.col("role") == "sup").select("vec_id")
    model, _ = models.train(models.logistic(50), prepared.join(sup_ids, "vec_id", "left_semi"))
    return _report(models.test_classifier(model, prepared, codes), floor=None)


def q_score_rows(spark, sf):
    """ML-2/10: forest trained on 80 % of lineitem, every row scored; ``right`` where the bands are wide apart."""
    # the split / encoded table feeds the label dictionary, the fit and the scoring:
    # materialise it once in the reliable checkpoint folder
    data = cut_lineage(_lineitem(spark, sf))
    codes = encode.fit_label_codes(data)
    prepared = models.prepare_labelled(data, codes)
    model, _ = models.train(models.random_forest(num_trees=10, max_depth=6), prepared.where(F.col("split") == "train"))
    scored = models.score(model, prepared, codes, keep=[*LINE_KEYS, "split", "label", "features"])
    # at least five units from a border of the bands, every tree has seen enough rows to be right
    quantity = F.col("features")[0]
    clear = (F.abs(quantity - 15) > 5) & (F.abs(quantity - 35) > 5)
    return scored.select(*LINE_KEYS, "split", "label", (~clear | (F.col("y_pred") == F.col("label"))).alias("right"))


def q_model_ttest(spark, sf):
    """ML-9: two forests (different size and seed) scored on the test split, 10 contiguous folds
    in vec_id order, accuracy per fold and the two-sample t-test attached."""
    data = cut_lineage(_embeddings(spark, sf))
    codes = encode.fit_label_codes(data)
    prepared = models.prepare_labelled(data, codes)
    train = prepared.where(F.col("split") == "train")
    m1, _ = models.train(models.random_forest(num_trees=10, max_depth=6, seed=1), train)
    m2, _ = models.train(models.random_forest(num_trees=30, max_depth=8, seed=2), train)
    test = prepared.where(F.col("split") == "test")
    s1 = models.score(m1, test, codes, keep=["vec_id", "label"]).withColumnRenamed("label", "y_true")
    s2 = models.score(m2, test, codes, keep=["vec_id"])
    folds, tt = models.statistical_test(s1, s2, ["vec_id"], "vec_id")
    shares = F.col("acc1").between(0, 1) & F.col("acc2").between(0, 1)
    return folds.crossJoin(tt).select("fold", "df", shares.alias("shares_ok"),  # one row of t, df, p
                                      (F.col("p").between(0, 1) | F.col("t").isNull()).alias("p_ok"))


def _held_out(scored: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(split, label, support, learnt): whether the share of right rows of a split reaches its floor."""
    right = cut_lineage(scored.select("split", "label", (F.col("y_pred") == F.col("label")).alias("right")))
    share = right.groupBy("split").agg(F.avg(F.col("right").cast("double")).alias("share"))
    floor = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])
    out = right.groupBy("split", "label").agg(F.count(F.lit(1)).alias("support")).join(share, "split")
    return out.select("split", "label", "support", (F.col("share") >= floor[F.col("split")]).alias("learnt"))


def q_relu_eval(spark, sf):
    """ML-3/6/7 + WIN-6: ReLU network on standardised lineitem; every tenth order is a validation order.

    The middle band lies between the others, so it takes a hidden layer.  ``learnt``: train and held-out accuracy of at
    least 0.9; ``stopped_by_rule``: the fit ended where the early-stop operator says, or with its last epoch.
    """
    parted = _lineitem(spark, sf)
    columns = parted.select("l_orderkey", "split", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(SCALE_COLS)])
    data = cut_lineage(columns)
    scaled = models.assemble(scale.fit_and_scale(data, SCALE_COLS, F.col("split") == "train"), SCALE_COLS).drop(*SCALE_COLS)
    codes = encode.fit_label_codes(data)
    prepared = models.prepare_labelled(scaled, codes).withColumn("is_val", F.col("l_orderkey") % 10 == 0)
    epochs, patience = 15, 3
    net = models.create_model("relu_ann", hidden=[16], epochs=epochs, patience=patience, batch_size=128, rate=0.02)
    model, _ = models.train(net, prepared.where(F.col("split") == "train"))
    hist = history.history_frame(spark, "relu", [h["train_loss"] for h in model.history], [h["val_loss"] for h in model.history])
    numbered = history.number_epochs(hist.withColumnRenamed("epoch", "at"), "run", ["at"], keep_partition=True)
    end = history.early_stop_epoch(numbered, "run", patience).first()
    by_rule = end["stop_epoch"] == end["n_epochs"] or (end["stop_epoch"] is None and end["n_epochs"] == epochs)
    out = _held_out(models.score(model, prepared, codes, keep=["split", "label"]), {"train": 0.9, "test": 0.9})
    return out.withColumn("stopped_by_rule", F.lit(by_rule))


def _waves(spark, sf) -> DataFrame:
    """Six functions of an order's price within its thousand, two of its key: few numbers tell the row, no straight line does."""
    t = (F.col("o_totalprice") % 1000) / 500 - 1
    u = (F.col("o_orderkey") % 97) / 48 - 1
    waves = F.array(t, t * t, F.sin(3 * t), F.abs(t), F.cos(4 * t), t * t * t, u, u * u)
    rows = table(spark, sf, "orders").select("o_orderkey", waves.alias("features"), F.when(t * t > 0.3, "far").otherwise("near").alias("label"))
    return split.stratified_split(rows, "label", "o_orderkey", [0.6, 0.2, 0.2], seed=SEED)


def q_autoencoder_error(spark, sf):
    """ML-4/6 + AGG-11: autoencoder with a code of two against PCA of two, both fitted on train; ``below_pca``: at most half its error."""
    data = cut_lineage(_waves(spark, sf))
    train = data.where(F.col("split") == "train")
    net = models.create_model("ae", encoder=[24, 2], decoder=[24], epochs=25, batch_size=48, rate=0.02)
    model, _ = models.train(net, models.with_vector(train))
    error = metrics.reconstruction_error(model.transform(models.with_vector(data)), "features", "recon")
    ours = error.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("sq_error_sum").alias("ours"))
    linear = metrics.reconstruction_error(models.pca_reconstruct(data, *models.fit_pca(train, 2)), "features", "recon")
    theirs = linear.groupBy("split").agg(F.avg("sq_error_sum").alias("pca"))
    return ours.join(theirs, "split").select("split", "n", (F.col("ours") <= F.col("pca") / 2).alias("below_pca"))


def q_pretrain_classify(spark, sf):
    """ML-5/6 + SPL-4: autoencoder on the unlabelled half of train, network on the codes of the labelled half; validation rows stop both."""
    data = cut_lineage(_waves(spark, sf))
    codes = encode.fit_label_codes(data)
    train = data.where(F.col("split") == "train").drop("split")
    roles = split.two_part_roles(train, "label", "o_orderkey", 0.5, seed=SEED).withColumn("is_val", F.lit(False))
    val = data.where(F.col("split") == "val").drop("split").withColumn("role", F.lit("sup")).withColumn("is_val", F.lit(True))
    net = models.create_model("relu_ae_ann", encoder=[24, 2], decoder=[24], hidden=[16], ae_epochs=15, epochs=20, patience=5,
                              batch_size=32, rate=0.02)
    model, _ = models.train(net, models.prepare_labelled(roles.unionByName(val), codes))
    scored = models.score(model, models.prepare_labelled(data, codes), codes, keep=["split", "label"])
    return _held_out(scored, {"train": 0.9, "val": 0.9, "test": 0.9})


QUERIES = {
    "relu_eval": q_relu_eval,
    "autoencoder_error": q_autoencoder_error,
    "pretrain_classify": q_pretrain_classify,
    "model_ttest": q_model_ttest,
    "forest_eval": q_forest_eval,
    "mlp_eval": q_mlp_eval,
    "pca_reconstruct": q_pca_reconstruct,
    "encode_classify": q_encode_classify,
    "score_rows": q_score_rows,
}
