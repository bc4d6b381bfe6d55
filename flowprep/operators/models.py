"""Models re-aimed at Spark ML (ML-1..10).

Features travel as one ``array<double>`` column and become an ML vector with
``array_to_vector`` (JVM side).  Labels are coded with the sorted-label table
of ``encode.fit_label_codes`` (a DataFrame; no driver round trip) and decoded
back by a join after scoring.

Divergences from the reference's trainers (documented, not hidden):
* the forest is single-output multi-class, not a multi-output forest on one-hot y;
* ``ann`` is Spark's multilayer perceptron (sigmoid hidden units, L-BFGS) and ``ae_ann`` codes
  by centred PCA; ``relu_ann``, ``ae`` and ``relu_ae_ann`` (``neural``) are networks with ReLU,
  dropout, Adam and early stop, without batch-norm.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.wrapper import JavaEstimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encode_labels, fit_label_codes
from .metrics import evaluate
from .neural import Autoencoder, NetworkClassifier, NetworkModel, PretrainedClassifier


def with_vector(df: DataFrame, features: str = "features", out: str = "fvec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric columns into one ``array<double>`` feature column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


#: The largest depth that Spark's trees can have: as near as they come to unlimited.
MAX_DEPTH = 30


def random_forest(num_trees: int = 100, min_instances: int = 1, max_depth: int = MAX_DEPTH, seed: int | None = 42,
                  weight_col: str | None = None, max_bins: int = 32,
                  max_memory_mb: int = 256, feature_subset: str = "auto") -> RandomForestClassifier:
    """ML-1: forest; trees grow to Spark's limit of depth unless ``max_depth`` says less.

    ``feature_subset`` is the share of
    features tried at a node (auto: the square root).  ``max_memory_mb`` bounds the split statistics one task holds (Spark's
    default 256 MB; more means fewer passes per level, but every concurrent
    task may use that much heap).  Node ids are kept per row instead of re-walking each
    tree from the root at every level.
    """
    rf = RandomForestClassifier(numTrees=num_trees, minInstancesPerNode=min_instances, maxDepth=max_depth,
                                featuresCol="fvec", labelCol="label_idx", predictionCol="pred_idx",
                                probabilityCol="prob", rawPredictionCol="raw", maxBins=max_bins,
                                featureSubsetStrategy=feature_subset, cacheNodeIds=True, maxMemoryInMB=max_memory_mb)
    if seed is not None:
        rf = rf.setSeed(seed)
    if weight_col:
        rf = rf.setWeightCol(weight_col)
    return rf


def mlp(n_features: int, hidden: Sequence[int], n_classes: int, max_iter: int = 100,
        seed: int = 42) -> MultilayerPerceptronClassifier:
    """ML-3: feed-forward classifier ``[d, *hidden, k]``."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=max_iter, seed=seed,
                                          featuresCol="fvec", labelCol="label_idx", predictionCol="pred_idx",
                                          probabilityCol="prob", rawPredictionCol="raw")


def logistic(max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, featuresCol="fvec", labelCol="label_idx",
                              predictionCol="pred_idx", probabilityCol="prob", rawPredictionCol="raw")


def encode_then_classify(n_components: int = 8, classifier: str = "logistic", **params):
    """ML-5: centring, PCA and a classifier on the code, as one estimator (a Spark ML pipeline).

    ``split.two_part_roles`` gives the parts when encoder and classifier are to be fitted on different rows.
    """
    from pyspark.ml import Pipeline
    last = create_model(classifier, **params).setFeaturesCol("code_vec")
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="fvec", outputCol="cvec"),
                            PCA(k=n_components, inputCol="cvec", outputCol="code_vec"), last])


MODEL_FACTORIES: dict[str, Callable[..., object]] = {
    "rf": random_forest,
    "ann": mlp,
    "logistic": logistic,
    "ae_ann": encode_then_classify,
    "relu_ann": NetworkClassifier,
    "ae": Autoencoder,
    "relu_ae_ann": PretrainedClassifier,
}


def model_params(name: str, given: dict, n_features: int, n_classes: int) -> dict:
    """Of the given experiment parameters those that the named model takes; widths come from the data."""
    import inspect
    if name not in MODEL_FACTORIES:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODEL_FACTORIES)}")
    widths = {"n_features": n_features, "n_classes": n_classes, "hidden": given.get("units", [n_features])}
    out = {}
    for key in inspect.signature(MODEL_FACTORIES[name]).parameters:
        if key in given:
            out[key] = given[key]
        elif key in widths:
            value = widths[key]
            out[key] = [int(v) for v in (value if isinstance(value, (list, tuple)) else [value])] if key == "hidden" else value
    return out


def create_model(name: str, **params):
    """ML-6: estimator by name; an unknown name is an error."""
    if name not in MODEL_FACTORIES:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODEL_FACTORIES)}")
    return MODEL_FACTORIES[name](**params)


def load_model(path: str) -> Model:
    """SNK-7 reload: a saved forest, perceptron, logistic, pipeline or network model (whichever the folder holds)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import (LogisticRegressionModel, MultilayerPerceptronClassificationModel,
                                           RandomForestClassificationModel)
    errors = []
    for cls in (RandomForestClassificationModel, MultilayerPerceptronClassificationModel, LogisticRegressionModel,
                PipelineModel, NetworkModel):
        try:
            return cls.load(path)
        except Exception as e:  # noqa: BLE001  (wrong class for this folder: try the next)
            errors.append(f"{cls.__name__}: {str(e)[:80]}")
    raise ValueError(f"no supported model at {path}: {errors}")


def prepare_labelled(df: DataFrame, codes: DataFrame, label: str = "label",
                     features: str = "features") -> DataFrame:
    """ENC-3 codes as the ML label column plus the feature vector."""
    coded = encode_labels(df, codes, label, "_code")
    return with_vector(coded.withColumn("label_idx", F.col("_code").cast("double")).drop("_code"), features)


#: Rows of one partition to fit on, about: what a task reads of the cached points in each pass does not grow with the table.
ROWS_EACH = 1 << 19


def _used(estimator, df: DataFrame) -> list[str]:
    """Columns of ``df`` that an estimator reads."""
    named = {estimator.getOrDefault(p) for p in estimator.params if p.name.endswith("Col") and estimator.isDefined(p)}
    return [c for c in df.columns if c in named]


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over more partitions if one has more than ``ROWS_EACH`` rows."""
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()  # a row a partition
    return df.repartition(-(-total // ROWS_EACH)) if most and most > ROWS_EACH else df


def train(estimator, train_df: DataFrame, save_path: str | None = None) -> tuple[Model, float]:
    """ML-7: fit with timing; optionally persist (SNK-7).

    Estimators pass over their input several times (metadata, split
    candidates, then the bagged trees); the input is persisted for the fit so
    the preparation plan runs once.  A persisted block lost with an executor
    is recomputed from lineage.  Spark's own estimators get the columns that they use, in
    partitions of at most about ``ROWS_EACH`` rows.
    """
    cached = (_dealt(train_df.select(*_used(estimator, train_df))) if isinstance(estimator, JavaEstimator) else train_df)
    cached = cached.persist(StorageLevel.MEMORY_AND_DISK)
    t0 = time.perf_counter()
    try:
        model = estimator.fit(cached)
    finally:
        cached.unpersist()
    took = time.perf_counter() - t0
    if save_path:
        model.write().overwrite().save(save_path)
    return model, took


def score(model: Model, df: DataFrame, codes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """ML-2: class prediction decoded to labels, with the class scores as an array."""
    out = model.transform(df)
    c = codes.select(F.col("code").alias("_pc"), F.col("label").alias("y_pred"))
    out = out.join(c, F.col("pred_idx").cast("int") == F.col("_pc"), "left")
    cols = list(keep) + ["y_pred"]
    if "prob" in out.columns:
        out = out.withColumn("probs", vector_to_array("prob"))
        cols.append("probs")
    return out.select(*cols)


def test_classifier(model: Model, data: DataFrame, codes: DataFrame, label: str = "label",
                    normal: str | None = None, split_col: str = "split"):
    """ML-8: score every split in one pass and build the report tables grouped by split."""
    scored = score(model, data, codes, keep=[split_col, label]).withColumnRenamed(label, "y_true")
    return evaluate(scored, normal=normal, by=[split_col])


def fit_pca(train_df: DataFrame, k: int, features: str = "features"):
    """ML-4: centred PCA; returns (scaler model, pca model)."""
    v = with_vector(train_df, features)
    centre = StandardScaler(withMean=True, withStd=False, inputCol="fvec", outputCol="cvec").fit(v)
    pca = PCA(k=k, inputCol="cvec", outputCol="code_vec").fit(centre.transform(v))
    return centre, pca


def pca_reconstruct(df: DataFrame, centre, pca, features: str = "features") -> DataFrame:
    """ML-4: encode to ``k`` dims and decode back: ``recon = mean + V z``."""
    enc = pca.transform(centre.transform(with_vector(df, features)))
    v = pca.pc.toArray()  # d x k loadings: a fixed-size model parameter
    mean = list(map(float, centre.mean.toArray()))
    z = vector_to_array("code_vec")

    @F.pandas_udf("array<double>")
    def decode(codes):  # Arrow batches: one matrix product each
        import numpy as np
        import pandas as pd
        return pd.Series(list(np.stack(codes) @ v.T + mean)) if len(codes) else pd.Series([], dtype=object)

    return enc.withColumn("encoded", z).withColumn("recon", decode("encoded"))


def statistical_test(scored1: DataFrame, scored2: DataFrame, order: Sequence[str], key: str,
                     y_true: str = "y_true", folds: int = 10) -> tuple[DataFrame, DataFrame]:
    """ML-9: contiguous folds over the test set, accuracy per fold for two models, t-test."""
    from .sequence import with_folds
    from .stats import fold_accuracy, ttest_independent
    cols = list(dict.fromkeys([*order, key]))
    both = scored1.select(*cols, y_true, F.col("y_pred").alias("pred1")).join(
        scored2.select(key, F.col("y_pred").alias("pred2")), key)
    folded = with_folds(both, order, folds)
    acc = fold_accuracy(folded, y_true, ["pred1", "pred2"])
    return acc, ttest_independent(acc)
