"""Evaluation: confusion matrix, per-class and averaged metrics (AGG-3..11, 14, 15).

The scored table is aggregated once into the long confusion matrix
``(by..., y_true, y_pred, n)`` (partial aggregation: at most k x k rows per
group leave each task).  Everything after that runs on that small table, kept
sparse; ``dense_confusion`` adds the empty cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import contains_ignore_case, squared_distance, threshold
from ..session import cut_lineage

RATIOS = ["tpr", "tnr", "ppv", "npv", "fpr", "fnr", "fdr", "acc", "f1"]


def safe_div(a: Column, b: Column) -> Column:
    """0/0 -> 0, as the reference replaces NaN ratios with 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              by: Sequence[str] = ()) -> DataFrame:
    """AGG-3, sparse form: observed cells ``(by..., y_true, y_pred, n)`` (groups x k x k rows at most)."""
    return (scored.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def dense_confusion(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-3: every cell of each group's label x label matrix, 0 where nothing was observed.

    A group's labels are those true or predicted in it; k x k cells are the result's own size.
    """
    by = list(by)
    axis = conf.select(*by, F.explode(F.array("y_true", "y_pred")).alias("_l")).distinct()
    rows, cols = axis.withColumnRenamed("_l", "y_true"), axis.withColumnRenamed("_l", "y_pred")
    cells = rows.join(cols, by) if by else rows.crossJoin(cols)
    seen = conf.select(*[F.col(c).alias(f"_{c}") for c in (*by, "y_true", "y_pred")], F.col("n").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "y_true", "y_pred")]
    return cells.join(seen, same, "left").select(*by, "y_true", "y_pred", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def class_counts(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-4: ``(by..., label, tp, fp, fn, tn, support)`` over the union of true and predicted labels.

    One aggregation: each matrix cell contributes to its true label's row sum
    (and diagonal) and to its predicted label's column sum; no joins.
    """
    by = list(by)
    diag = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(F.lit(0))
    cells = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c"),
                 diag.cast("long").alias("d")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c"),
                 F.lit(0).cast("long").alias("d"))))
    per = (conf.select(*by, cells.alias("x")).select(*by, "x.*")
           .groupBy(*by, "label").agg(F.sum("r").alias("support"), F.sum("c").alias("pred_n"), F.sum("d").alias("tp")))
    total = F.sum("support").over(Window.partitionBy(*by))  # labels per group: a tiny window
    return per.select(*by, "label", F.col("tp").cast("long").alias("tp"),
                      (F.col("pred_n") - F.col("tp")).cast("long").alias("fp"),
                      (F.col("support") - F.col("tp")).cast("long").alias("fn"),
                      (total - F.col("support") - F.col("pred_n") + F.col("tp")).cast("long").alias("tn"),
                      F.col("support").cast("long").alias("support"))


def ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    tpr = safe_div(tp, tp + fn)
    ppv = safe_div(tp, tp + fp)
    return [tpr.alias("tpr"), safe_div(tn, tn + fp).alias("tnr"), ppv.alias("ppv"),
            safe_div(tn, tn + fn).alias("npv"), safe_div(fp, fp + tn).alias("fpr"),
            safe_div(fn, tp + fn).alias("fnr"), safe_div(fp, tp + fp).alias("fdr"),
            safe_div(tp + tn, tp + fp + fn + tn).alias("acc"),
            safe_div(2 * ppv * tpr, ppv + tpr).alias("f1")]


def class_metrics(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-5: per-class TPR, TNR, PPV, NPV, FPR, FNR, FDR, ACC, F1 and support."""
    c = class_counts(conf, by)
    return c.select(*by, "label", "tp", "fp", "fn", "tn", "support",
                    *ratios(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def average_metrics(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-6: micro, macro and support-weighted averages of the nine ratios.

    Micro ACC is the overall accuracy (trace / total), as in the reference.
    """
    by = list(by)
    g = cm.groupBy(*by) if by else cm.groupBy()
    stp, sfp, sfn, stn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    total = F.sum("support")
    micro_tpr = safe_div(stp, stp + sfn)
    micro_ppv = safe_div(stp, stp + sfp)
    micro = [micro_tpr, safe_div(stn, stn + sfp), micro_ppv, safe_div(stn, stn + sfn),
             safe_div(sfp, sfp + stn), safe_div(sfn, stp + sfn), safe_div(sfp, stp + sfp),
             safe_div(stp, total), safe_div(2 * micro_ppv * micro_tpr, micro_ppv + micro_tpr)]
    macro = [F.avg(r) for r in RATIOS]
    weighted = [safe_div(F.sum(F.col(r) * F.col("support")), total) for r in RATIOS]
    agg = g.agg(*[m.alias(f"micro_{r}") for m, r in zip(micro, RATIOS)],
                *[m.alias(f"macro_{r}") for m, r in zip(macro, RATIOS)],
                *[m.alias(f"weighted_{r}") for m, r in zip(weighted, RATIOS)])
    stack = F.explode(F.array(*[F.struct(F.lit(t).alias("avg_type"), *[F.col(f"{t}_{r}").alias(r) for r in RATIOS])
                                for t in ("micro", "macro", "weighted")]))
    return agg.select(*by, stack.alias("s")).select(*by, "s.*")


def binary_confusion(conf: DataFrame, normal: str, attack_label: str = "attack",
                     normal_label: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """AGG-7: collapse to (attack, normal).  Exactly one label may match ``normal``
    (case-insensitive substring, taken literally); otherwise the job fails."""
    by = list(by)
    normal_label = normal_label or normal
    labels = (conf.select(*by, F.col("y_true").alias("label"))
              .unionByName(conf.select(*by, F.col("y_pred").alias("label"))).distinct())
    n_match = labels.groupBy(*by).agg(F.sum(contains_ignore_case("label", normal).cast("int")).alias("_nm"))
    joined = conf.join(n_match, by, "left") if by else conf.crossJoin(n_match)  # one row
    ok = F.col("_nm") == 1
    err = F.raise_error(F.concat(F.lit(f"expected one label matching '{normal}', found "),
                                 F.col("_nm").cast("string")))

    def relabel(c: str) -> Column:
        v = F.when(contains_ignore_case(c, normal), F.lit(normal_label)).otherwise(F.lit(attack_label))
        return F.when(ok, v).otherwise(err)

    # four cells per group, all of them, also those with nothing in them
    two = [attack_label, normal_label]
    sums = (joined.select(*by, relabel("y_true").alias("y_true"), relabel("y_pred").alias("y_pred"), "n").groupBy(*by)
            .agg(*[F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0)).alias(f"_{i}{j}")
                   for i, t in enumerate(two) for j, p in enumerate(two)]))
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"_{i}{j}").alias("n"))
                                for i, t in enumerate(two) for j, p in enumerate(two)]))
    return sums.select(*by, cells.alias("x")).select(*by, "x.*")


def evaluate(scored: DataFrame, normal: str | None = None, by: Sequence[str] = ("split",),
             y_true: str = "y_true", y_pred: str = "y_pred", attack_label: str = "attack"):
    """Multi-class and binary tables stacked with a ``granularity`` column (SNK-5 tables)."""
    by = list(by)
    # the scored rows are read once: all tables come from the stored matrix
    conf = cut_lineage(confusion(scored, y_true, y_pred, by))
    cm = class_metrics(conf, by).withColumn("granularity", F.lit("multi"))
    am = average_metrics(class_metrics(conf, by), by).withColumn("granularity", F.lit("multi"))
    cf = dense_confusion(conf, by).withColumn("granularity", F.lit("multi"))
    if normal is not None:
        bconf = binary_confusion(conf, normal, attack_label, by=by)
        bcm = class_metrics(bconf, by)
        cm = cm.unionByName(bcm.withColumn("granularity", F.lit("binary")))
        am = am.unionByName(average_metrics(bcm, by).withColumn("granularity", F.lit("binary")))
        cf = cf.unionByName(bconf.withColumn("granularity", F.lit("binary")))
    return {"confusion": cf, "class_metrics": cm, "average_metrics": am}


def accuracy_report(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-8: precision / recall / F1 / support per class, plus accuracy, macro and weighted rows."""
    by = list(by)
    per_class = cm.select(*by, F.col("label").cast("string").alias("label"), F.col("ppv").alias("precision"),
                          F.col("tpr").alias("recall"), "f1", "support")
    g = cm.groupBy(*by) if by else cm.groupBy()
    total = F.sum("support")
    acc = safe_div(F.sum("tp"), total)
    summary = g.agg(acc.alias("_acc"), total.alias("_n"), F.avg("ppv").alias("_mp"), F.avg("tpr").alias("_mr"),
                    F.avg("f1").alias("_mf"),
                    safe_div(F.sum(F.col("ppv") * F.col("support")), total).alias("_wp"),
                    safe_div(F.sum(F.col("tpr") * F.col("support")), total).alias("_wr"),
                    safe_div(F.sum(F.col("f1") * F.col("support")), total).alias("_wf"))
    rows = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("_acc").alias("precision"), F.col("_acc").alias("recall"),
                 F.col("_acc").alias("f1"), F.col("_n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1"), F.col("_n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("_wp").alias("precision"), F.col("_wr").alias("recall"),
                 F.col("_wf").alias("f1"), F.col("_n").alias("support"))))
    return per_class.unionByName(summary.select(*by, rows.alias("r")).select(*by, "r.*"))


def average_table(am: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-9: compact table (accuracy, precision, recall, false alarm, false negative, F1)."""
    return am.select(*by, "avg_type", F.col("acc").alias("accuracy"), F.col("ppv").alias("precision"),
                     F.col("tpr").alias("recall"), F.col("fpr").alias("false_alarm"),
                     F.col("fnr").alias("false_negative"), "f1")


def reconstruction_error(df: DataFrame, x_true: str, x_recon: str, out_col: str = "sq_error_sum") -> DataFrame:
    """AGG-11 per row: the **sum** of squared differences (the reference calls it MSE)."""
    return df.withColumn(out_col, squared_distance(x_true, x_recon))


def reconstruction_summary(errors: DataFrame, err_col: str = "sq_error_sum", by: Sequence[str] = ()) -> DataFrame:
    """AGG-11 dataset level: mean of the per-row sums and its square root."""
    g = errors.groupBy(*by) if by else errors.groupBy()
    return g.agg(F.avg(err_col).alias("mse"), F.sqrt(F.avg(err_col)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def multilabel_f1(df: DataFrame, y_col: str, p_col: str, by: Sequence[str] = (), at: float = 0.5,
                  n_classes: int | None = None) -> DataFrame:
    """AGG-14: support-weighted F1 of thresholded multi-label scores (no score above 0.5 => no label).

    With ``n_classes`` known, the per-class counts are plain sums over array
    elements (one aggregation, no explode).
    """
    by = list(by)
    if n_classes is not None:
        y, p = F.col(y_col), threshold(p_col, at)
        sums = []
        for j in range(n_classes):
            yj, pj = y[j], p[j]
            sums += [F.sum(yj * pj).alias(f"tp{j}"), F.sum((1 - yj) * pj).alias(f"fp{j}"),
                     F.sum(yj * (1 - pj)).alias(f"fn{j}"), F.sum(yj).alias(f"s{j}")]
        g = df.groupBy(*by) if by else df.groupBy()
        agg = g.agg(*sums)
        num = F.lit(0.0)
        den = F.lit(0)
        for j in range(n_classes):
            f1 = safe_div(2 * F.col(f"tp{j}"), 2 * F.col(f"tp{j}") + F.col(f"fp{j}") + F.col(f"fn{j}"))
            num = num + f1 * F.col(f"s{j}")
            den = den + F.col(f"s{j}")
        return agg.select(*by, safe_div(num, den).alias("weighted_f1"))
    ex = df.select(*by, F.posexplode(F.arrays_zip(F.col(y_col).alias("y"), threshold(p_col, at).alias("p"))))
    per = (ex.groupBy(*by, "pos")
           .agg(F.sum(F.col("col.y") * F.col("col.p")).alias("tp"),
                F.sum((1 - F.col("col.y")) * F.col("col.p")).alias("fp"),
                F.sum(F.col("col.y") * (1 - F.col("col.p"))).alias("fn"),
                F.sum(F.col("col.y")).alias("support")))
    f1 = safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    g = per.groupBy(*by) if by else per.groupBy()
    return g.agg(safe_div(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"))


def exact_match(df: DataFrame, y_col: str, p_col: str, by: Sequence[str] = (), at: float = 0.5) -> DataFrame:
    """AGG-15: share of rows whose thresholded scores equal the true one-hot exactly."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg((threshold(p_col, at) == F.col(y_col)).cast("double")).alias("exact_match"))
