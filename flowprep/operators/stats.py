"""Model comparison and distribution statistics (AGG-12, AGG-13, AGG-16, AGG-21, AGG-22, FN-13)."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import student_t_two_sided_p
from ..session import cut_lineage


def fold_accuracy(df: DataFrame, y_true: str, preds: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """AGG-12: accuracy of each prediction column per fold: ``(fold, acc1, acc2, ...)``."""
    return (df.groupBy(fold_col)
            .agg(*[F.avg(F.col(p).eqNullSafe(F.col(y_true)).cast("double")).alias(f"acc{i + 1}")
                   for i, p in enumerate(preds)]))


def _t_cdf_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p for any integer dof (A&S 26.7.3 even / 26.7.4 odd), built-in maths only."""
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    cos = F.cos(theta)
    cos2 = cos * cos
    # odd dof: A = 2/pi * (theta + sin(theta) * sum_{j=0}^{(v-3)/2} d_j cos^(2j+1)),
    # d_0 = 1, d_j = d_{j-1} * 2j / (2j+1)
    init = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, j):
        term = acc["term"] * (2 * j) / (2 * j + 1) * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    m = ((dof - 3) / 2).cast("int")
    odd_series = F.when(dof >= 3, F.when(m >= 1, F.aggregate(F.sequence(F.lit(1), m), init, step)["total"])
                        .otherwise(F.lit(1.0)) * cos).otherwise(F.lit(0.0))
    odd_a = F.lit(2.0 / 3.141592653589793) * (theta + F.sin(theta) * odd_series)
    return F.when(dof % 2 == 0, student_t_two_sided_p(t, dof)).otherwise(F.lit(1.0) - odd_a)


def ttest_independent(folds: DataFrame, a: str = "acc1", b: str = "acc2") -> DataFrame:
    """AGG-13: equal-variance two-sample t statistic, degrees of freedom and two-sided p."""
    s = folds.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
                  F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    t = F.when(se > 0, (F.col("m1") - F.col("m2")) / se)
    return s.select(t.alias("t"), dof.cast("int").alias("df"),
                    _t_cdf_two_sided_p(t, dof).alias("p"))


def histogram(df: DataFrame, col: str, num_bins: int) -> DataFrame:
    """AGG-16: counts in ``num_bins`` equal-width bins over [min, max]; the last bin is closed.

    Min and max are one aggregate row, inlined as literals; bins are a partial
    aggregate (at most ``num_bins`` rows leave each task).  NULL and NaN are in no
    bin; an empty bin has count 0.
    """
    x = F.col(col).cast("double")
    known = df.where(F.col(col).isNotNull() & ~F.isnan(x))
    lo_v, hi_v = known.agg(F.min(x), F.max(x)).first()
    if lo_v is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    lo_c, width = F.lit(lo_v), F.lit(hi_v) - F.lit(lo_v)
    raw = F.lit(0) if hi_v == lo_v else F.floor((x - lo_c) * num_bins / width)
    b = F.least(raw, F.lit(num_bins - 1)).cast("int")
    found = known.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = df.sparkSession.range(num_bins).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(found, "bin", "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long"))
    lo = lo_c + width * F.col("bin") / num_bins
    hi = lo_c + width * (F.col("bin") + 1) / num_bins
    return out.select("bin", lo.alias("lo"), hi.alias("hi"), "n")


def _plain_text(df: DataFrame, name: str) -> Column:
    """A value as text that any engine can write: six decimals, microseconds."""
    kind = df.schema[name].dataType.simpleString()
    if kind in ("double", "float"):
        return F.round(F.col(name), 6).cast("decimal(38,6)").cast("string")
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else F.col(name).cast("string")


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """AGG-21: order-free dataset fingerprint over every row: ``(n, fp)``.

    ``fp`` sums a 64-bit row hash as a decimal (a sum, not xor: duplicate rows
    do not cancel).  ``portable``: an md5 of the values' texts instead (numbers to six
    decimals), which other engines can compute too.
    """
    cols = list(cols or df.columns)
    if portable:
        parts = [F.coalesce(_plain_text(df, c), F.lit("\x00")) for c in cols]
        row = F.md5(F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:]))
        h = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    else:
        h = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("fp"))


def prediction_timing(score, frames: Sequence[DataFrame]) -> DataFrame:
    """AGG-22: run ``score(frame)`` into a no-op sink per repetition and time it on the driver."""
    rows = []
    for i, f in enumerate(frames, start=1):
        f = cut_lineage(f)  # the sample is drawn before the clock starts
        scored = score(f)
        n = f.count()
        t0 = time.perf_counter()
        scored.write.format("noop").mode("overwrite").save()
        rows.append((i, n, time.perf_counter() - t0))
    spark = frames[0].sparkSession
    return spark.createDataFrame(rows, "rep int, rows long, seconds double") \
        .withColumn("rows_per_sec", F.col("rows") / F.col("seconds"))


def dataset_sizes(df: DataFrame, feature_cols: Sequence[str], split_col: str = "split") -> DataFrame:
    """AGG-10: ``(split, n_rows, n_features)``."""
    return (df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("n_features", F.lit(len(feature_cols))))
