"""Feature scaling fitted on one part, applied to all (SCL-1..5, AGG-19, AGG-20).

The fit is a single aggregate (partial per partition, merged once): the
file-by-file partial fitting of the reference is what Spark's two-phase
aggregation already does.  The fitted statistics are one row; applying them
inlines them as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_


def fit_scaler(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """AGG-19/20, SCL-4: one row with ``mean_c, std_c (population), min_c, max_c`` and ``n``."""
    src = df.where(where) if where is not None else df
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        x = col_(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}"),
                 F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    return src.agg(*aggs)


def scaler_stats_long(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, mean, std_pop, min, max, n)`` of a fitted scaler."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"),
                                        F.col(f"std_{c}").alias("std_pop"), F.col(f"min_{c}").alias("min"),
                                        F.col(f"max_{c}").alias("max")) for c in columns]))
    return stats.select(rows.alias("s"), "n").select("s.*", "n")


def stats_row(stats: DataFrame) -> dict:
    """The fitted statistics as a dict: a fitted scaler is one row (4 numbers per column)."""
    rows = stats.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a fitted scaler has exactly one row")
    return rows[0].asDict()


def apply_scaler(df: DataFrame, stats: DataFrame | dict, columns: Sequence[str],
                 kind: str = "standard") -> DataFrame:
    """SCL-1/2/3: scale ``columns`` in place, keeping column order (SCL-5).

    standard: ``(x - mean) / std_pop``, a constant column gives 0.
    min_max:  ``(x - min) / (max - min)``, a constant column gives 0.

    The one-row statistics become literals: the projection needs no join and
    stays inside whole-stage codegen.
    """
    st = stats if isinstance(stats, dict) else stats_row(stats)
    cs = set(columns)
    out = []
    for c in df.columns:
        if c not in cs:
            out.append(col_(c))
            continue
        x = col_(c).cast("double")
        if kind == "standard":
            mean, std = st[f"mean_{c}"], st[f"std_{c}"]
            scale = 1.0 if not std else std  # 0 (constant column) -> divide by 1
            out.append(((x - F.lit(mean)) / F.lit(scale)).alias(c) if mean is not None
                       else F.lit(None).cast("double").alias(c))
        elif kind == "min_max":
            lo, hi = st[f"min_{c}"], st[f"max_{c}"]
            rng = 1.0 if lo is None or hi == lo else hi - lo
            out.append(((x - F.lit(lo)) / F.lit(rng)).alias(c) if lo is not None
                       else F.lit(None).cast("double").alias(c))
        else:
            raise ValueError(f"unknown scaler {kind}")
    return df.select(*out)


def fit_and_scale(df: DataFrame, columns: Sequence[str], fit_where: Column,
                  kind: str = "standard") -> DataFrame:
    """Fit on the rows matching ``fit_where`` (train) and scale every row."""
    return apply_scaler(df, fit_scaler(df, columns, fit_where), columns, kind)


def save_scaler(stats: DataFrame, path: str) -> None:
    """SNK-7: persist the fitted statistics (one row)."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
