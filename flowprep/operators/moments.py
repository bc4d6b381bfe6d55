"""Statistics that can be saved and continued: a state a file, merged (AGG-19, AGG-20, SCL-4, JOB-6).

The state of a column over some rows is (n, mean, m2, min, max), m2 being the sum of squared
distances from the mean.  States of disjoint rows merge without a loss: with N the sum
of the n and M the mean of the means weighed by n, m2 is the sum of m2 + n (mean - M)^2.
That is the pairwise update for any number of states at once, and unlike sums of
squares it does not cancel.  NULLs do not count; a column without values has n = 0.

``ScalerState`` keeps one state a file and column in a ``KeyedStore``: it knows which
files it holds, a file cannot come in twice, and files may come at any later time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import col_
from ..sources.store import KeyedStore

STATE = ["n", "mean", "m2", "min", "max"]


def column_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """(by..., column, n, mean, m2, min, max): one aggregate, partial before the shuffle."""
    src = df.where(where) if where is not None else df
    aggs = []
    for i, c in enumerate(columns):
        x = col_(c).cast("double")
        aggs.append(F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
                             F.min(x).alias("min"), F.max(x).alias("max")).alias(f"_s{i}"))
    stats = src.groupBy(*by).agg(*aggs)
    named = [F.struct(F.lit(c).alias("column"), *[F.col(f"_s{i}")[x].alias(x) for x in STATE]) for i, c in enumerate(columns)]
    return stats.select(*by, F.inline(F.array(*named)))


def merge_moments(states: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """One state a column (or other ``by``) of the states of disjoint rows."""
    keys = list(by)
    whole = states.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    from_mean = F.col("mean") - F.col("_mean")
    return (states.join(whole, keys).groupBy(*keys)
            .agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"),
                 F.sum(F.col("m2") + F.col("n") * from_mean * from_mean).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max")))


def with_deviation(moments: DataFrame) -> DataFrame:
    """``moments`` with ``std_pop``."""
    return moments.withColumn("std_pop", F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0))))


def as_scaler(moments: DataFrame) -> dict:
    """The statistics as ``scale.apply_scaler`` takes them: four numbers a column (one row a column is collected)."""
    out: dict = {}
    for r in with_deviation(moments).collect():
        c = r["column"]
        out.update({f"mean_{c}": r["mean"], f"std_{c}": r["std_pop"], f"min_{c}": r["min"], f"max_{c}": r["max"]})
    return out


class ScalerState:
    """A scaler's statistics in a folder, fitted file by file."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file_key"):
        self.key = key
        self.store = KeyedStore(spark, path, key)

    def files(self) -> DataFrame | None:
        """(key, rows) of the files that the state holds."""
        return self.store.committed()

    def add(self, df: DataFrame, columns: Sequence[str], where: Column | None = None, existing: str = "refuse") -> int:
        """Take in the files of ``df`` (by its key column); how many were added.

        A file that is in the state already is refused, or skipped with ``existing="skip"``.  Only rows that
        match ``where`` (such as the training part) count; a file without any is held with n = 0.
        """
        use = [F.when(where, col_(c)).otherwise(None).alias(c) if where is not None else col_(c) for c in columns]
        rows = df.select(col_(self.key), *use)
        return self.store.append(column_moments(rows, columns, [self.key]), existing)

    def moments(self) -> DataFrame:
        """(column, n, mean, m2, min, max) over all files held."""
        return merge_moments(self.store.read().drop(self.key))

    def scaler(self) -> dict:
        return as_scaler(self.moments())
