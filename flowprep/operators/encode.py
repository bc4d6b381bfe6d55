"""Category dummies and label codes (ENC-1..5, WIN-8)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_, one_hot
from ..session import cut_lineage
from .labels import sorted_labels
from .position import with_position


def _distinct_values(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(c, v): distinct non-null values of each column, over the union of ``frames`` (ENC-2)."""
    pairs = [f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                         for c in columns])).alias("p")).select("p.c", "p.v")
             for f in frames]
    return reduce(lambda a, b: a.unionByName(b), pairs).where(F.col("v").isNotNull()).distinct()


def category_values(frames: Sequence[DataFrame] | DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per category column, over the union of ``frames`` (ENC-2).

    For dummy *columns*: the values become column names, so they come to the
    driver.  A column with more values than a table should have columns is
    encoded by ``dummy_positions``, which keeps them in Spark.
    """
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    out: dict[str, list] = {c: [] for c in columns}
    for r in _distinct_values(frames, columns).collect():
        out[r["c"]].append(r["v"])
    return {c: sorted(vals) for c, vals in out.items()}


def category_positions(frames: Sequence[DataFrame] | DataFrame, column: str) -> DataFrame:
    """``(value, position)``: the place of each value in sorted order, for any number of values."""
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    values = _distinct_values(frames, [column]).select(F.col("v").alias("value"))
    return with_position(values, ["value"], "position")


def dummy_positions(df: DataFrame, column: str, positions: DataFrame, out_col: str | None = None) -> DataFrame:
    """ENC-1 for a column of many values: the position of the one dummy that is 1 (NULL: all zeros).

    Joined on the value; a hot value's rows are split by adaptive execution.
    """
    p = positions.select(F.col("value").alias("_v"), F.col("position").alias(out_col or f"{column}_position"))
    return df.join(p, F.col(column).cast("string") == F.col("_v"), "left").drop("_v")


def dummy_columns(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """ENC-1: originals removed, one 0/1 column ``col_value`` per sorted value appended.

    Missing values give all zeros.  One projection, no join.
    """
    cats = set(values)
    keep = [col_(c) for c in df.columns if c not in cats]
    dummies = [col_(c).cast("string").eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}")
               for c, vs in values.items() for v in vs]
    return df.select(*keep, *dummies)


def one_hot_encode(frames: Sequence[DataFrame] | DataFrame, columns: Sequence[str]):
    """ENC-1 + ENC-2: fit the value lists on all frames, encode each; returns a list."""
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    values = category_values(frames, columns)
    return [dummy_columns(f, values) for f in frames]


def fit_label_codes(*frames: DataFrame, label_col: str = "label", start: int = 0) -> DataFrame:
    """ENC-3 / WIN-8: ``(label, code)`` with codes in sorted label order from ``start``.

    A fit is eager, like an estimator's: the table (one row per class, built
    by partial aggregation) is written once to the checkpoint folder, so later
    size checks and joins do not rescan the inputs.  It never passes through
    the driver.
    """
    labels = sorted_labels(*frames, label_col=label_col).where(F.col("label").isNotNull())
    # numbered by range position: no dictionary, small or large, is sorted in one task
    return cut_lineage(with_position(labels, ["label"], "_pos").select(
        "label", (F.col("_pos") + start).cast("int").alias("code")))


def encode_labels(df: DataFrame, codes: DataFrame, label_col: str = "label",
                  code_col: str = "code") -> DataFrame:
    """ENC-3: attach codes; a label missing from ``codes`` fails the job (as the encoder does)."""
    c = codes.select(F.col("label").alias("_cl"), F.col("code").alias("_cc"))
    joined = df.join(c, F.col(label_col) == F.col("_cl"), "left")
    checked = F.when(F.col("_cc").isNotNull(), F.col("_cc")).otherwise(
        F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label_col).cast("string"), F.lit("NULL")))))
    return joined.withColumn(code_col, checked.cast("int")).drop("_cl", "_cc")


def onehot_labels(df: DataFrame, codes: DataFrame, code_col: str = "code",
                  out_col: str = "onehot") -> DataFrame:
    """ENC-4: one-hot int array of the code; width = number of classes (counted on the fitted table)."""
    k = codes.count()
    return df.withColumn(out_col, one_hot(code_col, k))


def decode_labels(df: DataFrame, codes: DataFrame, code_col: str = "code",
                  out_col: str = "label_decoded") -> DataFrame:
    """ENC-5: inverse transform codes to labels."""
    c = codes.select(F.col("code").alias("_dc"), F.col("label").alias(out_col))
    return df.join(c, F.col(code_col) == F.col("_dc"), "left").drop("_dc")
