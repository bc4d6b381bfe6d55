"""Projections, row filters and value cleaning (PRJ-1..4, FLT-1..4, CLN-1..4, CHK-1..3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..functions.exprs import (ascii_only, col_, is_number_text, non_finite_to_null, squeeze_blanks,
                               strict_number)

# ----------------------------------------------------------------- projections


def features_and_label_by_position(df: DataFrame, label_col: str = "label") -> DataFrame:
    """PRJ-1: the last column is the label; the rest stay features, in one frame."""
    *features, last = df.columns
    return df.select(*features, F.col(last).alias(label_col))


def drop_label(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """PRJ-2: features are every column but the label."""
    return df.drop(label_col)


def drop_last_column(df: DataFrame) -> DataFrame:
    """PRJ-3: drop the trailing column (NSL difficulty score)."""
    return df.drop(df.columns[-1])


def drop_if_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """PRJ-4: drop listed columns that exist; absent names are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def strip_column_names(df: DataFrame) -> DataFrame:
    """SRC-3 / FN-1: trim header names with stray blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


# --------------------------------------------------------------------- filters


def drop_classes(df: DataFrame, label_col: str, classes: Sequence[str]) -> DataFrame:
    """FLT-1: drop rows of listed classes; a NULL label is kept."""
    lab = F.col(label_col)
    return df.where(lab.isNull() | ~lab.isin(list(classes)))


def keep_numeric_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT-2: drop rows whose string column is not number text; NULL is kept.

    Non-string columns are left alone, as in the reference.
    """
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        if types.get(c) == "string":
            cond = cond & (F.col(c).isNull() | is_number_text(c))
    return df.where(cond)


def missing_non_finite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """FLT-3, first half: +-Infinity and NaN become missing."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = list(cols) if cols is not None else df.columns
    return df.select(*[non_finite_to_null(c).alias(c) if c in numeric and c in targets else col_(c)
                       for c in df.columns])


def drop_invalid_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """FLT-3: +-Infinity and NaN become missing, then rows with any missing value go."""
    targets = list(cols) if cols is not None else df.columns
    return missing_non_finite(df, cols).na.drop("any", subset=targets)


def drop_unseen_classes(train: DataFrame, other: DataFrame, label_col: str) -> DataFrame:
    """FLT-4 / JOIN-1: rows of ``other`` whose label occurs in ``train`` (left-semi join).

    The distinct train labels (one row per class, partial aggregation) are
    materialised once and broadcast only after a row-count check; above the
    bound the join stays a shuffle join (AQE splits a skewed partition).
    """
    seen = cut_lineage(train.select(label_col).where(F.col(label_col).isNotNull()).distinct())
    return other.join(seen, label_col, "left_semi")


# ---------------------------------------------------------------------- values


def clean_label_text(c: Column | str) -> Column:
    """CLN-1/2: strip non-ASCII characters, then squeeze blank runs; NULL stays NULL."""
    return squeeze_blanks(ascii_only(c))


def cast_columns_strict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-3: cast named text columns to double; the job fails on bad text."""
    cs = set(cols)
    return df.select(*[strict_number(c, c).alias(c) if c in cs else col_(c) for c in df.columns])


def cast_text_columns(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """CLN-4: every remaining string column to double in one projection, except ``skip``."""
    sk = set(skip)
    return df.select(*[strict_number(f.name, f.name).alias(f.name)
                       if isinstance(f.dataType, T.StringType) and f.name not in sk else col_(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------------- checks


def assert_class_count(df: DataFrame, label_col: str, expected: int) -> None:
    """CHK-1: distinct non-NULL labels must equal ``expected`` (one small action)."""
    n = df.agg(F.countDistinct(label_col)).first()[0]
    if n != expected:
        raise AssertionError(f"expected {expected} classes in {label_col}, found {n}")


def quality_report(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """CHK-2: ``(stage, rows_before, rows_after, removed)`` for consecutive stages.

    ``stages`` starts with the input; one count aggregate per stage, unioned,
    so the report is a single job.
    """
    counts = None
    for i, (name, frame) in enumerate(stages):
        c = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("i"), F.lit(name).alias("stage"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    prev = counts.select((F.col("i") + 1).alias("i"), F.col("rows").alias("rows_before"))
    return (counts.join(prev, "i").select("stage", "rows_before", F.col("rows").alias("rows_after"),
                                          (F.col("rows_before") - F.col("rows")).alias("removed"), "i")
            .orderBy("i").drop("i"))


def filter_report(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """CHK-2 for successive filters of one input, in one scan.

    Stage ``i`` keeps the rows that pass conditions ``1..i``; every stage count
    is a conditional count in a single aggregate (NULL conditions count as
    failing, as ``where`` drops them).  Returns ``(stage, rows_before,
    rows_after, removed)``.
    """
    cum = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("n0")]
    for i, (_, cond) in enumerate(stages, start=1):
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(cum).alias(f"n{i}"))
    counts = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(f"n{i - 1}").alias("rows_before"),
                                        F.col(f"n{i}").alias("rows_after"),
                                        (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("removed"))
                               for i, (name, _) in enumerate(stages, start=1)]))
    return counts.select(rows.alias("r")).select("r.*")


def valid_row(cols: Sequence[str]) -> Column:
    """The FLT-3 keep condition as one expression: no NULL, NaN or +-Infinity in ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & non_finite_to_null(c).isNotNull()
    return cond


def profile(df: DataFrame, n: int = 5):
    """CHK-3 / SRT-3: schema, row count and the first ``n`` rows (a driver-side preview of n rows)."""
    return {"schema": df.schema.simpleString(), "rows": df.count(), "head": df.limit(n).collect()}
