"""Fixed-length sequences of consecutive rows (WIN-1..3), folds and chunks (WIN-4, SNK-3).

A sequence holds ``L`` consecutive rows in ``order``; the incomplete tail is
dropped.  Each group has at most ``L`` members, so the grouping never builds a
large group no matter how the data is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .position import group_position, with_position


def with_sequence_ids(df: DataFrame, order: Sequence[str | Column], length: int,
                      pos_col: str = "pos") -> DataFrame:
    """``seq = pos div L`` and ``step = pos mod L``; rows of the incomplete tail removed (WIN-2)."""
    p = with_position(df, order, pos_col, total_col="_n")
    return (p
            .where(F.col(pos_col) < F.lit(length) * F.floor(F.col("_n") / length))
            .withColumn("seq", F.floor(F.col(pos_col) / length).cast("long"))
            .withColumn("step", (F.col(pos_col) % length).cast("int"))
            .drop("_n"))


def flow_sequences(df: DataFrame, order: Sequence[str | Column], length: int,
                   fields: Sequence[str], max_duration_secs: float | None = None) -> DataFrame:
    """WIN-1: one row per sequence ``(seq, steps array<struct<step, fields...>>)``.

    ``max_duration_secs`` is accepted and ignored, as in the reference.
    """
    rows = with_sequence_ids(df, order, length)
    return (rows.groupBy("seq")
            .agg(F.sort_array(F.collect_list(F.struct("step", *fields))).alias("steps")))


def flow_sequences_by(df: DataFrame, group: str, order: Sequence[str | Column], length: int,
                      fields: Sequence[str]) -> DataFrame:
    """WIN-1 for every value of ``group`` (e.g. each split) in one pass.

    Positions restart in each group (skew-safe ``group_position``, one range
    shuffle for all groups); the tail of each group is dropped using the group
    sizes (one row per group).  Output ``(group, seq, steps)``.
    """
    gp = group_position(df, group, order, "_gp")
    sizes = cut_lineage(df.groupBy(F.col(group).alias("_sg")).agg(F.count(F.lit(1)).alias("_gn")))
    rows = (gp.join(sizes, F.col(group).eqNullSafe(F.col("_sg"))).drop("_sg")
            .where(F.col("_gp") <= F.lit(length) * F.floor(F.col("_gn") / length))
            .withColumn("seq", F.floor((F.col("_gp") - 1) / length).cast("long"))
            .withColumn("step", ((F.col("_gp") - 1) % length).cast("int")))
    return rows.groupBy(group, "seq").agg(F.sort_array(F.collect_list(F.struct("step", *fields))).alias("steps"))


def flatten_sequences(seqs: DataFrame, steps_col: str = "steps") -> DataFrame:
    """WIN-3: back to one row per step."""
    return seqs.select("seq", F.inline(steps_col))


def fold_number(pos: Column, n: Column, k: int) -> Column:
    """1-based fold of a 0-based position among ``n``: the first ``n mod k`` folds have one row more."""
    base = F.floor(n / k)
    extra = n - base * k
    big = extra * (base + 1)
    fold = F.when(pos < big, F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - big) / base))
    return (fold + 1).cast("int")


def chunk_number(pos: Column, n: Column, num_chunks: int) -> Column:
    """1-based chunk of a 0-based position among ``n``: chunks of ``ceil(n / N)`` rows."""
    return (F.floor(pos / F.ceil(n / num_chunks)) + 1).cast("int")


def with_folds(df: DataFrame, order: Sequence[str | Column], k: int = 10,
               fold_col: str = "fold") -> DataFrame:
    """WIN-4: ``k`` contiguous folds; the first ``n mod k`` folds get one extra row (1-based)."""
    p = with_position(df, order, "_fpos", total_col="_n")
    return p.withColumn(fold_col, fold_number(F.col("_fpos"), F.col("_n"), k)).drop("_n", "_fpos")


def with_chunks(df: DataFrame, order: Sequence[str | Column], num_chunks: int,
                chunk_col: str = "chunk") -> DataFrame:
    """SNK-3: ``num_chunks`` consecutive ranges of ``ceil(n / N)`` rows (1-based; FN-9 ceil / floor)."""
    p = with_position(df, order, "_cpos", total_col="_n")
    return p.withColumn(chunk_col, chunk_number(F.col("_cpos"), F.col("_n"), num_chunks)).drop("_n", "_cpos")


def write_chunks(df: DataFrame, order: Sequence[str | Column], num_chunks: int, path: str,
                 fmt: str = "csv") -> None:
    """SNK-3 sink: one output folder per chunk (``chunk=i``)."""
    (with_chunks(df, order, num_chunks).write.mode("overwrite").partitionBy("chunk")
     .format(fmt).option("header", True).save(path))
