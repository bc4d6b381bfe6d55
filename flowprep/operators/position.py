"""Order-dependent helpers: global row position, skew-safe ranks and scans.

Row order is semantic in the reference (sequences, every-k-th sampling,
contiguous folds, file chunks).  Spark rows have no order, so every helper here
takes an explicit ``order`` whose columns must be unique together.

``row_number() over (order by ...)`` with no partition moves every row into one
task.  Instead:

* ``with_position``: range-partition on the order, sort inside partitions,
  cut lineage (the range bounds are sampled and must not be re-drawn), count
  rows per partition (one row per partition), prefix-sum those counts and
  broadcast them (size bounded by the partition count).
* ``class_rank``: rank rows inside a class by a seeded hash.  A class that
  holds most rows would put one window partition on one task, so rows are
  spread over 4096 hash buckets per class; bucket counts (classes x 4096
  rows at most) give each bucket its offset.
* ``segmented_scan``: running min / max / sum inside a group that may be hot,
  computed per (range partition, group) and carried across partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PID = "_pid"
ColumnOrName = Column | str


def _cols(cols: Sequence[ColumnOrName] | ColumnOrName) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_position(df: DataFrame, order: Sequence[ColumnOrName] | ColumnOrName,
                  pos_col: str = "pos", num_partitions: int | None = None,
                  keep_partition: bool = False, total_col: str | None = None) -> DataFrame:
    """Add a dense 0-based global position following ``order`` (unique keys).

    ``total_col`` also attaches the total row count, taken from the same
    per-partition count table (no extra pass over the rows).
    """
    order_cols = _cols(order)
    # without an explicit count Spark uses spark.sql.shuffle.partitions and AQE may
    # merge neighbouring (small) ranges, which keeps the order
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    ranged = (ranged
                .sortWithinPartitions(*order_cols)
                .withColumn(PID, F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: safe to broadcast at any data size
    offsets = (ranged.groupBy(PID)
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
               .withColumn("_tot", F.sum("_n").over(Window.partitionBy()))
               .select(PID, "_off", "_m0", "_tot"))
    out = (ranged.join(F.broadcast(offsets), PID)
           .withColumn(pos_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
           .drop("_off", "_m0", "_mid"))
    out = out.withColumnRenamed("_tot", total_col) if total_col else out.drop("_tot")
    return out if keep_partition else out.drop(PID)


def seeded_hash(keys: Sequence[ColumnOrName] | ColumnOrName, seed: int | str) -> Column:
    """md5 of ``key-seed`` as hex text; the same string in Spark and DuckDB.  A NULL key counts as U+0000."""
    parts = []
    for c in _cols(keys):
        parts.extend([F.coalesce(c.cast("string"), F.lit("\x00")), F.lit("-")])
    parts.append(F.lit(str(seed)))
    return F.md5(F.concat(*parts))


def _null_safe_key(label: str) -> tuple[Column, Column]:
    return (F.coalesce(F.col(label).cast("string"), F.lit("")),
            F.col(label).isNull())


def ranked_by_class(df: DataFrame, label: str, keys: Sequence[str] | str, seed: int | str = 42):
    """Rows with a per-(class, bucket) row number, and the (class, bucket) count table.

    The count table carries ``_boff``, the rows of the same class in earlier
    buckets; callers attach per-class columns to it (small) before the one join
    with the big side on ``(_lk, _ln, _b)``, the window's own partitioning.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    lk, ln = _null_safe_key(label)
    base = (df.withColumn("_h", seeded_hash(keys, seed))
              .withColumn("_lk", lk).withColumn("_ln", ln)
              .withColumn("_b", F.substring("_h", 1, 3)))
    part = ["_lk", "_ln", "_b"]
    # partial aggregation: at most classes x 4096 rows
    buckets = base.groupBy(*part).agg(F.count(F.lit(1)).alias("_bn"))
    wb = (Window.partitionBy("_lk", "_ln").orderBy("_b")
          .rowsBetween(Window.unboundedPreceding, -1))
    # computed once (one scan of the label and key columns) and reused by the
    # class totals, the quotas and the join: classes x 4096 rows at most
    buckets = cut_lineage(buckets.withColumn("_boff", F.coalesce(F.sum("_bn").over(wb), F.lit(0))))
    wr = Window.partitionBy(*part).orderBy("_h", *keys)
    ranked = base.withColumn("_rn", F.row_number().over(wr) - 1)
    return ranked, buckets


BUCKET_KEYS = ["_lk", "_ln", "_b"]
CLASS_KEYS = ["_lk", "_ln"]


def attach_rank(ranked: DataFrame, buckets: DataFrame, rank_col: str = "class_rank") -> DataFrame:
    """Join the bucket offsets on the window's own partition keys (no further exchange of the big side)."""
    out = (ranked.join(buckets.drop("_bn"), BUCKET_KEYS)
           .withColumn(rank_col, (F.col("_boff") + F.col("_rn")).cast("long")))
    return out.drop("_rn", "_boff")


def class_rank(df: DataFrame, label: str, keys: Sequence[str] | str, seed: int | str = 42,
               rank_col: str = "class_rank") -> DataFrame:
    """0-based rank of each row inside its class, ordered by ``seeded_hash(keys, seed)``."""
    ranked, buckets = ranked_by_class(df, label, keys, seed)
    return attach_rank(ranked, buckets, rank_col).drop("_h", "_lk", "_ln", "_b")


def group_position(df: DataFrame, group: str, order: Sequence[ColumnOrName],
                   pos_col: str = "group_pos", keep_partition: bool = False) -> DataFrame:
    """1-based position inside ``group`` following ``order``, safe when one group is hot.

    The global position over ``(group, order)`` spreads a hot group over many
    range partitions.  Each (range partition, group) slice reports its first
    position (one row per slice: groups + partitions rows at most); a group's
    start is the minimum over its slices.  The start is joined back on
    ``(partition, group)``, a key no group can dominate.  NULL groups are kept
    (null-safe key columns ``_gk``, ``_gn``).
    """
    keyed = (df.withColumn("_gk", F.coalesce(F.col(group).cast("string"), F.lit("")))
               .withColumn("_gn", F.col(group).isNull()))
    pos = with_position(keyed, [F.col(group), *_cols(order)], pos_col="_gpos", keep_partition=True)
    slice_keys = [PID, "_gk", "_gn"]
    slices = (pos.groupBy(*slice_keys).agg(F.min("_gpos").alias("_smin"))
              .withColumn("_gstart", F.min("_smin").over(Window.partitionBy("_gk", "_gn")))
              .select(*slice_keys, "_gstart"))
    out = (pos.join(slices, slice_keys)
           .withColumn(pos_col, (F.col("_gpos") - F.col("_gstart") + 1).cast("long"))
           .drop("_gstart"))
    return out if keep_partition else out.drop(PID, "_gpos", "_gk", "_gn")


_SCAN = {"min": F.min, "max": F.max, "sum": F.sum}


def segmented_scan(df: DataFrame, group: str | Sequence[str], pos: str, value: ColumnOrName, how: str = "min",
                   direction: str = "preceding", out_col: str = "scan") -> DataFrame:
    """Exclusive running ``how`` of ``value`` inside ``group`` along ``pos``.

    ``df`` must carry the range-partition id ``_pid`` produced by
    ``with_position(..., keep_partition=True)`` over ``(group, pos order)``, so
    each (partition, group) slice is contiguous.  A hot group is split across
    partitions: the local scan runs per (partition, group), and each slice gets
    the aggregate of the earlier (or later) slices of its group as carry-in.
    Frames from ``group_position(..., keep_partition=True)`` carry null-safe
    group keys; pass ``group=["_gk", "_gn"]`` to keep NULL groups.
    """
    gk = [group] if isinstance(group, str) else list(group)
    agg = _SCAN[how]
    v = F.col(value) if isinstance(value, str) else value
    base = df.withColumn("_sv", v)
    if direction == "preceding":
        local_frame, carry_frame = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, -1)
    else:
        local_frame, carry_frame = (1, Window.unboundedFollowing), (1, Window.unboundedFollowing)
    local_w = Window.partitionBy(PID, *gk).orderBy(pos).rowsBetween(*local_frame)
    carry_w = Window.partitionBy(*gk).orderBy(PID).rowsBetween(*carry_frame)
    slices = (base.groupBy(PID, *gk).agg(agg("_sv").alias("_slice"))
              .withColumn("_carry", agg("_slice").over(carry_w))
              .select(PID, *gk, "_carry"))
    local = base.withColumn("_local", agg("_sv").over(local_w))
    # same keys as the local window's partitioning: the big side is not re-shuffled
    joined = local.join(slices, [PID, *gk])
    if how == "sum":
        combined = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    elif how == "min":
        combined = F.least("_local", "_carry")
    else:
        combined = F.greatest("_local", "_carry")
    return joined.withColumn(out_col, combined).drop("_sv", "_local", "_carry")
