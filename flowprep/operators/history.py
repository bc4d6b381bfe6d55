"""Training-history operators (WIN-5..7, SNK-6).

A history is ``(run, epoch, loss, ...)``.  Best and goal epochs are plain
per-run aggregates.  The early-stop epoch needs, for each epoch, the best loss
seen before it and the next improving epoch after it: both are running
aggregates inside a run, computed with ``segmented_scan`` so a very long run is
spread over many tasks instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .position import group_position, segmented_scan


def number_epochs(df: DataFrame, run: str, order: Sequence[str | Column], epoch_col: str = "epoch",
                  keep_partition: bool = False) -> DataFrame:
    """1-based epoch number inside each run following ``order`` (skew-safe)."""
    return group_position(df, run, order, epoch_col, keep_partition=keep_partition)


def best_epoch(hist: DataFrame, run: str, epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """WIN-5: first epoch with the lowest loss: ``(run, best_epoch, best_loss)``."""
    best = F.min_by(F.col(epoch), F.struct(F.col(loss), F.col(epoch)))
    return hist.where(F.col(loss).isNotNull()).groupBy(run).agg(
        best.alias("best_epoch"), F.min(loss).alias("best_loss"))


def goal_epoch(hist: DataFrame, run: str, metric: str, goal: float, epoch: str = "epoch") -> DataFrame:
    """WIN-7: first epoch whose metric reaches ``goal``; NULL when never reached."""
    return hist.groupBy(run).agg(F.min(F.when(F.col(metric) >= goal, F.col(epoch))).alias("goal_epoch"),
                                 F.max(epoch).alias("n_epochs"))


def early_stop_epoch(hist: DataFrame, run: str, patience: int, epoch: str = "epoch",
                     loss: str = "val_loss") -> DataFrame:
    """WIN-6: epoch at which patience-based early stopping ends a run (NULL: never).

    An epoch improves when its loss is strictly below every earlier loss.
    Training stops at ``i + patience`` for the first improving epoch ``i`` with
    no improvement in ``(i, i + patience]``, if the run is that long.  Only
    active when ``0 < patience``.

    ``hist`` must carry ``_pid`` from ``number_epochs(..., keep_partition=True)``
    (range partitions over ``(run, epoch)``).
    """
    keys = ["_gk", "_gn"] if "_gk" in hist.columns else run
    hist = cut_lineage(hist)  # both scans and the epoch counts read the numbered epochs, none numbers them anew
    prev = segmented_scan(hist, keys, epoch, loss, "min", "preceding", "_prev_min")
    rec = prev.withColumn("_improved", F.col("_prev_min").isNull() | (F.col(loss) < F.col("_prev_min")))
    rec = rec.withColumn("_rec_epoch", F.when(F.col("_improved"), F.col(epoch)))
    nxt = segmented_scan(rec, keys, epoch, "_rec_epoch", "min", "following", "_next_rec")
    n_epochs = hist.groupBy(run).agg(F.max(epoch).alias("n_epochs"))
    stop_at = F.col(epoch) + patience
    cand = (nxt.where(F.col("_improved"))
            .where(F.col("_next_rec").isNull() | (F.col("_next_rec") > stop_at))
            .groupBy(run).agg(F.min(stop_at).alias("_stop")))
    active = patience > 0
    out = n_epochs.join(cand, run, "left")
    stop = F.when(F.lit(active) & (F.col("_stop") <= F.col("n_epochs")), F.col("_stop"))
    return out.select(run, "n_epochs", stop.cast("long").alias("stop_epoch"))


def history_frame(spark, run_id: str, train_loss: Sequence[float], val_loss: Sequence[float] | None = None,
                  val_f1: Sequence[float] | None = None) -> DataFrame:
    """SNK-6 input: one history; missing series are zeros."""
    n = len(train_loss)
    vl = list(val_loss) if val_loss is not None else [0.0] * n
    vf = list(val_f1) if val_f1 is not None else [0.0] * n
    rows = [(run_id, i + 1, float(train_loss[i]), float(vl[i]), float(vf[i])) for i in range(n)]
    return spark.createDataFrame(rows, "run string, epoch int, train_loss double, val_loss double, val_f1 double")


def save_history(hist: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-6: write ``(epoch, train_loss, val_loss, val_f1)`` per run, NULL series as 0."""
    cols = [c for c in ("train_loss", "val_loss", "val_f1") if c in hist.columns]
    out = hist.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in hist.columns])
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)
