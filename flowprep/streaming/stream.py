"""Streaming use of the row-wise operators.

The reference is batch only.  Its cleaning, label mapping and scaling are
stateless per row, so the same functions apply to a streaming DataFrame: a
flow stream can be cleaned and scaled with statistics fitted on a batch
table, and written with ``foreachBatch``.  Nothing here keeps state across
micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, labels, scale


def read_stream_parquet(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def clean_stream(stream: DataFrame, label_col: str, numeric: Sequence[str],
                 mapping: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """FLT-1/3, CLN-1/2/5 on a stream: label text cleaned, rare labels dropped, ±Inf/NaN rows dropped."""
    out = stream.withColumn(label_col, clean.clean_label_text(label_col))
    if drop:
        out = clean.drop_classes(out, label_col, drop)
    if mapping:
        out = labels.map_labels(out, label_col, mapping)
    return clean.drop_invalid_rows(out, list(numeric))


def scale_stream(stream: DataFrame, stats: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """SCL-3 on a stream: stats are a one-row batch table fitted beforehand (stream-static join)."""
    return scale.apply_scaler(stream, stats, columns, kind)


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  trigger_once: bool = True):
    """Run ``sink(batch_df, epoch_id)`` per micro-batch; the checkpoint folder makes it restartable."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def stream_label_counts(stream: DataFrame, label_col: str) -> DataFrame:
    """AGG-1 as a running streaming aggregate (complete output mode)."""
    return stream.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
