"""Registered queries of stores that grow and of file order (same contract as ``driver_queries``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scale, split
from ..operators.moments import ScalerState, with_deviation
from ..sources import file_order, io
from ..sources.store import KeyedStore, KeyInStore
from . import jobs
from .driver_queries import FOLDS, LINE_KEYS, SCALE_COLS, SEED, SEQ_LEN, _scratch, events, r6, table

PARTS = ["train", "val", "test"]


def _lines_by_year(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*LINE_KEYS, *SCALE_COLS, F.year("l_shipdate").cast("string").alias("file_key"))


def q_scaler_merged(spark, sf):
    """AGG-20, SCL-4: statistics fitted on the even years' files, saved, opened again and continued with the others."""
    lines, path = _lines_by_year(spark, sf), _scratch(spark, "moments")
    even = F.col("file_key").cast("int") % 2 == 0
    ScalerState(spark, path).add(lines.where(even), SCALE_COLS)
    again = ScalerState(spark, path)
    again.add(lines.where(~even), SCALE_COLS)
    try:
        again.add(lines.where(even), SCALE_COLS)
        refused = False
    except KeyInStore:
        refused = True
    out = with_deviation(again.moments())
    return out.select("column", "n", F.round("mean", 8).alias("mean"), F.round("std_pop", 8).alias("std_pop"), "min", "max", F.lit(refused).alias("refused"))


def q_scaler_continued(spark, sf):
    """SCL-3/4: every row scaled by statistics that came together file by file, by the training years only."""
    lines, path = _lines_by_year(spark, sf), _scratch(spark, "moments")
    train = F.col("file_key").cast("int") < 1997
    first = F.col("file_key").cast("int") < 1996
    ScalerState(spark, path).add(lines.where(first), SCALE_COLS, train)
    state = ScalerState(spark, path)
    state.add(lines, SCALE_COLS, train, existing="skip")
    out = scale.apply_scaler(lines.drop("file_key"), state.scaler(), SCALE_COLS)
    return out.select(*LINE_KEYS, *[r6(c).alias(c) for c in SCALE_COLS])


def q_keyed_append(spark, sf):
    """SNK-1 mode a, JOB-5: files appended one after the other, the job dies before the second is published, and is run again."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.quarter("o_orderdate").cast("string").alias("file_key"))
    path = _scratch(spark, "store")

    def job(dies_at=None):
        store = KeyedStore(spark, path, partition_by=["o_orderstatus"])
        for key in ("1", "2", "3", "4"):
            part = orders.where(F.col("file_key") == key)
            if key == dies_at:
                store.write_attempt(part)
                return
            store.append(part)

    job(dies_at="2")
    job()
    return KeyedStore(spark, path).read().select("o_orderkey", "o_totalprice", "o_orderstatus", "file_key")


CSV_SCHEMA = "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_comment string"


def q_csv_by_name(spark, sf):
    """SRC-1/2/3: plain and gzip exports with swapped, padded and surplus columns, typed by name."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    path = _scratch(spark, "csv")
    part = F.col("o_orderkey") % 3

    def export(df, name, **options):
        df.write.option("header", True).options(**options).csv(f"{path}/{name}")

    export(o.where(part == 0).select("o_orderkey", "o_totalprice", "o_orderstatus"), "a")
    export(o.where(part == 1).select("o_orderstatus", F.col("o_totalprice").alias(" o_totalprice "), "o_custkey", "o_orderkey"), "b", compression="gzip")
    export(o.where(part == 2).select("o_totalprice", "o_orderkey"), "c", compression="gzip")
    back = io.read_csv(spark, [f"{path}/{x}" for x in "abc"], schema=T.StructType.fromDDL(CSV_SCHEMA), strip_names=True)
    return back.drop("file_key")


def _line_exports(spark, sf) -> tuple[list[str], str]:
    """Stand-in input: line items as a CSV export a shipping year, one with its columns in another order."""
    path = _scratch(spark, "exports")
    li = table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"), F.lit("10.0.0.1").alias("Src IP"),
        F.when(F.col("l_linenumber") == 7, "Dst Port").otherwise(F.col("l_linenumber").cast("string")).alias("Dst Port"),
        *LINE_KEYS, F.col("l_quantity").alias(" Flow Size"),
        F.when(F.col("l_tax") == 0.08, "Infinity").otherwise(F.col("l_extendedprice").cast("string")).alias("Flow Rate"),
        F.col("l_returnflag").alias("Label"), F.year("l_shipdate").alias("y"))
    swapped = F.col("y") == 1997
    li.where(~swapped).write.option("header", True).partitionBy("y").csv(path)
    li.where(swapped).select("Label", *[c for c in li.columns if c != "Label"]).write.mode("append").option("header", True).partitionBy("y").csv(path)
    return [f"{path}/y=1995", f"{path}/y=1996", f"{path}/y=*"], path


_LINE_ORDER = ["Timestamp", *LINE_KEYS]


def _staged(spark, sf) -> KeyedStore:
    """JOB-5 over the exports: the first two are staged, the next attempt dies unpublished, then all are staged."""
    files, path = _line_exports(spark, sf)
    year = F.regexp_extract(F.col("file_key"), r"/y=(\d{4})/[^/]*$", 1)
    jobs.stage_ids18(spark, files[:2], f"{path}-store", key=year, order=_LINE_ORDER)
    KeyedStore(spark, f"{path}-store").write_attempt(spark.createDataFrame([("1998", -1)], "file_key string, idx long"))
    return jobs.stage_ids18(spark, files[2:], f"{path}-store", key=year, order=_LINE_ORDER)


def q_staged_files(spark, sf):
    """JOB-5: CSV exports cleaned into the keyed store by a job that is run again; each row with its place in its file."""
    rows = _staged(spark, sf).read()
    return rows.select("file_key", "idx", *[F.col(k).cast("long").alias(k) for k in LINE_KEYS], "label", r6("Flow Size").alias("size"), r6("Flow Rate").alias("rate"))


def q_staged_sample(spark, sf):
    """JOB-7: every fifth staged row in (file, place) order."""
    return jobs.staged_every_kth(_staged(spark, sf), 0.2).select(*[F.col(k).cast("long").alias(k) for k in LINE_KEYS], "pos")


def q_staged_prepare(spark, sf):
    """JOB-6: staged rows split by a manifest, fetched by bitmaps, scaled by statistics kept by file, written by split and file."""
    store = _staged(spark, sf)
    out = jobs.prepare_staged(spark, store, _scratch(spark, "staged"), keys=LINE_KEYS, drop=[*LINE_KEYS, "Dst Port"])
    return out.select(*[F.col(k).cast("long").alias(k) for k in LINE_KEYS], "split", "label", "file_key",
                      F.round(F.col("features")[0], 6).alias("size"), F.round(F.col("features")[1], 6).alias("rate"))


def _in_files(df: DataFrame, order: list, name: str) -> str:
    """Stand-in input: a table as Parquet files that lie in ``order``."""
    path = _scratch(df.sparkSession, name)
    df.repartitionByRange(5, *order).sortWithinPartitions(*order).write.parquet(path)
    return path


def q_file_order_sample(spark, sf):
    """SMP-1, JOB-7: every fifth row in file order, no row moved."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey")
    index = file_order.FileIndex(spark, _in_files(o, ["year", "o_orderkey"], "orders"))
    return index.every_kth(0.2).select("o_orderkey", "pos")


def q_file_order_sequences(spark, sf):
    """WIN-1/2: sequences of 32 rows in file order, only rows at block edges moved."""
    e = events(spark, sf).select("event_id", "ts", "event_type")
    index = file_order.FileIndex(spark, _in_files(e, ["ts", "event_id"], "events"))
    seqs = index.sequences(SEQ_LEN, ["event_id", "event_type"])
    return seqs.select("seq", F.size("steps").cast("long").alias("n_steps"),
                       F.col("steps")[0]["event_id"].alias("first_event_id"),
                       F.element_at("steps", -1)["event_id"].alias("last_event_id"),
                       F.array_join(F.transform("steps", lambda s: s["event_type"]), ",").alias("labels"))


def q_file_order_folds(spark, sf):
    """WIN-4, SNK-3: contiguous folds in file order."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return file_order.FileIndex(spark, _in_files(o, ["o_orderkey"], "orders")).folds(FOLDS).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


def q_manifest_bitmaps(spark, sf):
    """SPL-3, JOIN-2, JOB-6: a split of a narrow manifest, its wide rows fetched by bitmaps of row indexes."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    index = file_order.FileIndex(spark, _in_files(o, ["o_custkey", "o_orderkey"], "orders"))
    manifest = file_order.scan(spark, index.paths).select("_file", "_row", "o_orderkey", F.col("o_orderpriority").alias("label"))
    parted = split.stratified_split(manifest, "label", ["o_orderkey"], [0.6, 0.2, 0.2], PARTS, seed=SEED)
    return file_order.fetch(index, parted, PARTS).select("o_orderkey", "split", "o_totalprice", "o_custkey")


QUERIES = {
    "csv_by_name": q_csv_by_name,
    "scaler_merged": q_scaler_merged,
    "scaler_continued": q_scaler_continued,
    "keyed_append": q_keyed_append,
    "staged_files": q_staged_files,
    "staged_sample": q_staged_sample,
    "staged_prepare": q_staged_prepare,
    "file_order_sample": q_file_order_sample,
    "file_order_sequences": q_file_order_sequences,
    "file_order_folds": q_file_order_folds,
    "manifest_bitmaps": q_manifest_bitmaps,
}
