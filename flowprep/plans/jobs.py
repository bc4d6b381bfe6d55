"""Whole jobs (JOB-1..10): preparation of labelled flow tables and experiment runs.

Each preparation job is one lazy plan ending in one partitioned write; the
only other actions are the category-value list (ENC-1, bounded) and the
checkpoint inside the position helper when row order matters.  The out-of-core
two-stage design of the reference (per-file cleaning, then a manifest split
and a streaming scaler) collapses into partial aggregation + a join.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import col_
from ..operators import clean, encode, labels, models, scale, sequence, split
from ..operators.moments import ScalerState
from ..operators.position import group_position, with_position
from ..session import cut_lineage
from ..sources import file_order, io
from ..sources.store import KeyedStore
from .spec import read_specs, typed_specs, with_defaults

META = ("row_id", "split", "label", "file_key")


def feature_columns(df: DataFrame, meta: Sequence[str] = META) -> list[str]:
    return [c for c in df.columns if c not in meta]


def pack_features(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Wide numeric columns -> one ``array<double>`` (keeps rows inside codegen's field limit)."""
    keep = [col_(c) for c in df.columns if c not in set(cols)]
    return df.select(*keep, F.array(*[col_(c).cast("double") for c in cols]).alias(out))


def scale_and_pack(df: DataFrame, kind: str = "standard", materialize: bool = True) -> DataFrame:
    """SCL-1/3/4: fit on ``split = 'train'`` rows, scale every split, pack features.

    The split table feeds both the fit and the scaled output; ``materialize``
    writes it once to the checkpoint folder so the split's shuffle runs once
    (and the long lineage is cut before the final write).
    """
    if materialize:
        df = cut_lineage(df)
    cols = feature_columns(df)
    scaled = scale.fit_and_scale(df, cols, F.col("split") == "train", kind)
    return pack_features(scaled, cols)


def prepare_kdd(spark: SparkSession, train_paths: Sequence[str], out: str, *, nsl: bool = False,
                test_paths: Sequence[str] | None = None, five_classes: bool = False,
                rates: Sequence[float] | None = None, drop_rare: bool = False, seed: int = 42,
                expected_classes: int | None = None) -> DataFrame:
    """JOB-1/2/3: KDD'99 10 %, KDD'99 full (5 classes) and NSL-KDD (5 classes)."""
    n_cols = 43 if nsl else 42
    schema = io.positional_schema(n_cols, string_cols=[1, 2, 3, 41] if nsl else [1, 2, 3, 41])

    def load(paths):
        df = io.read_csv(spark, paths, header=False, schema=schema, na_values=None).drop("file_key")
        if nsl:
            df = clean.drop_last_column(df)                   # PRJ-3 difficulty score
        return clean.features_and_label_by_position(df)      # PRJ-1

    train = load(train_paths)
    if drop_rare:
        train = clean.drop_classes(train, "label", labels.KDD_SMALL_RARE_CLASSES)   # FLT-1
    if five_classes:
        fam = labels.add_suffixed_keys(labels.KDD_FAMILY_MAP, ".")                  # CLN-6
        train = labels.map_labels(train, "label", fam)                              # CLN-5
    frames = [train]
    test = None
    if test_paths:
        test = load(test_paths)
        if five_classes:
            test = labels.map_labels(test, "label", fam)
        frames.append(test)
    if expected_classes is not None:
        for f in frames:
            clean.assert_class_count(f, "label", expected_classes)                  # CHK-1
    encoded = encode.one_hot_encode(frames, ["c1", "c2", "c3"])                      # ENC-1/2
    # row ids by content: the same for any split of the files into tasks, unique over train and test
    both = encoded[0].withColumn("_test", F.lit(0))
    if test is not None:
        both = both.unionByName(encoded[1].withColumn("_test", F.lit(1)))
    both = io.with_stable_row_id(both, first=["_test"])
    train = both.where("_test = 0").drop("_test")
    rates = list(rates or ([0.8, 0.2] if test_paths else [0.6, 0.2, 0.2]))
    names = ["train", "val"] if test_paths else ["train", "val", "test"]
    parted = split.stratified_split(train, "label", "row_id", rates, names, seed)  # SPL-1
    if test is not None:
        t = both.where("_test = 1").drop("_test").withColumn("split", F.lit("test"))
        t = clean.drop_unseen_classes(parted.where(F.col("split") == "train"), t, "label")  # FLT-4
        parted = parted.unionByName(t)                                               # SPL-7
    prepared = scale_and_pack(parted)
    io.write_prepared(prepared, out)                                                  # SNK-1
    return spark.read.parquet(out)


# Columns of the second data set that are not features.
IDS18_DROP = ["Protocol", "Timestamp", "Flow ID", "Src IP", "Src Port", "Dst IP"]


def prepare_ids17(spark: SparkSession, paths: Sequence[str], out: str, *, subset: float | None = None,
                  seed: int = 42) -> DataFrame:
    """JOB-4: header CSVs, label text cleaning, ±Inf/NaN rows dropped, rare classes dropped, 60/20/20."""
    raw = io.read_csv(spark, paths, header=True, strip_names=True)
    df = raw.withColumnRenamed("Label", "label").withColumn("label", clean.clean_label_text("label"))  # CLN-1/2
    df = clean.cast_text_columns(df.drop("file_key"), skip=["label"])               # CLN-3/4
    df = clean.drop_invalid_rows(df)                                                 # FLT-3
    df = clean.drop_classes(df, "label", labels.IDS2017_RARE_CLASSES)                # FLT-1
    df = io.with_stable_row_id(df)
    if subset:
        df = split.stratified_subset(df, "label", "row_id", subset, seed)           # SMP-4
    parted = split.stratified_split(df, "label", "row_id", [0.6, 0.2, 0.2], seed=seed)
    prepared = scale_and_pack(parted)
    io.write_prepared(prepared, out)
    return spark.read.parquet(out)


def prepare_ids18(spark: SparkSession, paths: Sequence[str], out: str, *, every_kth: float | None = None,
                  seed: int = 42) -> DataFrame:
    """JOB-5/6/7: per-day CSVs with differing columns -> cleaned, split on a narrow manifest,
    scaler fitted on train rows, rows fetched back and written per split and source file.

    ``every_kth`` (e.g. 0.2) keeps every ceil(1/rate)-th row in (file, timestamp text) order first (JOB-7).
    """
    df = io.read_csv(spark, paths, header=True, strip_names=True)                    # SRC-2, by name
    unused = [c for c in IDS18_DROP if c != "Timestamp"]
    df = clean.drop_if_present(df, unused)                                           # PRJ-4: before the rows are moved
    # SRT-1: order inside a file by the timestamp *text*; the row's content breaks ties
    df = io.with_stable_row_id(df, first=["file_key", "Timestamp"])
    df = clean.drop_if_present(df, IDS18_DROP)
    df = clean.keep_numeric_text(df, ["Dst Port"])                                   # FLT-2
    df = df.withColumnRenamed("Label", "label")
    df = clean.cast_text_columns(df, skip=["label", "file_key"])                    # CLN-4
    df = clean.drop_invalid_rows(df)                                                 # FLT-3
    if every_kth:
        k = split.sample_step(every_kth)
        df = with_position(df, ["row_id"], "_kpos").where(F.col("_kpos") % k == 0).drop("_kpos")  # SMP-1
    # SPL-3 in the reference splits a narrow (file, index, label) manifest and fetches
    # the wide rows back (JOIN-2) to bound memory.  In Spark the class-rank window
    # already shuffles each row once and spills; splitting the wide rows directly
    # saves the manifest shuffle and the join (``split.split_manifest`` keeps the
    # late-materialised form for callers that only hold a manifest).
    parted = split.stratified_split(df, "label", "row_id", [0.6, 0.2, 0.2], seed=seed)
    prepared = scale_and_pack(parted)
    io.write_prepared(prepared, out, partition_by=("split", "file_key"))            # SNK-4
    return spark.read.parquet(out)


def stage_ids18(spark: SparkSession, paths: Sequence[str], store_path: str, *, key: Column | None = None,
                order: Sequence[str] = ("Timestamp",), files_each: int = 50) -> KeyedStore:
    """JOB-5: per-day CSVs with differing columns -> cleaned rows in a keyed store, ``files_each`` files an append.

    Files whose key is in the store are not read; a run that died is run again and goes on with the files
    that are not.  ``idx`` is a row's place among the file's rows (SRT-1: by ``order``, timestamps as
    text; the row's content breaks ties).  ``key`` (of the column ``file_key``, the full path) names a file; all files
    of one key have to come in one append.
    """
    store = KeyedStore(spark, store_path)
    named = F.col("file_key") if key is None else key
    whole = F.regexp_replace("path", "^file:/+", "file:///")
    files = io.list_files(spark, paths).select("path", whole.alias("file_key")).select("path", named.alias("file_key"))
    done = store.committed()
    if done is not None:
        files = files.join(done.select("file_key"), "file_key", "left_anti")
    todo = [r["paths"] for r in files.groupBy("file_key").agg(F.collect_list("path").alias("paths")).orderBy("file_key").collect()]
    for i in range(0, len(todo), files_each):
        df = io.read_csv(spark, [p for group in todo[i : i + files_each] for p in group], header=True, strip_names=True)
        df = df.withColumn("file_key", named).withColumnRenamed("Label", "label")
        df = clean.drop_if_present(df, [c for c in IDS18_DROP if c != "Timestamp"])      # PRJ-4
        df = clean.keep_numeric_text(df, ["Dst Port"])                                   # FLT-2
        df = clean.cast_text_columns(df, skip=["label", "file_key", "Timestamp"])       # CLN-4
        df = clean.missing_non_finite(df)                                                # FLT-3: to missing
        whole = df.columns
        content = F.md5(F.to_json(F.struct(*[col_(c) for c in whole])))
        # Text is parsed once: a filter on the parsed values would be pushed below the parsing and repeat it for every
        # place that it names them, and the range partitioning reads its input twice.
        df = cut_lineage(df.withColumn("_content", content).withColumn("_scan", F.monotonically_increasing_id()))
        df = df.na.drop("any", subset=[f"`{c}`" for c in whole])                         # FLT-3: rows with missing values go
        df = group_position(df, "file_key", [*[col_(c) for c in order], F.col("_content"), F.col("_scan")], "idx")
        df = df.withColumn("idx", F.col("idx") - 1)
        store.append(clean.drop_if_present(df, ["Timestamp", "_content", "_scan"]))      # SNK-1 mode a
    return store


def staged_every_kth(store: KeyedStore, rate: float, pos_col: str = "pos") -> DataFrame:
    """JOB-7: rows 0, k, 2k, ... of a staged store in (file, idx) order.

    The store's ledger tells the rows of each file: a file's offset is the sum over the files before it, and no row is moved.
    """
    earlier = Window.orderBy("file_key").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = store.committed().select("file_key", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_offset"))
    rows = store.read().join(offsets, "file_key")
    return rows.withColumn(pos_col, F.col("_offset") + F.col("idx")).drop("_offset").where(F.col(pos_col) % split.sample_step(rate) == 0)


def prepare_staged(spark: SparkSession, store: KeyedStore, out: str, *, keys: Sequence[str] = ("file_key", "idx"),
                   drop: Sequence[str] = (), rates: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """JOB-6: a staged store -> split, scaled on train rows, written per split and source file.

    A narrow manifest (file, row, ``keys``, label) is split (SPL-3); its parts become bitmaps that go to the scan of the
    wide rows (JOIN-2).  The scaler's statistics are kept by file in ``out``/_scaler, so a store that has grown
    is continued: only files that are not in it are read for the fit.  Split sizes belong to
    the rows of the store as it is, so a grown store is split anew.  ``drop`` are columns that are no features; kept beside them.
    """
    parts = ["train", "val", "test"]
    rows, folders = store.source()
    index = file_order.FileIndex(spark, folders, rows.schema, f"{store.path}/data")
    wide = index.scan()
    manifest = wide.select("_file", "_row", "label", *keys)
    parted = cut_lineage(split.stratified_split(manifest, "label", list(keys), rates, parts, seed).select("_file", "_row", "split"))
    fetched = file_order.fetch(index, parted, parts).drop(*file_order.PLACE)
    skip = {"label", "file_key", "idx", "split", "store_attempt", *drop}
    features = [c for c in fetched.columns if c not in skip]
    state = ScalerState(spark, f"{out}/_scaler")
    state.add(fetched, features, F.col("split") == "train", existing="skip")             # AGG-20, SCL-4
    scaled = scale.apply_scaler(fetched.drop("store_attempt"), state.scaler(), features)  # SCL-3
    packed = pack_features(scaled, features)
    io.write_prepared(packed, f"{out}/rows", partition_by=("split", "file_key"))         # SNK-4
    return spark.read.schema(packed.schema).parquet(f"{out}/rows")


def prepare_tabular(spark: SparkSession, path: str, merge_val: bool = False):
    """JOB-8: prepared table -> (optionally) train+val merged -> label codes (ENC-3/4)."""
    data = io.read_prepared(spark, path)
    io.require_rows(data.where(F.col("split") == "train"))
    if merge_val:
        data = split.merge_validation(data)                                          # SPL-6
    codes = encode.fit_label_codes(data)
    return data, codes


def prepare_sequences(spark: SparkSession, path: str, length: int = 32, merge_val: bool = False):
    """JOB-9: per split, consecutive rows (row_id order) cut into sequences of ``length``."""
    data, codes = prepare_tabular(spark, path, merge_val)
    seqs = sequence.flow_sequences_by(data, "split", ["row_id"], length, ["row_id", "label", "features"])
    return seqs, codes


def run_experiment(spark: SparkSession, params: Mapping[str, object], report_dir: str | None = None) -> dict:
    """JOB-10 for one typed spec row: actions train_test, test_only, compute_prediction_time,
    stat_test_2_models (the last two need stored models).

    ``model_location`` / ``model2_location`` (or ``model_path`` / ``model_path_2``) name model folders;
    ``class_weights`` 1 weighs rows by AGG-18; ``unsupervised_ratio`` leaves that share of train out of the
    fit (SPL-4), ``dataset_split_ratio`` keeps the later part of train only (SPL-5).
    """
    action = params.get("action", "train_test")
    path1 = params.get("model_path", params.get("model_location"))
    path2 = params.get("model_path_2", params.get("model2_location"))
    data, codes = prepare_tabular(spark, str(params["dataset_dir"]),
                                  params.get("training_set") == "train_valid_concat")
    prepared = cut_lineage(models.prepare_labelled(data, codes).drop("fvec"))
    prepared = models.with_vector(prepared)
    normal = params.get("normal_label")
    result: dict = {"action": action}
    if action in ("train_test", "test_only"):
        if action == "train_test":
            name = str(params.get("model", "rf"))
            fit_on = prepared.where(F.col("split") == "train")
            fit_on = split.data_efficiency_subset(fit_on, "label", "row_id", float(params.get("dataset_split_ratio") or 0))
            if params.get("unsupervised_ratio") is not None:
                fit_on = split.two_part_roles(fit_on, "label", "row_id", float(params["unsupervised_ratio"]))
                fit_on = fit_on.where(F.col("role") != "unsup").drop("role")
            wanted = {**params, **dict(params.get("model_params", {}))}
            if str(params.get("class_weights", "0")) in ("1", "1.0", "True", "true"):
                fit_on = labels.with_class_weight(fit_on, "label")
                wanted["weight_col"] = "weight"
            width = data.select(F.size("features")).first()[0]
            est = models.create_model(name, **models.model_params(name, wanted, width, codes.count()))
            model, took = models.train(est, fit_on, str(path1) if path1 else None)
            result["train_seconds"] = took
        else:
            model = models.load_model(str(path1))
        tables = models.test_classifier(model, prepared, codes, normal=str(normal) if normal else None)
        if report_dir:
            io.write_report(tables, report_dir, str(params.get("experiment_num", "run")))
        result["tables"] = tables
    elif action == "compute_prediction_time":
        from ..operators.stats import prediction_timing
        model = models.load_model(str(path1))
        n = int(params.get("num_samples", 100000))
        reps = int(params.get("repetitions", 6))
        train = prepared.where(F.col("split") == "train").withColumn("_k", F.col("row_id").cast("string"))
        samples = [split.hash_sample(train, "_k", n, seed=i) for i in range(1, reps + 1)]   # SMP-2
        result["timing"] = prediction_timing(lambda f: model.transform(f), samples)
    elif action == "stat_test_2_models":
        m1 = models.load_model(str(path1))
        m2 = models.load_model(str(path2))
        test = prepared.where(F.col("split") == "test")
        s1 = models.score(m1, test, codes, keep=["row_id", "label"]).withColumnRenamed("label", "y_true")
        s2 = models.score(m2, test, codes, keep=["row_id"])
        result["folds"], result["ttest"] = models.statistical_test(s1, s2, ["row_id"], "row_id")
    else:
        raise ValueError(f"unknown action {action!r}")
    return result


def grid_params(spark: SparkSession, spec_path: str) -> list[dict]:
    """SRC-7 + CLN-8/9: one dict of typed, defaulted parameters per row of the spec file (a list of experiments)."""
    rows: dict[str, dict] = {}
    for r in typed_specs(with_defaults(read_specs(spark, spec_path))).collect():
        out = rows.setdefault(r["experiment_num"], {"experiment_num": r["experiment_num"]})
        one = lambda x, text: x["int_value"] if x["kind"] == "int" else x["float_value"] if x["kind"] == "float" else text
        if r["kind"] == "list":
            out[r["key"]] = [one(i, i["text"]) for i in r["items"]]
        elif r["kind"] is not None:
            out[r["key"]] = one(r, r["raw"])
    return list(rows.values())


def run_grid(spark: SparkSession, spec_path: str, report_dir: str | None = None) -> dict[str, dict]:
    """JOB-10: every experiment of the spec file, in file order; results by experiment number."""
    return {str(p["experiment_num"]): run_experiment(spark, p, report_dir) for p in grid_params(spark, spec_path)}
