"""Registered queries over the driver tables, Spark side.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables.  The matching DuckDB SQL lives in ``oracle.py`` with the same column
names.  Computed doubles are rounded to 6 places where two engines may differ
in the last bits (averages, sums, square roots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import parse_number
from ..operators import clean, encode, history, labels, metrics, scale, sequence, split, stats
from ..operators.position import with_position
from ..session import cut_lineage

# Fixed query parameters shared with oracle.py
EVENT_CUTOFF = "2024-01-16 00:00:00"
SHIP_CUTOFF = "1998-01-01 00:00:00"
EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]
RARE_PART_TYPES = ["ECONOMY", "SMALL"]
EVENT_FAMILY = {"click": "engagement", "view": "engagement", "purchase": "conversion", "signup": "conversion"}
SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SEQ_LEN = 32
FOLDS = 10
CHUNKS = 7
PATIENCE = 5
GOAL = 99.0
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def _split_col() -> Column:
    return F.when(F.col("ts") < F.lit(EVENT_CUTOFF).cast("timestamp_ntz"), "train").otherwise("test")


def _rule(scale_: float) -> Column:
    idx = (F.floor(F.col("value") * scale_).cast("int") % len(EVENT_LABELS)) + 1
    return F.element_at(F.array(*[F.lit(x) for x in EVENT_LABELS]), idx)


def scored_events(spark, sf) -> DataFrame:
    """Events with a true label and two rule predictors (stand-ins for model output)."""
    return events(spark, sf).select("event_id", "ts", "user_id", "value", F.col("event_type").alias("y_true"),
                                    _rule(1.0).alias("y_pred"), _rule(3.0).alias("y_pred2"),
                                    _split_col().alias("split"))


# ------------------------------------------------------------------ labels

def q_label_counts(spark, sf):
    return labels.label_counts(events(spark, sf), "event_type")


def q_label_counts_union(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("label"))
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))
    return labels.label_counts_union([e, o])


def q_drop_rare_classes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return clean.drop_classes(p, "p_type", RARE_PART_TYPES)


def q_drop_unseen_classes(spark, sf):
    e = events(spark, sf).withColumn("split", _split_col())
    train = e.where((F.col("split") == "train") & (F.col("event_type") != "error"))
    test = e.where(F.col("split") == "test").select("event_id", "event_type")
    return clean.drop_unseen_classes(train, test, "event_type")


def q_map_labels(spark, sf):
    mapping = labels.add_suffixed_keys(EVENT_FAMILY, ".")
    e = events(spark, sf).select(
        "event_id", F.when(F.col("value") >= 50, F.concat("event_type", F.lit("."))).otherwise(F.col("event_type"))
        .alias("label"))
    return labels.map_labels(e, "label", mapping, "family")


def q_binary_labels(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", labels.to_binary_labels("event_type", "view").alias("binary_label"))


def q_class_weights(spark, sf):
    return labels.class_weights(events(spark, sf), "event_type")


# ------------------------------------------------------------------ cleaning

def q_ascii_labels(spark, sf):
    d = table(spark, sf, "documents")
    cleaned = clean.clean_label_text("text")
    return d.select("doc_id", F.md5(cleaned).alias("text_md5"), F.length(cleaned).cast("long").alias("n_chars_clean"))


def _number_candidates(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    e = events(spark, sf)
    return (o.select(F.col("o_orderkey").alias("id"), F.lit("priority").alias("src"), F.col("o_orderpriority").alias("x"))
            .unionByName(o.select(F.col("o_orderkey").alias("id"), F.lit("custkey").alias("src"),
                                  F.col("o_custkey").cast("string").alias("x")))
            .unionByName(e.select(F.col("event_id").alias("id"), F.lit("props").alias("src"), F.col("props").alias("x")))
            .unionByName(e.select(F.col("event_id").alias("id"), F.lit("value").alias("src"),
                                  F.col("value").cast("string").alias("x"))))


def q_non_numeric_rows(spark, sf):
    kept = clean.keep_numeric_text(_number_candidates(spark, sf), ["x"])
    return kept.select("id", "src", "x", parse_number("x").alias("num"))


def _ratio_frame(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    nan, inf = float("nan"), float("inf")
    r1 = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(nan)).otherwise(F.lit(inf))) \
        .otherwise(F.col("l_discount") / F.col("l_tax"))
    r2 = F.when(F.col("l_discount") == 0, F.lit(-inf)).otherwise(F.col("l_tax") / F.col("l_discount"))
    return li.select(*LINE_KEYS, "l_returnflag", r1.alias("r1"), r2.alias("r2"))


def q_invalid_values(spark, sf):
    cleaned = clean.drop_invalid_rows(_ratio_frame(spark, sf), ["r1", "r2"])
    return cleaned.select(*LINE_KEYS, "r1", "r2")


def q_cleaning_report(spark, sf):
    raw = _ratio_frame(spark, sf)
    flag = F.col("l_returnflag")
    return clean.filter_report(raw, [("drop_invalid", clean.valid_row(["r1", "r2"])),
                                     ("drop_rare", flag.isNull() | ~flag.isin("A"))])


def q_text_time_sort(spark, sf):
    e = events(spark, sf).select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("ts_text"))
    return with_position(e, ["ts_text", "event_id"], "pos")


# ------------------------------------------------------------------ encoding

def q_dummy_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_KEYS, "l_returnflag", "l_linestatus", "l_shipdate")
    cut = F.lit(SHIP_CUTOFF).cast("timestamp_ntz")
    train, test = li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)
    enc_train, enc_test = encode.one_hot_encode([train, test], ["l_returnflag", "l_linestatus"])
    return enc_train.unionByName(enc_test).drop("l_shipdate")


def _codes(spark, sf):
    e = events(spark, sf)
    return e, encode.fit_label_codes(e, label_col="event_type")


def q_label_codes(spark, sf):
    e, codes = _codes(spark, sf)
    return encode.encode_labels(e.select("event_id", "event_type"), codes, "event_type")


def q_label_onehot(spark, sf):
    e, codes = _codes(spark, sf)
    coded = encode.encode_labels(e.select("event_id", "event_type"), codes, "event_type")
    oh = encode.onehot_labels(coded, codes)
    return oh.select("event_id", F.array_join(F.transform("onehot", lambda x: x.cast("string")), ",").alias("onehot"))


def q_label_decode(spark, sf):
    e, codes = _codes(spark, sf)
    pred = e.select("event_id", _rule(1.0).alias("pred_label"))
    coded = encode.encode_labels(pred, codes, "pred_label", "pred_code")
    return encode.decode_labels(coded.select("event_id", "pred_code"), codes, "pred_code", "label_decoded")


def _scaled(spark, sf, kind: str):
    li = table(spark, sf, "lineitem").select(*LINE_KEYS, *SCALE_COLS, "l_shipdate")
    fit_on = F.col("l_shipdate") < F.lit(SHIP_CUTOFF).cast("timestamp_ntz")
    stats_ = scale.fit_scaler(li, SCALE_COLS, fit_on)
    out = scale.apply_scaler(li.drop("l_shipdate"), stats_, SCALE_COLS, kind)
    return out.select(*LINE_KEYS, *[r6(c).alias(c) for c in SCALE_COLS])


def q_standard_scale(spark, sf):
    return _scaled(spark, sf, "standard")


def q_minmax_scale(spark, sf):
    return _scaled(spark, sf, "min_max")


def q_scaler_stats(spark, sf):
    li = table(spark, sf, "lineitem")
    st = scale.scaler_stats_long(scale.fit_scaler(li, SCALE_COLS), SCALE_COLS)
    return st.select("column", r6("mean").alias("mean"), r6("std_pop").alias("std_pop"), "min", "max", "n")


# ------------------------------------------------------------------ splits and samples

def q_split_quota(spark, sf):
    return split.split_sizes(events(spark, sf), "event_type", [0.6, 0.2, 0.2])


def q_stratified_split(spark, sf):
    e = events(spark, sf).select("event_id", "event_type")
    return split.stratified_split(e, "event_type", "event_id", [0.6, 0.2, 0.2], seed=SEED)


def q_semi_supervised_split(spark, sf):
    lb = table(spark, sf, "labels").select("doc_id", "quality")
    return split.two_part_roles(lb, "quality", "doc_id", 0.25, seed=SEED)


def q_data_efficiency_split(spark, sf):
    e = events(spark, sf).select("event_id", "event_type")
    return split.data_efficiency_subset(e, "event_type", "event_id", 0.3, seed=SEED)


def q_manifest_fetch(spark, sf):
    o = table(spark, sf, "orders").withColumn("file_key", F.year("o_orderdate").cast("string"))
    manifest = o.select("file_key", F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("label"))
    wide = o.select("file_key", F.col("o_orderkey").alias("idx"), "o_totalprice")
    fetched = split.split_manifest(manifest, wide, ["file_key", "idx"], "label", [0.6, 0.2, 0.2], seed=SEED)
    return fetched.select(F.col("idx").alias("o_orderkey"), "file_key", "split", "o_totalprice")


def q_systematic_sample(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("file_key"), "o_orderkey")
    return split.systematic_sample(o, ["file_key", "o_orderkey"], 0.2).select("o_orderkey", "pos")


def q_hash_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.hash_sample(o, "o_orderkey", 100, seed=SEED)


def q_row_chunks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    ch = sequence.with_chunks(o, ["o_orderkey"], CHUNKS)
    return ch.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("min_key"),
                                   F.max("o_orderkey").alias("max_key"))


# ------------------------------------------------------------------ sequences

def _event_seq_rows(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "event_type", "value")
    return sequence.with_sequence_ids(e, ["ts", "event_id"], SEQ_LEN)


def q_flow_sequences(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "event_type", "value")
    seqs = sequence.flow_sequences(e, ["ts", "event_id"], SEQ_LEN, ["event_id", "event_type"])
    return seqs.select("seq", F.size("steps").cast("long").alias("n_steps"),
                       F.col("steps")[0]["event_id"].alias("first_event_id"),
                       F.element_at("steps", -1)["event_id"].alias("last_event_id"),
                       F.array_join(F.transform("steps", lambda s: s["event_type"]), ",").alias("labels"))


def q_sequence_flatten(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "event_type")
    seqs = sequence.flow_sequences(e, ["ts", "event_id"], SEQ_LEN, ["event_id", "event_type"])
    flat = sequence.flatten_sequences(seqs)
    return flat.select("seq", F.col("step").cast("long").alias("step"), "event_id", "event_type")


# ------------------------------------------------------------------ evaluation

def _conf(spark, sf):
    return metrics.confusion(scored_events(spark, sf), by=["split"])


def _round_ratios(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in metrics.RATIOS else F.col(c) for c in df.columns])


def q_confusion_matrix(spark, sf):
    return metrics.dense_confusion(_conf(spark, sf), ["split"])


def q_class_metrics(spark, sf):
    return _round_ratios(metrics.class_metrics(_conf(spark, sf), ["split"]))


def q_average_metrics(spark, sf):
    return _round_ratios(metrics.average_metrics(metrics.class_metrics(_conf(spark, sf), ["split"]), ["split"]))


def q_binary_metrics(spark, sf):
    b = metrics.binary_confusion(_conf(spark, sf), "view", "attack", by=["split"])
    return _round_ratios(metrics.class_metrics(b, ["split"]))


def q_accuracy_report(spark, sf):
    rep = metrics.accuracy_report(metrics.class_metrics(_conf(spark, sf), ["split"]), ["split"])
    return rep.select("split", "label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), "support")


def q_average_table(spark, sf):
    am = metrics.average_metrics(metrics.class_metrics(_conf(spark, sf), ["split"]), ["split"])
    t = metrics.average_table(am, ["split"])
    return t.select(*[r6(c).alias(c) if c not in ("split", "avg_type") else F.col(c) for c in t.columns])


def _recon(spark, sf):
    em = table(spark, sf, "embeddings")
    approx = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10)
    return metrics.reconstruction_error(em.withColumn("recon", approx), "embedding", "recon")


def q_reconstruction_error(spark, sf):
    return _recon(spark, sf).select("vec_id", r6("sq_error_sum").alias("sq_error_sum"))


def q_reconstruction_summary(spark, sf):
    s = metrics.reconstruction_summary(_recon(spark, sf), by=["label"])
    return s.select("label", r6("mse").alias("mse"), r6("rmse").alias("rmse"), "n")


def _multilabel(spark, sf):
    li = table(spark, sf, "lineitem")
    y = F.array(*[(F.col("l_returnflag") == v).cast("int") for v in ("A", "N", "R")])
    p = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
    return li.select("l_linestatus", y.alias("y"), p.alias("p"))


def q_multilabel_f1(spark, sf):
    m = metrics.multilabel_f1(_multilabel(spark, sf), "y", "p", ["l_linestatus"], n_classes=3)
    return m.select("l_linestatus", r6("weighted_f1").alias("weighted_f1"))


def q_exact_match(spark, sf):
    m = metrics.exact_match(_multilabel(spark, sf), "y", "p", ["l_linestatus"])
    return m.select("l_linestatus", r6("exact_match").alias("exact_match"))


def _fold_acc(spark, sf):
    s = scored_events(spark, sf)
    folded = sequence.with_folds(s, ["ts", "event_id"], FOLDS)
    return stats.fold_accuracy(folded, "y_true", ["y_pred", "y_pred2"])


def q_kfold_accuracy(spark, sf):
    return _fold_acc(spark, sf).select("fold", r6("acc1").alias("acc1"), r6("acc2").alias("acc2"))


def q_ttest_two_models(spark, sf):
    t = stats.ttest_independent(_fold_acc(spark, sf))
    return t.select(r6("t").alias("t"), "df", r6("p").alias("p"))


def q_histogram(spark, sf):
    h = stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def q_fingerprint(spark, sf):
    return stats.fingerprint(table(spark, sf, "orders"), portable=True)


# ------------------------------------------------------------------ histories

def _history(spark, sf, keep_partition=False):
    e = events(spark, sf).select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("val_loss"))
    return history.number_epochs(e, "run", ["ts", "event_id"], "epoch", keep_partition=keep_partition)


def q_best_epoch(spark, sf):
    b = history.best_epoch(_history(spark, sf), "run")
    return b.select("run", "best_epoch", "best_loss")


def q_early_stop_epoch(spark, sf):
    return history.early_stop_epoch(_history(spark, sf, keep_partition=True), "run", PATIENCE)


def q_goal_epoch(spark, sf):
    return history.goal_epoch(_history(spark, sf), "run", "val_loss", GOAL)


# ------------------------------------------------------------------ specs

def q_spec_params(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    from .spec import typed_param
    t = typed_param(F.col("text"))
    out = c.select("conv_id", "turn", t.alias("t"))
    items = F.md5(F.array_join(F.transform("t.items", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "|"))
    return out.select("conv_id", "turn", "t.kind", "t.n_items", F.col("t.float_value").alias("number"), items.alias("items_md5"))


QUERIES = {
    "label_counts": q_label_counts,
    "label_counts_union": q_label_counts_union,
    "drop_rare_classes": q_drop_rare_classes,
    "drop_unseen_classes": q_drop_unseen_classes,
    "map_labels": q_map_labels,
    "binary_labels": q_binary_labels,
    "class_weights": q_class_weights,
    "ascii_labels": q_ascii_labels,
    "non_numeric_rows": q_non_numeric_rows,
    "invalid_values": q_invalid_values,
    "cleaning_report": q_cleaning_report,
    "text_time_sort": q_text_time_sort,
    "dummy_columns": q_dummy_columns,
    "label_codes": q_label_codes,
    "label_onehot": q_label_onehot,
    "label_decode": q_label_decode,
    "standard_scale": q_standard_scale,
    "minmax_scale": q_minmax_scale,
    "scaler_stats": q_scaler_stats,
    "split_quota": q_split_quota,
    "stratified_split": q_stratified_split,
    "semi_supervised_split": q_semi_supervised_split,
    "data_efficiency_split": q_data_efficiency_split,
    "manifest_fetch": q_manifest_fetch,
    "systematic_sample": q_systematic_sample,
    "hash_sample": q_hash_sample,
    "row_chunks": q_row_chunks,
    "flow_sequences": q_flow_sequences,
    "sequence_flatten": q_sequence_flatten,
    "confusion_matrix": q_confusion_matrix,
    "class_metrics": q_class_metrics,
    "average_metrics": q_average_metrics,
    "binary_metrics": q_binary_metrics,
    "accuracy_report": q_accuracy_report,
    "average_table": q_average_table,
    "reconstruction_error": q_reconstruction_error,
    "reconstruction_summary": q_reconstruction_summary,
    "multilabel_f1": q_multilabel_f1,
    "exact_match": q_exact_match,
    "kfold_accuracy": q_kfold_accuracy,
    "ttest_two_models": q_ttest_two_models,
    "histogram": q_histogram,
    "fingerprint": q_fingerprint,
    "best_epoch": q_best_epoch,
    "early_stop_epoch": q_early_stop_epoch,
    "goal_epoch": q_goal_epoch,
    "spec_params": q_spec_params,
}


# ------------------------------------------------------------------ added coverage

def q_dataset_sizes(spark, sf):
    """AGG-10: rows per split and the feature count after a 60/20/20 split."""
    e = events(spark, sf).select("event_id", "event_type", "value", "user_id")
    parted = split.stratified_split(e, "event_type", "event_id", [0.6, 0.2, 0.2], seed=SEED)
    return stats.dataset_sizes(parted, ["value", "user_id"])


def q_stratified_subset(spark, sf):
    """SMP-4: stratified 8 % subset."""
    e = events(spark, sf).select("event_id", "event_type")
    return split.stratified_subset(e, "event_type", "event_id", 0.08, seed=SEED)


def q_binary_confusion(spark, sf):
    """AGG-7: the 2 x 2 (attack, normal) matrix per split."""
    return metrics.binary_confusion(_conf(spark, sf), "view", "attack", by=["split"])


def q_confusion_wide(spark, sf):
    """SNK-5 presentation: one column per predicted label (values from the label dictionary)."""
    from ..sources.io import confusion_wide
    return confusion_wide(_conf(spark, sf), ["split"])


def q_label_numbers(spark, sf):
    """WIN-8: sorted-label numbers starting at 1."""
    e = events(spark, sf)
    codes = encode.fit_label_codes(e, label_col="event_type", start=1)
    return encode.encode_labels(e.select("event_id", "event_type"), codes, "event_type", "label_number")


def q_sequence_sample(spark, sf):
    """SMP-3: 50 sequences drawn with replacement; only rows of drawn sequences are grouped."""
    rows = _event_seq_rows(spark, sf)
    n_seq = events(spark, sf).count() // SEQ_LEN
    draws = split.draws_with_replacement(spark, n_seq, 50, SEED)
    seqs = (rows.join(draws.select("seq").distinct(), "seq", "left_semi").groupBy("seq")
            .agg(F.sort_array(F.collect_list(F.struct("step", "event_type"))).alias("steps")))
    return split.sample_with_replacement(seqs, "seq", n_seq, 50, SEED).select(
        "draw", "seq", F.size("steps").cast("long").alias("n_steps"),
        F.array_join(F.transform("steps", lambda s: s["event_type"]), ",").alias("labels"))


def q_split_null_keys(spark, sf):
    """SPL-1 with NULLs among keys and labels: every row gets a part, sizes stay exact."""
    e = events(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("owner"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("label"))
    return split.stratified_split(e, "label", ["owner", "event_id"], [0.6, 0.2, 0.2], seed=SEED).drop("owner")


def q_category_positions(spark, sf):
    """ENC-1/2 for a column of as many values as rows: the place of each value, joined back."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return encode.dummy_positions(o, "o_orderkey", encode.category_positions(o, "o_orderkey"), "position")


PREP_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "r1", "l_linestatus_F", "l_linestatus_O"]


def q_prepare_lineitem(spark, sf):
    """JOB-4 shaped end to end: ratio feature, FLT-3, ENC-1 dummies, SPL-1 60/20/20 by return flag,
    SCL-1/3 standard scaling fitted on train only (features left unpacked for the SQL check)."""
    li = table(spark, sf, "lineitem")
    inf = float("inf")
    r1 = F.when(F.col("l_tax") == 0, F.lit(inf)).otherwise(F.col("l_discount") / F.col("l_tax"))
    base = li.select(*LINE_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", r1.alias("r1"),
                     "l_linestatus", F.col("l_returnflag").alias("label"))
    base = clean.drop_invalid_rows(base, ["r1"])
    (enc,) = encode.one_hot_encode([base], ["l_linestatus"])
    keyed = enc.withColumn("_key", F.concat_ws("-", *[F.col(k).cast("string") for k in LINE_KEYS]))
    parted = split.stratified_split(keyed, "label", "_key", [0.6, 0.2, 0.2], seed=SEED).drop("_key")
    # the split feeds both the scaler fit and the output: materialise it once
    parted = cut_lineage(parted)
    scaled = scale.fit_and_scale(parted, PREP_FEATURES, F.col("split") == "train")
    return scaled.select(*LINE_KEYS, "split", "label", *[r6(c).alias(c) for c in PREP_FEATURES])


def q_merge_validation(spark, sf):
    """SPL-6: 60/20/20 split, then validation rows join train (``train_valid_concat``)."""
    e = events(spark, sf).select("event_id", "event_type")
    return split.merge_validation(split.stratified_split(e, "event_type", "event_id", [0.6, 0.2, 0.2], seed=SEED))


def q_score_argmax(spark, sf):
    """FN-10 / FN-11: predicted class = first index of the largest score; scores rounded to 0/1."""
    from ..functions.exprs import argmax, threshold
    t = table(spark, sf, "lineitem")
    p = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50)
    return t.select(*LINE_KEYS, argmax(p).alias("pred_idx"),
                    F.array_join(F.transform(threshold(p), lambda x: x.cast("string")), ",").alias("rounded"))


def q_strict_cast(spark, sf):
    """FN-5 / CLN-3: number text cast to double; a bad text would fail the job."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("custkey_text"))
    return clean.cast_columns_strict(o, ["custkey_text"])


QUERIES.update({
    "split_null_keys": q_split_null_keys,
    "category_positions": q_category_positions,
    "merge_validation": q_merge_validation,
    "score_argmax": q_score_argmax,
    "strict_cast": q_strict_cast,
    "prepare_lineitem": q_prepare_lineitem,
    "dataset_sizes": q_dataset_sizes,
    "stratified_subset": q_stratified_subset,
    "binary_confusion": q_binary_confusion,
    "confusion_wide": q_confusion_wide,
    "label_numbers": q_label_numbers,
    "sequence_sample": q_sequence_sample,
})


# ------------------------------------------------------------------ sinks and scans, written and read again

def _scratch(spark, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_csv_union(spark, sf):
    """SNK-2, SRC-1/2: two CSV exports whose columns differ in order and number, read as one table by name."""
    from ..sources import io
    o = table(spark, sf, "orders")
    path = _scratch(spark, "csv")
    odd = F.col("o_orderkey") % 2 == 1
    io.write_csv(o.where(odd).select("o_orderkey", "o_orderstatus", "o_orderpriority"), f"{path}/a")
    io.write_csv(o.where(~odd).select("o_orderpriority", "o_custkey", "o_orderkey", "o_orderstatus"), f"{path}/b")
    back = io.read_csv(spark, [f"{path}/a", f"{path}/b"])
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", "o_orderpriority",
                       F.col("o_custkey").cast("long").alias("o_custkey"))


def q_prepared_round_trip(spark, sf):
    """SNK-1, SRC-4/5: the prepared table written by split, one split read back (a pruned partition)."""
    from ..sources import io
    e = events(spark, sf).select("event_id", F.col("event_type").alias("label"), "value", _split_col().alias("split"))
    path = _scratch(spark, "prepared")
    io.write_prepared(e, path)
    io.require_rows(io.read_prepared(spark, path, split="train"))
    return io.read_prepared(spark, path, split="test").select("event_id", "label", "value")


def q_keyed_round_trip(spark, sf):
    """SNK-4, SRC-6: written by split and file key, one key of one split read back."""
    from ..sources import io
    e = events(spark, sf).select("event_id", _split_col().alias("split"), F.col("event_type").alias("file_key"))
    path = _scratch(spark, "keyed")
    io.write_prepared(e, path, partition_by=("split", "file_key"))
    return io.read_prepared(spark, path, split="train", file_key="view").select("event_id")


def q_chunks_round_trip(spark, sf):
    """SNK-3: consecutive chunks written as CSV folders, read back and counted."""
    from ..sources import io
    path = _scratch(spark, "chunks")
    sequence.write_chunks(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], CHUNKS, path)
    back = spark.read.option("header", True).schema("o_orderkey long, chunk int").csv(path)
    return back.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("min_key"),
                                     F.max("o_orderkey").alias("max_key"))


def q_report_round_trip(spark, sf):
    """SNK-5: the evaluation report written twice under one run, class table read back (a rerun replaces itself)."""
    from ..sources import io
    path = _scratch(spark, "report")
    for _ in range(2):
        io.write_report(metrics.evaluate(scored_events(spark, sf), "view"), path, "r1")
    back = spark.read.parquet(f"{path}/class_metrics").where("run = 'r1' and granularity = 'multi'")
    return _round_ratios(back.select("split", "label", "tp", "fp", "fn", "tn", "support", *metrics.RATIOS))


def q_history_round_trip(spark, sf):
    """SNK-6: numbered histories saved as CSV and read back."""
    h = _history(spark, sf).select("run", "epoch", "val_loss")
    path = _scratch(spark, "history")
    history.save_history(h, path)
    return spark.read.option("header", True).schema("run long, epoch long, val_loss double").csv(path)


def q_scaler_round_trip(spark, sf):
    """SNK-7: a scaler fitted before the cutoff, saved, loaded and applied."""
    li = table(spark, sf, "lineitem").select(*LINE_KEYS, *SCALE_COLS, "l_shipdate")
    path = _scratch(spark, "scaler")
    scale.save_scaler(scale.fit_scaler(li, SCALE_COLS, F.col("l_shipdate") < F.lit(SHIP_CUTOFF).cast("timestamp_ntz")), path)
    out = scale.apply_scaler(li.drop("l_shipdate"), scale.load_scaler(spark, path), SCALE_COLS, "standard")
    return out.select(*LINE_KEYS, *[r6(c).alias(c) for c in SCALE_COLS])


QUERIES.update({
    "csv_union": q_csv_union,
    "prepared_round_trip": q_prepared_round_trip,
    "keyed_round_trip": q_keyed_round_trip,
    "chunks_round_trip": q_chunks_round_trip,
    "report_round_trip": q_report_round_trip,
    "history_round_trip": q_history_round_trip,
    "scaler_round_trip": q_scaler_round_trip,
})
