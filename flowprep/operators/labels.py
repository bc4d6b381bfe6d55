"""Label tables: counts, distinct sets, family maps, binary collapse, class weights.

(AGG-1, AGG-2, AGG-17, AGG-18, CLN-5..7, SET-1..3)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Attack name -> family for the KDD'99 / NSL-KDD five-class
# setting (train attacks first, then the attacks seen only in the test sets).
# "normal" is not a key and passes through unchanged.
KDD_FAMILY_MAP = {
    "back": "dos",
    "buffer_overflow": "u2r",
    "ftp_write": "r2l",
    "guess_passwd": "r2l",
    "imap": "r2l",
    "ipsweep": "probe",
    "land": "dos",
    "loadmodule": "u2r",
    "multihop": "r2l",
    "neptune": "dos",
    "nmap": "probe",
    "perl": "u2r",
    "phf": "r2l",
    "pod": "dos",
    "portsweep": "probe",
    "rootkit": "u2r",
    "satan": "probe",
    "smurf": "dos",
    "spy": "r2l",
    "teardrop": "dos",
    "warezclient": "r2l",
    "warezmaster": "r2l",
    "mscan": "probe",
    "apache2": "dos",
    "processtable": "dos",
    "snmpguess": "u2r",
    "saint": "probe",
    "mailbomb": "dos",
    "snmpgetattack": "r2l",
    "httptunnel": "u2r",
    "named": "r2l",
    "ps": "u2r",
    "sendmail": "r2l",
    "xterm": "u2r",
    "xlock": "r2l",
    "xsnoop": "r2l",
    "udpstorm": "dos",
    "sqlattack": "u2r",
    "worm": "u2r",
}

# Rare classes the reference drops before splitting.
# (IDS-2017 labels are compared after CLN-1/2 cleaning.)
KDD_SMALL_RARE_CLASSES = ["loadmodule.", "ftp_write.", "multihop.", "phf.", "perl.", "spy."]
IDS2017_RARE_CLASSES = ["Infiltration", "Web Attack Sql Injection", "Heartbleed"]


def with_share(counts: DataFrame, n_col: str = "n", out: str = "frac") -> DataFrame:
    """``n / sum(n)``: the total is a one-row aggregate joined by broadcast, so the
    counts table stays distributed however many groups it has."""
    total = counts.agg(F.sum(n_col).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn(out, F.col(n_col).cast("double") / F.col("_total")).drop("_total"))


def label_counts(df: DataFrame, label_col: str, out_label: str = "label") -> DataFrame:
    """AGG-1: ``(label, n, frac)``; NULL is its own class.  Most frequent first when ordered."""
    counts = df.groupBy(F.col(label_col).alias(out_label)).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts)


def label_counts_union(frames: Sequence[DataFrame], label_col: str = "label") -> DataFrame:
    """AGG-2 / SET-1: counts over the union of many inputs; pre-aggregated per input."""
    parts = [f.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")) for f in frames]
    merged = reduce(lambda a, b: a.unionByName(b), parts).groupBy("label").agg(F.sum("n").cast("long").alias("n"))
    return with_share(merged)


def sorted_labels(*frames: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG-17 / SET-2 / SET-3: distinct labels over a union of inputs (order by label to list)."""
    parts = [f.select(F.col(label_col).alias("label")).distinct() for f in frames]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def add_suffixed_keys(mapping: Mapping[str, str], suffix: str = ".") -> dict[str, str]:
    """CLN-6: every key also with ``suffix`` appended (``smurf`` -> also ``smurf.``)."""
    out = dict(mapping)
    out.update({k + suffix: v for k, v in mapping.items()})
    return out


def map_labels(df: DataFrame, label_col: str, mapping: Mapping[str, str] | DataFrame,
               out_col: str | None = None) -> DataFrame:
    """CLN-5 / JOIN-3: map labels through a dictionary; unmapped values stay.

    A Python dict becomes a literal map (constant folded, no join).  A mapping
    table ``(key, value)`` is joined left; a key with two values is an error (it would double rows).
    """
    out_col = out_col or label_col
    lab = F.col(label_col)
    if isinstance(mapping, DataFrame):
        pairs = mapping.select(F.col("key").alias("_mk"), F.col("value").alias("_mv")).distinct()
        # the check is part of the join: no second job
        m = (pairs.groupBy("_mk").agg(F.count(F.lit(1)).alias("_n"), F.first("_mv").alias("_mv"))
             .withColumn("_mv", F.when(F.col("_n") == 1, F.col("_mv")).otherwise(
                 F.raise_error(F.concat(F.lit("two values for the label "), F.col("_mk"))))).drop("_n"))
        joined = df.join(m, lab == F.col("_mk"), "left")
        return joined.withColumn(out_col, F.coalesce("_mv", lab)).drop("_mk", "_mv")
    lit_map = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return df.withColumn(out_col, F.coalesce(F.element_at(lit_map, lab), lab))


def mapping_table(spark, mapping: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "key string, value string")


def to_binary_labels(c: Column | str, normal: str, attack_label: str = "attack.") -> Column:
    """CLN-7: any label not containing ``normal`` (case-sensitive) becomes ``attack_label``."""
    lab = F.col(c) if isinstance(c, str) else c
    return F.when(lab.isNull(), F.lit(None).cast("string")) \
        .when(F.instr(lab, normal) > 0, lab).otherwise(F.lit(attack_label))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """AGG-18: balanced weights ``n / (k * n_c)`` per class."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    return (counts.crossJoin(F.broadcast(totals))
            .withColumn("weight", F.col("_n").cast("double") / (F.col("_k") * F.col("n_c")))
            .drop("_n", "_k"))


def with_class_weight(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Attach AGG-18 weights as a column (for ``weightCol``); joined on the label.

    The weight table (one row per class) is materialised.
    """
    w = cut_lineage(class_weights(df, label_col)
                    .select(F.col("label").alias(label_col), F.col("weight").alias(weight_col)))
    return df.join(w, label_col, "left")
