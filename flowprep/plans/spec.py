"""Experiment specs: scan, typed parameters, defaults (SRC-7, CLN-8, CLN-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import NUMBER_TEXT, split_list

INT_TEXT = r"^\s*[+-]?[0-9](?:_?[0-9])*\s*$"

# Defaults for parameters a spec row may leave out.
SPEC_DEFAULTS = {
    "model_origin": "new",
    "action": "train_test",
    "training_data_feed": "preload",
    "training_set": "train_set_only",
    "class_weights": "0",
}


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: CSV with a header; rows starting with ``#`` are comments.  All values stay text."""
    return (spark.read.option("header", True).option("comment", "#").option("inferSchema", False)
            .csv(path))


def typed_item(v: Column) -> Column:
    """CLN-8 for one list item: int, else float, else text."""
    is_int, is_float = v.rlike(INT_TEXT), v.rlike(NUMBER_TEXT)
    clean = F.regexp_replace(F.trim(v), "_", "")
    return F.struct(F.when(is_int, "int").when(is_float, "float").otherwise("str").alias("kind"),
                    F.when(is_int, clean.try_cast("long")).alias("int_value"),
                    F.when(is_int | is_float, clean.try_cast("double")).alias("float_value"), v.alias("text"))


def typed_param(v: Column) -> Column:
    """CLN-8: int, else float, else text; text with a comma becomes a list (one trailing empty item dropped).

    Returns ``struct(kind, int_value, float_value, items, n_items)``; items are ``typed_item`` structs.
    """
    is_int = v.rlike(INT_TEXT)
    is_float = v.rlike(NUMBER_TEXT)
    parts = F.split(v, ",", -1)
    is_list = ~is_int & ~is_float & (F.size(parts) > 1)
    items = F.when(is_list, F.transform(split_list(v, ","), typed_item))
    kind = (F.when(v.isNull(), F.lit(None).cast("string")).when(is_int, "int").when(is_float, "float")
            .when(is_list, "list").otherwise("str"))
    clean = F.regexp_replace(F.trim(v), "_", "")
    return F.struct(kind.alias("kind"),
                    F.when(is_int, clean.try_cast("long")).alias("int_value"),
                    F.when(is_int | is_float, clean.try_cast("double")).alias("float_value"),
                    items.alias("items"),
                    F.when(is_list, F.size(items)).otherwise(F.lit(1)).cast("long").alias("n_items"))


def with_defaults(specs: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """CLN-9: absent or empty parameters take their default."""
    defaults = defaults or SPEC_DEFAULTS
    out = specs
    for k, v in defaults.items():
        if k in out.columns:
            out = out.withColumn(k, F.coalesce(F.when(F.col(k) != "", F.col(k)), F.lit(v)))
        else:
            out = out.withColumn(k, F.lit(v))
    return out


def typed_specs(specs: DataFrame, id_col: str = "experiment_num") -> DataFrame:
    """Long form ``(id, key, raw, kind, int_value, float_value, items, n_items)``."""
    keys = [c for c in specs.columns if c != id_col]
    kv = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("raw")) for k in keys]))
    long = specs.select(F.col(id_col), kv.alias("p")).select(id_col, "p.key", "p.raw")
    return long.withColumn("t", typed_param(F.col("raw"))).select(id_col, "key", "raw", "t.*")
