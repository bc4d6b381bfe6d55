"""Stratified splits and samples (SPL-1..7, SMP-1..4).

SPL-1 sizes follow the reference's splitter, which peels one part off at a
time: with rates ``r`` the ``i``-th step sends ``n - ceil(t * n)`` rows to part
``i`` where ``t = 1 - r[i] / sum(r[i:])``, and shares those rows over classes
by largest remainders (ties broken by label text, where the reference's
library draws at random).  Which rows go where is decided by a seeded md5
order inside each class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .position import CLASS_KEYS, seeded_hash, with_position

DEFAULT_SEED = 42


def passed_on(rates: Sequence[float]) -> list[float]:
    """For each part but the last: of the rows that reach it, the fraction left for later parts."""
    if abs(sum(rates) - 1.0) > 1e-9:
        raise ValueError(f"split rates must sum to 1, got {list(rates)}")
    tails = [sum(rates[i:]) for i in range(len(rates) - 1)]
    return [1 - own / tail for own, tail in zip(rates, tails)]


def split_quotas(counts: DataFrame, rates: Sequence[float], count_col: str = "n",
                 order_cols: Sequence[str] = ("_lk", "_ln")) -> DataFrame:
    """Per-class quotas ``q0..q{p-1}`` for a stratified split of ``counts``.

    ``counts`` has one row per class (classes are few; the windows below run on
    that small table only).  Integer arithmetic only.
    """
    rem = F.col(count_col).cast("long")
    df = counts.withColumn("_rem", rem)
    tie = [F.col(c) for c in order_cols]
    whole = Window.partitionBy()
    for i, t in enumerate(passed_on(rates)):
        tot = F.sum("_rem").over(whole)
        df = df.withColumn("_tot", tot)
        df = df.withColumn("_ntrain", F.col("_tot") - F.ceil(F.lit(float(t)) * F.col("_tot")).cast("long"))
        # exact integer arithmetic: the product of two row counts can pass 2^63
        df = (df.withColumn("_prod", (F.col("_rem").cast("decimal(19,0)") * F.col("_ntrain").cast("decimal(19,0)")).cast("decimal(38,0)"))
                .withColumn("_dtot", F.col("_tot").cast("decimal(38,0)")))
        prod, tot = F.col("_prod"), F.col("_dtot")
        df = (df.withColumn("_fl", F.when(F.col("_tot") > 0, F.expr("_prod div _dtot")).otherwise(0).cast("long"))
                .withColumn("_r", F.when(F.col("_tot") > 0, prod - F.col("_fl").cast("decimal(38,0)") * tot)
                            .otherwise(0))
                .withColumn("_need", F.col("_ntrain") - F.sum("_fl").over(whole))
                .withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_r").desc(), *tie)))
                .withColumn(f"q{i}", (F.col("_fl") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)).cast("long"))
                .withColumn("_rem", F.col("_rem") - F.col(f"q{i}")))
    last = len(rates) - 1
    df = df.withColumn(f"q{last}", F.col("_rem"))
    return df.drop("_rem", "_tot", "_ntrain", "_fl", "_r", "_need", "_rk", "_prod", "_dtot")


def _past(cuts: int, rank: Column | None = None) -> Column:
    """How many of a class's cuts a row is past: its prefix is beyond the cut's, or it is the same and its rank is."""
    def one(i: int) -> Column:
        here = (F.col("_b") == F.col(f"_p{i}")) & (F.lit(True) if rank is None else rank >= F.col(f"_c{i}"))
        return F.when((F.col("_b") > F.col(f"_p{i}")) | here, 1).otherwise(0)  # no such prefix: nothing is past it
    return sum((one(i) for i in range(cuts)), F.lit(0))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str] | str,
                     rates: Sequence[float] = (0.6, 0.2, 0.2),
                     names: Sequence[str] = ("train", "val", "test"),
                     seed: int | str = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """SPL-1 (and SPL-2, the older 60/20/20 splitter: same call): exact-count stratified split;
    adds ``split_col`` (one of ``names``).  An existing column of that name is kept as
    ``_prev_<split_col>`` (splitting a part again keeps where the rows came from).

    Rows of a class are ordered by (seeded md5, keys) and cut at the quotas.  The rows are
    not shuffled for it: per class and md5 prefix they are counted (partial aggregation),
    which tells the prefix that each cut falls into; every row of another prefix gets its
    part by one comparison with its class's cuts (a table of a row per class).  Only the
    rows of a prefix that a cut divides, one per cut and class, are ranked.  The prefix
    grows with the data, so these stay few.  NULL keys and NULL labels are rows like any other.
    """
    if len(names) != len(rates):
        raise ValueError("one name per rate")
    if split_col in df.columns:
        df = df.withColumnRenamed(split_col, f"_prev_{split_col}")
    cols = df.columns
    keys = [keys] if isinstance(keys, str) else list(keys)
    hashed = (df.withColumn("_h", seeded_hash(keys, seed))
              .withColumn("_lk", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("_ln", F.col(label).isNull()))
    base, buckets = prefix_counts(hashed, CLASS_KEYS)
    n_cuts = len(rates) - 1
    quotas = split_quotas(buckets.groupBy(*CLASS_KEYS).agg(F.sum("_bn").alias("n")), rates).drop("n")
    ends = [sum((F.col(f"q{j}") for j in range(i + 1)), F.lit(0)) for i in range(n_cuts)]
    bounds = quotas.select(*CLASS_KEYS, *[e.alias(f"_c{i}") for i, e in enumerate(ends)])
    inside = lambda i, c: F.min(F.when(F.col("_boff") + F.col("_bn") > F.col(f"_c{i}"), F.col(c)))
    cuts = cut_lineage(buckets.join(bounds, CLASS_KEYS).groupBy(*CLASS_KEYS).agg(
        *[x for i in range(n_cuts) for x in (inside(i, "_b").alias(f"_p{i}"), inside(i, "_boff").alias(f"_o{i}"),
                                              F.first(f"_c{i}").alias(f"_c{i}"))]))
    placed = base.join(cuts, CLASS_KEYS)
    divided = F.lit(False)
    for i in range(n_cuts):
        divided = divided | F.coalesce((F.col("_b") == F.col(f"_p{i}")) & (F.col(f"_o{i}") < F.col(f"_c{i}")), F.lit(False))
    part = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_past") + 1).alias(split_col)
    plain = placed.where(~divided).withColumn("_past", _past(n_cuts)).select(*cols, part)
    if not n_cuts:
        return plain
    offset = F.coalesce(*[F.when(F.col("_b") == F.col(f"_p{i}"), F.col(f"_o{i}")) for i in range(n_cuts)])
    rank = offset + F.row_number().over(Window.partitionBy(*CLASS_KEYS, "_b").orderBy("_h", *keys)) - 1
    ranked = (placed.where(divided).withColumn("_rank", rank).withColumn("_past", _past(n_cuts, F.col("_rank")))
              .select(*cols, part))
    return plain.unionByName(ranked)


#: Rows that one md5 prefix is meant to hold at most; more rows make the prefix longer.
PREFIX_ROWS = 250_000


def prefix_counts(hashed: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``hashed`` with ``_b``, a prefix of ``_h``; and (group..., _b, _bn rows, _boff rows of the group before it)."""
    total = hashed.count()
    digits = 3
    while total > PREFIX_ROWS * 16 ** digits and digits < 8:
        digits += 1
    base = hashed.withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    return base, cut_lineage(counts.withColumn("_boff", F.coalesce(F.sum("_bn").over(before), F.lit(0))))


def split_sizes(df: DataFrame, label: str, rates: Sequence[float] = (0.6, 0.2, 0.2),
                names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Quota table ``(label, split, n)`` without touching row order (SPL-1 sizes)."""
    counts = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_lk", F.coalesce(F.col(label).cast("string"), F.lit("")))
              .withColumn("_ln", F.col(label).isNull()))
    q = split_quotas(counts, rates)
    stack = F.explode(F.array(*[F.struct(F.lit(nm).alias("split"), F.col(f"q{i}").alias("n"))
                                for i, nm in enumerate(names)]))
    return q.select(F.col(label).alias("label"), stack.alias("s")).select("label", "s.split", "s.n")


def two_part_roles(df: DataFrame, label: str, keys: Sequence[str] | str, ratio: float,
                   seed: int | str = DEFAULT_SEED, role_col: str = "role",
                   names: tuple[str, str] = ("unsup", "sup")) -> DataFrame:
    """SPL-4: split train into an unlabelled and a labelled part; ratio -1 uses all rows for both."""
    if ratio == -1:
        return df.withColumn(role_col, F.lit("both"))
    return stratified_split(df, label, keys, [ratio, 1 - ratio], names, seed, role_col)


def data_efficiency_subset(df: DataFrame, label: str, keys: Sequence[str] | str, ratio: float,
                           seed: int | str = DEFAULT_SEED) -> DataFrame:
    """SPL-5: split ``[ratio, 1 - ratio]`` and keep the second part for training."""
    if ratio <= 0:
        return df
    parted = stratified_split(df, label, keys, [ratio, 1 - ratio], ("set1", "set2"), seed, "_part")
    return parted.where(F.col("_part") == "set2").drop("_part")


def merge_validation(df: DataFrame, split_col: str = "split") -> DataFrame:
    """SPL-6: ``training_set=train_valid_concat``: validation rows join train."""
    return df.withColumn(split_col, F.when(F.col(split_col) == "val", F.lit("train"))
                         .otherwise(F.col(split_col)))


def stratified_subset(df: DataFrame, label: str, keys: Sequence[str] | str, keep: float = 0.08,
                      seed: int | str = DEFAULT_SEED) -> DataFrame:
    """SMP-4: keep a stratified ``keep`` share (first part of ``[keep, 1 - keep]``)."""
    parted = stratified_split(df, label, keys, [keep, 1 - keep], ("keep", "drop"), seed, "_part")
    return parted.where(F.col("_part") == "keep").drop("_part")


def sample_step(rate: float) -> int:
    """SMP-1 / FN-9: every k-th row with ``k = ceil(1 / rate)`` (0.3 gives 4, i.e. 25 %)."""
    return int(math.ceil(1 / rate))


def systematic_sample(df: DataFrame, order: Sequence[str | Column], rate: float,
                      pos_col: str = "pos") -> DataFrame:
    """SMP-1: rows at global positions 0, k, 2k, ... of ``order``."""
    k = sample_step(rate)
    return with_position(df, order, pos_col).where(F.col(pos_col) % k == 0)


def hash_sample(df: DataFrame, keys: Sequence[str] | str, n: int, seed: int | str = DEFAULT_SEED) -> DataFrame:
    """SMP-2: ``n`` rows without replacement: the first ``n`` in seeded-hash order (exact).

    The limit is the feature here (a sample of size n).  Rows are counted per md5 prefix;
    those before the prefix that the n-th row falls into are taken by a filter, and only the
    rows of that prefix are ordered.  Fewer than n rows are an error.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = df.columns
    base, counts = prefix_counts(df.withColumn("_h", seeded_hash(keys, seed)).withColumn("_g", F.lit(0)), ["_g"])
    cut = counts.agg(F.coalesce(F.sum("_bn"), F.lit(0)).alias("total"),
                     F.min(F.when(F.col("_boff") + F.col("_bn") > n, F.col("_b"))).alias("b"),
                     F.min(F.when(F.col("_boff") + F.col("_bn") > n, F.col("_boff"))).alias("before")).first()
    if cut.total < n:
        raise ValueError(f"cannot sample {n} rows from {cut.total} rows")
    if cut.b is None:
        return df
    whole = base.where(F.col("_b") < cut.b).select(*cols)
    rest = base.where(F.col("_b") == cut.b).orderBy("_h", *keys).limit(n - cut.before).select(*cols)
    return whole.unionByName(rest)


def draws_with_replacement(spark, n_total: int, n: int, seed: int = DEFAULT_SEED, index_col: str = "seq") -> DataFrame:
    """(index_col, draw): ``n`` indexes in [0, n_total), each from an md5 of the seed and the draw's number."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))
    return spark.range(n).select((F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % n_total).alias(index_col),
                                 F.col("id").alias("draw"))


def sample_with_replacement(df: DataFrame, index_col: str, n_total: int, n: int,
                            seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP-3: ``n`` draws of ``index_col`` in ``[0, n_total)`` with replacement.

    The draw table has ``n`` rows (the sample size); it is joined on the index,
    and repeated draws repeat the row.
    """
    return draws_with_replacement(df.sparkSession, n_total, n, seed, index_col).join(df, index_col)


def split_manifest(manifest: DataFrame, wide: DataFrame, keys: Sequence[str], label: str = "label",
                   rates: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "val", "test"),
                   seed: int | str = DEFAULT_SEED, split_col: str = "split") -> DataFrame:
    """SPL-3 + JOIN-2: split a narrow manifest ``(keys..., label)``, then fetch the wide rows.

    The join is an equi-join on the unique row keys (no hot key); Spark shuffles
    both sides on the keys, or broadcasts the manifest when AQE measures it small.
    """
    parted = stratified_split(manifest.select(*keys, label), label, list(keys), rates, names, seed, split_col)
    return wide.join(parted.select(*keys, split_col), list(keys))
