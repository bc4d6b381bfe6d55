"""Scans and sinks (SRC-1..7, SNK-1..7).

Prepared data is ONE table ``(row_id?, split, label, features...)`` written as
Parquet partitioned by ``split`` (and ``file_key`` when rows keep their source
file): the keyed HDF5 stores and X/y file pairs of the reference become
partition columns, so reading one split or one key is partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas reads these texts as missing by default; Spark's CSV reader takes one
# nullValue, so the others are mapped after the read.
DEFAULT_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def positional_schema(n_cols: int, string_cols: Sequence[int] = (), prefix: str = "c") -> T.StructType:
    """Schema for a headerless positional file: ``c0..c{n-1}``; listed columns stay text."""
    s = set(string_cols)
    return T.StructType([T.StructField(f"{prefix}{i}", T.StringType() if i in s else T.DoubleType(), True)
                         for i in range(n_cols)])


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path) of every data file under ``paths``; no file is opened."""
    return spark.read.format("binaryFile").load(list(paths)).select("path")


def _first_lines(batches):
    """Task side: the first line of each file, through the codec that its name tells."""
    from urllib.parse import urlsplit

    import pyarrow as pa
    from pyarrow import fs

    def first_line(uri: str) -> str:
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            store, base = fs.LocalFileSystem(), ""
        else:
            store, base = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
        rest = uri.split(":", 1)[1] if parts.scheme else uri
        if parts.netloc:
            rest = rest[len(parts.netloc) + 2 :]
        rest = "/" + rest.lstrip("/")
        line = b""
        with store.open_input_stream(base.rstrip("/") + rest, compression="detect") as stream:
            while b"\n" not in line:
                more = stream.read(1 << 16)
                if not more:
                    break
                line += more
        return line.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace")

    for batch in batches:
        lines = [first_line(p) for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["path", "header"])


def header_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, header): the first line of every file, read by tasks."""
    return list_files(spark, paths).mapInArrow(_first_lines, "path string, header string")


def header_names(line: str, sep: str = ",") -> list[str]:
    """Column names of a header line."""
    import csv
    return next(csv.reader([line], delimiter=sep), [])


def read_csv(spark: SparkSession, paths: str | Sequence[str], header: bool = True,
             schema: T.StructType | None = None, columns: Sequence[str] | None = None,
             strip_names: bool = False, na_values: Sequence[str] | None = DEFAULT_NA) -> DataFrame:
    """SRC-1/2/3: one or many CSV files as one DataFrame; no schema inference pass.

    With headers, files are united by column *name*: header lines are read by tasks, there is one scan per
    distinct header, missing columns are NULL.  A ``schema`` then types columns by name (after ``strip_names``):
    columns that it does not have are left out, its columns that no file has are NULL.  Without a schema every column is read as
    text (convert with ``clean.cast_text_columns``).  Without headers columns go by position.
    ``columns`` is a projection the scan prunes.  Adds ``file_key``, the file's full path.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", header).option("mode", "FAILFAST")

    def scan(files: Sequence[str], line: str | None) -> DataFrame:
        if schema is None:
            df = reader.option("inferSchema", False).csv(list(files))
            df = df.select("*", F.col("_metadata.file_path").alias("file_key"))
            return df.toDF(*[c.strip() for c in df.columns]) if strip_names else df
        if line is None:
            return reader.schema(schema).csv(list(files)).select("*", F.col("_metadata.file_path").alias("file_key"))
        names = [n.strip() if strip_names else n for n in header_names(line)]
        types = {f.name: f.dataType for f in schema.fields}
        if len(set(names) & set(types)) != len([n for n in names if n in types]):
            raise ValueError(f"a column stands twice in a header: {line}")
        # by position under other names, so that columns the schema leaves out may have any name
        own = T.StructType([T.StructField(f"_{i}", types.get(n, T.StringType())) for i, n in enumerate(names)])
        df = reader.schema(own).csv(list(files))
        at = {n: f"_{i}" for i, n in enumerate(names)}
        return df.select(*[F.col(at[f.name]).alias(f.name) if f.name in at else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in schema.fields], F.col("_metadata.file_path").alias("file_key"))

    if header:
        groups = {r["header"]: r["paths"] for r in header_table(spark, paths).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()}
        if not groups:
            raise FileNotFoundError(str(paths))
        # empty files have no header and no rows
        scans = [scan(sorted(files), line) for line, files in sorted(groups.items()) if line or len(groups) == 1]
    else:
        scans = [scan(paths, None)]
    df = union_files(scans)
    df = df.select(*[c for c in df.columns if c != "file_key"], "file_key")
    if columns is not None:
        df = df.select(*columns, "file_key")
    if na_values:
        na = list(na_values)
        df = df.select(*[F.when(F.col(f"`{f.name}`").isin(na), None).otherwise(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, T.StringType) and f.name != "file_key" else F.col(f"`{f.name}`")
                         for f in df.schema.fields])
    return df


def with_stable_row_id(df: DataFrame, index_col: str = "row_id", first: Sequence = ()) -> DataFrame:
    """A 0-based index in the order (``first``..., content), the same however the files are split into tasks.

    Rows equal in all columns are interchangeable: their order among themselves is the scan's.
    """
    from ..operators.position import with_position
    from ..functions.exprs import col_
    whole = F.md5(F.to_json(F.struct(*[col_(c) for c in df.columns])))
    return (with_position(df.withColumn("_content", whole).withColumn("_scan", F.monotonically_increasing_id()),
                          [*first, "_content", "_scan"], index_col).drop("_content", "_scan"))


def read_parquet_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-2 for Parquet: many files as one DataFrame, each row keeping ``file_key``
    (the file's full path, so sorting it sorts directories, then files) and ``idx``
    (its row index inside that file) from the file metadata."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else list(paths)))
    return df.select("*", F.col("_metadata.file_path").alias("file_key"),
                     F.col("_metadata.row_index").alias("idx"))


def with_fresh_index(df: DataFrame, index_col: str = "row_id") -> DataFrame:
    """SRC-2 ``ignore_index``: one 0-based index over all files, in (file name, row in file)
    order, computed with the distributed position helper."""
    from ..operators.position import with_position
    return with_position(df, file_order("file_key", "idx"), index_col)


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """SRC-2 / SET-1 when headers differ: union by name, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_prepared(spark: SparkSession, path: str, split: str | None = None,
                  file_key: str | None = None) -> DataFrame:
    """SRC-4/5/6: prepared table; ``split`` / ``file_key`` filters prune partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if file_key is not None:
        df = df.where(F.col("file_key") == file_key)
    return df


def require_rows(df: DataFrame, what: str = "train") -> DataFrame:
    """SRC-5 check: a split must not be empty (one-row probe)."""
    if not df.limit(1).collect():
        raise ValueError(f"no rows in {what}")
    return df


def write_prepared(df: DataFrame, path: str, mode: str = "overwrite",
                   partition_by: Sequence[str] = ("split",), compression: str = "zstd") -> None:
    """SNK-1/4: compressed Parquet, partitioned; ``mode`` overwrite (``w``) or append (``a``)."""
    (df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-2."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, run: str, fmt: str = "parquet") -> None:
    """SNK-5: confusion / class / average tables keyed by run, split and granularity.

    One folder per table and run: a rerun replaces its own rows and no others.
    """
    for name, t in tables.items():
        t.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}/run={run}")


def confusion_wide(conf: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """SNK-5 presentation: the matrix with one column per label, 0 for empty cells.

    Rows and columns are all labels that are true or predicted anywhere (k labels, k columns).
    """
    from ..operators.metrics import dense_confusion
    axis = sorted(r[0] for r in conf.select(F.explode(F.array("y_true", "y_pred")).alias("l")).distinct().collect() if r[0] is not None)
    out = dense_confusion(conf, by).groupBy(*by, "y_true").pivot("y_pred", axis).agg(F.first("n"))
    return out.na.fill(0, subset=[c for c in out.columns if c not in (*by, "y_true")])


def file_order(file_key: str = "file_key", idx: str = "row_id") -> list:
    """SRT-2: rows of many files in (sorted file name, position in file) order.

    The reference sorts file names before concatenating so X and y files pair
    up; here X and y are one table, and order-dependent operators take this
    list as their explicit ``order``.
    """
    return [F.col(file_key), F.col(idx)]


def head(df: DataFrame, n: int = 5, order: Sequence | None = None) -> DataFrame:
    """SRT-3: the first ``n`` rows (by ``order`` when given: a top-n, not a full sort)."""
    return (df.orderBy(*order) if order else df).limit(n)
