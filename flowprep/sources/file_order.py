"""Rows of Parquet files by their place: positions, samples, sequences and fetches without moving rows.

The order is the files' own: files by their path, rows as they lie in a file (SRT-2).  An
index tells the rows of each file block that a task reads (from the footers: no
column is read); prefix sums over the files give each file's offset, and a
row's position is that plus its row index.  The index has a row a block.

* positions, every k-th row, folds and chunks need no exchange of the rows (SMP-1, WIN-4, SNK-3, JOB-7);
* sequences that lie within one block are cut out of the rows as they are read; only the rows at
  a block's edges, less than two sequences a block, are brought together (WIN-1, WIN-2);
* a manifest (file, row, part) becomes bitmaps of row indexes, which go to the scan of
  their files; the wide rows stay where they are (SPL-3, JOIN-2, JOB-6).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import col_
from ..operators.sequence import chunk_number, fold_number
from ..operators.split import sample_step
from ..session import cut_lineage

#: The index is broadcast up to this many blocks (some 150 bytes each), joined plainly beyond it.
MAX_BLOCKS = 1 << 19
#: Bitmaps that are broadcast together; more files are fetched in several scans.
MAX_BITMAP_BYTES = 64 << 20
_BUCKET_BITS = 12   # rows of one bitmap: 64 words of 64 rows
PLACE = ["_file", "_block", "_row"]


def scan(spark: SparkSession, paths: str | Sequence[str], schema=None, base: str | None = None) -> DataFrame:
    """The files' rows with their file, the block that holds them and their index in the file.

    ``base``: the folder above partition folders, where ``paths`` are some of these.
    """
    reader = spark.read.option("basePath", base) if base else spark.read
    df = (reader.schema(schema) if schema is not None else reader).parquet(*([paths] if isinstance(paths, str) else list(paths)))
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.col("_metadata.row_index").alias("_row"))


class FileIndex:
    """Where each block's rows stand among all rows; made once, read by many."""

    def __init__(self, spark: SparkSession, paths: str | Sequence[str], schema=None, base: str | None = None):
        self.spark, self.paths, self.schema, self.base = spark, paths, schema, base
        blocks = cut_lineage(self.scan().groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low")))
        files = blocks.groupBy("_file").agg(F.sum("_n").alias("_rows"))
        # one row a file
        earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        self.files = cut_lineage(files.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
        self.blocks = cut_lineage(blocks.join(self.files, "_file").select("_file", "_block", "_offset", (F.col("_offset") + F.col("_low")).alias("_first"),
                                                                            (F.col("_offset") + F.col("_low") + F.col("_n") - 1).alias("_last")))
        self.n_blocks, self.total = self.blocks.agg(F.count(F.lit(1)), F.coalesce(F.max("_last") + 1, F.lit(0))).first()

    def scan(self, files: Sequence[str] | None = None) -> DataFrame:
        return scan(self.spark, self.paths if files is None else files, self.schema, self.base)

    def rows(self, pos_col: str = "pos") -> DataFrame:
        """The rows with their position, and the first and last position of their block (_first, _last)."""
        blocks = F.broadcast(self.blocks) if self.n_blocks <= MAX_BLOCKS else self.blocks
        rows = self.scan().join(blocks, ["_file", "_block"], "left")
        # files that have changed, or blocks cut by other session settings, are an error rather than lost rows
        pos = F.when(F.col("_offset").isNull(), F.raise_error(F.concat(F.lit("not in the index: "), F.col("_file"))).cast("long"))
        return rows.withColumn(pos_col, pos.otherwise(F.col("_offset") + F.col("_row")))

    def positions(self, pos_col: str = "pos") -> DataFrame:
        """The rows with their 0-based position in file order (SRC-2's fresh index)."""
        return self.rows(pos_col).drop(*PLACE, "_offset", "_first", "_last")

    def every_kth(self, rate: float, pos_col: str = "pos") -> DataFrame:
        """SMP-1: rows 0, k, 2k, ... with k = ceil(1 / rate)."""
        return self.positions(pos_col).where(F.col(pos_col) % sample_step(rate) == 0)

    def folds(self, k: int, fold_col: str = "fold") -> DataFrame:
        """WIN-4: k contiguous folds, numbered from 1; the first ones get a row more where they differ."""
        return self.positions("_pos").withColumn(fold_col, fold_number(F.col("_pos"), F.lit(self.total), k)).drop("_pos")

    def chunks(self, n: int, chunk_col: str = "chunk") -> DataFrame:
        """SNK-3: n consecutive chunks, numbered from 1."""
        return self.positions("_pos").withColumn(chunk_col, chunk_number(F.col("_pos"), F.lit(self.total), n)).drop("_pos")

    def sequences(self, length: int, fields: Sequence[str]) -> DataFrame:
        """WIN-1/2: (seq, steps) of ``length`` consecutive rows; the incomplete tail is dropped.

        The same rows as ``sequence.flow_sequences`` in file order.
        """
        start = F.col("_seq") * length
        rows = (self.rows("_pos").withColumn("_seq", F.expr(f"_pos div {length}")).where(F.col("_seq") < self.total // length)
                .withColumn("_within", (start >= F.col("_first")) & (start + (length - 1) <= F.col("_last"))))
        step = (F.col("_pos") % length).cast("int").alias("step")
        narrow = rows.select(F.col("_seq").alias("seq"), "_within", step, *[col_(f) for f in fields])
        whole = narrow.where("_within").drop("_within")
        edges = (narrow.where("not _within").groupBy("seq")
                 .agg(F.sort_array(F.collect_list(F.struct("step", *[col_(f) for f in fields]))).alias("steps")))
        return whole.mapInArrow(_cut(length), edges.schema).unionByName(edges)


def _cut(length: int):
    """Rows of whole sequences, in order -> one row a sequence."""
    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            n = len(table) // length
            rest = table.slice(n * length)
            if n:
                whole = table.slice(0, n * length).combine_chunks()
                columns = {name: whole.column(name).combine_chunks() for name in whole.column_names}
                numbers = columns.pop("seq").to_numpy()
                if (numbers[::length] != numbers[length - 1 :: length]).any():
                    raise ValueError("rows of a sequence do not follow each other")
                steps = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
                lists = pa.ListArray.from_arrays(pa.array(range(0, n * length + 1, length), pa.int32()), steps)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[::length]), lists], ["seq", "steps"])
        if rest is not None and len(rest):
            raise ValueError("a sequence's rows are read by two tasks")
    return run


# ---------------------------------------------------------------- fetching by a manifest

def row_bitmaps(manifest: DataFrame, parts: Sequence[str], part_col: str = "split") -> DataFrame:
    """(_file, _bucket, b0, b1, ...): for each part, one bit a row index, 4,096 rows to a bitmap.

    ``manifest`` has (_file, _row, part).  Partly aggregated per 64 rows before the shuffle; a row of the result
    is of fixed size.
    """
    word = F.shiftright("_row", 6)
    bit = F.expr("shiftleft(1L, cast(_row & 63 as int))")
    words = manifest.groupBy("_file", word.alias("_word")).agg(
        *[F.coalesce(F.bit_or(F.when(F.col(part_col) == p, bit)), F.lit(0)).alias(f"_w{i}") for i, p in enumerate(parts)])
    inside = F.col("_word").bitwiseAND(F.lit(63))
    maps = words.groupBy("_file", F.shiftright("_word", _BUCKET_BITS - 6).alias("_bucket")).agg(
        *[F.map_from_entries(F.collect_list(F.struct(inside, f"_w{i}"))).alias(f"_m{i}") for i in range(len(parts))])

    def dense(entries: str) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")),
                           lambda k: F.coalesce(F.try_element_at(F.col(entries), k), F.lit(0).cast("long")))

    return maps.select("_file", "_bucket", *[dense(f"_m{i}").alias(f"b{i}") for i in range(len(parts))])


def fetch(index: FileIndex, manifest: DataFrame, parts: Sequence[str], part_col: str = "split",
          max_bytes: int = MAX_BITMAP_BYTES) -> DataFrame:
    """The wide rows that ``manifest`` (_file, _row, part) names, with their part; other rows are left out.

    One scan of the files; where the bitmaps of all files are larger than ``max_bytes``, one scan for
    each group of files whose bitmaps are not.  A row named twice keeps the first of ``parts`` that names it.
    """
    bitmaps = cut_lineage(row_bitmaps(manifest, parts, part_col))
    rows_each = max(1, max_bytes * 8 // len(parts))
    grouped = index.files.select("_file", (F.expr(f"_offset div {rows_each}")).alias("_group"))
    groups = {r["_group"]: r["files"] for r in grouped.groupBy("_group").agg(F.collect_list("_file").alias("files")).collect()}
    out = None
    for files in groups.values():
        one = bitmaps if len(groups) == 1 else bitmaps.where(F.col("_file").isin(files))
        rows = index.scan(None if len(groups) == 1 else files)
        named = (rows.withColumn("_bucket", F.shiftright("_row", _BUCKET_BITS)).join(F.broadcast(one), ["_file", "_bucket"])
                 .withColumn(part_col, F.coalesce(*[F.when(_bit(f"b{i}"), F.lit(p)) for i, p in enumerate(parts)]))
                 .where(F.col(part_col).isNotNull()).drop("_bucket", *[f"b{i}" for i in range(len(parts))]))
        out = named if out is None else out.unionByName(named)
    return out


def _bit(words: str) -> Column:
    return F.expr(f"getbit(get({words}, cast(shiftright(_row, 6) & 63 as int)), cast(_row & 63 as int)) = 1")
