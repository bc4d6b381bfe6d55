"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Characters that separate words in every contract: space and \t \n \v \f \r.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_uri(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only (the same in every engine and locale)."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; null or blank text: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once per row, also where a lambda uses it many times."""
    return F.transform(F.array(value), body)[0]


def held_out_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True if a *stored* table has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


#: Bits of a bitmap of ids: at most 2^20 rows of 64 bits are broadcast, however many ids there are.
BITMAP_BITS = 26


def split_by_ids(df: DataFrame, id_of: Column, ids: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(inside, outside): the rows of ``df`` whose id may be among ``ids`` (column id: bigint), and those where it is not.

    ``ids`` become a bitmap, by id modulo 2^bits, of fixed size, so it can be broadcast whatever their number and
    the rows of ``df`` are not shuffled.  A full bitmap only lets more rows inside; none is lost.
    """
    def slot(c):
        return c.bitwiseAND(F.lit((1 << bits) - 1))

    words = (ids.select(F.shiftright(slot(F.col("id")), 6).alias("__block"), slot(F.col("id")).bitwiseAND(F.lit(63)).cast("int").alias("__bit"))
             .groupBy("__block").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__word")))
    joined = (df.withColumn("__slot", slot(id_of)).withColumn("__block", F.shiftright("__slot", 6))
              .join(F.broadcast(words), "__block", "left")
              .withColumn("__hit", F.coalesce(F.expr("shiftright(__word, cast(__slot & 63 as int)) & 1L = 1L"), F.lit(False))))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return joined.where("__hit").select(*columns), joined.where("not __hit").select(*columns)


# ---------------------------------------------------------------- word hashes in Arrow batches

_PIECE = 1 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class ByteHasher:
    """64-bit hashes of byte tokens, computed for a whole buffer at once.

    A token is a maximal run of bytes of one class in ``classes`` (0: separator);
    ``fold_case`` lower-cases A-Z first.  Buffers are worked off in pieces cut
    between tokens, so memory does not grow with a text's length.
    """

    def __init__(self, fold_case: bool = True, split_punctuation: bool = False):
        table = _splitmix(256, 17)
        kinds = np.ones(256, dtype=np.uint8)
        kinds[[9, 10, 11, 12, 13, 32]] = 0
        if split_punctuation:
            for b in range(33, 127):
                if not chr(b).isalnum():
                    kinds[b] = 2
        if fold_case:
            table[65:91] = table[97:123]
        self.table, self.kinds = table, kinds
        self.base = np.uint64(0x9E3779B97F4A7C15 * 4 + 5 & 0xFFFFFFFFFFFFFFFF)
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        inverse = pow(int(self.base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, b in (("power", self.base), ("inverse", np.uint64(inverse))):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def _piece(self, data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        kind = self.kinds[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge[fresh] = True
        bounds = np.flatnonzero(edge)
        ends = np.append(bounds[1:], len(data))
        keep = kind[bounds] > 0
        start, end = bounds[keep], ends[keep]
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(data) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(self.table[data] * self.power[: len(data)], out=total[1:])
            h = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        return mix64(h), start, end, kind[start]

    def pieces(self, column: pa.Array):
        """For a string column, yield ``(hashes, document of each token, first byte, end byte, kind, piece bytes)``.

        Tokens come in text order; documents never repeat out of order.  A null
        or empty text has no token.
        """
        data, offsets = string_buffers(column)
        position, n = 0, len(data)
        while position < n:
            stop = min(n, position + _PIECE)
            if stop < n:
                # go back to a separator or a text's first byte, or on if a token fills the piece
                blank = np.flatnonzero(self.kinds[data[position:stop]] == 0)
                text_at = np.searchsorted(offsets, stop, side="right") - 1
                cut = max(int(offsets[text_at]), position + int(blank[-1]) + 1 if len(blank) else 0)
                if cut <= position:
                    after = np.flatnonzero(self.kinds[data[stop:]] == 0)
                    following = int(offsets[np.searchsorted(offsets, stop, side="left")])
                    cut = min(following, stop + int(after[0]) + 1 if len(after) else n)
                stop = cut
            piece = data[position:stop]
            inside = offsets[(offsets > position) & (offsets < stop)] - position
            h, start, end, kind = self._piece(piece, inside)
            doc = np.searchsorted(offsets, start + position, side="right") - 1
            yield h, doc, start, end, kind, piece
            position = stop


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0 (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often (or with what total weight) each occurs."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)
