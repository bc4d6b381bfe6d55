"""Corpus-wide line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus is equal to it, or within one
character edit (insertion, deletion, substitution) of it.  Lines are compared
in normal form (lower case, blanks at both ends cut); earlier means smaller
(doc_id, line number).  Lines shorter than ``min_fuzzy`` characters
are only compared for equality; blank lines are left alone.

1. Each distinct normal form is reduced to its first place (within each batch
   of documents, then by aggregation on a 128-bit digest: the copies of a very
   common line never meet).
2. Lines that can have a neighbour are sought, which loses none: an edit leaves
   a line's beginning or its end as it is (cut at a multiple of 16 characters,
   so that lines of neighbouring length are cut alike).  Only lines that share
   one of these with another line go on.  Their texts are fetched from a second
   scan through a bitmap of fixed size (a full one only lets more lines pass).
3. They are cut into 16 segments, and a segment is kept if all of the line but
   this segment is shared, at the same or at neighbouring length.
4. In the kept segments, all variants within the edit bound are emitted as
   hashed keys: the line itself, and the line without each one character.
   Lines that differ by a substitution share the variant without that position;
   a line and one with a character more share the shorter line's full text.
5. Equal variants are joined: per key the earliest line (partial aggregation),
   joined back, so a key's lines are linked to its earliest and never paired
   among themselves.  Lines of one substitution key are all within the bound of
   each other; at an insertion key the full line is one text, linked to the
   earliest longer line, and each longer line to it.
6. The pairs are verified by edit distance on the texts, and a line is dropped
   if its partner is earlier.

Defined results: null or empty text has no line and stays as it is.  A document
whose lines all go is kept with text "" (``drop_emptied`` removes it).  Rows
equal in doc_id and text are one document: each gets the same text.  Documents
of one id and different text are ordered by a hash of the text, null ids first.
Extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, mix64, split_by_ids, stored

MIN_FUZZY = 20
SEGMENTS = 16
_GRID = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BLANKS = " \t\v\f\r"


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def normal_form(raw: str) -> str:
    return raw.strip(_BLANKS).lower()


def _cut(n: int) -> int:
    """Length of the compared beginning and end of a line of ``n`` characters: no more than half of it."""
    return n // (2 * _GRID) * _GRID if n >= 2 * _GRID else n // 2


def end_keys(line: str) -> list[int]:
    """Hashes of the line's beginning and end, of which one edit leaves one as it is, for all lines of its length
    and, where the cut moves with the length, for lines one character shorter."""
    n, out = len(line), []
    for a in sorted({_cut(n), _cut(n - 1)}):
        out.append(xxhash.xxh3_64_intdigest(line[:a].encode(), 0) - (1 << 63))
        out.append(xxhash.xxh3_64_intdigest(line[n - a:].encode(), 1) - (1 << 63))
    return out


def _lines(docs: DataFrame, min_fuzzy: int, doc_id: str, text: str, whole: bool) -> DataFrame:
    """(key, id, doc, row, no, line or ends): the distinct non-blank lines of each batch of documents, at their first places.

    ``line`` is the normal form (``whole``), ``ends`` its end keys; null for lines shorter than ``min_fuzzy``.
    """
    def run(batches):
        for batch in batches:
            docs = pa.Table.from_batches([batch])
            # documents in order, so that the first place met is the earliest
            order = pc.sort_indices(docs, sort_keys=[("doc", "ascending"), ("row", "ascending")], null_placement="at_start")
            docs = docs.take(order).combine_chunks()
            seen: set[bytes] = set()
            for first in range(0, len(docs), 512):
                keys, at, places, last = [], [], [], []
                for i, t in enumerate(docs.column("text").slice(first, 512).to_pylist()):
                    for no, raw in enumerate(t.split("\n") if t else ()):
                        line = normal_form(raw)
                        if not line:
                            continue
                        key = hashlib.md5(line.encode(), usedforsecurity=False).digest()
                        if key in seen:
                            continue
                        seen.add(key)
                        keys.append(key)
                        at.append(first + i)
                        places.append(no)
                        last.append(None if len(line) < min_fuzzy else line if whole else end_keys(line))
                key = pa.array(keys, pa.binary())
                ids = pa.array(np.frombuffer(b"".join(keys), dtype="<i8")[::2])
                yield pa.RecordBatch.from_arrays(
                    [key, ids, docs.column("doc").take(pa.array(at, pa.int64())).combine_chunks(),
                     docs.column("row").take(pa.array(at, pa.int64())).combine_chunks(), pa.array(places, pa.int32()),
                     pa.array(last, pa.string() if whole else pa.list_(pa.int64()))],
                    ["key", "id", "doc", "row", "no", "line" if whole else "ends"])

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"key binary, id bigint, doc {kind}, row bigint, no int, {'line string' if whole else 'ends array<bigint>'}")


class _Hashes:
    """Prefix sums of a line's characters under two bases: hashes of any part, and of the line without one."""

    def __init__(self):
        self.power = [np.ones(1, dtype=np.uint64)] * 2
        self.inverse = self.power

    def of(self, line: str) -> int:
        codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
        self.n = n = len(codes)
        with np.errstate(over="ignore"):
            if len(self.power[0]) < n + 2:
                run = lambda b: np.cumprod(np.append(np.uint64(1), np.full(2 * n + 64, b, dtype=np.uint64)))
                self.power = [run(b) for b in _BASES]
                self.inverse = [run(pow(b, -1, 1 << 64)) for b in _BASES]
            letters = mix64(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            self.sums = [np.append(np.uint64(0), np.cumsum(letters * p[:n])) for p in self.power]
        return n

    def without(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the line with [start, end) taken out, its parts moved together."""
        s, inv = self.sums[which], self.inverse[which]
        with np.errstate(over="ignore"):
            return mix64(s[start] + (s[self.n] - s[end]) * inv[end - start] + (self.n - (end - start)).astype(np.uint64))


def _edges(n: int, segments: int) -> np.ndarray:
    return np.arange(segments + 1) * n // segments


def _segment_keys(candidates: DataFrame, segments: int) -> DataFrame:
    """(seg_key, longer, seg, key): the line but for one segment, cut as its length, or as one less, is cut."""
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            keys, out = batch.column(0), []
            for line in batch.column(1).to_pylist():
                n = hashes.of(line)
                for longer in (0, 1):
                    e = _edges(n - longer, segments)
                    start, end = e[:-1], e[1:] + longer
                    tag = np.uint64((n - longer) * 1_000_003) + np.arange(segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    out.append(mix64(hashes.without(start, end, 0) ^ mix64(tag)))
            take = pa.array(np.repeat(np.arange(len(batch)), 2 * segments))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(np.repeat([False, True], segments), len(batch))),
                 pa.array(np.tile(np.arange(segments, dtype=np.int32), 2 * len(batch))), keys.take(take)],
                ["seg_key", "longer", "seg", "key"])

    return candidates.select("key", "line").mapInArrow(run, "seg_key bigint, longer boolean, seg int, key binary")


def variants(chosen: DataFrame, segments: int) -> DataFrame:
    """(v1, v2, at, full, key): hashed variants of each line in its kept segments ``kept`` (array of 2 * seg + longer).

    ``at`` is the deleted position, or -1 for keys that link a line (``full``) to one with a character more.
    """
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            keys, rows, held, took = batch.column(0), [], 0, []
            for i, (line, kept) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                n = hashes.of(line)
                at, mark = [np.zeros(1, dtype=np.int64)], [np.full(1, -1)]
                for k in kept:
                    e = _edges(n - k % 2, segments)
                    cut = np.arange(e[k // 2], e[k // 2 + 1] + k % 2)
                    at.append(cut)
                    mark.append(cut if k % 2 == 0 else np.full(len(cut), -1))
                at, mark = np.concatenate(at), np.concatenate(mark).astype(np.int32)
                end = at + 1
                end[0] = 0
                rows.append((hashes.without(at, end, 0), hashes.without(at, end, 1), mark, np.arange(len(at)) == 0))
                took.append(np.full(len(at), i))
                held += len(at)
                if held > 200_000 or i == len(batch) - 1:
                    v1, v2, mark, full = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v1.view(np.int64)), pa.array(v2.view(np.int64)), pa.array(mark), pa.array(full),
                         keys.take(pa.array(np.concatenate(took)))], ["v1", "v2", "at", "full", "key"])
                    rows, held, took = [], 0, []

    return chosen.select("key", "line", "kept").mapInArrow(run, "v1 bigint, v2 bigint, at int, full boolean, key binary")


def near_lines(candidates: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Keys of the candidate lines (key, first, line) that have an earlier line within one edit."""
    parts = stored(_segment_keys(candidates, segments), "segments")
    met = (parts.groupBy("seg_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("longer")).alias("own"))
           .where("n > 1 and own").select("seg_key"))
    kept = (parts.join(met, "seg_key").groupBy("key")
            .agg(F.collect_set(F.col("seg") * 2 + F.col("longer").cast("int")).alias("kept")))
    chosen = candidates.join(kept, "key")
    place = F.struct("first", "key")
    emitted = stored(variants(chosen, segments).dropDuplicates(["v1", "v2", "at", "key"])
                     .join(candidates.select("key", "first"), "key"), "variants")
    at = ["v1", "v2", "at"]
    # substitution keys: all lines of a key are within one edit of its earliest
    same = emitted.where("at >= 0")
    ends = same.groupBy(*at).agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    subs = same.join(ends, at).where(F.col("key") != F.col("best.key")).select("key", F.col("best.key").alias("other"))
    # insertion keys: one full text, its longer neighbours on the other side
    inserts = emitted.where("at < 0")
    ends = (inserts.groupBy(*at).agg(F.min(F.when(F.col("full"), place)).alias("whole"),
                                     F.min(F.when(~F.col("full"), place)).alias("longer"))
            .where("whole is not null and longer is not null"))
    ins = inserts.join(ends, at).select(
        "key", F.when(F.col("full"), F.col("longer.key")).otherwise(F.col("whole.key")).alias("other"))
    pairs = subs.union(ins).distinct()
    other = candidates.select(F.col("key").alias("other"), F.col("line").alias("other_line"), F.col("first").alias("other_first"))
    return (pairs.join(candidates, "key").join(other, "other")
            .where((F.col("other_first") < F.col("first")) & (F.levenshtein("line", "other_line", 1) >= 0))
            .select("key").distinct())


def line_places(docs: DataFrame, min_fuzzy: int = MIN_FUZZY, doc_id: str = "doc_id", text: str = "text",
                bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(doc, row, no, near): place of each distinct line's first occurrence; whether an earlier line is near it."""
    place = F.min(F.struct("doc", "row", "no")).alias("first")
    # a key is 128 bits, its first 64 are the id
    first = stored(_lines(docs, min_fuzzy, doc_id, text, False).groupBy("key").agg(
        place, F.first("id").alias("id"), F.first("ends").alias("ends")), "lines")
    ends = first.select("id", F.explode("ends").alias("end")).distinct()
    shared = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("end")
    wanted = stored(ends.join(shared, "end").select("id").distinct(), "wanted")
    passed, _ = split_by_ids(_lines(docs, min_fuzzy, doc_id, text, True).where("line is not null"), F.col("id"), wanted, bitmap_bits)
    here = F.struct("doc", "row", "no")
    texts = (passed.join(first.join(wanted, "id", "left_semi").select("key", "first"), "key")
             .where(here.eqNullSafe(F.col("first"))).dropDuplicates(["key"]).select("key", "first", "line"))
    near = near_lines(stored(texts, "candidates")).select("key", F.lit(True).alias("near"))
    return first.join(near, "key", "left").select("first.doc", "first.row", "first.no", F.coalesce("near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, min_fuzzy: int = MIN_FUZZY, doc_id: str = "doc_id", text: str = "text",
                counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with later copies of lines taken out of the text; columns as given.

    ``counts`` adds __n_lines, __n_copies and __n_near (non-blank lines, equal
    and near ones taken out).  ``drop_emptied`` removes documents that had lines
    and lost all of them.
    """
    # a document's own places are an array no longer than its lines
    kept = (line_places(docs, min_fuzzy, doc_id, text).groupBy("doc", "row")
            .agg(F.collect_list(F.when(~F.col("near"), F.col("no"))).alias("__kept"), F.count_if("near").alias("__n_near"))
            .withColumnsRenamed({"doc": "__doc", "row": "__row"}))
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    joined = (docs.join(kept, d.eqNullSafe(F.col("__doc")) & (F.xxhash64(t) == F.col("__row")), "left")
              .withColumn("__kept", F.coalesce("__kept", F.array().cast("array<int>")))
              .withColumn("__lines", F.split(t, "\n")))
    # kept places and lines in one sorted run: a line is kept if its own place stands before it
    marks = F.transform("__kept", lambda no: F.struct(no.alias("no"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    whole = F.transform("__lines", lambda x, no: F.struct(no.alias("no"), F.lit(1).alias("kind"), x.alias("line")))
    joined = joined.withColumn("__run", F.array_sort(F.concat(marks, whole)))
    before = F.concat(F.array(F.lit(None).cast("struct<no:int,kind:int,line:string>")), F.col("__run"))
    chosen = F.zip_with("__run", before, lambda x, b: F.when(
        (x["kind"] == 1) & ((b["kind"] == 0) | ~has_word(x["line"])), x["line"]))
    n_lines = F.size(F.filter("__lines", has_word))
    joined = (joined.withColumn("__out", F.array_join(F.filter(chosen, lambda x: x.isNotNull()), "\n"))
              .withColumn("__n_lines", F.when(t.isNull(), F.lit(0)).otherwise(n_lines).cast("long"))
              .withColumn("__n_near", F.coalesce("__n_near", F.lit(0)).cast("long"))
              .withColumn("__n_copies", F.col("__n_lines") - F.size("__kept") - F.col("__n_near")))
    if drop_emptied:
        joined = joined.where((F.col("__n_lines") == 0) | (F.size("__kept") > 0))
    emptied = (F.col("__n_lines") > 0) & (F.size("__kept") == 0)
    new_text = F.when(emptied, F.lit("")).otherwise(F.when(t.isNotNull(), F.col("__out"))).alias(text)
    return joined.select(*[new_text if c == text else F.col(f"`{c}`") for c in docs.columns],
                         *(["__n_lines", "__n_copies", "__n_near"] if counts else []))
