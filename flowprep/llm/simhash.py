"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over the XXH64 hashes of a text's word
shingles.  All fingerprints within ``distance`` differing bits of each other are
linked, exactly, and connected into groups:

* Equal fingerprints are one entry.  The 64 bits are cut into ``segments``
  parts; two entries that differ in at most ``distance`` bits agree in all bits
  of at least ``segments - distance`` parts.  Each entry goes to one bucket per
  choice of that many parts, keyed by their bits, so each link has a bucket in
  common (6 parts and 4 bits: 15 buckets keyed by about 21 bits).
* A bucket's entries, sorted by Gray rank, form a hierarchy: entries with equal
  leading Gray-rank bits lie together and share a masked bit pattern.  A bucket
  of more than ``leaf_rows`` entries is cut into nodes by ever longer rank
  prefixes, in Spark; a node's pattern is the bits on which its entries agree.
  Node pairs whose patterns differ in more than ``distance`` bits are pruned
  whole; the others are searched, one task group each, of 2 * ``leaf_rows``
  entries at most.  No bucket is gathered beyond that, however hot it is.
* In a task group the same hierarchy goes on in numpy: differences on the bits
  that a level newly fixes are added to those of the level above, and a pair of
  subtrees is dropped once the sum passes ``distance``.
* A task group reports each entry's smallest linked entry in it, not all pairs:
  links grow with the entries.

Defined results: a text with no words (null, empty, blank) has fingerprint zero
and links like any other.  Rows may repeat: each is returned, with equal
results.  A null doc_id is never a group's id unless the whole group has none.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_by_ids, stored
from .components import components, local_roots
from .decontaminate import row_key

LEAF_ROWS = 4096
_CHUNK = 1 << 16
_FAN = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles (repeats count)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    end = (start + size)[min(shingle, len(words)) - 1 :]
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(start[k : min(n, k + _CHUNK)].tolist(), end[k : k + _CHUNK].tolist())])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp) per row of ``docs``: its id, ``row_key``, and fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"),
                        F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, row binary, fp bigint"))


def gray_rank(fp: Column) -> Column:
    """Position of a fingerprint in the reflected Gray code order (as the same 64 bits)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _segment_masks(segments: int, distance: int) -> list[int]:
    edges = [64 * i // segments for i in range(segments + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in kept) for kept in combinations(range(segments), segments - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(entries: DataFrame, leaf_rows: int, step: int = 8) -> DataFrame:
    """entries (bucket, key, fp, rank) with their node: the shortest rank prefix of at most ``leaf_rows`` entries.

    Levels beyond the first only see entries of nodes that are still too large.
    """
    done, open_, level = None, entries.withColumn("level", F.lit(0)).withColumn("prefix", F.lit(0).cast("long")), 0
    while True:
        at = ["bucket", "key", "prefix"]
        counts = open_.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
        crowded = stored(counts.where(F.col("__n") > leaf_rows).select(*at), "crowded")
        if level >= 64 or not crowded.head(1):
            return open_ if done is None else done.unionByName(open_)
        fits = open_.join(crowded, at, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        level += step
        open_ = stored(open_.join(crowded, at, "left_semi")
                       .withColumn("prefix", F.shiftrightunsigned("rank", 64 - level) if level < 64 else F.col("rank"))
                       .withColumn("level", F.lit(level)), "nodes")


def _near_pairs(fp: np.ndarray, split: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within ``distance`` of Gray-sorted ``fp``; with ``split``: i < split <= j only."""
    n = len(fp)
    if n <= _FAN * 2:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        i, j = i[near], j[near]
        cross = (i < split) & (j >= split) if split else slice(None)
        return i[cross], j[cross]
    # levels of the hierarchy, from the leaves up: (agreed mask, value) of runs of _FAN, _FAN * 8, ... entries
    levels, width = [], _FAN
    while True:
        first = np.arange(0, n, width)
        ones, some = np.bitwise_and.reduceat(fp, first), np.bitwise_or.reduceat(fp, first)
        levels.append((width, ~(ones ^ some), ones))
        if len(first) == 1:
            break
        width *= 8
    a = b = np.zeros(1, dtype=np.int64)
    spent, above = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        _, mask, value = levels[depth]
        if depth < len(levels) - 1:  # to the children of each pair that is left
            kids, child = len(mask), np.arange(8)
            pa_, pb_ = np.repeat(a, 64) * 8 + np.tile(np.repeat(child, 8), len(a)), np.repeat(b, 64) * 8 + np.tile(child, 8 * len(b))
            keep = (pa_ <= pb_) & (pb_ < kids) & (pa_ < kids)
            a, b, spent, above = pa_[keep], pb_[keep], np.repeat(spent, 64)[keep], np.repeat(above, 64)[keep]
        common = mask[a] & mask[b]
        spent = spent + np.bitwise_count((value[a] ^ value[b]) & common & ~above)
        live = spent <= distance
        a, b, spent, above = a[live], b[live], spent[live], common[live]
    lefts, rights = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = fp[x * _FAN : (x + 1) * _FAN], fp[y * _FAN : (y + 1) * _FAN]
        i, j = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= distance)
        i, j = i + x * _FAN, j + y * _FAN
        ok = (i < j) & ((i < split) & (j >= split) if split else True)
        lefts.append(i[ok])
        rights.append(j[ok])
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, int), np.zeros(0, int))


def group_links(fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of one task group: (entry, smallest linked entry) for entries with any.

    ``side`` 0 and 1: the two nodes of a pair (links across only); all 0: one node against itself.
    """
    split = int((side == 0).sum()) if side.any() else 0
    order = np.lexsort((_gray(fp), side))
    fp = fp[order]
    i, j = _near_pairs(fp, split, distance)
    if not len(i):
        return fp[:0], fp[:0]
    root = local_roots(len(fp), i, j)
    moved = root != np.arange(len(fp))
    return fp[moved], fp[root[moved]]


def _gray(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def fingerprint_links(entries: DataFrame, distance: int = 4, segments: int = 6, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b): links whose connected components are those of all pairs within ``distance``.

    ``entries`` has distinct ``fp``.
    """
    if not 0 <= distance < segments:
        raise ValueError("needs more segments than differing bits")
    keys = F.array(*[F.struct(F.lit(k).alias("bucket"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for k, m in enumerate(_segment_masks(segments, distance))])
    placed = (entries.select("fp", F.explode(keys).alias("at")).select("at.bucket", "at.key", "fp")
              .withColumn("rank", gray_rank(F.col("fp"))))
    at = ["bucket", "key"]
    cut = _nodes(placed, leaf_rows)
    nodes = (cut.groupBy(*at, "level", "prefix")
             .agg(F.count(F.lit(1)).alias("n"), F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
             .withColumn("mask", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some")))))
    nodes = stored(nodes, "nodes")
    # pairs of nodes of a bucket whose patterns allow a link; a lone entry has none with itself
    x, y = nodes.alias("x"), nodes.alias("y")
    apart = F.bit_count(F.col("x.ones").bitwiseXOR(F.col("y.ones")).bitwiseAND(F.col("x.mask"))
                        .bitwiseAND(F.col("y.mask")))
    name = lambda t: F.struct(f"{t}.level", f"{t}.prefix")
    several = nodes.groupBy(*at).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select(*at)
    pairs = (x.join(several, at, "left_semi").alias("x").join(y, at).where((name("x") < name("y")) & (apart <= distance))
             .select(*at, F.col("x.level").alias("la"), F.col("x.prefix").alias("pa"),
                     F.col("y.level").alias("lb"), F.col("y.prefix").alias("pb")))
    both = pairs.select(*at, "la", "pa", "lb", "pb", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("la").alias("level"), F.col("pa").alias("prefix")),
        F.struct(F.lit(1).alias("side"), F.col("lb").alias("level"), F.col("pb").alias("prefix")))).alias("m")).select(
            *at, "la", "pa", "lb", "pb", "m.side", "m.level", "m.prefix")
    alone = (nodes.where("n > 1").select(*at, F.col("level").alias("la"), F.col("prefix").alias("pa"),
                                         F.col("level").alias("lb"), F.col("prefix").alias("pb"),
                                         F.lit(0).alias("side"), "level", "prefix"))
    group = [*at, "la", "pa", "lb", "pb"]
    tasks = (cut.select(*at, "level", "prefix", "fp").join(alone.unionByName(both), [*at, "level", "prefix"])
             .select(F.xxhash64(*group).alias("g"), *group, "side", "fp"))

    def run(batches):
        """Groups come together (sorted); a group never spans more than what is kept of one batch."""
        kept = None
        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy() for k in range(len(group))])
            side, fp = batch.column(len(group)).to_numpy(), batch.column(len(group) + 1).to_numpy().view(np.uint64)
            if kept is not None:
                cols, side, fp = np.concatenate([kept[0], cols], axis=1), np.append(kept[1], side), np.append(kept[2], fp)
            first = np.append(0, np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1)
            a, b = _runs(first, side, fp, distance)
            kept = cols[:, first[-1] :], side[first[-1] :], fp[first[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        if kept is not None:
            a, b = group_links(kept[2], kept[1], distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return (tasks.repartition("g").sortWithinPartitions(*group)
            .select(*[F.col(c).cast("long") for c in group], F.col("side").cast("int"), "fp")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def _runs(first: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all runs but the last (which may go on in the next batch)."""
    length = np.diff(first)
    two = first[:-1][length == 2]  # by far the most: at once
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
    a, b = [fp[two + 1][near]], [fp[two][near]]
    for at, n in zip(first[:-1][length > 2].tolist(), length[length > 2].tolist()):
        x, y = group_links(fp[at : at + n], side[at : at + n], distance)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 6,
                    leaf_rows: int = LEAF_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, __row), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the own one
    included; ``fingerprint`` is 16 lower-case hex digits; ``__row`` is the
    document's ``row_key``.
    """
    own = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    entries = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    found = components(fingerprint_links(entries.select("fp"), distance, segments, leaf_rows))
    groups = entries.join(found, entries.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stored(groups.join(ids, "root").select("fp", "root", "component_id"), "groups")
    return (own.join(final, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                    F.col("row").alias("__row"), F.col("root").alias("__group")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id (null: last); columns as given.

    Of rows equal in doc_id and text one stays.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    found = stored(near_duplicates(docs, doc_id=doc_id, text=text, **options).select("__group", "doc_id", "__row"), "members")
    stay = stored(found.groupBy("__group").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row")), "stay")
    # rows that go, and rows that repeat, are looked at; all others stay where they are
    doubtful = (found.select("__row").join(stay, "__row", "left_anti")
                .union(found.groupBy("__row").count().where("count > 1").select("__row")))
    keyed = docs.withColumn("__row", row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    inside, outside = split_by_ids(keyed, F.xxhash64("__row"), doubtful.select(F.xxhash64("__row").alias("id")))
    return outside.unionByName(inside.join(stay, "__row", "left_semi").dropDuplicates(["__row"])).drop("__row")
