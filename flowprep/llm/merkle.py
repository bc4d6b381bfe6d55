"""Merkle manifest of a dataset: a postorder append log, written by aligned builders, and proofs read from it.

Every row is a leaf; the leaves of a group (a source) in key order make a tree in
which runs of up to 16 consecutive nodes become their hash until one node is left
(the last run may be short, also a single node).  The groups' roots, in order of
their names, make the top tree in the same way.

Builders are aligned: a builder takes leaves b * 4096 to (b + 1) * 4096 of one tree,
so that no node but the roots of the builders' subtrees depends on two of them.  A
builder appends each node to its part of the log when the node is complete, children
first.  The roots of one tier's builders are the leaves of the next tier's; the last
tier has one builder a tree.  Three levels a tier, so the tiers are few at any size.

In such a log no addresses are stored: a node is complete after all nodes to its left
on its level and below, and after those above that end before it begins, so its
position is a closed form of its level, its index and the number of leaves
(``position``).  A proof takes the siblings of a node and of each of its ancestors
from their positions; the parts above a builder's root come down from the next tier.

Rows are numbered by a range partitioning of (group, key), so a group of any size is
spread over tasks; a builder's share is 4096 rows at most.  Nothing but the root and
the number of leaves of the largest tree comes to the driver.

Defined results: nulls are ``-`` in a leaf; the null group comes first and is a group
of its own; null keys come first in their group.  Rows with equal keys follow each
other by their leaves (rows that are equal in all are interchangeable, each is a leaf).
Empty and very long texts are values like others.  A table without rows has no root.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.position import PID, with_position
from .common import lower_ascii, stored

FAN = 16
TIER = 3                 # levels that one builder makes
SHARE = FAN ** TIER      # leaves of one builder
HEX = 64
TREE = ["tree", "unnamed"]
_PATH = "array<struct<slot:int,siblings:string>>"


def H(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


# ---------------------------------------------------------------- one builder's part of the log

def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place in the log of node ``index`` of ``level`` in a tree of ``leaves`` leaves and ``top`` levels above them.

    With e the leaves that end with the node: on its own level and below, all nodes over the first e leaves are
    in the log by then; above it those that end where the node begins or earlier.
    """
    end = min((index + 1) * FAN ** level, leaves)
    below = sum(-(-end // FAN ** m) for m in range(level + 1))
    above = sum(index // FAN ** (m - level) for m in range(level + 1, top + 1))
    return below + above - 1


class Log:
    """An append log of hex digests in the order in which nodes are completed."""

    def __init__(self, top: int):
        self.top, self.data = top, bytearray()
        self.open: list[list[bytes]] = [[] for _ in range(top)]

    def append(self, digest: bytes, level: int = 0) -> None:
        self.data += digest
        if level < self.top:
            self.open[level].append(digest)
            if len(self.open[level]) == FAN:
                self._complete(level)

    def _complete(self, level: int) -> None:
        children, self.open[level] = self.open[level], []
        self.append(H(b"".join(children)), level + 1)

    def close(self) -> bytes:
        """Completes the short runs at the right edge, lowest first; the log."""
        for level in range(self.top):
            if self.open[level]:
                self._complete(level)
        return bytes(self.data)


class Reader:
    """Siblings of a builder's nodes, by their positions in its part of the log."""

    def __init__(self, log: bytes, leaves: int, top: int):
        self.log, self.leaves, self.top = log, leaves, top
        self.runs: dict[tuple[int, int], bytes] = {}

    def run(self, level: int, run: int) -> bytes:
        """The digests of one run of a level, joined."""
        known = self.runs.get((level, run))
        if known is None:
            width = -(-self.leaves // FAN ** level)
            at = [position(level, i, self.leaves, self.top) * HEX for i in range(run * FAN, min(run * FAN + FAN, width))]
            known = self.runs[level, run] = b"".join([self.log[p : p + HEX] for p in at])
        return known

    def path(self, leaf: int) -> list[tuple[int, bytes]]:
        """(place in the run, the others of the run joined) for the leaf and its ancestors below this builder's root."""
        out = []
        for level in range(self.top):
            run, slot = divmod(leaf, FAN)
            whole = self.run(level, run)
            out.append((slot, whole[: slot * HEX] + whole[slot * HEX + HEX :]))
            leaf = run
        return out


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for slot, others in path:
        digest = H(others[: slot * HEX] + digest + others[slot * HEX :])
    return digest


# ---------------------------------------------------------------- leaves

def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(key, tree, unnamed, leaf, tampered): the leaf of each document, and that after the test's tampering (null: none)."""
    c = {n: F.col(f"`{n}`") for n in ("doc_id", "source", "lang", "n_chars", "text")}
    rest = [c["doc_id"], c["source"], c["lang"], c["n_chars"]]
    hit = F.coalesce(F.crc32(c["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    return docs.select(c["doc_id"].alias("key"), F.coalesce(c["source"].cast("string"), F.lit("")).alias("tree"), c["source"].isNull().alias("unnamed"),
                       leaf_digest(*rest, c["text"]).alias("leaf"),
                       F.when(hit, leaf_digest(*rest, lower_ascii(c["text"]))).alias("tampered"))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``pos`` (from 0) in their tree and ``n``, the tree's number of leaves."""
    order = [F.col("unnamed").desc(), F.col("tree"), F.col("key"), F.col("leaf"), F.col("_scan")]
    at = with_position(leaves.withColumn("_scan", F.monotonically_increasing_id()), order, "_at", keep_partition=True)
    # a row per (range partition, tree); joined back on both, a key that no tree can dominate
    whole = Window.partitionBy(*TREE)
    slices = (at.groupBy(PID, *TREE).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
              .withColumn("_first", F.min("_from").over(whole)).withColumn("n", F.sum("_rows").over(whole))
              .select(PID, *TREE, "_first", "n"))
    return at.join(slices, [PID, *TREE]).withColumn("pos", F.col("_at") - F.col("_first")).drop(PID, "_at", "_first", "_scan")


# ---------------------------------------------------------------- building

def _tops(n: int) -> int:
    return min(TIER, height(n))


def _build(table: pa.Table) -> pa.Table:
    """One builder: its digests in order -> one row with its part of the log."""
    table = table.sort_by("pos")
    n = table.column("n")[0].as_py()
    log = Log(_tops(n))
    for digest in table.column("leaf").to_pylist():
        log.append(digest.encode())
    part = table.slice(0, 1).select([*TREE, "block", "n"])
    return part.append_column("leaves", pa.array([len(table)], pa.int64())).append_column(
        "log", pa.array([log.close().decode()], pa.string()))


def _tier(inputs: DataFrame) -> DataFrame:
    """(tree, unnamed, block, n, leaves, log) of (tree, unnamed, pos, n, leaf): one tier of builders."""
    return stored(inputs.select(*TREE, "pos", "n", "leaf", F.expr(f"pos div {SHARE}").alias("block"))
                  .groupBy(*TREE, "block").applyInArrow(
                      _build, "tree string, unnamed boolean, block bigint, n bigint, leaves bigint, log string"), "merkle-log")


def _root_of(part: str = "log") -> Column:
    return F.substring(part, -HEX, HEX)


def build(leaves: DataFrame) -> list[DataFrame]:
    """The tiers of all trees over numbered ``leaves`` (tree, unnamed, pos, n, leaf), lowest first."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    tiers = [_tier(leaves)]
    while largest > SHARE:
        largest = -(-largest // SHARE)
        above = tiers[-1].where(F.col("n") > SHARE).select(
            *TREE, F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(SHARE)).cast("long").alias("n"), _root_of().alias("leaf"))
        tiers.append(_tier(above))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, unnamed, root) of each tree: its last tier's one builder holds it."""
    found = [t.where(F.col("n") <= SHARE).select(*TREE, _root_of().alias("root")) for t in tiers]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- proofs

def _paths(row: dict, above: list[dict]) -> list[list[dict]]:
    reader = Reader(row["log"].encode(), row["leaves"], _tops(row["n"]))
    return [[{"slot": s, "siblings": o.decode()} for s, o in reader.path(i)] + above for i in range(row["leaves"])]


def _descend(key, logs: pa.Table, above: pa.Table) -> pa.Table:
    """One builder: the path of its root -> those of its leaves, which are the roots of the tier below."""
    row, over = logs.to_pylist()[0], above.to_pylist()[0]
    paths = _paths(row, over["path"])
    n = len(paths)
    return pa.table({"tree": [row["tree"]] * n, "unnamed": [row["unnamed"]] * n,
                     "block": pa.array([row["block"] * SHARE + i for i in range(n)], pa.int64()),
                     "subroot": [over["subroot"]] * n,
                     "path": pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())])))})


def top_down(tiers: list[DataFrame], start: DataFrame) -> DataFrame:
    """(tree, unnamed, block, subroot, path) of the lowest tier's builders, from ``start`` (tree, unnamed, subroot, path)."""
    def last(tier: DataFrame) -> DataFrame:
        one = tier.where(F.col("n") <= SHARE).select(*TREE, "block")
        return one.join(start, TREE).select(*TREE, "block", "subroot", "path")

    over = last(tiers[-1])
    for upper, lower in zip(tiers[:0:-1], tiers[-2::-1]):
        keys = [*TREE, "block"]
        down = upper.groupBy(*keys).cogroup(over.toDF(*over.columns).groupBy(*keys)).applyInArrow(
            _descend, f"tree string, unnamed boolean, block bigint, subroot string, path {_PATH}")
        over = stored(down.unionByName(last(lower)), "merkle-paths")
    return over


def _prove(whole_root: str, with_paths: bool):
    def run(key, rows: pa.Table, logs: pa.Table) -> pa.Table:
        row = logs.to_pylist()[0]
        reader = Reader(row["log"].encode(), row["leaves"], _tops(row["n"]))
        above = [(p["slot"], p["siblings"].encode()) for p in row["path"]]
        over = b"".join([others for _, others in above])
        out: dict[str, list] = {"proof_sha256": [], "folded_root": []}
        paths = []
        leaves, changed = rows.column("leaf").to_pylist(), rows.column("tampered").to_pylist()
        for pos, leaf, other in zip(rows.column("pos").to_pylist(), leaves, changed):
            path = reader.path(pos - row["block"] * SHARE)
            out["proof_sha256"].append(sha256(b"".join([o for _, o in path]) + over).hexdigest())
            out["folded_root"].append(fold((leaf if other is None else other).encode(), path + above).decode())
            if with_paths:
                paths.append([{"slot": s, "siblings": o.decode()} for s, o in path + above])
        n = len(rows)
        columns = [rows.column("key"), rows.column("leaf"), pa.array([row["subroot"]] * n, pa.string()),
                   pa.array([whole_root] * n, pa.string()), pa.array(out["proof_sha256"], pa.string()),
                   pa.array(out["folded_root"], pa.string()), pa.array([f == whole_root for f in out["folded_root"]], pa.bool_())]
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if with_paths:
            columns.append(pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())]))))
            names.append("proof")
        return pa.table(columns, names=names)
    return run


def manifest(leaves: DataFrame, with_paths: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of (key, tree, unnamed, leaf, tampered) rows.

    ``folded_root`` is worked out from the tampered leaf (where there is one, else the leaf) and the
    leaf's proof.  ``with_paths`` adds the proof itself: (place in its run, the run's other digests) a level.
    """
    kind = leaves.schema["key"].dataType.simpleString()
    rows = numbered(stored(leaves, "merkle-leaves"))
    tiers = build(rows)
    # the top tree: one leaf a group, in order of the groups' names
    groups = stored(roots(tiers), "merkle-subroots")
    named = with_position(groups, [F.col("unnamed").desc(), F.col("tree")], "pos", total_col="n").select(
        F.lit("").alias("tree"), F.lit(False).alias("unnamed"), "pos", "n", F.col("root").alias("leaf"),
        F.col("tree").alias("group"), F.col("unnamed").alias("group_unnamed"))
    top = build(named)
    whole = roots(top).first()
    whole_root = whole["root"] if whole else ""
    begin = leaves.sparkSession.createDataFrame([("", False, "", [])], f"tree string, unnamed boolean, subroot string, path {_PATH}")
    over = top_down(top, begin)
    in_top = _each_group(top[0].join(over.select(*TREE, "block", "path"), [*TREE, "block"]), named)
    paths = top_down(tiers, in_top)
    below = tiers[0].join(paths.select(*TREE, "block", "subroot", "path"), [*TREE, "block"])
    keys = [*TREE, "block"]
    members = rows.select("key", *TREE, "pos", "leaf", "tampered", F.expr(f"pos div {SHARE}").alias("block"))
    names = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return members.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInArrow(
        _prove(whole_root, with_paths), names + (f", proof {_PATH}" if with_paths else ""))


def _each_group(top: DataFrame, named: DataFrame) -> DataFrame:
    """(tree, unnamed, subroot, path) of each group: the path of its root in the top tree."""
    def run(key, groups: pa.Table, logs: pa.Table) -> pa.Table:
        row = logs.to_pylist()[0]
        paths = _paths(row, row["path"])
        at = [p - row["block"] * SHARE for p in groups.column("pos").to_pylist()]
        return pa.table([groups.column("group"), groups.column("group_unnamed"), groups.column("leaf"),
                         pa.array([paths[i] for i in at], pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())])))],
                        names=["tree", "unnamed", "subroot", "path"])

    members = named.select("pos", "leaf", "group", "group_unnamed", F.expr(f"pos div {SHARE}").alias("block"))
    return stored(members.groupBy("block").cogroup(top.groupBy("block")).applyInArrow(
        run, f"tree string, unnamed boolean, subroot string, path {_PATH}"), "merkle-groups")
