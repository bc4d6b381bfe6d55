"""Merkle manifest against trees built in memory."""

import random
import zlib
from hashlib import sha256

from flowprep.llm import merkle as M

from .conftest import DOCS


def H(data):
    return sha256(data).hexdigest().encode()


def field(x):
    return b"-" if x is None else str(len(str(x).encode())).encode() + b":" + str(x).encode()


def leaf(row, text):
    return H(b"".join(field(x) for x in (row[0], row[3], row[2], row[4], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(b"".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf(r, text)
            for before, after in steps:
                d = H(b"".join([*before, d, *after]))
            proof = H(b"".join(x for b, a in steps for x in b + a))
            out.append((r[0], *(x.decode() for x in (leaf(r, r[1]), trees[s][-1][0], top[-1][0], proof, d)), d == top[-1][0]))
    return out


def same(spark, rows, extra=lambda df: df):
    docs = extra(spark.createDataFrame(rows, DOCS.replace("lang string, source string", "lang string, source string")))
    got = M.manifest(M.document_leaves(docs)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    return got


def test_positions_are_closed_form():
    for n in [*range(1, 300), 255, 256, 257, 4095, 4096]:
        leaves = [H(str(i).encode()) for i in range(n)]
        log = M.Log(M.height(n))
        for d in leaves:
            log.append(d)
        data, levels = log.close(), tree(leaves)
        assert len(data) == M.HEX * sum(map(len, levels)) and M.height(n) == len(levels) - 1
        for k, nodes in enumerate(levels):
            for i, d in enumerate(nodes):
                at = M.position(k, i, n, M.height(n)) * M.HEX
                assert data[at : at + M.HEX] == d


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = same(spark, rows)
    assert 0 < sum(r.verified for r in got) < len(got)


def test_hot_source_of_many_tiers(spark, clashing):
    rng = random.Random(4)
    rows = [(i, f"T{i}" if i % 7 else None, "en", "hot" if i % 3 else rng.choice(["a", "b", None, "ä", ""]), i) for i in range(9000)]
    rows += [(None, "X", None, None, None)] * 2 + [(5, "Dup", "en", "hot", 3)] * 40
    same(spark, rows, clashing)


def test_many_sources(spark):
    same(spark, [(i, "A", "x", f"s{i}", 1) for i in range(4200)])


def test_small_and_odd_tables(spark):
    assert same(spark, [(1, "One", None, "s", 3)])[0].proof_sha256 == sha256(b"").hexdigest()
    same(spark, [(1, "", "en", "", 0), (1, None, "en", None, None), (2, "lang " * 200_000, "en", "", 1), (None, None, None, None, None)])
    empty = spark.createDataFrame([], DOCS)
    assert M.manifest(M.document_leaves(empty)).count() == 0


def test_proofs_are_given_out(spark, docs):
    rows = M.manifest(M.document_leaves(docs), with_paths=True).collect()
    for r in rows:
        steps = [(p.slot, p.siblings.encode()) for p in r.proof]
        assert M.fold(r.leaf.encode(), steps).decode() == r.root
        assert sha256(b"".join(o for _, o in steps)).hexdigest() == r.proof_sha256
