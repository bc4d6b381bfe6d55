import random
import re

import numpy as np
import xxhash

from flowprep.llm import simhash
from flowprep.llm.components import components

from .conftest import ODD


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints(texts):
    for _, text in texts[:60] + ODD:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("A b C d e") == slow_fingerprint("A b C d e") != 0


def test_query_matches_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    assert [r.component_id for r in got] == brute([r.doc_id for r in got], fps)
    assert len({r.component_id for r in got}) < len(got)


def cluster(rng, n, flips):
    centre = rng.getrandbits(64)
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(n)]


def test_links_of_crowded_buckets(spark):
    """Small leaves: buckets are cut into nodes, node pairs are pruned and searched."""
    rng = random.Random(5)
    fps = list({*cluster(rng, 400, 5), *cluster(rng, 200, 9), *(rng.getrandbits(64) for _ in range(300)), 0, (1 << 64) - 1, 15})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    links = simhash.fingerprint_links(df, leaf_rows=16)
    found = {r.node: r.root for r in components(links).collect()}
    signed = sorted(simhash._signed(x) for x in fps)
    assert [found.get(x, x) for x in signed] == brute(signed, [x & (1 << 64) - 1 for x in signed])


def test_near_pairs_of_a_large_group():
    rng = random.Random(6)
    fp = np.array(sorted({*cluster(rng, 500, 6), *(rng.getrandbits(64) for _ in range(300))}), dtype=np.uint64)
    fp = fp[np.argsort(simhash._gray(fp))]
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    assert set(zip(*simhash._near_pairs(fp, 0, 4))) == want
    assert set(zip(*simhash._near_pairs(fp, 200, 4))) == {(i, j) for i, j in want if i < 200 <= j}


def test_odd_rows(spark, make, clashing):
    rows = simhash.near_duplicates(clashing(make(ODD))).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(empty) == 5 and {r.component_id for r in empty} == {1}
    kept = simhash.keep_one(make(ODD))
    assert kept.columns == make(ODD).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert simhash.keep_one(make([(None, "a b"), (None, "a b")])).count() == 1
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0


def test_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)
