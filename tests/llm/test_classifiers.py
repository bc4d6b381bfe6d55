import random
import zlib

import numpy as np
import pytest

from flowprep.llm import quality_classifier, toxicity

from .conftest import ODD

SF01 = "/root/testdata/sf0.1"


def held_out(rows, labels):
    return [(r, labels[r["doc_id"]]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in labels]


@pytest.fixture(scope="module")
def large(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_quality_on_held_out_rows(large):
    docs, labels = large
    rows = quality_classifier.classify(docs.select("doc_id", "text"), labels).collect()
    pairs = held_out(rows, {r.doc_id: r.quality for r in labels.collect()})
    good = [r["__predicted"] for r, y in pairs if y == 1]
    bad = [r["__predicted"] for r, y in pairs if y == 0]
    print("quality", len(good), np.mean(good), len(bad), np.mean(bad))
    assert len(rows) == docs.count() and np.mean(good) > 0.98 and np.mean(bad) < 0.15
    p, y = np.array([r["__score"] for r, _ in pairs]), np.array([y for _, y in pairs])
    for low, high in ((0, 0.1), (0.9, 1.01)):  # calibrated: the mean score of a bin is near its share
        here = (p >= low) & (p < high)
        assert abs(p[here].mean() - y[here].mean()) < 0.06


def test_toxicity_on_held_out_rows(large):
    docs, labels = large
    rows = toxicity.classify(docs, labels).collect()
    pairs = held_out(rows, {r.doc_id: r.toxic for r in labels.collect()})
    bad = [r.predicted for r, y in pairs if y == 1]
    good = [r.predicted for r, y in pairs if y == 0]
    print("toxic", len(bad), np.mean(bad), len(good), np.mean(good))
    assert len(rows) == docs.count() and np.mean(bad) > 0.9 and np.mean(good) < 0.01
    assert all(r.evidence for r in rows if r.predicted)


def test_rare_words_of_the_sample_count(spark, make):
    # the toxic words stand in three labelled rows each, and each document has a term
    rows = [(i, f"quiet garden word{'abcdefghij'[i % 10]} " + ("vile rant" if i % 40 == 7 else "calm talk")) for i in range(1, 121)]
    labels = spark.createDataFrame([(i, int(i % 40 == 7)) for i, _ in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(make([*rows, (500, "such a vile rant"), (501, "calm talk")]), labels).collect()}
    assert got[500].score > 2 * got[501].score and got[500].evidence[0].label == 1
    assert all(r.evidence for r in got.values())


@pytest.mark.parametrize("n_terms, most", [(40, 6), (3000, 60)])
def test_nearest_examples_are_exact(n_terms, most):
    assert (n_terms > toxicity.COMMON) == (most > 6)  # the second case has postings
    rng = random.Random(8)
    vectors = []
    for _ in range(700):
        # low term numbers are in many examples
        at = np.array(sorted({int(n_terms * rng.random() ** 2) for _ in range(rng.randrange(1, most))}))
        w = np.array([rng.random() + 0.1 for _ in at])
        vectors.append((at, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, n_terms)
    dense = np.zeros((700, n_terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for q in range(0, 700, 23):
        cosine = np.round(dense @ dense[q], 12)
        cosine[q] = 0
        order = [i for i in np.lexsort((np.arange(700), -cosine)) if cosine[i] > 0][:15]
        rows, scores = index.nearest(*vectors[q], 15, skip=q)
        assert np.allclose(scores, cosine[order]) and set(rows[scores > scores[-1]]) == {i for i in order if cosine[i] > cosine[order[-1]]}


def test_context_vectors_match_a_plain_count(spark, make):
    rows = [(1, "the cat sat THE the the end"), (2, "a!! b, the cat"), (3, None)]
    got = quality_classifier.context_vectors(make(rows))
    place, sign = quality_classifier._index_vectors()
    hasher = quality_classifier.ByteHasher(fold_case=False, split_punctuation=True)
    import pyarrow as pa
    want = np.zeros_like(got, dtype=float)
    for _, text in rows:
        ids = [int(b) for bucket, _ in quality_classifier._tokens(hasher, pa.array([text], pa.string())) for b in bucket]
        for i, t in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    for k in range(quality_classifier.NONZERO):
                        want[t, place[ids[j], k]] += sign[ids[j], k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)], [(None, 1), (1, None), (99, 0)], [(4, 0), (6, 1), (4, 0)]])
def test_odd_rows(spark, make, clashing, rows):
    labels = spark.createDataFrame([(d, y, y) for d, y in rows], "doc_id bigint, quality int, toxic int")
    odd = clashing(make(ODD + [(20, "a " * 50_000)]))
    out = quality_classifier.classify(odd, labels)
    assert out.columns == [*odd.columns, "__score", "__predicted"]
    got = out.collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["__score"] <= 1 for r in got)
    kept = quality_classifier.classify(odd, labels, keep_only=True)
    assert kept.columns == odd.columns and kept.count() == sum(r["__predicted"] for r in got)
    toxic = toxicity.classify(odd, labels).collect()
    assert len(toxic) == len(got) and all(0 <= r.score <= 1 for r in toxic)
    empty = make([])
    assert quality_classifier.classify(empty, labels).count() == 0 and toxicity.classify(empty, labels).count() == 0


def test_weights_are_worked_out_in_slices():
    """op6's check: the driver's memory; term weights of the sample take little beside the sample's own arrays."""
    import tracemalloc
    rng, each, n = np.random.default_rng(5), 200, 5000
    at, size, y = rng.integers(0, 1000, each * n).astype(np.int32), np.full(n, each), (np.arange(n) % 3 == 0).astype(float)
    tracemalloc.start()
    got = toxicity.relevance(y, at, size, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * each * n  # bytes: the terms themselves
    either, a = np.bincount(at, minlength=1000).astype(float), np.bincount(at, np.repeat(y, size), 1000)
    pos, neg = y.sum(), n - y.sum()
    chi = (pos + neg) * (a * neg - (either - a) * pos) ** 2 / (pos * neg * np.maximum(either, 1) * np.maximum(pos + neg - either, 1))
    assert np.allclose(got, np.sqrt(chi) + toxicity.FLOOR)


def test_a_process_holds_little_beside_the_examples():
    """op6's check: an executor's memory; look-up of terms, matrix and postings take little beside the sample's places."""
    import pickle
    import tracemalloc
    rng, each, n, n_terms = np.random.default_rng(6), 200, 3000, 60_000
    at = np.concatenate([np.sort(rng.choice(n_terms, each, replace=False)) for _ in range(n)]).astype(np.int32)
    words = sorted({"".join(w) for w in rng.choice(list("abcdefghijklmnop"), (n_terms + 500, 7))})[:n_terms]
    tf, y = rng.integers(1, 9, each * n).astype(np.int32), (np.arange(n) % 3 == 0).astype(float)
    df, size = np.bincount(at, minlength=n_terms).astype(float), np.full(n, each)
    fitted = toxicity.Model(" ".join(words), df, n, [str(i) for i in range(n)], y, at, tf, size)
    blob = pickle.dumps(fitted)
    texts = [" ".join(" ".join([words[t]] * int(c)) for t, c in zip(at[k : k + each], tf[k : k + each])) for k in range(0, 64 * each, each)]
    tracemalloc.start()
    got = pickle.loads(blob).scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak bytes a place", peak / (each * n))
    assert peak < 70 * each * n  # 62; 79 with a dictionary of all terms and 64-bit weights
    assert all(e[0][0] == str(i) and e[0][1] == 1 for i, (_, e) in enumerate(got))  # each text's nearest is itself


@pytest.mark.parametrize("hashed", [hash, len, lambda t: hash(t[:1])])
def test_places_are_those_of_a_dictionary(monkeypatch, hashed):
    monkeypatch.setattr(toxicity, "hash", hashed, raising=False)  # terms of one hash, too
    monkeypatch.setattr(toxicity, "_SLICE", 16)
    for terms in ([], ["a"], sorted({"ab" * k + c for k in range(4) for c in ("x", "yé", "ж", "語", "zz")})):
        known = {t: i for i, t in enumerate(terms)}
        asked = [*terms[::-1], "none", "x" * 40, "a", "", *terms[:3]]
        assert toxicity.Places(" ".join(terms))(asked).tolist() == [known.get(t, -1) for t in asked]
    assert toxicity.Places("a b")([]).tolist() == []


def test_weights_from_counts_are_those_of_vectors():
    rng, n_terms = np.random.default_rng(9), 2000
    assert n_terms > toxicity.COMMON  # some terms have postings
    size, by_term = rng.integers(1, 60, 1500), rng.random(n_terms) + 0.1
    at = np.concatenate([np.sort(rng.choice(n_terms, k, replace=False)) for k in size]).astype(np.int32)
    tf, end = rng.integers(1, 400, len(at)).astype(np.uint16), np.cumsum(size)
    vectors = []
    for k, to in zip(size, end):
        w = (1 + np.log(tf[to - k : to].astype(np.float32))) * by_term[at[to - k : to]]
        vectors.append((at[to - k : to], w / np.linalg.norm(w)))
    plain, counted = toxicity.BlockMaxIndex(vectors, n_terms), toxicity.CountIndex(at, tf, size, by_term)
    for q in range(0, 1500, 97):
        (rows, cosine), (others, same) = plain.nearest(*vectors[q], 15, skip=q), counted.nearest(*vectors[q], 15, skip=q)
        assert np.allclose(cosine, same, atol=1e-11) and set(rows[cosine > cosine[-1] + 1e-9]) <= set(others)
