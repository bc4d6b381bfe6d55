import random

from flowprep.llm import decontaminate

from .conftest import ODD


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} - {""}


def brute(docs, items, threshold=0.8):
    return {(d, i): (len(a & b), len(b)) for d, t in docs for i, s in items
            for a, b in [(shingles(t), shingles(s))] if b and len(a & b) >= threshold * len(b) - 1e-9}


def test_matches_brute_force(spark, make):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 9, 10, 11, 14, 24, 25, 40, 70, 150])]
    docs = []
    for d in range(80):
        body = [rng.choice(words) for _ in range(rng.choice([3, 20, 400]))]
        item = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):  # word errors: containment around the limit
            item[rng.randrange(len(item))] = "odd"
        at = rng.randrange(len(body))
        docs.append((d, " ".join([*body[:at], *item, *body[at:]]).upper()))
    docs += [(100 + i, t) for i, t in items]
    got = decontaminate.find_items(make(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) > 20


def test_shuffle_joins_give_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.find_items(docs, items).drop("__row").collect()))
    monkeypatch.setattr(decontaminate, "SKETCH_ROWS", 0)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 0)
    assert sorted(map(tuple, decontaminate.find_items(docs, items).drop("__row").collect())) == want and want


def test_odd_rows(spark, make, clashing):
    items = spark.createDataFrame([(None, "one"), (1, None), (2, ""), (3, "tie of words here and there"), (3, "tie of words here and there"),
                                   (4, "tie of words here and there")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) if r.item_id is not None else (r.doc_id, -1) for r in
                 decontaminate.find_items(clashing(make(ODD)), items.withColumn("doc_id", items.item_id)).collect())
    assert got == [(4, -1), (5, -1), (6, 3), (6, 4)]  # repeated rows of document 4 count once
    clean = decontaminate.decontaminate(clashing(make(ODD)), items)
    assert clean.columns == clashing(make(ODD)).columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in clean.collect() if r.doc_id is not None) == [(True, 1), (True, 2), (True, 3)]
    assert clean.count() == 5
    none = items.limit(0)
    assert decontaminate.find_items(make(ODD), none).count() == 0 and decontaminate.decontaminate(make(ODD), none).count() == len(ODD)
    assert decontaminate.find_items(make([]), items).count() == 0


def test_item_in_a_very_long_document(spark, make):
    text = " ".join(f"a{i}" for i in range(60_000)) + " tie of words here and there"
    items = spark.createDataFrame([(3, "Tie of words\nhere and there")], "item_id bigint, text string")
    assert [(r.doc_id, r.containment) for r in decontaminate.find_items(make([(9, text)]), items).collect()] == [(9, 1.0)]
