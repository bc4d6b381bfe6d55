import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from flowprep.llm import kneser_ney

from .conftest import ODD


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not (n[0] and n[1]):
        return [0.5] * 3
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.5]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def brute(rows):
    train = [t for d, t in rows if zlib.crc32(str(d if d is not None else "").encode()) % 7 != 2]
    uni, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        pairs.update(zip(["<s>", *w], w))
    followers, contexts = defaultdict(list), Counter()
    for (v, w), c in pairs.items():
        followers[v].append(c)
        contexts[w] += 1
    d2, d1 = discounts(pairs.values()), discounts(contexts.values())
    of = lambda d, c: d[min(c, 3) - 1] if c else 0
    n, size = sum(uni.values()), len(uni)
    g0 = sum(of(d1, c) for c in contexts.values()) / len(pairs) if pairs else 1

    def p1(w):
        return (contexts[w] - of(d1, contexts[w])) / max(len(pairs), 1) + g0 / (size + 1)

    def p(v, w):
        if v not in followers:
            return p1(w)
        total = sum(followers[v])
        return (pairs[v, w] - of(d2, pairs[v, w])) / total + sum(of(d2, c) for c in followers[v]) / total * p1(w)

    out = []
    for d, t in rows:
        w = tokens(t)
        out.append((d, zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2, len(w), sum(x in uni for x in w), n,
                    sum(math.log10((uni[x] + 1) / (n + size + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))))
    return out, p, list(uni)


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def scored(df):
    return [tuple(r) for r in kneser_ney.language_model_scores(df).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def test_matches_brute_force(spark, docs, texts):
    want, p, words = brute(texts)
    same(scored(docs), want)
    assert sum(p("<s>", w) for w in words) + p("<s>", "unseen") == pytest.approx(1)
    assert sum(p(words[0], w) for w in words) + p(words[0], "unseen") == pytest.approx(1)


def test_small_pieces_and_flushes(spark, docs, texts, monkeypatch):
    from flowprep.llm import common
    monkeypatch.setattr(common, "_PIECE", 700)
    hasher = common.ByteHasher()
    import pyarrow as pa
    column = pa.array([t for _, t in texts[:50]] + [None, "", "é" * 2000, "ab"])
    small, ends = kneser_ney._sequence(hasher, column)
    monkeypatch.setattr(common, "_PIECE", 1 << 20)
    large, ends2 = kneser_ney._sequence(common.ByteHasher(), column)
    assert (small == large).all() and (ends == ends2).all()
    counter = kneser_ney._Counter()
    monkeypatch.setattr(kneser_ney, "FLUSH", 100)
    import numpy as np
    total = Counter()
    for k in range(20):
        if counter.add(large[k * 90:(k + 1) * 90]):
            keys, n = counter.take()
            total.update(dict(zip(keys.tolist(), n.tolist())))
    keys, n = counter.take()
    total.update(dict(zip(keys.tolist(), n.tolist())))
    want = Counter(large[:1800].tolist())
    assert total == want
    keys = np.sort(np.unique(large))
    blob = kneser_ney._pack(keys, np.arange(len(keys)))
    back = kneser_ney._unpack(**blob)
    assert (back[0] == keys).all() and (back[1] == np.arange(len(keys))).all()


def test_odd_rows(spark, make, clashing):
    rows = ODD + [(21, "w " * 30_000), (22, "new words only")]
    same(scored(clashing(make(rows))), brute(rows)[0])
    assert scored(make([])) == []
    held = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    assert [r[3:] for r in scored(make(held))] == [(0, 0, 0.0, 0.0)] * 3
