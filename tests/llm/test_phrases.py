"""Phrase mining against counting everything."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from flowprep.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, limit, min_count, share=80):
    """All phrases of (lang, text) rows counted, dropped and ranked."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        held = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * c[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in held:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, text, left, rest) in enumerate(sorted(ranked)[:limit]):
            out.append((lang, i + 1, text.decode(), -a, left, rest, n[lang], -s))
    return sorted(out)


def mined(df, **options):
    out = P.mine(df, **options)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


@pytest.fixture()
def invented():
    """Phrases that repeat, share parts and stand in each other, in three languages, with words of odd characters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ü", "ß-x", "'", "a b", "“q”"]
    fixed = ["new york city hall", "w1 w2 w3", "w2 w3", "Ü ß-x", "in the w4 of", "the w4"]
    rows = []
    for i in range(300):
        words = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("limit,min_count", [(2000, 3), (5, 3), (25, 6), (1, 2)])
def test_like_counting_everything(make, clashing, invented, limit, min_count):
    want = brute([(lang, t) for _, t, lang in invented], limit, min_count)
    assert want and mined(clashing(make(invented)), limit=limit, min_count=min_count) == want


def test_documents(docs):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert mined(docs, min_count=4, limit=50) == brute(rows, 50, 4)


def test_small_bitmaps_change_nothing(make, invented, monkeypatch):
    """Full of false hits, they only make tasks count more."""
    want = mined(make(invented), limit=10, min_count=3)
    monkeypatch.setattr(P.bitmap_of, "__defaults__", (9,))
    assert mined(make(invented), limit=10, min_count=3) == want


def test_odd_rows(make):
    rows = [(None, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "one", None), (4, "a b. a b! a\tB", "en"), (4, "a b. a b! a\tB", "en")]
    assert mined(make(rows), min_count=2) == brute([(lang, t) for _, t, lang in rows], 2000, 2)
    assert mined(make([])) == []
    assert mined(make([(1, "no two alike", "en")])) == []


def test_long_texts_are_read_across_pieces(make):
    text = "alpha beta gamma delta epsilon " * 90_000
    long_word = "x" * 3_000_000
    rows = [(1, text, "en"), (2, f"{long_word} end " * 2, "en")]
    assert mined(make(rows), min_count=2) == brute([(lang, t) for _, t, lang in rows], 2000, 2)


def test_long_words_do_not_collide():
    """Two different words that a polynomial modulo a power of two cannot tell apart."""
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    reader = P.PhraseReader()
    keys = [k for k, *_ in reader.words(pa.array(["en"]), pa.array([f"{one} {other}"]))]
    assert len(set(np.concatenate(keys).tolist())) == 2


@pytest.mark.parametrize("n,most", [(1, 85), (2, 130), (4, 180)])
def test_a_task_holds_little_memory(make, n, most):
    """Two tasks share an executor with its heap: what a worker holds of its phrases stays small, and none is lost."""
    make([])  # a session, for column expressions
    texts, full = MagicMock(), P.Bitmap(np.full(1 << 6, 255, dtype=np.uint8), 9)
    texts.sparkSession.sparkContext.broadcast = lambda value: SimpleNamespace(value=value)
    if n == 1:
        P.count_words(texts)
    else:
        P.count_phrases(texts, n, {"word": full}, lambda maps, words: np.ones(len(words[0]), dtype=bool))
    run = texts.mapInArrow.call_args.args[0]
    rng = np.random.default_rng(3)
    rows, size = (300, 1_000) if n == 1 else (300, 8_000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * rows), pa.array([" ".join(map(str, rng.integers(0, 1 << 20, size).tolist())) for _ in range(rows)])], ["lang", "text"])
    tracemalloc.start()
    try:
        counted = sum(int(np.sum(out.column(out.num_columns - 1).to_numpy())) for out in run([batch]))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert counted == rows * (size - n + 1)
    assert peak < most
