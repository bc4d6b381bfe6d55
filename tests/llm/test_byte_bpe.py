"""Byte-level BPE against the tokenizer library and plain merging."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from flowprep.llm import byte_bpe as B
from flowprep.llm.queries import QUERIES

from .conftest import ODD, SF


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(B.ranks_path())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    """The encoder, with the decoder's decode."""
    both = B.Encoder(ranks, B.split_pattern(), B.stand_ins())
    both.decode = B.Decoder(ranks).decode
    return both


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_whole_texts_like_the_library(codec, library, texts):
    for _, t in texts:
        assert ids(codec.encode(t or "")) == library.encode_ordinary(t or "")
        assert codec.decode(codec.encode(t or "")) == (t or "")


def test_random_bytes_and_scripts(codec, library):
    rng = random.Random(3)
    alphabets = ["abcdeeeaattt", "ab é漢字日本語!  \n\t😀ßا", "aA0 '’sdlltve", " \n\t  ", "АБВгд ежз", "===---###  "]
    for k in range(6000):
        s = "".join(rng.choices(alphabets[k % 6], k=rng.randrange(50)))
        assert ids(codec.encode(s)) == library.encode_ordinary(s), s


def test_every_character(codec, library):
    """One text of a stretch of characters each; also those that the two libraries' Unicode tables class apart."""
    points = [*range(0, 0xD800, 7), *range(0xE000, 0x30000, 11), *sorted(codec.stand_in)[::13]]
    for k in range(0, len(points), 256):
        s = "".join(f"x{chr(p)}1{chr(p)} {chr(p)}a\n" for p in points[k : k + 256])
        assert ids(codec.encode(s)) == library.encode_ordinary(s)
        assert codec.decode(codec.encode(s)) == s


def test_transducer_is_plain_merging():
    """Random merges over three bytes, most of them of many readings; forgetting all states changes nothing."""
    rng = random.Random(8)
    for _ in range(60):
        ranks = {b: i for i, b in enumerate([b"a", b"b", b"c"])}
        tokens = list(ranks)
        while len(ranks) < 30:
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in ranks and len(new) < 9:
                ranks[new] = len(ranks)
                tokens.append(new)
        many, few = B.Transducer(ranks), B.Transducer(ranks, max_states=4)
        for _ in range(60):
            data = bytes(rng.choices(b"aabc", k=rng.randrange(40)))
            want = B.merge(ranks, data)
            assert many.encode(data) == want and few.encode(data) == want and list(many.stream(data)) == want
        assert len(few.states) <= 5


def test_lookahead_is_bounded(ranks):
    """A token is out once as many bytes as the longest token has are read beyond it."""
    t, longest = B.Transducer(ranks), max(map(len, ranks))
    data = b" hello world, the quick brown fox" * 20
    read = 0

    def feed():
        nonlocal read
        for b in data:
            read += 1
            yield b

    out = 0
    for token in t.stream(feed()):
        out += len(t.raw[token])
        assert read - out <= 2 * longest


def test_long_matches_take_linear_time(codec):
    for s in ("a" * 1_000_000, " " * 1_000_000, "ab" * 500_000, "é" * 500_000, "word " * 300_000):
        start = time.time()
        assert codec.decode(codec.encode(s)) == s
        assert time.time() - start < 20


def test_streaming_decoder():
    raw = [bytes([b]) for b in range(256)] + ["é".encode(), "漢".encode()[:2], "漢".encode()[2:], "x漢".encode()[:3], "😀".encode()]
    rng = random.Random(1)
    for _ in range(3000):
        given = rng.choices([*range(256), *range(256, 261)] if rng.random() < 0.5 else [65, 0xF0, 0x9F, 0x98, 0x80, 0xC3, 0xA9, 257, 258, 259, 260, 0xED, 0xA0], k=rng.randrange(12))
        d = B.StreamDecoder(raw)
        parts, cut = [], 0
        while cut < len(given):
            n = rng.randrange(1, 4)
            parts.append(d.feed(np.array(given[cut : cut + n], dtype=np.uint32)))
            assert len(d.tail) <= 3
            cut += n
        assert "".join(parts) + d.finish() == b"".join(raw[i] for i in given).decode("utf-8", "replace")


def test_odd_rows(make, clashing):
    rows = ODD + [(7, "<|endoftext|>"), (8, "a\x00b"), (9, "long " * 5000)]
    df = clashing(make(rows))
    out = B.round_trip(df).collect()
    want = sorted((str(d), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), r.decoded) for r in out) == want
    assert sorted((str(r.doc_id), r["__text"]) for r in B.decode(B.encode(df)).collect()) == want
    assert all(r.n_tokens * 4 == len(r.ids) and (r.n_tokens > 0) == (r.decoded != "") for r in out)
    assert B.digests(B.round_trip(make([]))).count() == 0


def test_query(spark, library, texts):
    from hashlib import sha256
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        want = library.encode_ordinary(t or "")
        assert got[d].n_tokens == len(want)
        assert got[d].ids_sha256 == sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == sha256((t or "").encode()).hexdigest()
