import random

import pytest
import sentencepiece as library
from sentencepiece import sentencepiece_model_pb2

from flowprep.llm import sentencepiece

from .conftest import ODD


@pytest.fixture(scope="module")
def codec():
    return sentencepiece.Codec(sentencepiece.read_model())


@pytest.fixture(scope="module")
def unigram():
    """The library's own Viterbi over the same pieces and scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return library.SentencePieceProcessor(model_proto=proto.SerializeToString())


def slow_score(text, scores, unknown):
    """Best total score over all segmentations, by plain dynamic programming over every substring."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + (unknown if text[end - 1] not in scores else scores[text[end - 1]])
        for start in range(max(0, end - 20), end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
    return best[-1]


def test_matches_library(codec, unigram, texts):
    """Equal to the library's n-best lattice search on every word; never below its one-best search, which now and
    then returns a path of a lower score over this vocabulary."""
    scores = [s for _, s, _ in sentencepiece.read_model()]
    words = sorted({w for _, t in texts for w in t.split()})
    assert len(words) > 5000
    for w in words[::2]:
        ids = codec.encode(w).tolist()
        assert ids == unigram.nbest_encode_as_ids(w, 2)[0]
        assert sum(scores[i] for i in ids) >= sum(scores[i] for i in unigram.encode(w))
    rng = random.Random(1)
    for _ in range(100):  # a text is put together of its words
        some = rng.sample(words, 30)
        assert codec.encode(" ".join(some)).tolist() == [i for w in some for i in codec.encode(w).tolist()]


def test_best_score_of_any_text(codec):
    pieces = sentencepiece.read_model()
    scores = {p: s for p, s, kind in pieces if kind == 1}
    rng = random.Random(4)
    for _ in range(400):
        part = "".join(rng.choice("▁▁theinaré,.0漢☃") for _ in range(rng.randrange(1, 14)))
        ids, total, text = codec.segment(part), 0.0, part
        for i in ids:  # bytes stand for one unknown character
            if pieces[i][2] == 6:
                continue
            total += pieces[i][1]
        unknown = sum(c not in scores for c in text)
        assert total + unknown * codec.unknown_score == pytest.approx(slow_score(text, scores, codec.unknown_score), rel=1e-12)


def test_parts_do_not_change_the_result(codec, texts):
    whole = sentencepiece.Codec(sentencepiece.read_model(), memo=5)
    for _, t in texts[:20]:
        line = t.split("\n")[0][:200]
        assert codec.encode(line).tolist() == whole.encode(line).tolist() == codec.segment("▁" + line.replace(" ", "▁"))


def test_round_trip(spark, docs, make, clashing):
    assert sentencepiece.encode(docs).where("not round_trip").count() == 0
    odd = ODD + [(10, "tab\tand  two blanks "), (11, " lead"), (12, "☃ 漢字 \x00 \U0001F600"), (13, "a▁b"), (14, "x" * 100_000)]
    out = sentencepiece.encode(clashing(make(odd)))
    rows = sentencepiece.decode(out).collect()
    assert len(rows) == len(odd)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[13].round_trip is False and by[13]["__text"] == "a b"
    for doc, text in odd:
        if doc and doc != 13:
            assert by[doc].round_trip and by[doc]["__text"] == (text or "") and by[doc].n_tokens == len(by[doc].ids)
    assert by[1].ids == [] and sentencepiece.encode(make([])).count() == 0
