"""SentencePiece encoding and decoding: Aho-Corasick driven Viterbi.

The segmentation of a text is the one whose pieces have the largest sum of
scores.  One pass over the text finds it: an Aho-Corasick automaton over all
pieces names, at each position, the pieces that end there (following output
links), and each relaxes the best score at its end from that at its start.  A
character of no piece costs the worst score less 10 and becomes its UTF-8 bytes.

A text is " " + text with blanks written as U+2581.  No piece has a blank after
another character, and line breaks and tabs that stand in no longer piece are
pieces of their own: a best segmentation is put together of those
of the parts between, which are worked out once per task and kept in a bounded
memo (it changes no result).

The vocabulary is a file of a public tokenizer; its path is a parameter, its
pieces are broadcast (half a MB).  Its scores are merge ranks: the encoding is the
best by score, which need not be the one that merges in rank order find.

Defined results: null is taken as the empty text; the empty text has no token
and decodes to itself.  Decoding gives back every text exactly, but for U+2581 in
a text, which comes back as a blank (``round_trip`` false).  Rows may repeat.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_BLANK = "▁"
_APART = "\n\r\t"  # cut around, if no piece joins them to others
_MEMO = 400_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a SentencePiece model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in proto.pieces]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], memo: int = _MEMO):
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == _NORMAL]
        self.automaton = ahocorasick.Automaton()
        for i, p, s in normal:
            self.automaton.add_word(p, (len(p), i, s))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, _, s in normal) - 10
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(_BLANK, " ").encode() if kind == _NORMAL
                    else " ⁇ ".encode() if kind == _UNKNOWN else b"" for p, _, kind in pieces]
        apart = "".join(sorted(set(_APART) - {c for _, p, _ in normal if len(p) > 1 for c in p}))
        whole = any(_BLANK in p.lstrip(_BLANK) for _, p, _ in normal)
        self.parts = re.compile(r"(?s).+" if whole else f"[{apart}]|{_BLANK}*[^{_BLANK}{apart}]+|{_BLANK}+")
        self.memo: dict[str, bytes] = {}
        self.room = memo

    def segment(self, part: str) -> list[int]:
        """Ids of the best segmentation, by one pass over the matches."""
        n, low = len(part), float("-inf")
        best, start, piece = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here are final but for the unknown character

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                score = best[done] + self.unknown_score
                done += 1
                if best[done] == low:  # no piece ends here
                    best[done], start[done], piece[done] = score, done - 1, -1

        for last, (size, i, score) in self.automaton.iter(part):
            settle(last)
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1], start[last + 1], piece[last + 1] = total, last + 1 - size, i
        settle(n)
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(part[start[at] : at].encode())]
            else:
                ids.append(self.unknown)
            at = start[at]
        return ids[::-1]

    def _known(self, part: str) -> bytes:
        if len(self.memo) >= self.room:
            self.memo.clear()
        out = self.memo[part] = np.array(self.segment(part), dtype=np.int32).tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        memo, known = self.memo.get, self._known
        parts = self.parts.findall((" " + text).replace(" ", _BLANK))
        return np.frombuffer(b"".join([memo(p) or known(p) for p in parts]), dtype=np.int32)

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) per row; ``round_trip``: decoding ``ids`` gives the text."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches):
        codec = Codec(pieces.value)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                n = np.array([len(i) for i in ids], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists, pa.array(same)],
                                                 ["doc_id", "n_tokens", "ids", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, round_trip boolean"))


def decode(tokens: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``tokens`` with a column __text: the text of each id list (null: null)."""
    pieces = tokens.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf("string")
    def run(parts):
        codec = Codec(pieces.value)
        return parts.map(lambda x: None if x is None else codec.decode(x))

    return tokens.withColumn("__text", run(F.col(f"`{ids}`")))
