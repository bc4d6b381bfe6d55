"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merges of a rank file (token bytes -> rank) define one token sequence for
each byte string: the adjacent pair whose joined bytes have the lowest rank is
merged, the leftmost of equal ones first, until no pair has a rank.  A sequence
is that of its bytes exactly if each two neighbours are the sequence of *their*
bytes, so the merges compile to a transducer that reads bytes and keeps (last
token, place in the trie of tokens): it moves down the trie, and where a token
ends that may follow the last one it may also start the next.  That machine has
several open readings at a time; they are determinised on demand.  A
determinised state is the list of open readings, each with the tokens it has not
emitted yet; what all readings share is emitted.  A reading lives as long as the
bytes since its last token begin some token, so no token is held back for more
bytes than the longest token has.  States are made when first met, shared by all
texts of a worker, and forgotten together when there are too many (this changes
no result).

Each match of the split pattern is encoded by itself; a match that is a token as
a whole is that token.  The two libraries' pattern engines know different versions
of Unicode: characters that they class apart are found once by asking both, and
stand-ins of the wanted class take their place while a text is split.  Matches are taken from the text one after the other and a
long match is read byte by byte, so time is linear in the text.

Decoding joins the tokens' bytes and follows them with a UTF-8 state machine,
one step a token (a token's effect on each state is worked out once), so a
stream gives out all complete characters as they come and holds back at most
three bytes.  A malformed run gives U+FFFD for each longest part that a
character could begin with.

The rank file's path is a parameter; its ranks are broadcast (about a MB, as
large as the file whatever the input).

Defined results: null is taken as the empty text; the empty text has no token and
decodes to itself; bytes that are no UTF-8 are read as U+FFFD.  Rows may repeat
and come in any order.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file and split pattern of the public tokenizers (see their README).
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Determinised states and memorised matches (of a new and an old half each) kept in a worker; more are forgotten and made again.
MAX_STATES = 450_000
MAX_MEMO = 250_000
_LONG = 256         # a match of more characters is not memorised
_BLOCK = 1 << 16    # matches, or ids, worked off at a time
Ranks = dict[bytes, int]


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> Ranks:
    """Token bytes -> rank, from lines of base64 text and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(ranks: Ranks, data: bytes) -> list[int]:
    """The token sequence of a short byte string, by merging as the ranks say."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        known = [r for r in found if r is not None]
        if not known:
            break
        at = found.index(min(known))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes in, tokens out; states are tuples of readings (last token or -1, trie node, tokens held back)."""

    def __init__(self, ranks: Ranks, max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.raw = {i: t for t, i in ranks.items()}
        self.down: dict[int, int] = {}     # node * 256 + byte -> node
        self.token: list[int] = [-1]       # the token that ends at a node
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.down.get(node * 256 + b)
                if nxt is None:
                    nxt = self.down[node * 256 + b] = len(self.token)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, tuple]] = {}   # state * 256 + byte -> (state, tokens given out)
        self.final: list[tuple] = []
        self._intern(((-1, 0, ()),))

    def _intern(self, state: tuple) -> int:
        known = self.number.get(state)
        if known is None:
            known = self.number[state] = len(self.states)
            self.states.append(state)
            # one reading has just ended a token: its held tokens are what is left at the end of the input
            self.final.append(next((held for _, node, held in state if node == 0), ()))
        return known

    def may_follow(self, last: int, token: int) -> bool:
        """Are [last, token] (or [token] at the start) the sequence of their bytes?"""
        pair = last << 32 | token
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > 2 * self.max_states:
                self.fits.clear()
            want = [token] if last < 0 else [last, token]
            known = self.fits[pair] = merge(self.ranks, b"".join([self.raw[t] for t in want])) == want
        return known

    def _move(self, at: int, byte: int) -> tuple[int, tuple]:
        readings = []
        for last, node, held in self.states[at]:
            nxt = self.down.get(node * 256 + byte)
            if nxt is None:
                continue
            readings.append((last, nxt, held))
            token = self.token[nxt]
            if token >= 0 and self.may_follow(last, token):
                readings.append((token, 0, held + (token,)))
        shared = min(len(r[2]) for r in readings)
        first = readings[0][2]
        while any(r[2][:shared] != first[:shared] for r in readings):
            shared -= 1
        state = tuple((last, node, held[shared:]) for last, node, held in readings)
        if len(self.states) >= self.max_states and state not in self.number:
            self._forget()
            return self._intern(state), first[:shared]
        move = self.moves[at << 8 | byte] = (self._intern(state), first[:shared])
        return move

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes, each given out as soon as no later byte can change it."""
        at = 0
        for b in data:
            at, out = self.moves.get(at << 8 | b) or self._move(at, b)
            yield from out
        yield from self.final[at]

    def encode(self, data: bytes) -> list[int]:
        at, tokens = 0, []
        for b in data:
            at, out = self.moves.get(at << 8 | b) or self._move(at, b)
            if out:
                tokens += out
        tokens += self.final[at]
        return tokens


class Utf8Machine:
    """States of a UTF-8 reader: 0 between characters, else bytes read so far and what may follow.

    ``step(state, byte)`` is total: a byte that cannot follow starts afresh.
    """

    # Fixed values (the Unicode standard's table of well-formed sequences): lead bytes, range of the second byte,
    # length of the character.
    LEADS = [(0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3),
             (0xED, 0xED, 0x80, 0x9F, 3), (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4),
             (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4)]

    def __init__(self):
        self.states: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]  # (bytes read, least next, greatest next, length)
        number = {self.states[0]: 0}

        def state(key):
            if key not in number:
                number[key] = len(self.states)
                self.states.append(key)
            return number[key]

        start = {b: state((1, low, high, size)) for a, z, low, high, size in self.LEADS for b in range(a, z + 1)}
        self.table: list[list[int]] = []
        k = 0
        while k < len(self.states):
            read, low, high, size = self.states[k]
            row = [start.get(b, 0) for b in range(256)]
            if read:
                after = 0 if read + 1 == size else state((read + 1, 0x80, 0xBF, size))
                row[low : high + 1] = [after] * (high + 1 - low)
            self.table.append(row)
            k += 1
        self.held = [s[0] for s in self.states]

    def run(self, state: int, data: bytes) -> int:
        for b in data:
            state = self.table[state][b]
        return state


class StreamDecoder:
    """Ids in, text out: all characters that are complete."""

    def __init__(self, raw: list[bytes], machine: Utf8Machine | None = None):
        self.raw = raw
        self.machine = machine or Utf8Machine()
        # tokens that go from between two characters to between two characters
        self.whole = np.array([not self._open(t) for t in raw], dtype=bool)
        self.steps: dict[tuple[int, int], int] = {}
        self.reset()

    @staticmethod
    def _open(token: bytes) -> bool:
        try:
            return token.decode() is None
        except UnicodeDecodeError:
            return True

    def reset(self) -> None:
        self.state, self.tail = 0, b""

    def _after(self, ids: np.ndarray) -> int:
        state, previous = self.state, -1
        for at in np.flatnonzero(~self.whole[ids]).tolist():
            if state and at != previous + 1:
                state = 0   # a whole token came in between: what was open is malformed
            key = (int(ids[at]), state)
            nxt = self.steps.get(key)
            if nxt is None:
                nxt = self.steps[key] = self.machine.run(state, self.raw[key[0]])
            state, previous = nxt, at
        return state if previous == len(ids) - 1 or previous < 0 and not len(ids) else 0

    def feed(self, ids: np.ndarray) -> str:
        raw = self.raw
        data = self.tail + b"".join([raw[i] for i in ids.tolist()])
        self.state = self._after(ids)
        cut = len(data) - self.machine.held[self.state]
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out = self.tail.decode("utf-8", "replace")
        self.reset()
        return out


#: Character classes of the split pattern, each with a character of it that no contraction has.
CLASSES = {r"\p{L}": "x", r"\p{N}": "0", r"\s": "\n", r"[^\s\p{L}\p{N}]": "#"}


def stand_ins() -> dict[int, int]:
    """Characters that the splitting library classes unlike the tokenizer library -> a character of the latter's class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out: dict[int, int] = {}
    for kind, instead in CLASSES.items():
        asked = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        wanted = bytes(asked.encode_ordinary(every)).decode()
        out.update((ord(c), ord(instead)) for c in set(wanted) - set(regex.findall(kind, every)))
    return out


class Encoder:
    def __init__(self, ranks: Ranks, pattern: str, stand_in: dict[int, int] | None = None,
                 max_states: int = MAX_STATES, max_memo: int = MAX_MEMO):
        self.ranks, self.room = ranks, max_memo
        self.transducer = Transducer(ranks, max_states)
        self.pattern = regex.compile(pattern)
        self.stand_in = stand_in or {}
        self.apart = np.zeros(0x110000, dtype=bool)
        self.apart[list(self.stand_in)] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, match: str) -> bytes:
        out = self.old.get(match) or self._encoded(match)
        if len(match) <= _LONG:
            if len(self.memo) >= self.room:
                # what was not used since the last change is forgotten
                self.old = self.memo.copy()
                self.memo.clear()   # in place: a list under construction looks it up
            self.memo[match] = out
        return out

    def _encoded(self, match: str) -> bytes:
        data = match.encode()
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.transducer.encode(data), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo, make = self.memo.get, self._ids
        apart = not text.isascii() and self.apart[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any()
        if not apart and len(text) <= 1 << 20:
            return b"".join([memo(m) or make(m) for m in self.pattern.findall(text)])
        found = self.pattern.finditer(text.translate(self.stand_in) if apart else text)
        out, matches = bytearray(), (text[m.start() : m.end()] for m in found)
        while block := list(islice(matches, _BLOCK)):
            out += b"".join([memo(m) or make(m) for m in block])
        return bytes(out)


class Decoder:
    def __init__(self, ranks: Ranks):
        raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            raw[i] = token
        self.decoder = StreamDecoder(raw)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4")
        self.decoder.reset()
        parts = [self.decoder.feed(numbers[k : k + _BLOCK]) for k in range(0, len(numbers), _BLOCK)]
        return "".join(parts) + self.decoder.finish()


_WORKER: dict = {}


def _kept(shared, make):
    """The worker's encoder or decoder for broadcast (rank file's path, ranks, ...): what it learns serves all tasks of the process."""
    path, *values = shared.value
    key = (make, path, *[v for v in values if isinstance(v, str)])
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make(*values)
    return _WORKER[key]


_ROWS = 256


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row: the ids, and the text that they decode to.

    ``ids`` is binary: little-endian unsigned 32-bit integers.
    """
    path = path or ranks_path()
    shared = docs.sparkSession.sparkContext.broadcast((path, read_ranks(path), pattern or split_pattern(), stand_ins()))

    def run(batches):
        encoder, decoder = _kept(shared, _both)
        for batch in batches:
            for k in range(0, len(batch), _ROWS):
                part = batch.slice(k, _ROWS)
                ids = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                texts = [decoder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                                                  pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string"))


def _both(ranks: Ranks, pattern: str, stand_in: dict[int, int]) -> tuple[Encoder, Decoder]:
    return Encoder(ranks, pattern, stand_in), Decoder(ranks)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per row."""
    return round_trip(docs, path, pattern, doc_id, text).drop("decoded")


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``tokens`` with a column __text: the text of each row's ids (null: empty)."""
    path = path or ranks_path()
    shared = tokens.sparkSession.sparkContext.broadcast((path, read_ranks(path)))

    @F.pandas_udf("string")
    def run(column):
        decoder = _kept(shared, Decoder)
        return column.map(lambda x: decoder.decode(x or b""))

    return tokens.withColumn("__text", run(F.col(f"`{ids}`")))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``'s rows."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
