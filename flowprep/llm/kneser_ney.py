"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped hash arrays.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and an end after
each document; a start stands before its first token as context only.

Counting, over all training documents:

1. Each task counts its tokens' 64-bit hashes; sorted blobs of (hash, count) go
   to shards by hash range and are merged there into the vocabulary: arrays of
   hashes and counts.  A token's id is its place in all shards.
2. Each task looks its tokens up and counts pairs (context id, token id), packed
   into one 64-bit key (exact); sorted, delta-coded blobs go to shards by a hash
   of the key, so the pairs of a very common context spread evenly.  A shard
   merges them into arrays of keys and counts, and hands each context's totals
   and each token's number of different contexts on to the range of their ids.
3. The ranges add these up into arrays beside the vocabulary.
4. Discounts D1, D2, D3+ of both orders come from the counts of counts (a few
   numbers a shard).

    p(w | v) = (c(vw) - D) / c(v.) + g(v) * p1(w)
    p1(w)    = (n(.w) - D') / n(..) + g0 / (V + 1)

``c`` are counts, ``n(.w)`` numbers of different contexts, ``g`` the mass that the
discounts free.  A context not seen in training leaves p1; a token not seen has
the last term only.  The probabilities of V words and the unknown one add to 1.

The arrays lie in the session's shared folder and are memory-mapped by the
workers; a document's pairs are sorted before they are searched.  A shard holds
the n-grams of about ``SHARD_BYTES`` of text, so its merge fits a task; tasks
hand counts on every ``FLUSH`` keys.  A file's name follows from its shard and it
is moved into place whole; every attempt of a task writes the same bytes, so lost
executors do no harm, and the driver holds a few numbers a shard.

Defined results: null text is the empty text, whose only token is the end.  Rows
may repeat; each counts.  A null id belongs to the fold of the empty text.  With
no training document every token is unknown (probability 1).  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, _splitmix, counted, held_out_fold, mix64, scratch_uri, stored, string_buffers
from .files import make_dir, map_array, write_array

SHARD_BYTES = 32 << 20
FLUSH = 6_000_000
_SLICE = 4 << 20
_END = _splitmix(1, 4242)[0]


def _row_slices(column: pa.Array):
    """Runs of rows of about ``_SLICE`` bytes (one row at least)."""
    _, offsets = string_buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def _sequence(hasher: ByteHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, and the index of each document's end."""
    hashes, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for h, doc, *_ in hasher.pieces(column):
        hashes.append(h)
        docs.append(doc)
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    out = np.full(len(h) + len(column), _END, dtype=np.uint64)
    out[np.arange(len(h)) + doc] = h
    ends = np.cumsum(np.bincount(doc, minlength=len(column))) + np.arange(len(column))
    return out, ends


def _pack(keys: np.ndarray, counts: np.ndarray) -> dict:
    """Sorted keys as differences, and counts, compressed."""
    press = zstandard.ZstdCompressor(level=1)
    step = np.diff(keys, prepend=keys.dtype.type(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T) if len(step) else step
    return {"n": len(keys), "keys": press.compress(planes.tobytes()), "counts": press.compress(counts.astype(np.uint32).tobytes())}


def _unpack(n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    press = zstandard.ZstdDecompressor()
    planes = np.frombuffer(press.decompress(keys, 8 * n), dtype=np.uint8).reshape(8, n)
    step = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)
    return np.cumsum(step, dtype=np.uint64), np.frombuffer(press.decompress(counts, 4 * n), dtype=np.uint32).astype(np.int64)


def _merged(n: list[int], keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(*x) for x in zip(n, keys, counts)]
    return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


_BLOB = "kind int, shard int, n bigint, keys binary, counts binary"


def _blobs(kind: int, shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard; keys sorted within it."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, dtype=int)
    rows = [{"kind": kind, "shard": int(shard[a]), **_pack(keys[a:b], counts[a:b])} for a, b in zip(first, np.append(first[1:], len(shard)))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()),
                                                              ("keys", pa.binary()), ("counts", pa.binary())]))


class _Counter:
    """Counts of keys, handed on as blobs whenever there are many."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(counted(keys))
        self.held += len(self.parts[-1][0])
        if self.held > FLUSH and len(self.parts) > 1:
            self.parts = [self.take()]
            self.held = len(self.parts[0][0])
        return self.held > FLUSH // 2 and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _by_range(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Vocabulary:
    """Memory-mapped token arrays: ``find`` gives ids, ``gather`` values by id."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.sizes, self.shards = folder, sizes, len(sizes)
        self.offsets = np.append(0, np.cumsum(sizes))
        self.maps: dict[tuple[int, str], np.ndarray] = {}

    def __len__(self) -> int:
        return int(self.offsets[-1])

    def _map(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.maps:
            self.maps[shard, name] = map_array(f"{self.folder}/words-{shard}-{name}.npy")
        return self.maps[shard, name]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, or -1, of sorted distinct hashes."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        shard = _by_range(hashes, self.shards)
        for k in np.unique(shard).tolist():
            if self.sizes[k]:
                here, known = np.flatnonzero(shard == k), self._map(k, "hashes")
                at = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
                hit = known[at] == hashes[here]
                out[here[hit]] = at[hit] + self.offsets[k]
        return out

    def gather(self, ids: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """Values of distinct, sorted ids."""
        out = [np.zeros(len(ids)) for _ in names]
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        for k in np.unique(shard).tolist():
            here = np.flatnonzero(shard == k)
            for values, name in zip(out, names):
                values[here] = self._map(k, name)[ids[here] - self.offsets[k]]
        return out


def _ids(vocabulary: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    known, back = np.unique(hashes, return_inverse=True)
    return vocabulary.find(known)[back]


def _pairs(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """Context ids: the token before, or ``start`` at each document's beginning."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    if len(ids):
        context[0] = start
        context[ends[:-1] + 1] = start
    return context


class Model:
    """What scoring needs: the folder of the arrays and a few numbers (pickled to the tasks)."""

    def __init__(self, folder: str, sizes: np.ndarray, n_tokens: int, pairs: list, ranges: list, n_docs: int):
        self.folder, self.sizes, self.shards = folder, sizes, len(sizes)
        self.pair_shards = np.zeros(self.shards, dtype=bool)
        self.pair_shards[[r.shard for r in pairs]] = True
        self.n_tokens, self.n_docs, self.size = n_tokens, n_docs, int(sizes.sum())
        self.pair_discounts = _discounts(np.sum([r.of for r in pairs], axis=0) if pairs else np.zeros(4))
        counts = np.sum([r.of for r in ranges], axis=0) if ranges else np.zeros(6)
        self.word_discounts = _discounts(counts[:4])
        self.n_pairs = int(counts[5])
        d = self.word_discounts
        many = counts[4]  # words of three or more contexts
        self.freed = (d[0] * counts[0] + d[1] * counts[1] + d[2] * many) / self.n_pairs if self.n_pairs else 1.0
        self.start = next(({"total": r.start[0], "of": r.start[1:]} for r in ranges if r.start[0]), {"total": 0, "of": [0, 0, 0]})

    def scorer(self) -> "Scorer":
        return Scorer(self)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1 to 4 times; halves where there are too few to tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts <= 0, 0, np.asarray([0.0, *d])[np.clip(counts, 0, 3).astype(np.int64)])


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.vocabulary = Vocabulary(model.folder, model.sizes)
        self.maps: dict[int, tuple] = {}

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted keys (0: not seen)."""
        out, shard = np.zeros(len(keys)), _by_range(mix64(keys), self.m.shards)
        order = np.argsort(shard, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)) if len(keys) else []
        for a, b in zip(first, np.append(first[1:], len(keys)) if len(keys) else []):
            here = order[a:b]
            k = int(shard[here[0]])
            if not self.m.pair_shards[k]:
                continue
            if k not in self.maps:
                self.maps[k] = tuple(map_array(f"{self.m.folder}/pairs-{k}-{x}.npy") for x in ("keys", "counts"))
            known, counts = self.maps[k]
            at = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
            out[here] = np.where(known[at] == keys[here], counts[at], 0)
        return out

    def __call__(self, hasher: ByteHasher, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, score (log10)."""
        m = self.m
        tokens, ends = _sequence(hasher, column)
        words, back = np.unique(tokens, return_inverse=True)
        found = self.vocabulary.find(words)
        seen = found >= 0
        # by distinct word
        count, contexts, total, freed = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words))
        count[seen], contexts[seen], total[seen], freed[seen] = self.vocabulary.gather(found[seen], ["counts", "contexts", "total", "freed"])
        p1 = (contexts - _discount(contexts, m.word_discounts)) / max(m.n_pairs, 1) + m.freed / (m.size + 1)
        mass = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        # by token: its context is the token before
        ids = found[back]
        context = _pairs(ids, ends, m.size)
        at_start = _pairs(np.zeros(len(ids), dtype=np.int64), ends, 1) == 1
        before = np.append(0, back[:-1])
        d = m.pair_discounts
        start_total = m.start["total"]
        start_mass = sum(x * y for x, y in zip(d, m.start["of"])) / start_total if start_total else 1.0
        ctx_total = np.where(at_start, start_total, total[before])
        ctx_mass = np.where(at_start, start_mass, mass[before])
        both = (ids >= 0) & (context >= 0)
        keys = (context[both].astype(np.uint64) << np.uint64(32)) | ids[both].astype(np.uint64)
        distinct, again = np.unique(keys, return_inverse=True)
        c = np.zeros(len(ids))
        c[both] = self._pair_counts(distinct)[again]
        p = (c - _discount(c, d)) / np.maximum(ctx_total, 1) + ctx_mass * p1[back]
        base = np.log10((count[back] + 1) / (m.n_tokens + m.size + 1))
        first = np.append(0, ends[:-1] + 1)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return np.diff(np.append(-1, ends)), add((count[back] > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the model over all rows of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(16, -(-size.b // shard_bytes))
    folder = make_dir(scratch_uri(spark, "kneser-ney"))

    def count_words(batches):
        hasher, counter = ByteHasher(), _Counter()
        for batch in batches:
            for _, part in _row_slices(batch.column(0)):
                if counter.add(_sequence(hasher, part)[0]):
                    keys, counts = counter.take()
                    yield _blobs(0, _by_range(keys, shards), keys, counts)
        keys, counts = counter.take()
        yield _blobs(0, _by_range(keys, shards), keys, counts)

    def merge_words(table: pa.Table) -> pa.Table:
        keys, counts = _merged(*(table.column(c).to_pylist() for c in ("n", "keys", "counts")))
        shard = table.column("shard")[0].as_py()
        write_array(f"{folder}/words-{shard}-hashes.npy", keys)
        write_array(f"{folder}/words-{shard}-counts.npy", counts)
        return pa.Table.from_pylist([{"shard": shard, "n": len(keys), "total": int(counts.sum())}])

    words = stored(texts.mapInArrow(count_words, _BLOB).groupBy("shard").applyInArrow(
        merge_words, "shard bigint, n bigint, total bigint"), "kn-words").collect()  # one row a shard
    sizes = np.zeros(shards, dtype=np.int64)
    sizes[[r.shard for r in words]] = [r.n for r in words]
    n_words = int(sizes.sum())
    if n_words >= 1 << 32:
        raise ValueError("more than 2^32 different tokens")
    offsets = np.append(0, np.cumsum(sizes))

    def count_pairs(batches):
        hasher, counter, vocabulary = ByteHasher(), _Counter(), Vocabulary(folder, sizes)
        for batch in batches:
            for _, part in _row_slices(batch.column(0)):
                tokens, ends = _sequence(hasher, part)
                ids = _ids(vocabulary, tokens)
                context = _pairs(ids, ends, n_words)
                if counter.add((context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)):
                    keys, counts = counter.take()
                    yield _blobs(0, _by_range(mix64(keys), shards), keys, counts)
        keys, counts = counter.take()
        yield _blobs(0, _by_range(mix64(keys), shards), keys, counts)

    def merge_pairs(table: pa.Table) -> pa.Table:
        keys, counts = _merged(*(table.column(c).to_pylist() for c in ("n", "keys", "counts")))
        shard = table.column("shard")[0].as_py()
        name = f"{folder}/pairs-{shard}"
        write_array(f"{name}-keys.npy", keys)
        kind = np.uint16 if counts.max() < 1 << 16 else np.uint64
        write_array(f"{name}-counts.npy", counts.astype(kind))
        rows = [{"kind": -1, "shard": shard, "n": len(keys), "of": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}]
        # what the contexts and the words of these pairs add up to, by the range of their ids
        context, word = (keys >> np.uint64(32)), keys & np.uint64(0xFFFFFFFF)
        sums = [(0, *counted(context, counts)), *((k, *counted(context[counts == k])) for k in (1, 2)),
                (3, *counted(context[counts >= 3])), (4, *counted(word))]
        for kind, ids, n in sums:
            at = np.minimum(np.searchsorted(offsets, ids, side="right") - 1, shards - 1)
            rows += _blobs(kind, at, ids, n).to_pylist()
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
            ("of", pa.list_(pa.int64()))]))

    merged = stored(texts.mapInArrow(count_pairs, _BLOB).groupBy("shard").applyInArrow(
        merge_pairs, _BLOB + ", of array<bigint>"), "kn-pairs")
    pairs = merged.where("kind = -1").select("shard", "of").collect()  # one row a shard
    d = _discounts(np.sum([r.of for r in pairs], axis=0) if pairs else np.zeros(4))

    def merge_ranges(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        low = int(offsets[shard])
        n = int(offsets[shard + 1]) - low + (1 if shard == shards - 1 else 0)  # the last range has the start's context too
        sums = np.zeros((5, n), dtype=np.int64)
        columns = [table.column(c).to_pylist() for c in ("kind", "n", "keys", "counts")]
        for kind, *blob in zip(*columns):
            ids, counts = _unpack(*blob)
            sums[kind, ids.astype(np.int64) - low] += counts
        total, contexts = sums[0], sums[4]
        freed = d[0] * sums[1] + d[1] * sums[2] + d[2] * sums[3]
        for label, values in (("total", total), ("freed", freed), ("contexts", contexts)):
            write_array(f"{folder}/words-{shard}-{label}.npy", values)
        start = sums[:4, -1].tolist() if shard == shards - 1 else [0] * 4
        return pa.Table.from_pylist([{"shard": shard, "start": start, "of": [
            *(int((contexts == k).sum()) for k in (1, 2, 3, 4)), int((contexts >= 3).sum()), int(contexts.sum())]}])

    ranges = stored(merged.where("kind >= 0").select("kind", "shard", "n", "keys", "counts").groupBy("shard").applyInArrow(
        merge_ranges, "shard bigint, start array<bigint>, of array<bigint>"), "kn-ranges").collect()  # one row a shard
    return Model(folder, sizes, sum(r.total for r in words), pairs, ranges, size.n)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # nine bytes a shard

    def run(batches):
        hasher, scorer = ByteHasher(), shared.value.scorer()
        for batch in batches:
            for at, part in _row_slices(batch.column(1)):
                n, known, base, total = scorer(hasher, part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(total)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"))


def language_model_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, doc_id: str = "doc_id", text: str = "text",
                          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Train on the rows outside the held-out fold, score all: adds held_out and train_tokens."""
    out = held_out_fold(F.col(f"`{doc_id}`"), folds) == held_out
    model = train(docs.where(~out), text, shard_bytes)
    return (score(docs, model, doc_id, text)
            .select("doc_id", (held_out_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known",
                    F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"))
