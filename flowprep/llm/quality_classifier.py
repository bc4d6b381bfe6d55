"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Random indexing: every token bucket has a fixed sparse index vector (``NONZERO``
signs at hashed places); a bucket's context vector is the sum of the index
vectors of its neighbours, two to each side, over *all* documents.  The sums are
exact integers, added up per task and then per slab of buckets; the whole table
is ``BUCKETS * DIM`` numbers, whatever the input.  A document is the mean of its
tokens' unit vectors and its log length.  A two-layer numpy network is trained
on a bounded sample of labelled rows (``max_rows``, the first in hash order of
their ids) and its logits are divided by a temperature fitted on a part of the
sample that the weights have not seen, so scores are calibrated.

Tokens are runs of letters and digits, and runs of punctuation, in their case.  A
token equal to the one before it, and a word in capitals, each have a bucket of
their own.

Defined results: null or empty text is the zero vector and gets a score like
any other.  Rows may repeat.  Labels that are null, or of no document, are left
out.  With labels of one class only (or none) every score is the share of label
1 (0.5 without labels).  Other columns are carried through or ignored, whatever
their names; only the text is an input of a score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ByteHasher, _splitmix, held_out_fold

BUCKETS, DIM, NONZERO, WINDOW = 1 << 15, 32, 4, 2
#: Labelled rows that the network is fitted on, at most.
MAX_ROWS = 20_000
_REPEAT, _CAPITALS = 0, 1
_SLABS = 64


def _tokens(hasher: ByteHasher, column: pa.Array):
    """Yield (bucket, document) arrays of a string column, piece by piece."""
    for h, doc, start, end, kind, piece in hasher.pieces(column):
        if not len(h):
            continue
        bucket = (h >> np.uint64(49)).astype(np.int64)
        upper = (piece >= 65) & (piece <= 90)
        bucket[(end - start >= 2) & upper[start] & upper[end - 1]] = _CAPITALS
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        bucket[1:][again] = _REPEAT
        yield bucket, doc


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    h = _splitmix(BUCKETS * NONZERO, 99).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The BUCKETS x DIM context vectors over all documents (rows of unit length, or zero)."""
    def count(batches):
        hasher, (place, sign) = ByteHasher(fold_case=False, split_punctuation=True), _index_vectors()
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for bucket, doc in _tokens(hasher, batch.column(0)):
                for step in range(1, WINDOW + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = bucket[:-step][near], bucket[step:][near]
                    for of, by in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(of * DIM + place[by, k], weights=sign[by, k], minlength=len(total))
        if total.any():
            for k, part in enumerate(np.split(total.astype(np.int64), _SLABS)):
                yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "part": [zlib.compress(part.tobytes(), 1)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(part), dtype=np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "part": [part.tobytes()]})

    schema = "slab int, part binary"
    parts = docs.select(F.col(f"`{text}`")).mapInArrow(count, schema).repartition(_SLABS, "slab").mapInArrow(add, schema)
    table = np.zeros((_SLABS, BUCKETS * DIM // _SLABS))
    for row in parts.collect():  # 64 rows, 8 MB
        table[row.slab] = np.frombuffer(row.part, dtype=np.int64)
    table = table.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(hasher: ByteHasher, vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """One row per text: mean token vector, and log of 1 + tokens."""
    sums, n = np.zeros((len(column), DIM)), np.zeros(len(column))
    for bucket, doc in _tokens(hasher, column):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sums[doc[first]] += np.add.reduceat(vectors[bucket], first, axis=0)
        n[doc[first]] += np.diff(np.append(first, len(doc)))
    return np.column_stack([sums / np.maximum(n, 1)[:, None], np.log1p(n) / 10])


class Network:
    """tanh hidden layer, logistic output, Adam; fixed seed, so a fit can be repeated."""

    def __init__(self, hidden: int = 32, epochs: int = 80, batch: int = 256, rate: float = 0.01, decay: float = 1e-4):
        self.hidden, self.epochs, self.batch, self.rate, self.decay = hidden, epochs, batch, rate, decay
        self.temperature, self.constant = 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        held = np.arange(len(y)) % 5 == 4
        if y[held].min() == y[held].max():
            held = np.ones(len(y), dtype=bool)
        train = ~held if not held.all() else held
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        rng = np.random.default_rng(7)
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        xs, ys = (x[train] - self.mean) / self.scale, y[train]
        for epoch in range(self.epochs):
            order = rng.permutation(len(ys))
            for at in range(0, len(ys), self.batch):
                xb, yb = xs[order[at : at + self.batch]], ys[order[at : at + self.batch]]
                h = np.tanh(xb @ w[0] + w[1])
                g = (_sigmoid(h @ w[2] + w[3]) - yb) / len(yb)
                back = np.outer(g, w[2]) * (1 - h * h)
                grads = [xb.T @ back + self.decay * w[0], back.sum(axis=0), h.T @ g + self.decay * w[2], g.sum(keepdims=True)]
                step += 1
                rate = self.rate * (1 - 0.9 * epoch / self.epochs)
                for i, grad in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        logits, target = self._logits(x[held]), y[held]
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - target * logits / t)
        self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self._logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def labelled_sample(labels: DataFrame, label: str, doc_id: str = "doc_id", folds: int = 5, max_rows: int = MAX_ROWS) -> DataFrame:
    """(__id, __y): at most ``max_rows`` labelled ids that are not held out, the first in hash order."""
    key = F.col(f"`{doc_id}`")
    rows = (labels.where(key.isNotNull() & F.col(f"`{label}`").isNotNull() & (held_out_fold(key, folds) != 0))
            .select(key.alias("__id"), F.col(f"`{label}`").cast("double").alias("__y")).distinct())
    return rows.orderBy(F.md5(F.col("__id").cast("string")), "__id", "__y").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
        max_rows: int = MAX_ROWS):
    """(vectors, network) learnt from ``docs`` and the labels outside the held-out fold."""
    vectors = context_vectors(docs, text)
    sample = F.broadcast(labelled_sample(labels, label, doc_id, max_rows=max_rows))  # max_rows rows at most

    def features(batches):
        hasher = ByteHasher(fold_case=False, split_punctuation=True)
        for batch in batches:
            x = pooled(hasher, vectors, batch.column(2))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "y": batch.column(1),
                                              "x": [r.tobytes() for r in x]})

    rows = (docs.join(sample, F.col(f"`{doc_id}`") == F.col("__id")).select("__id", "__y", F.col(f"`{text}`"))
            .mapInArrow(features, "id string, y double, x binary").collect())  # max_rows rows of 264 bytes
    rows.sort(key=lambda r: (zlib.crc32(r.id[::-1].encode()), r.id, r.y, bytes(r.x)))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), DIM + 1)
    return vectors, Network().fit(x, np.array([r.y for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", doc_id: str = "doc_id",
             text: str = "text", keep_only: bool = False, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with __score and __predicted; ``keep_only``: the documents predicted 1, columns as given."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, doc_id, text, max_rows))
    at = docs.columns.index(text)

    def run(batches):
        hasher, (vectors, network) = ByteHasher(fold_case=False, split_punctuation=True), model.value
        for batch in batches:
            score = network.score(pooled(hasher, vectors, batch.column(at)))
            if keep_only:
                yield batch.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 [*batch.schema.names, "__score", "__predicted"])

    extra = [] if keep_only else [T.StructField("__score", T.DoubleType()), T.StructField("__predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))
