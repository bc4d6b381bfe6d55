"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF over a block-max inverted index.

Terms are runs of letters in lower case: all those of a bounded, labelled sample
(``max_rows``, the first in hash order of their ids); none is left out.  Their
document frequencies are counted over all documents.  A document's vector is
(1 + ln tf) * ln((N + 1) / (df + 1)) * r of these terms, of unit length, where r
is the root of the term's chi-square against the label in the sample plus
``FLOOR``, so that words of either class weigh more than words of both.

Index: the ``COMMON`` terms of most examples lie in a matrix, cut into blocks of
``BLOCK`` examples with each term's largest weight in each block; all others have
postings.  Only term counts travel; a process works weights out from them.  A query adds up its postings' products, bounds each block by its best
sum so far plus query weight times block maximum, and visits the blocks whose bound
reaches the k-th best sum.  These sums are of 32 bits: all examples
within ``SLACK`` of the k-th best are worked out again in 64.  The k nearest are
exact, ties by example order.

The k nearest vote with the square of their cosine, together with ``PRIOR`` votes
of the sample's share; examples with no term are their own neighbours.  A logistic
curve fitted on leave-one-out votes of the sample (without terms that only the
example itself has) makes the vote a calibrated score.  The evidence is the
nearest examples.

Defined results: null and empty texts have no term and get the calibrated score of
such examples.  Rows may repeat.  Labels that are null, or of no document, are left
out.  With labels of one class only (or none) every score is the share of label 1
(0.0 without labels).  Other columns are ignored, whatever their names; only the
text is an input of a score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from itertools import repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import labelled_sample

#: Labelled examples, at most; what is added to each term's weight, so that no term has none.
MAX_ROWS, FLOOR = 20_000, 0.1
BLOCK, NEIGHBOURS, PRIOR = 64, 15, 0.5
#: Terms in the matrix; queries worked off together; more than rounding to 32 bits can change a cosine.
COMMON, QUERIES, SLACK = 768, 256, 1e-4
_SLABS = 64
#: Blocks that are multiplied together.
RUN = 16
#: Examples that the driver works on together.
EXAMPLES = 1024
#: Characters of the terms whose places a process works out together.
_SLICE = 1 << 18
#: Terms whose places a process keeps in a dictionary, and those of one more call.
KNOWN = 1 << 17
_TERM = re.compile(r"[^\W\d_]+")
_LETTERS = "".join(chr(b) if _TERM.match(chr(b)) else " " for b in range(256)).encode("latin-1")


def terms_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    try:  # the same runs, faster
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _TERM.findall(low)


def _sampled(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__id, __y, text) of the sampled documents: at most ``max_rows`` ids are broadcast."""
    return docs.join(F.broadcast(sample), F.col(f"`{doc_id}`") == F.col("__id")).select("__id", "__y", F.col(f"`{text}`").alias("text"))


def _slices(size: np.ndarray):
    """(examples, their places) of ``EXAMPLES`` at a time, example i having ``size[i]`` places: work on them takes little memory."""
    end = np.cumsum(size)
    for k in range(0, len(size), EXAMPLES):
        rows = slice(k, min(k + EXAMPLES, len(size)))
        yield rows, slice(int(end[k] - size[k]), int(end[rows.stop - 1]))


def relevance(y: np.ndarray, at: np.ndarray, size: np.ndarray, n_terms: int) -> np.ndarray:
    """Each term's weight: root of its chi-square against the label, plus ``FLOOR``; example i holds ``size[i]`` of ``at``."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return np.ones(n_terms)
    either, a = np.zeros(n_terms), np.zeros(n_terms)
    for rows, of in _slices(size):
        either += np.bincount(at[of], minlength=n_terms)
        a += np.bincount(at[of], np.repeat(y[rows], size[rows]), n_terms)
    chi = (pos + neg) * (a * neg - (either - a) * pos) ** 2 / (pos * neg * np.maximum(either, 1) * np.maximum(pos + neg - either, 1))
    return np.sqrt(chi) + FLOOR


class Places:
    """Places of terms in a string of terms joined by spaces: sorted hashes, as a dictionary takes ten times the memory."""

    def __init__(self, terms: str):
        self.terms = terms
        self.end = np.empty(terms.count(" ") + 1, dtype=np.int64)  # where each term's characters end
        key, first, at = np.empty(len(self.end), dtype=np.int64), 0, 0
        while first < len(terms):  # a slice of the string at a time
            cut = terms.find(" ", first + _SLICE)
            held = terms[first : cut if cut >= 0 else len(terms)].split(" ")
            size = np.fromiter(map(len, held), np.int64, len(held))
            self.end[at : at + len(held)] = first + np.cumsum(size + 1) - 1
            key[at : at + len(held)] = np.fromiter(map(hash, held), np.int64, len(held))
            first, at = int(self.end[at + len(held) - 1]) + 1, at + len(held)
        self.place = np.argsort(key[:at], kind="stable").astype(np.int32)  # no term at all: at is 0
        self.key = key[self.place]
        self.known: dict[str, int] = {}  # those asked for first, among them the commonest

    def __call__(self, asked: list[str]) -> np.ndarray:
        """The place of each, or -1."""
        out = np.fromiter(map(self.known.get, asked, repeat(-2)), np.int64, len(asked))
        new = np.flatnonzero(out == -2)
        rest = [asked[i] for i in new.tolist()]
        out[new] = places = self._look_up(rest)
        if len(self.known) < KNOWN:
            self.known.update(zip(rest, places.tolist()))
        return out

    def _look_up(self, asked: list[str]) -> np.ndarray:
        """Hashes only point to a place, the characters are compared."""
        h = np.fromiter(map(hash, asked), np.int64, len(asked))
        to = np.searchsorted(self.key, h)
        out = np.full(len(asked), -1, dtype=np.int64)
        left = np.flatnonzero(to < len(self.key))
        while len(left):
            left = left[self.key[to[left]] == h[left]]
            place = self.place[to[left]]
            end = self.end[place]
            begin = np.where(place > 0, self.end[place - 1] + 1, 0)
            held = map(self.terms.__getitem__, map(slice, begin.tolist(), end.tolist()))
            same = np.fromiter(map(eq, held, map(asked.__getitem__, left.tolist())), bool, len(left))
            out[left[same]] = place[same]
            left = left[~same]  # another term of the same hash: the next one
            to[left] += 1
            left = left[to[left] < len(self.key)]
        return out


def document_frequencies(docs: DataFrame, terms: str, n_terms: int, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each of the terms (joined by spaces), and documents, over all rows."""
    place = docs.sparkSession.sparkContext.broadcast(terms)  # terms are letters; a dictionary is larger
    size = n_terms + 1

    def count(batches):
        places, total = Places(place.value), np.zeros(size, dtype=np.int64)
        n_rows = 0
        for batch in batches:
            for k in range(0, len(batch), EXAMPLES):
                held: Counter = Counter()
                for t in batch.column(0).slice(k, EXAMPLES):
                    held.update(set(terms_of(t.as_py())))
                np.add.at(total, places(list(held)), np.fromiter(held.values(), np.int64, len(held)))  # others: in the last place
            n_rows += len(batch)
        total[-1] = n_rows
        if n_rows:
            for k, part in enumerate(np.array_split(total, _SLABS)):
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
    rows = docs.select(F.col(f"`{text}`")).mapInArrow(count, schema).repartition(_SLABS, "slab").mapInArrow(add, schema)
    parts = np.array_split(np.zeros(size), _SLABS)
    for row in rows.collect():  # 64 rows, 8 bytes a term
        parts[row.slab] = np.frombuffer(row.part, dtype=np.int64)
    place.destroy()
    found = np.concatenate(parts).astype(float)
    return found[:-1], int(found[-1])


class Vectors:
    """Vectors over the terms (joined by spaces), of the given weights, as (term indexes, weights) in term order."""

    def __init__(self, terms: str, weights: np.ndarray):
        self.terms, self.place, self.weights = terms, None, weights

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.place is None:  # made by the process that asks
            self.place = Places(self.terms)
        held = [Counter(terms_of(t)) for t in texts]
        every, out, first = self.place([t for counts in held for t in counts]), [], 0
        for counts in held:
            at, tf = every[first : first + len(counts)], np.fromiter(counts.values(), float, len(counts))
            order = np.argsort(at)[np.count_nonzero(at < 0):]
            out.append((at[order], self.of(at[order], tf[order])))
            first += len(counts)
        return out

    def of(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.weights[at]
        return w / max(np.linalg.norm(w), 1e-12)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each start, ``size`` of them, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class BlockMaxIndex:
    """Inverted index over example vectors; the commonest terms in a matrix with each term's largest weight per block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        self._set(np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32),
                  np.array([len(t) for t, _ in vectors], dtype=np.int64), n_terms)

    def _set(self, term: np.ndarray, length: np.ndarray, n_terms: int) -> None:
        self.term, self.length, self.n_terms = term, length, n_terms
        self.n, self.blocks = len(length), -(-len(length) // BLOCK)
        self.first = np.cumsum(self.length) - self.length
        self.size = np.zeros(n_terms, dtype=np.int64)
        for _, of in _slices(length):
            self.size += np.bincount(term[of], minlength=n_terms)
        self.matrix = None

    def weights(self, row, of) -> np.ndarray:
        """Weights at the places ``of``, each of the example in ``row``."""
        return self.weight[of]

    def _build(self) -> None:
        """The matrix and the postings, when a process first asks for neighbours; by slices, beside which little is held."""
        n_terms, held_by = self.n_terms, self.size
        common = np.sort(np.argsort(-held_by, kind="stable")[:COMMON])
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        # examples of one heaviest common term lie together
        heaviest = np.full(self.n, -1)
        for rows, of in _slices(self.length):
            row, column = np.repeat(np.arange(rows.start, rows.stop), self.length[rows]), self.column[self.term[of]]
            held, w = np.flatnonzero(column >= 0), self.weights(row, of)
            by = held[np.argsort(w[held], kind="stable")]
            heaviest[row[by]] = column[by]
        self.order = np.argsort(heaviest, kind="stable")
        self.inside = np.empty(self.n, dtype=np.int64)
        self.inside[self.order] = np.arange(self.n)
        self.matrix = np.zeros((self.n, len(common)), dtype=np.float32)
        # postings of the others, term by term
        self.postings = np.where(self.column < 0, held_by, 0)
        self.start = np.cumsum(self.postings) - self.postings
        self.row, self.value = (np.empty(self.postings.sum(), dtype=kind) for kind in (np.int32, np.float32))
        free = self.start.copy()
        for rows, of in _slices(self.length):
            row, term = np.repeat(np.arange(rows.start, rows.stop), self.length[rows]), self.term[of]
            column, w, row = self.column[term], self.weights(row, of), self.inside[row]
            held, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
            self.matrix[row[held], column[held]] = w[held]
            rare = rare[np.argsort(term[rare], kind="stable")]
            own, each = np.unique(term[rare], return_counts=True)
            to = _ranges(free[own], each)
            self.row[to], self.value[to] = row[rare], w[rare]
            free[own] += each
        cut = np.arange(0, self.n, BLOCK)
        self.top = np.maximum.reduceat(self.matrix, cut, axis=0).T.copy() if self.n else np.zeros((len(common), 0), np.float32)

    def forget(self) -> None:
        """Frees what ``_build`` made."""
        self.matrix = self.top = self.row = self.value = self.column = self.start = self.postings = None

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (ties: smaller place first), without example ``skip``."""
        return next(self.nearest_of([(at, w, skip)], k))

    def nearest_of(self, queries: list[tuple], k: int):
        """``nearest`` of each query (at, w, skip)."""
        if self.matrix is None:
            self._build()
        for g in range(0, len(queries), QUERIES):
            yield from self._group(queries[g : g + QUERIES], k)

    def _group(self, queries: list[tuple], k: int):
        m, cut = len(queries), np.arange(0, self.n, BLOCK)
        if not self.n:
            yield from [(np.zeros(0, dtype=np.int64), np.zeros(0))] * m
            return
        common, sums = np.zeros((m, self.matrix.shape[1]), dtype=np.float32), np.zeros((m, self.n), dtype=np.float32)
        for i, (at, w, skip) in enumerate(queries):
            column, size = self.column[at], self.postings[at]
            common[i, column[column >= 0]] = w[column >= 0]
            here = _ranges(self.start[at], size)
            if len(here):
                sums[i] = np.bincount(self.row.take(here), self.value.take(here) * np.repeat(w.astype(np.float32), size), self.n)
            if skip >= 0:
                sums[i, self.inside[skip]] = -2.0
        # the k-th best block maximum is no more than the k-th best sum
        best = np.maximum.reduceat(sums, cut, axis=1)
        bound = best + common @ self.top
        visit = (bound > 0) & (bound >= _kth(best, k) - SLACK)
        nearly = 2 * np.count_nonzero(visit, axis=0) > m  # no copy of the queries; neighbouring blocks at once
        edge = np.flatnonzero(np.diff(nearly, prepend=False, append=False))
        for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):
            for b in range(first, last, RUN):
                here = slice(b * BLOCK, min(b + RUN, last) * BLOCK)
                sums[:, here] += common @ self.matrix[here].T
        for b in np.flatnonzero(visit.any(axis=0) & ~nearly).tolist():
            who, here = np.flatnonzero(visit[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            sums[who, here] += common[who] @ self.matrix[here].T
        query, asked, least = np.zeros(self.n_terms), np.zeros(self.n_terms, dtype=bool), _kth(np.maximum.reduceat(sums, cut, axis=1), k) - SLACK
        for i, (at, w, _) in enumerate(queries):
            rows = np.flatnonzero(sums[i] >= least[i])
            found = sums[i, rows]
            rows = np.sort(self.order[rows[(found > 0) & (found >= _kth(found[None], k) - SLACK)[0]]])
            query[at], asked[at] = w, True
            of, row = _ranges(self.first[rows], self.length[rows]), np.repeat(np.arange(len(rows)), self.length[rows])
            shared = np.flatnonzero(asked.take(self.term.take(of)))
            of, row = of.take(shared), row.take(shared)
            scores = np.round(np.bincount(row, query[self.term[of]] * self.weights(rows[row], of), len(rows)), 12)
            asked[at] = False
            rows, scores = rows[scores > 0], scores[scores > 0]
            best = np.lexsort((rows, -scores))[:k]
            yield rows[best], scores[best]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row as a column, at least 0."""
    n = x.shape[1]
    return np.maximum(np.partition(x, n - k, axis=1)[:, n - k : n - k + 1], 0) if n > k else np.zeros((len(x), 1))


class CountIndex(BlockMaxIndex):
    """The same over term counts: an example's weights are worked out whenever they are asked for."""

    def __init__(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray, by_term: np.ndarray, norm: np.ndarray | None = None):
        self.tf, self.by_term, self.norm = tf, by_term, np.ones(len(length)) if norm is None else norm
        self._set(term, length, len(by_term))
        if norm is None:
            for rows, of in _slices(length):
                row = np.repeat(np.arange(rows.start, rows.stop), length[rows])
                self.norm[rows] = np.sqrt(np.bincount(row - rows.start, self.weights(row, of) ** 2, rows.stop - rows.start))

    def weights(self, row, of) -> np.ndarray:
        return (1 + np.log(self.tf[of].astype(np.float32))) * self.by_term[self.term[of]] / self.norm[row]

    def __reduce__(self):
        """Only the examples travel."""
        return CountIndex, (self.term, self.tf, self.length, self.by_term, self.norm)


def vote(rows: np.ndarray, cosine: np.ndarray, y: np.ndarray, share: float) -> float:
    w = cosine**2
    return float((w @ y[rows] + PRIOR * share) / (w.sum() + PRIOR))


def own_votes(index: BlockMaxIndex, y: np.ndarray, share: float, bare: float, first: int, last: int) -> list[float]:
    """Votes on examples ``first`` to ``last`` by the others; terms that only an example has are unknown to the others."""
    out = []
    for g in range(first, last, QUERIES):
        asked = []
        for i in range(g, min(g + QUERIES, last)):
            of = slice(index.first[i], index.first[i] + index.length[i])
            known = index.size[index.term[of]] > 1
            w = index.weights(i, of)[known]
            asked.append((index.term[of][known], w / max(np.linalg.norm(w), 1e-12), i))
        out += [vote(*found, y, share) if len(q[0]) else bare for q, found in zip(asked, index.nearest_of(asked, NEIGHBOURS))]
    return out


def votes_in_tasks(spark, index: BlockMaxIndex, y: np.ndarray, share: float, bare: float) -> np.ndarray:
    """``own_votes`` on all examples, worked out by tasks; only the votes come to the driver."""
    shared, n = spark.sparkContext.broadcast((index, y, share, bare)), index.n

    def run(batches):
        for batch in batches:
            for g in batch.column(0).to_pylist():
                last = min(g + QUERIES, n)
                votes = own_votes(*shared.value, g, last)
                yield pa.RecordBatch.from_arrays([pa.array(range(g, last), pa.int64()), pa.array(votes, pa.float64())], ["i", "vote"])

    out = np.zeros(n)
    for row in spark.range(0, n, QUERIES).mapInArrow(run, "i bigint, vote double").collect():
        out[row.i] = row.vote
    shared.destroy()
    return out


class Model:
    def __init__(self, terms: str, df: np.ndarray, n: int, ids: list[str], y: np.ndarray, at: np.ndarray, tf: np.ndarray, size: np.ndarray,
                 spark=None):
        """Example i has ``size[i]`` of the term indexes ``at`` and term counts ``tf``, in term order; with ``spark`` they vote in tasks."""
        self.vectors = Vectors(terms, (np.log((n + 1) / (df + 1)) + 1e-9) * relevance(y, at, size, len(df)))
        self.share = float(y.mean()) if len(y) else 0.0
        rest, bare = np.flatnonzero(size > 0), y[size == 0]
        self.ids, self.y = [ids[i] for i in rest.tolist()], y[rest]
        self.index = CountIndex(at, tf, size[rest], self.vectors.weights)
        self.bare_vote = (bare.sum() + PRIOR * self.share) / (len(bare) + PRIOR)
        self.curve = None
        if len(rest) and 0 < self.share < 1:
            given = (self.index, self.y, self.share, self.bare_vote)
            votes = votes_in_tasks(spark, *given) if spark else own_votes(*given, 0, len(rest))
            self._calibrate(np.append(votes, [self.bare_vote] * len(bare)), np.append(self.y, bare))
        self.index.forget()

    def _vote(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        return vote(rows, cosine, self.y, self.share)

    def _calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of label on log odds of the vote, by Newton steps, slightly damped; the slope stays above zero."""
        x = np.column_stack([_log_odds(votes), np.ones(len(votes))])
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w - np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0]))
        self.curve = w if w[0] > 0 else np.array([1.0, 0.0])

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple]]]:
        """Calibrated score of each text, and its nearest examples as (id, cosine, label)."""
        if self.curve is None:
            return [(self.share, [])] * len(texts)
        asked, out = [(*v, -1) for v in self.vectors(texts)], []
        for q, (rows, cosine) in zip(asked, self.index.nearest_of(asked, NEIGHBOURS)):
            vote = self._vote(rows, cosine) if len(q[0]) else self.bare_vote
            z = float(np.clip(_log_odds(np.array([vote]))[0] * self.curve[0] + self.curve[1], -30, 30))
            out.append((1 / (1 + np.exp(-z)), [(str(self.ids[r]), float(c), int(self.y[r])) for r, c in zip(rows[:3].tolist(), cosine[:3].tolist())]))
        return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Model:
    rows = _sampled(docs, labelled_sample(labels, label, doc_id, max_rows=max_rows), doc_id, text)

    # only the distinct terms of the sampled texts and their counts come to the driver, compressed
    def split(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                sets = [sorted(Counter(terms_of(t)).items()) for t in part.column(2).to_pylist()]
                blob = pickle.dumps([(str(i), y, copy, " ".join(t for t, _ in s), array("i", [c for _, c in s])) for i, y, copy, s in zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), sets)])
                yield pa.RecordBatch.from_pydict({"part": [zlib.compress(blob, 1)]})

    place, found, at, tf = {}, [], array("i"), array("i")
    parts = rows.withColumn("copy", F.xxhash64("text")).mapInArrow(split, "part binary").collect()
    while parts:  # freed one by one
        for i, y, copy, held, counts in pickle.loads(zlib.decompress(parts.pop().part)):
            found.append((i, y, copy, len(at), len(counts)))
            at.extend([place.setdefault(t, len(place)) for t in held.split()])
            tf.extend(counts)
    found.sort()
    # terms in order, whatever order the parts came in
    terms = sorted(place)
    rank = np.empty(len(terms), dtype=np.int32)
    rank[[place[t] for t in terms]] = np.arange(len(terms))
    n_terms, terms = len(terms), " ".join(terms)  # the strings themselves take several times as much
    del place
    ids, y, size = [x[0] for x in found], np.array([x[1] for x in found], dtype=float), np.array([x[4] for x in found], dtype=np.int64)
    came, tf = np.frombuffer(at, dtype=np.int32), np.frombuffer(tf, dtype=np.int32)
    in_order, counts, to = np.empty(len(came), dtype=np.int32), np.empty(len(tf), dtype=np.min_scalar_type(tf.max(initial=0))), 0
    del at
    for _, _, _, first, n in found:
        in_order[to : to + n] = rank[came[first : first + n]]
        counts[to : to + n] = tf[first : first + n]
        to += n
    del came, tf, found, rank
    df, n = document_frequencies(docs, terms, n_terms, text)
    return Model(terms, df, n, ids, y, in_order, counts, size, docs.sparkSession)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", doc_id: str = "doc_id",
             text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score, predicted, evidence) per row of ``docs``; evidence: (id, cosine, label) of the nearest examples."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, doc_id, text, max_rows))
    neighbour = pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())])

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), QUERIES):
                part = batch.slice(k, QUERIES)
                found = model.value.scores(part.column(1).to_pylist())
                score = np.array([s for s, _ in found], dtype=float)
                evidence = pa.array([[{"id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found], pa.list_(neighbour))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), evidence],
                                                 ["doc_id", "score", "predicted", "evidence"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<id:string,cosine:double,label:int>>"))
