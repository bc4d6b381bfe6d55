"""Phrase collocation mining by best-first branch and bound over a prefix tree of phrases.

Texts are cut into pieces at punctuation and line ends, pieces into words; phrases
are runs of 2 to 4 words of a piece, counted per language.  A phrase's score is the
least, over its cuts into a first part and a rest, of 2,000,000 a / (l + r), rounded
down (a, l, r: occurrences of the phrase, the first part, the rest).  Phrases that a
longer one with at least 80 % of their count holds are dropped; the first 2,000 of the
others, by score, count and text, are a language's result.

A phrase that extends a prefix p occurs at most f(p) times, and its cut after its
first word w has l = f(w) and r >= a, so its score is at most
2,000,000 f(p) / (f(w) + f(p)): p's bound.  A prefix is expanded (the phrases that
go on from it are counted) only while its bound reaches the frontier's level.
Levels fall: first that of the 4,000th best pair of words, then of eight times as
many, ..., at last 0.  All phrases that score the level or more are known when their
prefixes are expanded.  A language is settled when 2,000 of these survive, or at
level 0: whatever was not expanded scores less than the level, so the 2,000th score,
ties with it included, can no longer change.

Whether a phrase is dropped is decided by its extensions by one word alone (any
longer phrase that holds it has one at least as frequent).  Those to the right are
under the expanded prefix; those to the left are counted beside them, and counts of
rests that no prefix brought are counted on demand.

Each level reads the texts three times (three words, four words, rests).  What a task
has to know is bitmaps of a fixed size: frequent words and pairs, expanded prefixes,
phrases whose left extensions are wanted.  A false hit only counts a phrase nobody asked for; every
count is of all occurrences.  Tasks count what they read in arrays of bounded size
before the shuffle, so no word, line or language makes a hot key; the tables that
are joined hold one row per frequent phrase.

A word stands for itself as a 64-bit hash of (language, word); two frequent ones of the same
hash are an error, never a wrong count.  Arithmetic is in whole numbers (decimals of 38 digits).

Defined results: null text is empty; a null language is ``und`` and one with it.  Repeated
rows count each time.  Very long texts are read in pieces, phrases across them counted.  A language with too
few phrases gives those it has, an empty table none.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ByteHasher, mix64, stored

MIN_COUNT, LIMIT, SHARE, SCALE = 30, 2000, 80, 2_000_000
LONGEST = 4
#: Bits of each bitmap: 8 MB, whatever the input; a fuller bitmap only makes tasks count more.
BITMAP_BITS = 26
_ROWS = 1 << 19         # phrases that a task holds before it counts them (Spark's partial sums join a task's parts)
_WORDS = 1 << 16        # different words that a task holds before it hands them on
_LONG = 64              # bytes; longer words are hashed one by one
_OUT = 1 << 18


# ---------------------------------------------------------------- reading texts

class PhraseReader(ByteHasher):
    """Words with their hash, and the place at which pieces end."""

    def __init__(self):
        super().__init__()
        self.kinds[:] = 1
        self.breaks = np.zeros(256, dtype=np.int32)
        self.breaks[[*b".,;:!?", *range(10, 14)]] = 1
        self.kinds[self.breaks == 1] = 0
        self.kinds[[9, 32]] = 0

    def words(self, langs: pa.Array, texts: pa.Array):
        """Yield (key of each word, number of its piece, first byte, end byte, row, bytes); piece numbers rise."""
        names = [x or "und" for x in langs.to_pylist()]
        number = {x: np.uint64(xxhash.xxh3_64_intdigest(x.encode())) for x in set(names)}
        lang = np.array([number[x] for x in names], dtype=np.uint64)
        passed = 0
        for h, row, start, end, _, data in self.pieces(texts):
            for i in np.flatnonzero(end - start > _LONG).tolist():
                h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes().lower())
            ends = np.cumsum(self.breaks[data])
            yield mix64(h ^ lang[row]), passed + ends[start] + row, start, end, row, data
            passed += int(ends[-1]) if len(ends) else 0


def gram_slot(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmap slot of each phrase (one array a word)."""
    with np.errstate(over="ignore"):
        h = words[0]
        for w in words[1:]:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Bitmap:
    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    def holds(self, words: list[np.ndarray]) -> np.ndarray:
        slot = gram_slot(words, self.bits)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(phrases: DataFrame, n: int, bits: int = BITMAP_BITS) -> Bitmap:
    """The phrases (k1 .. kn) as a bitmap of fixed size; tasks or together their parts, the driver gets the words."""
    def run(batches):
        for batch in batches:
            slot = gram_slot([_u64(batch.column(i)) for i in range(n)], bits)
            order = np.unique(slot)
            block, first = np.unique(order >> 6, return_index=True)
            if not len(block):
                continue
            ones = np.uint64(1) << (order & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.bitwise_or.reduceat(ones, first).view(np.int64))], ["block", "word"])

    parts = (phrases.select(*_keys(n)).mapInArrow(run, "block bigint, word bigint")
             .groupBy("block").agg(F.bit_or("word").alias("word")).toArrow())
    data = np.zeros(1 << (bits - 6), dtype=np.int64)
    data[parts.column("block").to_numpy()] = parts.column("word").to_numpy()
    return Bitmap(data.view(np.uint8), bits)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _keys(n: int, first: int = 1) -> list[str]:
    return [f"k{i}" for i in range(first, first + n)]


# ---------------------------------------------------------------- counting

def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, k1, f) for all words."""
    def run(batches):
        reader = PhraseReader()
        held: dict[int, list] = {}

        def hand_on():
            rows = list(held.values())
            table = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string()),
                 pa.array(np.array(list(held), dtype=np.uint64).view(np.int64)), pa.array([r[2] for r in rows], pa.int64())],
                ["lang", "word", "k1", "f"])
            held.clear()
            return table

        for batch in batches:
            names = batch.column(0).to_pylist()
            for key, _, start, end, row, data in reader.words(batch.column(0), batch.column(1)):
                order = np.argsort(key, kind="stable")
                ordered = key[order]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(key)))
                at = order[first]
                for k, i, c in zip(ordered[first].tolist(), at.tolist(), counts.tolist()):
                    known = held.get(k)
                    if known is None:
                        held[k] = [names[row[i]], data[start[i] : end[i]].tobytes().lower(), c]
                    else:
                        known[2] += c
                if len(held) >= _WORDS:
                    yield hand_on()
        if held:
            yield hand_on()

    return (texts.mapInArrow(run, "lang string, word string, k1 bigint, f bigint")
            .groupBy("lang", "word", "k1").agg(F.sum("f").alias("f")))


def _counted(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal phrases as one with their number, in the order of a hash (phrases that it joins stay apart); uses up ``columns``."""
    order = np.argsort(gram_slot(columns, 63), kind="stable")
    for i, c in enumerate(columns):
        columns[i] = c[order]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns] + [np.diff(np.append(first, len(order)))]


def count_phrases(texts: DataFrame, n: int, bitmaps: dict[str, Bitmap], wanted, min_count: int = MIN_COUNT) -> DataFrame:
    """(k1 .. kn, a) of the phrases of n words that ``wanted(bitmaps, words)`` marks and that occur ``min_count`` times.

    ``wanted`` sees one array a word and gives a mask; it looks at the words alone, so a phrase is counted
    wherever it stands or nowhere.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)
    names = [*_keys(n), "a"]

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        whole = np.concatenate(parts)
        parts.clear()  # else a task holds its phrases twice while it sorts them
        return whole

    def emit(held: list[list[np.ndarray]]):
        out = _counted([joined(parts) for parts in held])
        for k in range(0, len(out[0]), _OUT):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + _OUT].view(np.int64)) for c in out], names)

    def run(batches):
        reader, maps = PhraseReader(), shared.value
        held, rows = [[] for _ in range(n)], 0
        for batch in batches:
            tail, tail_piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for key, piece, *_ in reader.words(batch.column(0), batch.column(1)):
                # the last words before go along: a phrase that ends in a new word is counted here
                key, piece = np.concatenate([tail, key]), np.concatenate([tail_piece, piece])
                tail, tail_piece = key[1 - n :], piece[1 - n :]
                if len(key) < n:
                    tail, tail_piece = key, piece
                    continue
                at = np.flatnonzero(piece[: len(key) - n + 1] == piece[n - 1 :])
                at = at[maps["word"].holds([key])[at]]
                words = [key[at + i] for i in range(n)]
                mask = wanted(maps, words)
                words = [w[mask] for w in words]
                rows += len(words[0])
                for part, w in zip(held, words):
                    part.append(w)
                if rows >= _ROWS:
                    yield from emit(held)
                    held, rows = [[] for _ in range(n)], 0
        if rows:
            yield from emit(held)

    kinds = ", ".join(f"{k} bigint" for k in names)
    return (texts.mapInArrow(run, kinds).groupBy(*_keys(n)).agg(F.sum("a").alias("a"))
            .where(F.col("a") >= min_count))


def _wanted_pairs(maps, w):
    return maps["word"].holds([w[1]])


def _wanted_triples(maps, w):
    """Frequent pairs inside; the first is expanded, or the second's left extensions are wanted."""
    mask = maps["pair"].holds(w[1:])
    some = np.flatnonzero(mask)
    inner = [x[some] for x in w]
    mask[some] = maps["open"].holds(inner[:2]) | maps["left"].holds(inner[1:])
    return mask


def _wanted_fours(maps, w):
    mask = maps["pair"].holds(w[2:])
    some = np.flatnonzero(mask)
    inner = [x[some] for x in w]
    mask[some] = maps["open"].holds(inner[:3]) | maps["left"].holds(inner[1:])
    return mask


def _wanted_rests(maps, w):
    return maps["open"].holds(w)


# ---------------------------------------------------------------- scores

def ratio(a: str, parts: str) -> Column:
    """floor(2,000,000 a / parts), exactly."""
    return F.expr(f"(cast({SCALE} as decimal(10,0)) * cast({a} as decimal(20,0))) div cast({parts} as decimal(20,0))")


def bound(a: str, first: str) -> Column:
    """No phrase that goes on from a prefix of ``a`` occurrences and this first word scores more."""
    return ratio(a, f"({first} + {a})")


def least_cut(cuts: list[tuple[str, str]]) -> list[Column]:
    """(l, r, score) of the cut with the lowest score, the earliest of equal ones."""
    tried = [F.struct(ratio("a", f"({left} + {rest})").alias("score"), F.lit(i).alias("cut"), F.col(left).alias("l"), F.col(rest).alias("r"))
             for i, (left, rest) in enumerate(cuts)]
    best = F.array_min(F.array(*tried))
    return [best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")]


def _renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(new) for c, new in columns.items()])


def _frequent_words(words: DataFrame, min_count: int) -> DataFrame:
    frequent = stored(words.where(F.col("f") >= min_count), "phrase-words")
    twice = frequent.groupBy("k1").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("two frequent words have the same hash")
    return frequent


def _pairs(texts: DataFrame, frequent: DataFrame, maps: dict[str, Bitmap], min_count: int) -> DataFrame:
    """(lang, k1, k2, a, f1, f2, l, r, score, bound) of all frequent pairs."""
    counted = count_phrases(texts, 2, maps, _wanted_pairs, min_count)
    rows = (counted.join(_renamed(frequent, {"k1": "k1", "lang": "lang", "f": "f1"}), "k1")
            .join(_renamed(frequent, {"k1": "k2", "f": "f2"}), "k2"))
    return stored(rows.select("lang", "k1", "k2", "a", "f1", "f2", *least_cut([("f1", "f2")]), bound("a", "f1").alias("bound")), "phrase-pairs")


def _triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, k1..k3, a, f1, f12, l, r, score, bound) of counted triples."""
    rows = (counted.join(_renamed(pairs, {"k1": "k1", "k2": "k2", "lang": "lang", "a": "f12", "f1": "f1"}), ["k1", "k2"])
            .join(_renamed(pairs, {"k1": "k2", "k2": "k3", "a": "f23", "f2": "f3"}), ["k2", "k3"]))
    return rows.select("lang", *_keys(3), "a", "f1", "f12", *least_cut([("f1", "f23"), ("f12", "f3")]), bound("a", "f1").alias("bound"))


def _level(histogram: DataFrame, rank: int) -> DataFrame:
    """(lang, level): the score of the ``rank``-th best pair, 0 where there are fewer."""
    down = Window.partitionBy("lang").orderBy(F.col("score").desc())
    return (histogram.withColumn("upto", F.sum("count").over(down)).groupBy("lang")
            .agg(F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("level")))


def _held_longer(part: DataFrame, longer: DataFrame, n: int, share: int) -> DataFrame:
    """Phrases of ``part`` (n words) that none of the phrases of n + 1 words holds with at least ``share`` % of their count."""
    most = None
    for first in (1, 2):
        one = longer.select(*[F.col(f"k{first + i}").alias(f"k{1 + i}") for i in range(n)], F.col("a").alias("longer"))
        most = one if most is None else most.unionByName(one)
    most = most.groupBy(*_keys(n)).agg(F.max("longer").alias("longer"))
    return (part.join(most, _keys(n), "left")
            .where(~F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share, F.lit(False))).drop("longer"))


def _as_candidates(df: DataFrame, n: int) -> DataFrame:
    """Phrases of n words with four key columns."""
    return df.select("lang", *_keys(n), *[F.lit(None).cast("bigint").alias(f"k{i}") for i in range(n + 1, LONGEST + 1)], "a", "l", "r", "score")


def _expand(texts: DataFrame, pairs: DataFrame, levels: DataFrame, maps: dict[str, Bitmap], min_count: int, share: int) -> DataFrame:
    """All surviving phrases that score their language's level or more."""
    def at_level(df: DataFrame, column: str) -> DataFrame:
        return df.join(levels, "lang").where(F.col(column) >= F.col("level")).drop("level")

    best2 = at_level(pairs, "score")
    maps3 = {**maps, "open": bitmap_of(at_level(pairs, "bound"), 2), "left": bitmap_of(best2, 2)}
    counted3 = stored(count_phrases(texts, 3, maps3, _wanted_triples, min_count), "phrase-triples")
    triples = stored(_triples(counted3, pairs), "phrase-triples")
    open3, best3 = at_level(triples, "bound"), at_level(triples, "score")
    maps4 = {**maps, "open": bitmap_of(open3, 3), "left": bitmap_of(best3, 3)}
    counted4 = stored(count_phrases(texts, 4, maps4, _wanted_fours, min_count), "phrase-fours")
    fours = (counted4.join(_renamed(open3, {"k1": "k1", "k2": "k2", "k3": "k3", "lang": "lang", "f1": "f1", "f12": "f12", "a": "f123"}), _keys(3))
             .join(_renamed(pairs, {"k1": "k3", "k2": "k4", "a": "f34", "f2": "f4"}), ["k3", "k4"]))
    # without the cut after the first word, whose rest may not have been counted
    fours = stored(at_level(fours.withColumn("_other", F.least(ratio("a", "(f12 + f34)"), ratio("a", "(f123 + f4)"))), "_other").drop("_other"), "phrase-fours")
    rests = fours.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), F.col("k4").alias("k3")).distinct()
    missing = stored(rests.join(counted3, _keys(3), "left_anti"), "phrase-rests")
    known3 = counted3
    if missing.limit(1).count():
        asked = count_phrases(texts, 3, {**maps, "open": bitmap_of(missing, 3)}, _wanted_rests, min_count)
        known3 = counted3.unionByName(stored(asked.join(missing, _keys(3), "left_semi"), "phrase-rests"))
    fours = fours.join(_renamed(known3, {"k1": "k2", "k2": "k3", "k3": "k4", "a": "f234"}), ["k2", "k3", "k4"])
    fours = fours.select("lang", *_keys(4), "a", *least_cut([("f1", "f234"), ("f12", "f34"), ("f123", "f4")]))
    return (_as_candidates(_held_longer(best2, counted3, 2, share), 2)
            .unionByName(_as_candidates(_held_longer(best3, counted4, 3, share), 3))
            .unionByName(_as_candidates(at_level(fours, "score"), 4)))


def _first(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each language with their rank; of any part of a language only its first rows move on."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    parts = (found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("_at", F.row_number().over(part))
             .where(F.col("_at") <= limit).drop("_part", "_at"))
    whole = Window.partitionBy("lang").orderBy(*order)
    return parts.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= limit)


def mine(docs: DataFrame, limit: int = LIMIT, min_count: int = MIN_COUNT, share: int = SHARE, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``limit`` phrases."""
    texts = _texts(docs, lang, text)
    words = stored(count_words(texts), "phrase-all-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = _frequent_words(words, min_count)
    maps = {"word": bitmap_of(frequent, 1)}
    pairs = _pairs(texts, frequent, maps, min_count)
    maps["pair"] = bitmap_of(pairs, 2)
    histogram = stored(pairs.groupBy("lang", "score").count(), "phrase-scores")
    todo, found, rank = histogram.select("lang").distinct(), None, 2 * limit
    while todo.limit(1).count():
        levels = stored(_level(histogram, rank).join(todo, "lang", "left_semi"), "phrase-levels")
        survivors = stored(_expand(texts, pairs, levels, maps, min_count, share), "phrase-survivors")
        enough = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        state = stored(levels.join(enough, "lang", "left")
                       .select("lang", ((F.col("level") == 0) | (F.coalesce("n", F.lit(0)) >= limit)).alias("settled")), "phrase-settled")
        done = survivors.join(state.where("settled"), "lang", "left_semi")
        found = done if found is None else found.unionByName(done)
        todo, rank = state.where("not settled").select("lang"), rank * 8
    if found is None:
        found = _as_candidates(pairs, 2)
    for i in range(1, LONGEST + 1):
        found = found.join(_renamed(frequent, {"k1": f"k{i}", "word": f"w{i}"}), f"k{i}", "left")
    named = found.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(1, LONGEST + 1)]).alias("phrase"), "a", "l", "r", "score")
    return _first(named, limit).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
