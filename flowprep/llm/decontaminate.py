"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of ``n`` word shingles is found in a document that holds at least
``threshold`` of them, however long the document is.  Jaccard similarity is of
no use there (it falls with the document's length), so the search is for
containment:

1. Items are partitioned by size, partition ``p`` holding those of ``2^p`` to
   ``2^(p+1) - 1`` shingles.  A partition's sketch length ``k`` is one more than
   the shingles that its largest item may lack.  An item's sketch is its ``k``
   smallest hash values (bottom-k MinHash).
2. Document shingles are probed with the sketches.  Of a sketch of ``k`` values
   a document that qualifies can lack no more than the item may lack, so it has
   at least ``k - lacking`` of them: the candidates hold every match.
3. Candidates are verified by exact containment of the shingle texts.  Only the
   candidate documents are moved for it (a bitmap of fixed size leaves the others
   out; a full one only lets more pass).

Everything is DataFrame functions.  Documents are exploded once, each shingle
against the sketches (a few values an item); they are broadcast if a count
shows that they are few, and joined by shuffle otherwise.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` in lower case.  A
text of fewer than five words has one shingle, all its words, so a short item
is found only in a document of just these words.  A text with no words (null,
empty, blank) has no shingle and matches nothing.  Rows equal in id and text
count once; ids may be null; equal items under two ids are both reported.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, let, split_by_ids, stored, words_of

#: Rows of sketches (32 bytes each) and bytes of item texts (their shingles take about six times that) that may be broadcast.
SKETCH_ROWS, ITEM_BYTES = 500_000, 8 << 20


def _shingles(words: Column, n: int, hashed: bool) -> Column:
    """Array of the n-word shingles of ``words``, as 64-bit hashes or as texts; repeats stay."""
    put = F.xxhash64 if hashed else (lambda w: F.array_join(w, " "))
    units = F.transform(words, lambda w: F.xxhash64(w)) if hashed else words
    return let(units, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>" if hashed else "array<string>"))
               .when(F.size(w) < n, F.array(put(w)))
               .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
                                      lambda i: put(F.slice(w, i, F.lit(n))))))


def shingle_set(text: Column, n: int = 5, hashed: bool = False) -> Column:
    return F.array_distinct(_shingles(words_of(F.lower(text)), n, hashed))


def _lacking(n: Column, threshold: float) -> Column:
    """How many of n shingles may be missing at containment >= threshold."""
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))).cast("long")


def item_sketches(items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row per item and sketch value: (item, sketch, need): a match holds ``need`` values at least.

    ``items`` has (item, text).
    """
    sized = (items.select("item", F.array_sort(shingle_set(F.col("text"), n, hashed=True)).alias("h"))
             .withColumn("n", F.size("h")).where("n > 0")
             .withColumn("partition", F.floor(F.log2("n")).cast("int")))
    largest = F.pow(F.lit(2.0), F.col("partition") + 1).cast("long") - 1
    k = F.least(F.col("n").cast("long"), _lacking(largest, threshold) + 1)
    return (sized.withColumn("k", k)
            .select("item", F.explode(F.slice("h", F.lit(1), F.col("k").cast("int"))).alias("sketch"),
                    F.greatest(F.col("k") - _lacking(F.col("n"), threshold), F.lit(1)).alias("need")))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (id, text) with an own 16-byte row key."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("text"), row_key(F.col(key), F.col(text)).alias("item"))


def row_key(key: Column, text: Column) -> Column:
    """16 bytes that are equal for rows of equal id and text (nulls included)."""
    return F.unhex(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("\x00"),
                                  F.when(text.isNull(), F.lit("n")).otherwise(F.lit("t")),
                                  F.coalesce(text, F.lit("")))))


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5,
               doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment, __row) for each document and item found in it.

    ``__row`` is ``row_key(doc_id, text)`` of the document.
    """
    known = stored(_keyed(items, item_id, item_text).dropDuplicates(["item"]), "items")
    sketches = stored(item_sketches(known.select("item", "text"), threshold, n), "sketches")
    probe = F.broadcast(sketches) if fits_broadcast(sketches, SKETCH_ROWS) else sketches
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    exploded = texts.select(row_key(F.col("doc"), F.col("body")).alias("row"),
                            F.explode(shingle_set(F.col("body"), n, hashed=True)).alias("sketch"))
    # repeated rows of one document add equal hits: count distinct sketch values
    hits = (exploded.join(probe, "sketch").groupBy("row", "item", "sketch").agg(F.max("need").alias("need"))
            .groupBy("row", "item").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
            .where("hits >= need").select("row", "item"))
    candidates = stored(hits, "candidates")

    sets = known.select("item", F.col("id").alias("item_id"), shingle_set(F.col("text"), n).alias("wanted"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sets = F.broadcast(sets) if size <= ITEM_BYTES else sets
    # only documents with a candidate are moved: the others do not pass the bitmap
    named, _ = split_by_ids(texts.withColumn("row", row_key(F.col("doc"), F.col("body"))), F.xxhash64("row"),
                            candidates.select(F.xxhash64("row").alias("id")))
    # one row a document here: its candidate items are an array no longer than the items
    found = candidates.groupBy("row").agg(F.collect_list("item").alias("items"))
    held = (named.join(found, "row").dropDuplicates(["row"])
            .select("row", "doc", shingle_set(F.col("body"), n).alias("held"), F.explode("items").alias("item")))
    shared = F.size(F.array_intersect("wanted", "held"))
    return (held.join(sets, "item")
            .select(F.col("doc").alias("doc_id"), "item_id", F.size("wanted").cast("long").alias("n_item"),
                    shared.cast("long").alias("n_shared"), F.col("row").alias("__row"))
            .where(F.col("n_shared") >= F.col("n_item") - _lacking(F.col("n_item"), threshold))
            .withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6)))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5,
                  doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns as given."""
    bad = stored(find_items(docs, items, threshold, n, doc_id, text, **names).select("__row").distinct(), "contaminated")
    keyed = docs.withColumn("__row", row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    doubtful, clean = split_by_ids(keyed, F.xxhash64("__row"), bad.select(F.xxhash64("__row").alias("id")))
    return clean.unionByName(doubtful.join(bad, "__row", "left_anti")).drop("__row")
