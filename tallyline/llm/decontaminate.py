"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so containment (the share of an
item's shingles that a document holds) is searched, not resemblance. Items are
partitioned by their number of shingles. An item of a partition with at most
``u`` shingles keeps the ``u - ceil(t u) + 1`` smallest hash values of its
shingles: a document that contains at least the share ``t`` lacks at most
``u - ceil(t u)`` of them, so it holds one of those kept and no document is
missed. The documents' shingle hashes meet this index in one equality join.
Candidates are then verified by the exact containment of their shingle texts.

Words are runs of letters, marks and digits, lower-cased; a shingle is five of
them. An item with fewer words is one shingle of its whole sequence, searched
among document shingles of that length.

Defined results: null or empty texts and items hold no shingles and match
nothing; repeated items each get their own rows; repeated documents (by id)
are one document with the shingles of all its rows; a null id groups like any
id; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import BROADCAST_ROWS, col, small, written

SHINGLE = 5
CONTAINMENT = 0.8
SIZE_STEP = 1.25            # each size partition reaches so many times further

_WORD_GAP = r"[^\p{L}\p{M}\p{N}]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD_GAP), "")


def _windows(n: Column, k: int) -> Column:
    """Start positions of the k-word windows of a sequence of n words."""
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))


def _shingle_hashes(hashes: Column, k: int) -> Column:
    """Hashes of the k-word shingles, from the hashes of the words."""
    return F.transform(_windows(F.size(hashes), k),
                       lambda i: F.xxhash64(*[F.get(hashes, i + j - 1) for j in range(k)]))


def _shingle_texts(words: Column, k: int) -> Column:
    return F.transform(_windows(F.size(words), k),
                       lambda i: F.concat_ws(" ", *[F.get(words, i + j - 1) for j in range(k)]))


def _bounds(most: int) -> list[int]:
    """Upper bounds of the size partitions up to ``most`` shingles."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * SIZE_STEP)))
    return bounds


def _kept(size: Column, most: int, share: float) -> Column:
    """How many hash values an item of this size keeps."""
    out = None
    for u in _bounds(most):
        k = u - math.ceil(share * u - 1e-9) + 1
        out = F.when(size <= u, F.lit(k)) if out is None else out.when(size <= u, F.lit(k))
    return out


def _sized(side: DataFrame) -> DataFrame:
    """A written side, broadcast if it is small; else neither side is: the planner
    sizes the documents' shingles as the documents before the explode."""
    return F.broadcast(side) if small(side, BROADCAST_ROWS) else side.hint("merge")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
              text: str = "text", shingle: int = SHINGLE, share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document
    and item with a containment of at least ``share``."""
    item_words = (items.select(col(item_id).alias("item"), normal_words(col(text)).alias("words"))
                  .filter(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(shingle))))
    lengths = sorted(r[0] for r in item_words.select("k").distinct().collect())  # at most `shingle` numbers
    doc_words = docs.select(col(doc_id).alias("doc"), normal_words(col(text)).alias("words"))
    if not lengths:
        return (doc_words.join(items.select(col(item_id).alias("item")).limit(0), F.lit(False))
                .select(col("doc").alias(doc_id), col("item").alias(item_id), F.lit(0).alias("n_shingles"),
                        F.lit(0).cast("long").alias("n_found"), F.lit(0.0).alias("containment")))

    # Equal items are searched once.
    by_length = None
    for k in lengths:
        part = item_words.filter(col("k") == k).select("item", "k", F.array_distinct(_shingle_texts(col("words"), k)).alias("shingles"))
        by_length = part if by_length is None else by_length.unionAll(part)
    tagged = by_length.select("item", "k", F.array_sort("shingles").alias("shingles"))
    tagged = written(tagged.withColumn("class", F.xxhash64("k", "shingles")), "decon-items")
    classes = (tagged.groupBy("class").agg(F.first("k").alias("k"), F.first("shingles").alias("shingles"))
               .withColumn("n", F.size("shingles")))
    most = classes.agg(F.max("n")).first()[0]

    # The index hashes an item's shingles word by word, as the documents' are.
    hashed = classes.select("class", "k", F.array_sort(F.transform(
        "shingles", lambda s: _hash_of(s, shingle))).alias("hashes"), _kept(col("n"), most, share).alias("keep"))
    index = written(hashed.select("k", F.explode(F.slice("hashes", F.lit(1), F.least("keep", F.size("hashes")))).alias("h"), "class"),
                    "decon-index")
    word_hashes = doc_words.select("doc", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    found = None
    for k in lengths:
        grams = word_hashes.select("doc", F.explode(_shingle_hashes(col("hashes"), k)).alias("h"))
        hits = grams.join(_sized(index.filter(col("k") == k)), "h").select("doc", "class")
        found = hits if found is None else found.unionAll(hits)
    candidates = written(found.distinct(), "decon-candidates")

    # Exact check: the shingle texts of the candidate documents alone.
    shingles = written(classes.select("class", "k", "n", F.explode("shingles").alias("shingle")), "decon-shingles")
    wanted = candidates.select("doc").distinct()
    if small(candidates, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    raw = docs.select(col(doc_id).alias("doc"), col(text).alias("text"))
    near = (raw.join(wanted, raw["doc"].eqNullSafe(wanted["doc"]), "left_semi")
            .select("doc", normal_words(col("text")).alias("words")))
    texts = None
    for k in lengths:
        part = near.select("doc", F.lit(k).alias("k"), F.explode(F.array_distinct(_shingle_texts(col("words"), k))).alias("shingle"))
        texts = part if texts is None else texts.unionAll(part)
    held = (texts.join(_sized(shingles), ["k", "shingle"]).groupBy("doc", "class")
            .agg(F.countDistinct("shingle").alias("n_found"), F.max("n").alias("n")))
    pairs = candidates.withColumnRenamed("doc", "candidate")
    sure = (held.filter(col("n_found") >= F.lit(share) * col("n") - 1e-9)
            .join(pairs, held["doc"].eqNullSafe(pairs["candidate"]) & (held["class"] == pairs["class"]), "left_semi"))
    return (sure.join(tagged.select("item", "class"), "class")
            .select(col("doc").alias(doc_id), col("item").alias(item_id), col("n").alias("n_shingles"), "n_found",
                    (col("n_found") / col("n")).alias("containment")))


def _hash_of(shingle: Column, most: int) -> Column:
    """The hash of a shingle text, built from its words' hashes. The number of
    words decides how many hashes are combined."""
    parts = F.transform(F.split(shingle, " "), lambda w: F.xxhash64(w))
    out = None
    for k in range(1, most + 1):
        h = F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(k)])
        out = F.when(F.size(parts) == k, h) if out is None else out.when(F.size(parts) == k, h)
    return out


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no test item."""
    hit = written(contained(docs, items).select(col("doc_id").alias("hit")).distinct(), "decon-hits")
    side = F.broadcast(hit) if small(hit, BROADCAST_ROWS) else hit
    return docs.join(side, docs["doc_id"].eqNullSafe(side["hit"]), "left_anti")
