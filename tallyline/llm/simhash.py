"""SimHash near-duplicates by deletion-variant signatures.

A document's 64-bit fingerprint has a bit set where more than half of its
shingles' XXH64 values have it. Two fingerprints that differ in at most three
bits have one 32-bit half that differs in at most one. So two halves suffice:
each half is indexed as it is and with each single bit deleted; a half with
the bit set meets, in an equality join, the same half with the bit clear. All
pairs that share a variant are verified on the 64 bits.

Equal fingerprints are one node before anything is joined, so a group of
copies of any size is one row. Components are found on the fingerprints.

Defined results: a text without words (null, empty, blank) has fingerprint 0
and links like any other; fewer words than a shingle are one shingle; equal
rows are copies; a null id belongs to its fingerprint's component but never
names it unless all its ids are null; an empty table gives an empty table;
other columns are ignored (or kept, by ``unique_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import BROADCAST_ROWS, col, fresh, small, written
from tallyline.llm.components import components

WORDS = 3
SEED = 42
BITS = 3
CHUNK = 1 << 16   # shingles whose bits are laid out at once


def _fingerprint(text: bytes | None, k: int) -> int:
    parts = text.lower().split() if text else []   # bytes: ASCII letters and white space only
    if not parts:
        return 0
    n = max(1, len(parts) - k + 1)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(k)))) if len(parts) >= k else [b" ".join(parts)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """The fingerprint as a (signed) long."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_fingerprint(t, k) for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text.cast("binary"))


def _variants(nodes: DataFrame) -> DataFrame:
    """(key, one, fp): each half of a fingerprint with each bit deleted (``one``
    tells whether it was set) and, as bit 32, the whole half."""
    rows = []
    for side, half in enumerate((F.shiftrightunsigned("fp", 32), col("fp").bitwiseAND(0xFFFFFFFF))):
        for i in range(33):
            tag = F.lit((33 * side + i) << 32)
            bit = F.lit(1 << i if i < 32 else 0).cast("long")
            one = half.bitwiseAND(bit) != 0 if i < 32 else F.lit(None).cast("boolean")
            rows.append(F.struct(half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(tag).alias("key"), one.alias("one")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("v")).select("fp", "v.key", "v.one")


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) of all pairs of the distinct fingerprints ``fp`` that differ in
    1 to ``bits`` (at most 3) bits."""
    if bits > 3:
        raise ValueError("two halves with one deleted bit find at most 3 differing bits")
    rows = _variants(nodes)
    index = rows.filter(F.coalesce("one", F.lit(True))).select("key", col("one").isNull().alias("whole"), col("fp").alias("a"))
    probe = rows.filter(~F.coalesce("one", F.lit(False))).select("key", col("fp").alias("b"))
    near = F.bit_count(col("a").bitwiseXOR(col("b"))) <= bits
    # The planner sizes both sides as the nodes before the explode and would broadcast 33 rows for each.
    return index.hint("merge").join(probe, "key").filter(near & (~col("whole") | (col("a") < col("b")))).select("a", "b")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, bits: int = BITS,
            tags: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row, and the ``tags`` asked for."""
    tags = tags or {}
    rows = written(docs.select(col(doc_id).alias("doc"), fingerprint(col(text), k).alias("fp"),
                               *[v.alias(n) for n, v in tags.items()]), "simhash-fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-nodes")
    roots = components(links(nodes, bits))
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")
    side = F.broadcast(classes) if small(classes, BROADCAST_ROWS) else classes
    return rows.join(side, "fp").select(col("doc").alias(doc_id), "fp", "component_id", "root", *tags)


def near_duplicates(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document of each group: the one whose id names it, with all its
    columns. Of rows that repeat its id and text one stays."""
    key, mark = fresh(docs, "text_hash", "dropped")
    text_key = F.xxhash64(col("text"))
    found = written(grouped(docs, tags={key: text_key}), "simhash-groups")
    leads = found.filter(col("doc_id").eqNullSafe(col("component_id")))
    rest = found.filter(~col("doc_id").eqNullSafe(col("component_id")))
    tagged = docs.withColumn(key, text_key)
    kept = _matching(tagged, written(rest.select(col("doc_id").alias(mark), col(key).alias(mark + "_text")).distinct(),
                                     "simhash-rest"), key, mark, "left_anti")
    if leads.count() > leads.select("root").distinct().count():
        # An id or a text is repeated: of each group's leading rows one stays.
        texts = leads.groupBy("root", "doc_id").agg(F.min(key).alias(key))
        kept = _matching(kept, written(texts.select(col("doc_id").alias(mark), col(key).alias(mark + "_text")),
                                       "simhash-leads"), key, mark, "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*[col(c) for c in docs.columns])


def _matching(rows: DataFrame, side: DataFrame, key: str, mark: str, how: str) -> DataFrame:
    """Rows by whether their (id, text hash) is in the written ``side``."""
    side = F.broadcast(side) if small(side, BROADCAST_ROWS) else side
    return rows.join(side, col("doc_id").eqNullSafe(col(mark)) & (col(key) == col(mark + "_text")), how)
