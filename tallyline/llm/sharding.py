"""Sharding by jump consistent hashing.

A key's shard is the last of a pseudo-random sequence of ever larger numbers
that lies below the shard count. The sequence depends on the key alone, so one
more shard takes some keys into itself and moves no other: no ring, no table,
no state. Slots number the rows of each shard from 0 without a gap and without
one task ever holding a shard: rows are dealt into many buckets per shard, the
bucket counts give each bucket's first slot.

Defined results: a null key counts as key 0; other than integer keys are
hashed first; repeated keys share their shard and get a slot each; an empty
table gives an empty table. Columns already named like a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyline.llm.common import col, fresh

# Fixed value: the multiplier of the 64-bit congruential generator.
MULTIPLIER = 2862933555777941757
SHORT = 64          # draws made at once; a key needs about ln(shards) of them
BUCKET_DIGITS = 3   # hex digits of a row's hash that name its bucket: 4,096 buckets per shard

_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _draw(s: Column, shards: int) -> Column:
    """One draw: advance the generator (two 32-bit halves, so that no product
    leaves 63 bits) and jump, unless the sequence has passed ``shards``."""
    hi, lo, at, to = s["hi"], s["lo"], s["at"], s["to"]
    p0 = lo.bitwiseAND(0xFFFF) * _long(_LOW) + _long(1)
    p1 = F.shiftright(lo, 16) * _long(_LOW) + F.shiftright(p0, 16)
    new_lo = F.shiftleft(p1.bitwiseAND(0xFFFF), 16).bitwiseOR(p0.bitwiseAND(0xFFFF))
    high = F.shiftleft((F.shiftright(hi, 16) * _long(_LOW)).bitwiseAND(0xFFFF), 16) + hi.bitwiseAND(0xFFFF) * _long(_LOW)
    new_hi = (F.shiftright(p1, 16) + lo * _long(_HIGH) + high).bitwiseAND(0xFFFFFFFF)
    jump = F.floor((to + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + 1).cast("double")))
    more = to < shards
    return F.struct(F.when(more, new_hi).otherwise(hi).alias("hi"), F.when(more, new_lo).otherwise(lo).alias("lo"),
                    F.when(more, to).otherwise(at).alias("at"), F.when(more, jump.cast("long")).otherwise(to).alias("to"))


def jump(key: Column, shards: int) -> Column:
    """Struct (at, to) for a long key: its shard, and the next shard number
    that would take it."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(0xFFFFFFFF).alias("lo"),
                     _long(0).alias("at"), _long(0).alias("to"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, SHORT))), start, lambda s, _: _draw(s, shards))
    if shards > SHORT:
        rest = F.when(state["to"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
        state = F.aggregate(rest, state, lambda s, _: _draw(s, shards))
    return F.struct(state["at"].alias("at"), state["to"].alias("to"))


def stable_key(df: DataFrame, name: str) -> Column:
    whole = isinstance(df.schema[name].dataType, IntegralType)
    return F.coalesce(col(name).cast("long") if whole else F.xxhash64(col(name)), _long(0))


def assign(df: DataFrame, key: str = "doc_id", shards: int = 16, order: list[str] | None = None,
           digits: int = BUCKET_DIGITS) -> DataFrame:
    """``df`` with shard, slot and grown_shard (the shard with one more).

    ``order`` names further columns that tell rows of one key apart; they
    spread a hot key over buckets and order its slots.
    """
    df = df.drop("shard", "slot", "grown_shard")
    names = [key, *(order or [])]
    at, bucket, first, n = fresh(df, "jumped", "bucket", "first_slot", "n_rows")
    placed = (df.withColumn(at, jump(stable_key(df, key), shards))
              .withColumn("shard", col(at)["at"].cast("int"))
              .withColumn("grown_shard", F.when(col(at)["to"] == shards, F.lit(shards)).otherwise(col("shard")).cast("int"))
              .withColumn(bucket, F.substring(F.md5(F.concat_ws("|", *[col(x).cast("string") for x in names]).cast("binary")), 1, digits))
              .drop(at))
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), _long(0)).alias(first))
    within = Window.partitionBy("shard", bucket).orderBy(*[col(x) for x in names])
    return (placed.withColumn("slot", F.row_number().over(within).cast("long") - 1)
            .join(starts, ["shard", bucket])
            .withColumn("slot", col("slot") + col(first))
            .select(*[col(c) for c in df.columns], "shard", "slot", "grown_shard"))


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of the sharding of a documents table: one row per document.

    A null text counts as the empty text: size 1, CRC 0.
    """
    text = F.coalesce(col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(rows, "doc_id", shards, order=["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
