"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a pseudo-random (keyed) order,
passed through again and again up to ``limit`` times. A copy's virtual finish
time is the source's words up to its end, divided by the source's target; the
copies of all sources are taken by finish time until the budget is full. As
the targets add up to the budget, all sources reach their targets together, up
to one document each.

Running totals never sit in one task: rows are dealt into ranges of the order,
the ranges' sums give each range its start. Only one part of the one range of
finish times in which the budget ends is looked at row by row: about a millionth
of all rows.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; equal rows are ordered arbitrarily among
themselves, which changes no result; an empty table gives an empty table.
Columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import col, fresh, words, written

WEIGHTS = (5, 2, 1)   # by the source's rank, repeating
SHARE = 1.5           # words to take, as a share of all words
LIMIT = 2             # passes through a source at most
PER_OCTAVE = 256      # ranges of finish times per doubling
PARTS = 4096          # parts of the range in which the budget ends


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, key, source_size, rank, target) of a table (source, source_size).

    Level filling in closed form: by rising ratio of cap to weight, a source is
    capped while its cap lies under its share of what the capped ones before it
    leave; the rest share the remainder by weight. One row per source, so the
    windows without a key are as small as the list of sources.
    """
    ranked = sizes.select(
        "source", _key(col("source")).alias("key"), "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                      (col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", col("source_size").cast("double") * float(limit))
    by_ratio = Window.orderBy(col("cap") / col("weight"), "rank")
    level = ranked.select(
        "*",
        (F.sum("cap").over(Window.partitionBy()) / float(limit) * share).alias("budget"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.row_number().over(by_ratio).alias("turn"))
    level = level.withColumn("level", (col("budget") - col("filled")) / col("open"))
    level = level.withColumn("first_open", F.min(F.when(col("cap") > col("weight") * col("level"), col("turn")))
                             .over(Window.partitionBy()))
    level = level.withColumn("final", F.max(F.when(col("turn") == col("first_open"), col("level")))
                             .over(Window.partitionBy()))
    return level.select(
        "source", "key", "source_size", "rank",
        F.when(col("first_open").isNull() | (col("turn") < col("first_open")), col("cap"))
        .otherwise(col("weight") * col("final")).alias("target"))


def _finish(passes: int) -> Column:
    """Finish time of a row's copy in the given pass (counted from 0)."""
    return (col("end") + col("source_size") * passes).cast("double") / col("target")


def _range(finish: Column) -> Column:
    return F.floor(F.log2(finish) * PER_OCTAVE)


def _part(finish: Column, at: int) -> Column:
    """The part of range ``at`` that a finish time lies in, rising with it."""
    low, high = 2.0 ** (at / PER_OCTAVE), 2.0 ** ((at + 1) / PER_OCTAVE)
    return F.floor((finish - low) / (high - low) * PARTS)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
        weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = "",
        tags: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``key``, size, source_size, target, passes, taken.

    ``tags`` adds columns computed from the documents (such as a text hash).
    """
    size = F.size(words(col("text"))).cast("long") if size is None else size.cast("long")
    tags = tags or {}
    key_out = "doc_key"
    rows = docs.select(
        col(key).alias(key_out), col(source).alias("source"), F.coalesce(size, F.lit(0).cast("long")).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary")).alias("shuffle"),
        *[v.alias(k) for k, v in tags.items()])
    rows = written(rows, "mix-sizes")
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit),
                      "mix-targets")
    budget = sources.agg(F.sum("source_size")).first()[0]
    budget = (budget or 0) * share

    rows = rows.withColumn("key", _key(col("source"))).withColumn("slice", F.substring("shuffle", 1, 3))
    sums = rows.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.select("key", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("start"))
              .join(sources.drop("source"), "key"))
    upto = (Window.partitionBy("key", "slice").orderBy("shuffle", col(key_out), "size")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.withColumn("end", F.sum("size").over(upto)).join(starts, ["key", "slice"])
              .withColumn("end", col("start") + col("end")))
    placed = written(placed.select(col(key_out), "source", "size", "source_size", "target", "rank", "end", *tags),
                     "mix-places")

    copies = (placed.filter((col("size") > 0) & (col("target") > 0))
              .select("size", "rank", F.explode(F.array(*[_finish(p) for p in range(limit)])).alias("finish"))
              .withColumn("range", _range(col("finish"))))
    ranges = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    running = ranges.select("range", "range_size", F.sum("range_size").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("total"))
    last = running.filter(col("total") > budget).orderBy("range").first()

    if last is not None:
        # The range in which the budget ends, in equal parts; then the part.
        inside = copies.filter(col("range") == last["range"]).withColumn("part", _part(col("finish"), last["range"]))
        left = last["total"] - last["range_size"]
        parts = inside.groupBy("part").agg(F.sum("size").alias("part_size"))
        end = (parts.select("part", "part_size", (F.sum("part_size").over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + left).alias("total"))
            .filter(col("total") > budget).orderBy("part").first())
        left = end["total"] - end["part_size"]
        in_order = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = (inside.filter(col("part") == end["part"])
               .select("finish", "rank", (F.sum("size").over(in_order) + left).alias("total"))
               .filter(col("total") <= budget).agg(F.max(F.struct("finish", "rank")))).first()[0]

    def taken(passes: int) -> Column:
        finish = _finish(passes)
        live = (col("size") > 0) & (col("target") > 0)
        if last is None:
            return live
        part = _part(finish, last["range"])
        before = part < end["part"]
        if cut is not None:
            before = before | ((part == end["part"]) & ((finish < cut["finish"]) | (
                (finish == cut["finish"]) & (col("rank") <= cut["rank"]))))
        return live & ((_range(finish) < last["range"]) | ((_range(finish) == last["range"]) & before))

    passes = sum((F.coalesce(taken(p), F.lit(False)).cast("int") for p in range(1, limit)),
                 F.coalesce(taken(0), F.lit(False)).cast("int"))
    return placed.select(col(key_out).alias(key), "source", "size", "source_size", "target", passes.alias("passes"),
                         (col("size") * passes).cast("long").alias("taken"), *tags)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as many times as the mix takes it, with
    their own columns. Rows equal in id, source and text are one document
    here: all take its largest number of passes."""
    text_hash, size, key, passes, copy = fresh(docs, "text_hash", "word_count", "source_key", "passes", "copy")
    plan = mix(docs.select("doc_id", "source", "text"), tags={text_hash: F.xxhash64(col("text"))}, **how)
    plan = (plan.filter(col("passes") > 0)
            .groupBy(F.coalesce(col("doc_id").cast("string"), F.lit("-")).alias(size),
                     _key(col("source")).alias(key), text_hash).agg(F.max("passes").alias(passes)))
    tagged = (docs.withColumn(size, F.coalesce(col("doc_id").cast("string"), F.lit("-")))
              .withColumn(key, _key(col("source"))).withColumn(text_hash, F.xxhash64(col("text"))))
    return (tagged.join(written(plan, "mix-plan"), [size, key, text_hash])
            .withColumn(copy, F.explode(F.sequence(F.lit(1), col(passes))))
            .select(*[col(c) for c in docs.columns]))
