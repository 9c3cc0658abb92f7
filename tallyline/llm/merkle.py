"""Merkle manifest of a table by sibling-shift self-joins.

Rows are leaves. Per group (source) the leaves, in order, are numbered. At
every level the nodes of slot zero compute the indices of their siblings (XOR
with 1 for two children, slot offsets otherwise), the nodes are equijoined
with themselves on those indices, and the rows of slot zero, which then hold
their whole run, emit the parents. The groups' last nodes are the leaves of
one more tree, whose last node is the root.

A node's siblings are the rest of its run, so paths go down again over the
runs: a run's path is itself, then the path of its parent's run. A parent has
at most ``arity`` children: no key of these joins is hot, and only the last
join, with the leaves, meets every row. There the paths are folded and hashed
in place; they are never written per leaf.

Numbering is by ranges: rows are range-partitioned by (group, id, leaf),
counted by (range, group), and numbered within their range. Neither a group
nor a run of equal rows is in one task. The number of jobs grows with the
logarithm of the largest group.

Defined results: nulls in any column are hashed as "-"; a null group is a
group of its own and the first, a null id comes first in its group; rows of
equal id are ordered by leaf digest, and equal rows take places beside each
other; a lone leaf is its group's subroot and a lone subroot the root; the
proof of a row without siblings is the digest of the empty text; an empty
table gives an empty table; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import ascii_lower, col, written

ARITY = 16
TAMPER = 5   # in the check, a row is tampered with where this divides the CRC-32 of its id


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: "-", or its size in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's columns, in hex."""
    return digest(F.concat(*[field(v) for v in values]))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, id, digest, ...) with tree (the group's place among the
    groups), idx (the row's place in its group) and n (the group's rows)."""
    keys = [F.col("grp"), F.col("id").asc_nulls_first(), F.col("digest")]
    # The last key divides equal rows; the rows are written first, as ranges are sampled.
    whole = written(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    placed = written(whole.repartitionByRange(*keys, "row").withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = written(placed.groupBy("part", "grp").agg(F.count("*").alias("in_part")), "merkle-counts")
    groups = counts.groupBy("grp").agg(F.min("part").alias("home"), F.sum("in_part").alias("n"))
    # Groups are numbered by the range they begin in (one row per range here), then within it.
    begun = groups.groupBy("home").agg(F.count("*").alias("begun"))
    earlier = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("home", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before"))
    at_home = F.row_number().over(Window.partitionBy("home").orderBy("grp"))
    trees = groups.withColumn("at", at_home).join(begun, "home").select(
        "grp", "n", (F.col("at") - 1 + F.col("before")).cast("long").alias("tree"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("start", F.coalesce(F.sum("in_part").over(before), F.lit(0))).join(trees, "grp")
              .select("part", "grp", "start", "tree", "n"))
    within = F.row_number().over(Window.partitionBy("part", "grp").orderBy(*keys[1:], "row"))
    return (placed.withColumn("at", within).join(written(starts, "merkle-starts"), ["part", "grp"])
            .withColumn("idx", (F.col("at") - 1 + F.col("start")).cast("long"))
            .drop("part", "grp", "row", "at", "start"))


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """The parents of ``nodes`` (tree, idx, n, digest): (tree, idx, n, digest)
    and ``run``, the digests of their children in order."""
    some = nodes.filter("n > 1").select("tree", "idx", "n", F.unhex("digest").alias("d"))
    zero = some.filter(F.pmod("idx", F.lit(arity)) == 0)
    if arity == 2:
        siblings = F.array(F.col("idx"), F.col("idx").bitwiseXOR(1))
    else:
        siblings = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda offset: F.col("idx") + offset)
    asked = zero.select("tree", (F.col("idx") / arity).cast("long").alias("parent"), "n", F.explode(siblings).alias("idx"))
    met = asked.filter("idx < n").join(some.select("tree", "idx", "d"), ["tree", "idx"])
    whole = met.groupBy("tree", "parent").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "d"))).alias("run"))
    text = F.lower(F.array_join(F.transform("run", lambda s: F.hex(s["d"])), ""))
    return whole.select("tree", col("parent").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
                        digest(text).alias("digest"), F.unhex(text).alias("run"))


def _grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level over ``leaves`` (tree, idx, n, digest), lowest
    first, and each tree's last node (tree, digest)."""
    nodes, levels = leaves, []
    most = leaves.agg(F.max("n")).first()[0] or 0
    last = nodes.filter("n = 1").select("tree", "digest")
    while most > 1:
        nodes = written(_runs(nodes, arity), f"merkle-level-{len(levels)}")
        levels.append(nodes)
        last = last.unionAll(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // arity)
    return levels, last


def _with_paths(leaves: DataFrame, levels: list[DataFrame], base: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with path (the runs they and their ancestors lie in, lowest
    first) and the columns ``base`` has for their tree."""
    kept = [c for c in base.columns if c != "tree"]
    none = F.array().cast("array<binary>")

    def under(rows: DataFrame, above: DataFrame | None, own: Column) -> DataFrame:
        """Rows with the path of the run above them, or of their tree's end."""
        alone = rows.filter("n = 1").join(base, "tree").withColumn("path", own)
        if above is None:
            return alone
        link = above.select("tree", col("idx").alias("above"), col("path").alias("upper"), *kept)
        rest = rows.filter("n > 1").withColumn("above", (F.col("idx") / arity).cast("long"))
        rest = rest.join(link, ["tree", "above"]).withColumn("path", F.concat(own, F.col("upper"))).drop("above", "upper")
        return rest.unionByName(alone)

    above = None
    for level in reversed(levels):
        above = under(level.select("tree", "idx", "n", "run"), above, F.array("run")).drop("run")
    return under(leaves, above, none)


def _steps(path: str, idx: str, arity: int) -> Column:
    """What stands left and right of a node on its way up, level by level."""
    def step(run: Column, level: Column) -> Column:
        place = F.call_function("div", F.col(idx), F.pow(F.lit(arity), level).cast("long"))
        slot = F.pmod(place, F.lit(arity)).cast("int")
        left = F.lower(F.hex(run.substr(F.lit(1), 32 * slot)))
        return F.struct(left.alias("left"), F.lower(F.hex(run.substr(32 * slot + 33, F.octet_length(run)))).alias("right"))

    return F.transform(path, step)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def manifest(rows: DataFrame, group: Column, order: Column, digest_: Column, arity: int = ARITY, **kept: Column) -> DataFrame:
    """One row per row: leaf, subroot, root, steps (array of left and right
    sibling digests, concatenated, on the way to the root) and the ``kept``
    columns."""
    named = rows.select(F.when(group.isNull(), "").otherwise(F.concat(F.lit("1"), group.cast("string"))).alias("grp"),
                        order.alias("id"), digest_.alias("digest"), F.struct(*[v.alias(k) for k, v in kept.items()]).alias("kept"))
    leaves = written(_numbered(named), "merkle-leaves")
    levels, subroots = _grown(leaves, arity)
    subroots = written(subroots, "merkle-subroots")
    heads = subroots.select(F.lit(0).cast("long").alias("tree"), col("tree").alias("idx"),
                            F.lit(subroots.count()).cast("long").alias("n"), "digest")
    upper, root = _grown(heads, arity)
    heads = _with_paths(heads, upper, root.select("tree", col("digest").alias("root")), arity)
    base = heads.select(col("idx").alias("tree"), col("digest").alias("subroot"), "root", _steps("path", "idx", arity).alias("over"))
    out = _with_paths(leaves, levels, written(base, "merkle-heads"), arity)
    return out.select(col("digest").alias("leaf"), "subroot", "root",
                      F.concat(_steps("path", "idx", arity), "over").alias("steps"), *[col("kept")[k].alias(k) for k in kept])


def document_leaf(text: Column) -> Column:
    return leaf(col("doc_id"), col("source"), col("lang"), col("n_chars"), text)


def checked_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The manifest of a documents table, checked after tampering with some
    texts: which rows still lead to the root."""
    hit = F.crc32(col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    lowered = F.when(hit, document_leaf(ascii_lower(col("text"))))
    rows = manifest(docs, col("source"), col("doc_id"), document_leaf(col("text")), arity, doc_id=col("doc_id"), tampered=lowered)
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"),
                      folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
