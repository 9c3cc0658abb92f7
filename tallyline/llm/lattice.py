"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to eight dimensions by a random matrix, scaled, and
decoded to the nearest point of the E8 lattice; vectors that are near decode
to the same point or to a neighbouring one. Several tables with matrices of
their own each index every vector under its point; as a query, a vector also
probes the neighbouring points that its residual leans to most. Vectors meet
in the cell (label, table, point) that one of them owns and the other owns or
probes; the cosine of those that meet, in double precision, decides.

Pairs are never rows: vectors go to the cells in which they meet someone, a
cell of many is cut into blocks, and a task compares two blocks by a matrix
product. It returns a row per vector: its count of links and one vector that
it is connected with. A pair that meets in several cells is counted in the one
of the least key.

Equal vectors of a label are one class before anything is joined: a group of
copies is one row with a count, and its members' links are counted, not
listed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing and are kept;
components of any finite size count, however large or small;
vectors of different length do not link; repeated rows are copies; rows with a
null id count as copies but never name a component; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import col, written
from tallyline.llm.components import components

COSINE = 0.98
TABLES = 4
PROBES = 12       # neighbouring points probed in each table
WIDTH = 0.8       # of a lattice unit, in projected length
SEED = 1
BLOCK = 512       # vectors decoded at once; members of a block of a cell, about
SMALL = 32        # rows up to which units are compared together
PAIRS = 1 << 13   # pairs whose cells are compared at once


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or eight halves
    with an even number of minus signs."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(pairs + halves)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the
    sum is odd, round the least certain coordinate the other way."""
    near = np.round(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    near[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the even points and those moved by half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def _mixed(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key for lattice points (of any leading shape) of a table."""
    with np.errstate(over="ignore"):
        h = np.full(points.shape[:-1], np.uint64(table + 1), dtype=np.uint64)
        for k in range(8):
            h = (h ^ np.round(2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
          seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Own keys (n, tables) and probed keys (n, tables, probes) of unit vectors."""
    n, d = vectors.shape
    own, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    around = shortest()
    for t in range(tables):
        matrix = np.random.default_rng([seed, d, t]).standard_normal((d, 8)) / width
        for at in range(0, n, BLOCK):
            x = vectors[at:at + BLOCK] @ matrix
            point = decode(x)
            lean = (x - point) @ around.T
            best = np.argpartition(-lean, probes, axis=1)[:, :probes]
            own[at:at + BLOCK, t] = _mixed(point, t)
            near[at:at + BLOCK, t] = _mixed(point[:, None, :] + around[best], t)
    return own, near


def _hashed(tables: int, probes: int, width: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len), sort=False):
                own, near = cells(np.stack(part["v"].to_list()), tables, probes, width)
                yield part.assign(own=list(own), near=list(near.reshape(len(part), -1)))
    return run


def least_shared(own: np.ndarray, probed: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least key of the cells in which each pair (x, y) of rows meets: those
    that one of the two owns and the other owns or probes."""
    out = np.empty(len(x), np.int64)
    none = np.iinfo(np.int64).max
    for at in range(0, len(x), PAIRS):
        p, q = x[at:at + PAIRS], y[at:at + PAIRS]
        both = [np.where((own[a][:, :, None] == probed[b][:, None, :]).any(axis=2), own[a], none).min(axis=1)
                for a, b in ((p, q), (q, p))]
        out[at:at + PAIRS] = np.minimum(*both)
    return out


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of the n rows that each is connected with by the pairs (x, y)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def unit_links(key: int, i: int, j: int, block: np.ndarray, v: np.ndarray, own: np.ndarray, near: np.ndarray,
               n: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, root, links) of the rows of one unit, blocks i and j of a cell, that
    have a link there. A link met in several cells is counted where its least
    key is, so it is counted once; roots hold the unit's links together."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    owner = (own == key).any(axis=1)
    near_enough = (v[left] @ v[right].T >= cosine) & (owner[left][:, None] | owner[right][None, :])
    x, y = np.nonzero(np.triu(near_enough, 1) if i == j else near_enough)
    x, y = left[x], right[y]
    here = least_shared(own, np.concatenate([own, near], axis=1), x, y) == key
    links = np.zeros(len(v), np.int64)
    np.add.at(links, x[here], n[y[here]])
    np.add.at(links, y[here], n[x[here]])
    rows = np.unique(np.concatenate([x, y]))
    return rows, roots(len(v), x, y)[rows], links[rows]


def small_links(unit: np.ndarray, key: np.ndarray, across: np.ndarray, block: np.ndarray, v: np.ndarray, own: np.ndarray,
                near: np.ndarray, n: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``unit_links`` for many small units at once, whose rows follow each
    other: every row with the first after it, then with the second, and so on.
    ``across`` tells the rows of units of two blocks."""
    owner = (own == key[:, None]).any(axis=1)
    probed = np.concatenate([own, near], axis=1)
    xs, ys, x, step = [], [], np.arange(len(v)), 0
    while len(x):
        step += 1
        x = x[x + step < len(v)]
        x = x[unit[x] == unit[x + step]]
        y = x + step
        linked = (owner[x] | owner[y]) & (~across[x] | (block[x] != block[y]))
        linked[linked] = np.einsum("pd,pd->p", v[x[linked]], v[y[linked]]) >= cosine
        xs.append(x[linked])
        ys.append(y[linked])
    x, y = np.concatenate(xs), np.concatenate(ys)
    here = least_shared(own, probed, x, y) == key[x]
    links = np.zeros(len(v), np.int64)
    np.add.at(links, x[here], n[y[here]])
    np.add.at(links, y[here], n[x[here]])
    rows = np.unique(np.concatenate([x, y]))
    return rows, roots(len(v), x, y)[rows], links[rows]


def _verified(cosine: float):
    """Over rows sorted by unit (label, key, i, j): (class, root, links)."""
    of_unit = ["label", "key", "i", "j"]

    def told(rows: pd.DataFrame, unit: np.ndarray) -> Iterator[pd.DataFrame]:
        for _, at in pd.Series(np.arange(len(rows))).groupby(rows["v"].map(len).to_numpy(), sort=False):
            part, number = rows.iloc[at.to_numpy()], unit[at.to_numpy()]
            size = np.bincount(number)[number]
            few = np.flatnonzero((size > 1) & (size <= SMALL))
            many = np.flatnonzero(size > SMALL)
            lots = np.split(many, np.flatnonzero(np.diff(number[many])) + 1) if len(many) else []
            for lot in [few, *lots]:
                if not len(lot):
                    continue
                some = part.iloc[lot]
                key, i, j, block, n, ids = (some[c].to_numpy() for c in ("key", "i", "j", "block", "n", "class"))
                v, own, near = (np.stack(some[c].to_list()) for c in ("v", "own", "near"))
                if lot is few:
                    row, root, links = small_links(number[lot], key, i != j, block, v, own, near, n, cosine)
                else:
                    row, root, links = unit_links(key[0], i[0], j[0], block, v, own, near, n, cosine)
                yield pd.DataFrame({"class": ids[row], "root": ids[root], "links": links})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            begins = (rows[of_unit] != rows[of_unit].shift()).any(axis=1).to_numpy()
            last = int(np.flatnonzero(begins)[-1])          # its unit may go on in the next batch
            yield from told(rows.iloc[:last], np.cumsum(begins[:last]))
            held = rows.iloc[last:]
        if held is not None:
            yield from told(held, np.ones(len(held), np.int64))
    return run


def unit_vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec, label, v): unit vectors in double precision; v is null where a
    vector can link with nothing."""
    raw = col("e")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(col(vec_id).alias("vec"), col(label).alias("label"), col(embedding).cast("array<double>").alias("e"))
    usable = col("label").isNotNull() & (F.size(raw) > 0) & finite
    # Squares of very large or small components leave the range of a double: those vectors are scaled first.
    largest = F.array_max(F.transform(raw, F.abs))
    scaled = rows.withColumn("norm", F.when(usable, size)).withColumn(
        "e", F.when(col("norm").between(1e-100, 1e100), raw).when(usable & (largest > 0), F.transform(raw, lambda x: x / largest)))
    return scaled.withColumn("norm", size).select("vec", "label", F.when(col("norm") > 0, F.transform(raw, lambda x: x / col("norm"))).alias("v"))


def linked(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
           cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = unit_vectors(df, vec_id, embedding, label)
    rows = written(rows.withColumn("class", F.when(col("v").isNotNull(), F.xxhash64("label", "v"))), "lattice-rows")
    classes = written(rows.filter(col("class").isNotNull()).groupBy("class").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec").alias("first")),
        "lattice-classes")

    keyed = T.StructType([*classes.select("class", "label", "v", "n").schema,
                          *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("own", "near"))])
    keys = written(classes.select("class", "label", "v", "n").mapInPandas(_hashed(tables, probes, width), keyed), "lattice-keys")
    # Cells with an owner and someone else; where nobody meets, no vector is moved.
    members = keys.select("class", "label", "own", F.explode(F.array_distinct(F.concat("own", "near"))).alias("key"))
    members = members.select("class", "label", "key", F.array_contains("own", col("key")).alias("owner"))
    crowds = members.groupBy("label", "key").agg(F.count("*").alias("members"), F.max("owner").alias("owned"))
    met = members.join(crowds.filter(col("owned") & (col("members") > 1)), ["label", "key"])
    # A cell of many members is cut into blocks; every two blocks are one unit of work.
    cut = F.ceil(col("members") / BLOCK).cast("int")
    met = met.select("class", "key", cut.alias("cut"), F.pmod(F.xxhash64("class", "key"), cut).cast("int").alias("block"))
    units = F.explode(F.transform(F.sequence(F.lit(0), col("cut") - 1), lambda c: F.struct(
        F.least("block", c).alias("i"), F.greatest("block", c).alias("j"))))
    work = (keys.join(met, "class").withColumn("unit", units)
            .select("label", "key", col("unit")["i"].alias("i"), col("unit")["j"].alias("j"), "block", "class", "n", "v", "own", "near"))
    work = work.repartition("label", "key", "i", "j").sortWithinPartitions("label", "key", "i", "j")
    links = written(work.mapInPandas(_verified(cosine), "class bigint, root bigint, links bigint"), "lattice-links")

    outside = links.groupBy("class").agg(F.sum("links").alias("outside"))
    joined = components(links.select(col("class").alias("a"), col("root").alias("b"))).withColumnRenamed("node", "class")
    rooted = (classes.select("class", "n", "first").join(outside, "class", "left").join(joined, "class", "left")
              .select("class", (F.coalesce("outside", F.lit(0)) + col("n") - 1).alias("n_links"), "first",
                      F.coalesce("root", "class").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = written(rooted.join(least, "root").select("class", "n_links", "component_id"), "lattice-told")
    out = rows.select("vec", "class").join(told, "class", "left")
    component = F.when(col("class").isNull(), col("vec")).otherwise(col("component_id"))
    return out.select(col("vec").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"), col("vec").eqNullSafe(component).alias("kept"))
