"""Hard negatives by an inverted multi-index with certified windows.

Vectors of whole numbers are cut in two halves; a codebook of each half is
fitted by k-means on at most ``SAMPLE`` rows per codeword (the rows of least
hash). A pair of codewords is a cell. Every row is indexed: its cell is known,
and each codeword has the largest distance of any row's half to it (its
radius). For an anchor, the inner product with a codeword plus the anchor
half's length times the radius bounds the half-score of every row under it;
the multi-sequence heap visits the cells in the order of the summed bounds.

A search has two rounds, in which anchors meet the blocks of the cells they
visit. The first visits cells along the heap until ``PROBE`` rows are seen and
gives every window of scores that is asked for a k-th best score. The second
visits all cells whose bound is not below all of them: then no unseen row can
be among the k best, and the windows are certified. The result is exact,
whatever the codebooks are. The search is done once for the
positives (same label, any score) and once for the negatives (another label,
scores within a share of a positive's).

Blocks hold at most about ``BLOCK`` rows, batches ``BATCH`` anchors; large cells
are several blocks, small ones share one. Neighbouring blocks are a shelf and
batches a crate, each of at most about ``SHELF`` and ``CRATE`` bytes. A shelf
and a crate meet in one task, by a shuffle whatever the planner takes their
sizes for; it scores batch against block by a matrix product and keeps k rows
per window. So blocks are sent once per crate, and batches once per shelf.
Equal vectors of a label are one row with their first ids, so that copies cost
nothing. The driver holds the codebooks and a count and place per cell (at most
``MOST_WORDS`` squared).

Defined results: rows with a null id, label or vector, or with null or
non-finite components, take no part; rows equal in id, label and vector are
one row, and an anchor is not its own positive; shorter vectors count as
ending in zeros; equal scores are ordered by id; a negative positive score
has no window; scores are exact, and end at the ends of a long; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import col, written

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95    # hundredths of the positive's score that a negative's must lie between
BLOCK = 2048          # rows scored at once
BATCH = 256           # anchors scored at once
PROBE = 4096          # rows seen before windows are certified
SAMPLE = 64           # rows per codeword the codebooks are fitted on
LEAST_WORDS, MOST_WORDS = 8, 64
ROUNDS, SEED = 8, 3
SLACK = 1e-9          # relative rounding error allowed for in bounds
ENDS = (-(1 << 63), (1 << 63) - 1)
EXACT, EXACT_SHORT = float(1 << 53), float(1 << 24)
SHELF, CRATE = 32 << 20, 32 << 20   # bytes of blocks, and of batches, that a task holds at once
TILES = 48            # shelves at least, where there are as many blocks
MOST_TASKS = 4096


class Index:
    """Codebooks of both halves, their radii, and the cells' rows and blocks."""

    def __init__(self, sample: np.ndarray, words: int):
        self.cut = (sample.shape[1] + 1) // 2
        self.books = [_book(sample[:, :self.cut], words), _book(sample[:, self.cut:], words)]
        self.words = words
        self.radii = [np.zeros(words), np.zeros(words)]
        self.counts = np.zeros(words * words, np.int64)
        self.first = np.zeros(words * words, np.int64)
        self.parts = np.ones(words * words, np.int64)

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each row and its halves' distances to their codewords."""
        near, far = [], []
        for half, book in zip(self.halves(x), self.books):
            at = _nearest(half, book)
            near.append(at)
            far.append(np.sqrt(((half - book[at]) ** 2).sum(axis=1)) * (1 + SLACK))
        return near[0] * self.words + near[1], far

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half, the greatest and least score (rows, words) that any row
        under a codeword can have with each of ``x``."""
        upper, lower = [], []
        for half, book, radius in zip(self.halves(x), self.books, self.radii):
            length = np.sqrt((half ** 2).sum(axis=1))[:, None]
            near, spread = half @ book.T, length * radius
            room = SLACK * (length * np.sqrt((book ** 2).sum(axis=1)) + spread) + 1e-6
            upper.append(near + spread + room)
            lower.append(near - spread - room)
        return upper, lower

    def settle(self, cells: dict[int, int], radii: list[dict[int, float]], block: int) -> None:
        """Take the index's counts and radii; deal cells to blocks in cell order."""
        for half, found in zip(self.radii, radii):
            for word, radius in found.items():
                half[word] = radius
        at = held = 0
        for cell, n in sorted(cells.items()):
            self.counts[cell] = n
            if held and held + n > block:
                at, held = at + 1, 0
            self.first[cell], self.parts[cell] = at, -(-n // block)
            if n > block:
                at, held = at + int(self.parts[cell]), 0
            else:
                held += n


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book ** 2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


def _book(x: np.ndarray, words: int) -> np.ndarray:
    """Codewords of the rows by k-means."""
    draw = np.random.default_rng(SEED)
    book = x[draw.choice(len(x), words, replace=len(x) < words)].astype(float)
    for _ in range(ROUNDS):
        at = _nearest(x, book)
        n = np.bincount(at, minlength=words)
        sums = np.zeros_like(book)
        np.add.at(sums, at, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def visits(upper: list[np.ndarray], lower: list[np.ndarray]) -> Iterator[tuple[float, float, int]]:
    """One anchor's cells by descending sum of half-score bounds: (upper, lower,
    cell). The heap holds, per first word in order, its next second word."""
    order = [np.argsort(-u, kind="stable") for u in upper]
    first, second = (u[o].tolist() for u, o in zip(upper, order))
    low = [v[o].tolist() for v, o in zip(lower, order)]
    names = [o.tolist() for o in order]
    words = len(second)
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
        if j + 1 < words:
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        yield -bound, low[0][i] + low[1][j], names[0][i] * words + names[1][j]


def route(upper, lower, counts, windows: list[tuple[int, int, int]], needs: list[int] | None, probe: int) -> list[int]:
    """The cells an anchor visits for its ``windows`` (name, least, greatest
    score): without ``needs``, those of the first round; with the score each
    window needs, the others whose bounds can still reach one of them."""
    out, rows, least = [], 0, min(needs) if needs else None
    for high, low, cell in visits(upper, lower):
        if needs and rows >= probe and high < least:
            break
        if not needs and rows >= probe:
            break
        if not counts[cell] or not any(high >= a and low <= b for _, a, b in windows):
            continue
        if rows < probe:
            if not needs:
                out.append(cell)
        elif any(high >= need and low <= b for need, (_, _, b) in zip(needs, windows)):
            out.append(cell)
        rows += counts[cell]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; beyond a long its ends."""
    return _products(a, b).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same, in the narrowest type that holds every partial sum."""
    shared = min(a.shape[1], b.shape[1])
    a, b = a[:, :shared], b[:, :shared]
    most = max(abs(int(a.min(initial=0))), int(a.max(initial=0))) * max(abs(int(b.min(initial=0))), int(b.max(initial=0))) * shared
    for kind, ends in ((np.float32, EXACT_SHORT), (np.float64, EXACT)):
        if most < ends:
            return a.astype(kind) @ b.T.astype(kind)
    exact = a.astype(object) @ b.T.astype(object)
    return np.array([[min(max(int(x), ENDS[0]), ENDS[1]) for x in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


def _matrix(rows) -> np.ndarray:
    """Lists of whole numbers as a matrix, the shorter ones ending in zeros, in
    the narrowest type that holds them."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    for kind in (np.int16, np.int32):
        ends = np.iinfo(kind)
        if not out.size or (out.min() >= ends.min and out.max() <= ends.max):
            return out.astype(kind)
    return out


PACKED = ("block long, width int, kind string, vectors binary, lengths binary, labels binary, cells binary, ids array<long>, "
          "counts binary")


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.iloc[np.argsort([ids[0] for ids in rows["ids"]], kind="stable")]
    vectors = _matrix(rows["v"].to_list())
    return pd.DataFrame([{"block": key[0], "width": vectors.shape[1], "kind": vectors.dtype.str, "vectors": vectors.tobytes(),
                          "lengths": rows["v"].map(len).to_numpy(np.int64).tobytes(),
                          "labels": rows["label"].to_numpy(np.int64).tobytes(), "cells": rows["cell"].to_numpy(np.int64).tobytes(),
                          "ids": [x for ids in rows["ids"] for x in ids], "counts": rows["ids"].map(len).to_numpy(np.int64).tobytes()}])


def _longs(data: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(data, np.int64)
    return out if width is None else out.reshape(-1, width)


def _vectors(row) -> np.ndarray:
    return np.frombuffer(row.vectors, row.kind).reshape(len(_longs(row.labels)), row.width)


def _placed(rows: DataFrame, index: Index, name: str) -> DataFrame:
    """``rows`` (label, v, ids) with cell, far_1 and far_2."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at:at + BLOCK]
                x = np.zeros((len(part), index.width))
                for i, v in enumerate(part["v"]):
                    x[i, :len(v)] = v
                cell, far = index.place(x)
                yield part.assign(cell=cell, far_1=far[0], far_2=far[1])

    return written(rows.mapInPandas(run, "label long, v array<long>, ids array<long>, cell long, far_1 double, far_2 double"), name)


def _blocks(placed: DataFrame, first: np.ndarray, parts: np.ndarray, cells: dict[int, int], name: str) -> DataFrame:
    """``placed`` packed into one row per block."""
    spark = placed.sparkSession
    where = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in cells], "cell long, first long, parts long")
    dealt = placed.join(F.broadcast(where), "cell")   # a row per cell: bounded
    block = F.col("first") + F.pmod(F.xxhash64("label", "v"), F.col("parts"))
    return written(dealt.select(block.alias("block"), "label", "v", "ids", "cell").groupBy("block").applyInPandas(_pack, PACKED), name)


def _counted(placed: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}   # at most words squared


Windows = Callable[[int], tuple[int, int]]


def _ends(low: int, high: int) -> tuple[float, float]:
    """A window as bounds see it: at the ends of a long lies all beyond."""
    return -np.inf if low <= ENDS[0] else low, np.inf if high >= ENDS[1] else high


def _slots(n: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, least, greatest score) as three matrices with a row per
    anchor; places that are left over hold no score."""
    turn = np.arange(len(slots)) - np.searchsorted(slots[:, 0], slots[:, 0])
    most = int(turn.max(initial=0)) + 1
    name, least, greatest = np.zeros((n, most), np.int64), np.full((n, most), ENDS[1]), np.full((n, most), ENDS[0])
    for out, column in ((name, 1), (least, 2), (greatest, 3)):
        out[slots[:, 0], turn] = slots[:, column]
    return name, least, greatest


def reach(upper: list[np.ndarray], lower: list[np.ndarray], cells: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """(anchors, cells): whether a cell's bounds can still reach a score that one of the
    anchor's windows needs, as ``route`` finds cell by cell."""
    words = upper[1].shape[1]
    first, second = np.divmod(cells, words)
    high, low = upper[0][:, first] + upper[1][:, second], lower[0][:, first] + lower[1][:, second]
    out = np.zeros(high.shape, bool)
    for need, end in zip(least.T, greatest.T):
        some = need <= end
        need = np.where(need <= ENDS[0], -np.inf, need)[:, None]
        end = np.where(end >= ENDS[1], np.inf, end)[:, None]
        out |= (high >= need) & (low <= end) & some[:, None]
    return out


def _routes(index: Index, window: Windows, k: int, probe: int, per: int, second: bool):
    """Batches of anchors with their goals (and what the first round found) to
    the shelves they visit, with what is needed to score them there."""
    places = np.flatnonzero(index.counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                vectors, labels, lengths, ids = _vectors(row), _longs(row.labels), _longs(row.lengths), np.asarray(row.ids, np.int64)
                x = np.zeros((len(vectors), index.width))
                x[:, :vectors.shape[1]] = vectors
                upper, lower = index.bounds(x)
                found: dict[tuple, list] = {}
                for f in (row.found if second and row.found is not None else ()):
                    found.setdefault((f["anchor"], f["win"]), []).append(f["score"])
                goals = []
                for a, w in sorted({(g["anchor"], g["win"]) for g in row.goals}):
                    low, high = window(w)
                    if low <= high:
                        best = found.get((a, w), ())
                        goals.append((a, w, min(best) if len(best) >= k else low, high))
                slots = np.array(goals, np.int64).reshape(-1, 4)
                going: dict[int, list] = {}
                if second:
                    _, least, greatest = _slots(len(x), slots)
                    near = places[reach(upper, lower, places, least, greatest).any(axis=0)]
                    going = {shelf: [] for at in near for shelf in _shelves(index, at, per)}
                else:
                    asked: dict[int, list] = {}
                    for a, w, low, high in goals:
                        asked.setdefault(a, []).append((w, *_ends(low, high)))
                    for a, windows in asked.items():
                        for cell in route([u[a] for u in upper], [v[a] for v in lower], index.counts, windows, None, probe):
                            for shelf in _shelves(index, cell, per):
                                going.setdefault(shelf, []).append((a, cell))
                out: dict[tuple, dict] = {}
                for shelf, pairs in going.items():
                    there = np.unique(slots[:, 0]) if second else np.unique([a for a, _ in pairs])
                    mine = slots[np.isin(slots[:, 0], there)].copy()
                    mine[:, 0] = there.searchsorted(mine[:, 0])
                    visits = np.array([(there.searchsorted(a), c) for a, c in pairs], np.int64)
                    # All shelves of a second round share one row until they are dealt out.
                    to = out.setdefault(("all",) if second else (shelf,), {
                        "shelves": [], "batch": row.block, "anchors": there.tobytes(), "width": row.width, "kind": row.kind,
                        "vectors": vectors[there].tobytes(), "lengths": lengths[there].tobytes(), "labels": labels[there].tobytes(),
                        "own": ids[there].tobytes(), "visits": visits.tobytes(), "slots": mine.tobytes()})
                    to["shelves"].append(int(shelf))
                for at in range(0, len(out), 64):
                    yield pd.DataFrame(list(out.values())[at:at + 64])
    return run


def _shelves(index: Index, cell: int, per: int) -> range:
    return range(int(index.first[cell]) // per, (int(index.first[cell]) + int(index.parts[cell]) - 1) // per + 1)


ROUTED = ("shelves array<int>, batch long, anchors binary, width int, kind string, vectors binary, lengths binary, labels binary, "
          "own binary, visits binary, slots binary")
FOUND = "batch long, anchor int, anchor_id long, win long, score long, id long"


class _Best:
    """The k best rows so far of each window of a batch's anchors."""

    def __init__(self, row, k: int, same: bool):
        self.k, self.same = k, same
        self.vectors, self.lengths, self.labels, self.own = _vectors(row), _longs(row.lengths), _longs(row.labels), _longs(row.own)
        self.name, self.least, self.greatest = _slots(len(self.labels), _longs(row.slots, 4))
        self.kept = [np.zeros(0, np.int64)] * 3   # place of the window, score, id

    def add(self, block, seen: np.ndarray) -> None:
        """Take in a block's rows, whose cells each anchor has ``seen``."""
        who = np.flatnonzero(seen.any(axis=1))
        if not len(who):
            return
        scores = _products(self.vectors[who], block.vectors)
        fit = (self.labels[who][:, None] == block.labels) == self.same
        fit &= seen[who][:, block.at]
        least, greatest = _held(self.least[who], scores.dtype), _held(self.greatest[who], scores.dtype)
        fit &= (scores >= least.min(axis=1)[:, None]) & (scores <= greatest.max(axis=1)[:, None])
        hits = np.count_nonzero(fit)
        if not hits:
            return
        most, windows = self.k + 1, least.shape[1]   # the anchor's own row may be among them
        dense = hits > 4 * most * len(who) and scores.shape[1] > most
        if not dense:
            i, j = np.nonzero(fit)
            s = scores[i, j]
        new = [self.kept]
        for w in range(windows):
            if dense:
                some = fit & (scores >= least[:, w, None]) & (scores <= greatest[:, w, None])
                ends = np.where(some, scores, -np.inf if scores.dtype.kind == "f" else ENDS[0])
                some &= scores >= np.partition(ends, -most, axis=1)[:, -most, None]
                at, to = np.nonzero(some)
                score = scores[at, to]
            else:
                some = (s >= least[i, w]) & (s <= greatest[i, w])
                at, to, score = i[some], j[some], s[some]
            n = block.counts[to]
            turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, to, score = np.repeat(who[at], n), np.repeat(to, n), np.repeat(score.astype(np.int64), n)
            ids = block.ids[block.start[to] + turn]
            if self.same:
                keep = np.ones(len(ids), bool)
                for x in np.flatnonzero(ids == self.own[at]):
                    keep[x] = not (self.lengths[at[x]] == block.lengths[to[x]] and _equal(self.vectors[at[x]], block.vectors[to[x]]))
                at, score, ids = at[keep], score[keep], ids[keep]
            new.append([at * windows + w, score, ids])
        place, score, ids = (np.concatenate(x) for x in zip(*new))
        order = np.lexsort((ids, ~score, place))
        place, score, ids = place[order], score[order], ids[order]
        turn = np.arange(len(place)) - place.searchsorted(place)
        keep = turn < self.k
        self.kept = [place[keep], score[keep], ids[keep]]
        full = turn == self.k - 1
        self.least.reshape(-1)[place[full]] = np.maximum(self.least.reshape(-1)[place[full]], score[full])

    def rows(self, row) -> pd.DataFrame:
        place, score, ids = self.kept
        at = place // self.name.shape[1]
        return pd.DataFrame({"batch": row.batch, "anchor": _longs(row.anchors)[at].astype(np.int32), "anchor_id": self.own[at],
                             "win": self.name.reshape(-1)[place], "score": score, "id": ids})


class _Block:
    def __init__(self, row):
        self.vectors, self.lengths, self.labels = _vectors(row), _longs(row.lengths), _longs(row.labels)
        self.counts, self.ids = _longs(row.counts), np.asarray(row.ids, np.int64)
        self.start = np.cumsum(self.counts) - self.counts
        self.cells, self.at = np.unique(_longs(row.cells), return_inverse=True)


def _held(ends: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Ends of windows in the type of the scores; those beyond all scores stay so."""
    if kind.kind != "f":
        return ends
    most = int(EXACT if kind.itemsize == 8 else EXACT_SHORT)
    return np.clip(ends, -most, most).astype(kind)


def _scores(index: Index, k: int, same: bool, second: bool):
    """The k best rows of a shelf for each window of the anchors visiting it."""
    def run(visitors: pd.DataFrame, shelf: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = [_Block(row) for row in shelf.itertuples(index=False)] if len(visitors) else []
        for row in visitors.itertuples(index=False):
            best = _Best(row, k, same)
            if second:
                x = np.zeros((len(best.labels), index.width))
                x[:, :row.width] = best.vectors
                upper, lower = index.bounds(x)
            else:
                visits = _longs(row.visits, 2)
            for block in blocks:
                if second:
                    seen = reach(upper, lower, block.cells, best.least, best.greatest)
                else:
                    at = np.minimum(block.cells.searchsorted(visits[:, 1]), len(block.cells) - 1)
                    hit = block.cells[at] == visits[:, 1]
                    seen = np.zeros((len(best.labels), len(block.cells)), bool)
                    seen[visits[hit, 0], at[hit]] = True
                best.add(block, seen)
            out.append(best.rows(row))
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pd.concat(out) if out else pd.DataFrame(columns=names)
    return run


def _equal(a: np.ndarray, b: np.ndarray) -> bool:
    shared = min(len(a), len(b))
    return np.array_equal(a[:shared], b[:shared]) and not a[shared:].any() and not b[shared:].any()


def _kept(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("batch", "anchor", "win").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search(batches: DataFrame, goals: DataFrame, blocks: DataFrame, index: Index, window: Windows, k: int, same: bool,
            probe: int, name: str) -> DataFrame:
    """The k best rows of each window: (batch, anchor, anchor_id, win, score, id, rank)."""
    asked = goals.groupBy(col("batch").alias("block")).agg(F.collect_set(F.struct("anchor", "win")).alias("goals"))
    rows = written(batches.join(asked.hint("merge"), "block"), f"negatives-{name}-goals")
    # Whole shelves of blocks meet whole crates of batches, each dealt to the other's number.
    n_blocks, block_bytes = _weights(blocks)
    n_batches, batch_bytes = _weights(batches)
    per = max(1, min(SHELF // max(1, block_bytes), -(-n_blocks // TILES)))
    crate = max(1, CRATE // max(1, batch_bytes))
    crates, shelves = -(-n_batches // crate), -(-n_blocks // per)
    tasks = max(1, min(crates * shelves, MOST_TASKS))
    shelved = (blocks.withColumn("shelf", F.expr(f"block div {per}").cast("int"))
               .withColumn("crate", F.explode(F.sequence(F.lit(0), F.lit(max(0, crates - 1))))).repartition(tasks, "shelf", "crate"))

    def scored(anchors: DataFrame, second: bool) -> DataFrame:
        routed = (anchors.mapInPandas(_routes(index, window, k, probe, per, second), ROUTED)
                  .withColumn("crate", F.expr(f"batch div {crate}").cast("int"))
                  .withColumn("shelf", F.explode("shelves")).drop("shelves").repartition(tasks, "shelf", "crate"))
        return (routed.groupBy("shelf", "crate").cogroup(shelved.groupBy("shelf", "crate"))
                .applyInPandas(_scores(index, k, same, second), FOUND))

    first = written(_kept(scored(rows, False), k).drop("rank"), f"negatives-{name}-first")
    seen = first.groupBy(col("batch").alias("block")).agg(F.collect_list(F.struct("anchor", "win", "score")).alias("found"))
    return written(_kept(scored(rows.join(seen.hint("merge"), "block", "left"), True), k), f"negatives-{name}")


def _weights(packed: DataFrame) -> tuple[int, int]:
    """How many blocks there are, numbered from 0, and the bytes of the largest."""
    n, most = packed.agg(F.max("block") + 1, F.max(F.octet_length("vectors") + F.octet_length("cells") * 6)).first()
    return n or 0, most or 0


def mine(rows: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "vector", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, batch: int = BATCH,
         probe: int = PROBE, words: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows that ``anchor`` holds of; ``vector`` holds
    whole numbers."""
    keep = max(positives + 1, negatives)
    usable = rows.filter(col(id).isNotNull() & col(label).isNotNull() & col(vector).isNotNull()
                         & ~F.exists(col(vector), lambda x: x.isNull()))
    named = usable.select(col(id).cast("long").alias("id"), col(label).cast("long").alias("label"),
                          col(vector).cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    single = written(named.groupBy("id", "label", "v").agg(F.max("is_anchor").alias("is_anchor")), "negatives-rows")
    first_ids = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    classes = written(single.withColumn("at", first_ids).filter(F.col("at") <= keep).groupBy("label", "v")
                      .agg(F.array_sort(F.collect_list("id")).alias("ids")), "negatives-classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    words = words or min(MOST_WORDS, max(LEAST_WORDS, int(np.ceil(np.sqrt(n / block)))))
    # The least hashes are looked for below a bound that some four times as many lie under.
    want = SAMPLE * words
    bound = F.lit(min(ENDS[1], ENDS[0] + (4 * (want + 100) << 64) // max(1, n)))
    drawn = classes.filter(F.xxhash64("v") <= bound).orderBy(F.xxhash64("v"), "label").limit(want).select("v").collect()
    sample = np.zeros((max(1, len(drawn)), width or 0))
    for i, r in enumerate(drawn):
        sample[i, :len(r["v"])] = r["v"]
    index = Index(sample, words)

    placed = _placed(classes, index, "negatives-placed")
    cells = _counted(placed)
    radii = [{r[0]: r[1] for r in placed.groupBy(F.expr(side).alias("w")).agg(F.max(far).alias("r")).collect()}   # a row per codeword
             for side, far in ((f"cell div {words}", "far_1"), (f"cell % {words}", "far_2"))]
    index.settle(cells, radii, block)
    blocks = _blocks(placed, index.first, index.parts, cells, "negatives-blocks")

    # Anchors of a cell go together: they visit alike.
    asking = _placed(single.filter("is_anchor").select("label", "v", F.array("id").alias("ids")), index, "negatives-anchors")
    where = Index(sample[:, :0], words)
    asked = _counted(asking)
    where.settle(asked, [{}, {}], batch)
    batches = _blocks(asking, where.first, where.parts, asked, "negatives-batches")

    every = batches.select(col("block").alias("batch"), F.posexplode("ids").alias("anchor", "x"), F.lit(0).cast("long").alias("win"))
    near = _search(batches, every.drop("x"), blocks, index, lambda w: ENDS, positives, True, probe, "positives")
    goals = near.select("batch", "anchor", col("score").alias("win"))
    far = _search(batches, goals, blocks, index, lambda s: (-(-low * s // 100), high * s // 100), negatives, False, probe, "negatives")
    pairs = near.select("batch", "anchor", "anchor_id", col("id").alias("positive_id"), col("score").alias("win"))
    return pairs.join(far.drop("anchor_id").hint("merge"), ["batch", "anchor", "win"]).select(
        "anchor_id", "positive_id", "rank", col("id").alias("negative_id"), col("win").alias("positive_score"),
        col("score").alias("negative_score"))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where one is null or not finite."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def hard_negatives(rows: DataFrame, **options) -> DataFrame:
    """Hard negatives of an embeddings table, a seventh of its labels moved on;
    anchors are the rows whose id 50 divides."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    named = rows.select(col("vec_id").alias("id"), moved.alias("label"), quantised(col("embedding")).alias("vector"))
    return mine(named, F.col("id") % 50 == 0, **options)
