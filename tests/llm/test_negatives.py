"""Hard negatives against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import common, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows) -> list[tuple]:
    """The contract by comparing every anchor with every row."""
    kept = set()
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        q = tuple(min(max(math.floor(256 * float(np.float32(x))), -2**63), 2**63 - 1) for x in v)
        kept.add((r["vec_id"], label, q))

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -2**63), 2**63 - 1)

    out = []
    for a in kept:
        if a[0] % 50:
            continue
        scored = sorted(((-score(a[2], b[2]), b[0], b[1]) for b in kept if b != a))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a[0], p, i + 1, x[1], -s, -x[0]) for i, x in enumerate(fit)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def got(df, **options) -> list[tuple]:
    out = negatives.hard_negatives(df, **options)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def cloud(n: int, d: int, groups: int, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, d)) / math.sqrt(d)
    at = draw.integers(0, groups, n)
    x = centres[at] + draw.standard_normal((n, d)) * 0.08
    return [(i, [float(f) for f in np.float32(v)], int(draw.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("options", [{}, {"block": 40, "batch": 3, "probe": 30, "words": 5}])
def test_clusters(spark, options):
    """Grouped vectors, so that cells are cut off; whole table in one block or many."""
    data = cloud(700, 12, 9, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute([dict(zip(("vec_id", "embedding", "label"), r)) for r in data])
    assert len(want) > 100 and got(df, **options) == want


def test_many_shelves_and_crates(spark, monkeypatch):
    """Each block a shelf and each batch a crate, so that every window is put together from many tasks."""
    monkeypatch.setattr(negatives, "SHELF", 1)
    monkeypatch.setattr(negatives, "CRATE", 1)
    data = cloud(300, 12, 5, 2)
    data += [(1000 + i, data[i % 7][1], data[i % 7][2]) for i in range(40)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute([dict(zip(("vec_id", "embedding", "label"), r)) for r in data])
    assert want and got(df, block=30, batch=2, probe=20, words=4) == want


def test_searches_broadcast_nothing(spark, monkeypatch):
    """The planner takes routed anchors for as small as the batches they come from."""
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.written(df, name)

    monkeypatch.setattr(negatives, "written", written)
    out = negatives.hard_negatives(spark.createDataFrame(cloud(300, 12, 5, 2), SCHEMA))
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    searches = [n for n in plans if n == "out" or n.startswith(("negatives-positives", "negatives-negatives"))]
    assert len(searches) == 7 and not [n for n in searches if "Broadcast" in plans[n]]


def test_reach_is_the_second_round_of_route():
    draw = np.random.default_rng(6)
    x = np.round(draw.standard_normal((500, 6)) * 40)
    index = negatives.Index(x[:100], 5)
    cell, far = index.place(x)
    radii = [{int(w): far[h][at == w].max() for w in set(at)} for h, at in enumerate((cell // 5, cell % 5))]
    index.settle({int(c): int((cell == c).sum()) for c in set(cell)}, radii, 50)
    upper, lower = index.bounds(x[:30])
    cells, cut = np.flatnonzero(index.counts), 0
    for a in range(30):
        windows = [(0, 4000, 90000), (1, 6000, 20000)]
        needs = [int(draw.integers(4000, 90000)), int(draw.integers(6000, 20000))]
        up, low = [u[a] for u in upper], [v[a] for v in lower]
        want = {c for c in negatives.route(up, low, index.counts, windows, needs, 0)}
        least, greatest = np.array([needs]), np.array([[90000, 20000]])
        seen = negatives.reach([u[a:a + 1] for u in upper], [v[a:a + 1] for v in lower], cells, least, greatest)[0]
        assert set(cells[seen].tolist()) == want
        cut += len(want) < len(cells)
    assert cut


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5, 0.5], 1), (50, [0.5, 0.5], 1), (100, [], 1), (150, [0.0, 0.0], 2), (200, [-0.5, -0.25], 1), (250, [3e38, 3e38], 3)]
    data += [(i, [0.5, 0.5], 1) for i in range(300, 320)] + [(i, [0.4, 0.4], 2) for i in range(400, 420)]
    data += [(i, [0.45, 0.35, 0.1], 3) for i in range(500, 505)] + [(i, [-0.3], 1) for i in range(600, 605)]
    data += [(None, [0.4, 0.4], 2), (700, None, 2), (701, [0.4, 0.4], None), (702, [nan, 0.4], 2), (703, [0.4, inf], 2), (704, [None, 0.4], 2)]
    data += [(250, [3e38, 3e38], 3), (50, [0.5, 0.5], 1), (50, [0.5, 0.25], 1), (705, [3e38, 1e38], 3), (706, [1e38, 1e38], 4)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = brute([dict(zip(("vec_id", "embedding", "label"), r)) for r in data])
    clashing = df.withColumns({k: F.lit(v) for k, v in {"id": 1, "v": "x", "ids": 2, "cell": 3, "block": 4, "win": 5, "n": 6, "at": 7}.items()})
    assert want and got(clashing) == want == got(df, block=4, batch=1, probe=1, words=3)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id is null or label is null")) == []
    assert got(spark.createDataFrame([(50, [0.5], 1)], SCHEMA)) == []


def test_heap_goes_down_the_bounds():
    """Cells come once each, by descending bound, and bounds hold for their rows."""
    draw = np.random.default_rng(5)
    x = np.round(draw.standard_normal((400, 7)) * 50)
    index = negatives.Index(x[:100], 6)
    cell, far = index.place(x)
    radii = [{int(w): far[h][at == w].max() for w in set(at)} for h, at in enumerate((cell // 6, cell % 6))]
    index.settle({int(c): int((cell == c).sum()) for c in set(cell)}, radii, 50)
    upper, lower = index.bounds(x[:20])
    for a in range(20):
        walk = list(negatives.visits([u[a] for u in upper], [v[a] for v in lower]))
        highs = [w[0] for w in walk]
        assert highs == sorted(highs, reverse=True) and sorted(w[2] for w in walk) == list(range(36))
        ends = {c: (low, high) for high, low, c in walk}
        for row, c in zip(x, cell):
            assert ends[c][0] <= x[a] @ row <= ends[c][1]


def test_second_round_stops_where_windows_are_certified():
    upper, lower = [np.array([10.0, 5.0, 1.0]), np.array([10.0, 5.0, 1.0])], [np.array([8.0, 3.0, 0.0]), np.array([8.0, 3.0, 0.0])]
    counts = np.full(9, 10)
    window = [(0, 2, 100)]
    first = negatives.route(upper, lower, counts, window, None, 15)
    assert first == [0, 1]
    assert negatives.route(upper, lower, counts, window, [12], 15) == [3]
    assert sorted(first + negatives.route(upper, lower, counts, window, [2], 15)) == list(range(9))
    # Cells that lie above the window are passed by.
    assert negatives.route(upper, lower, counts, [(0, 2, 9)], None, 15) == [2, 6]


def test_products_are_exact():
    a = np.array([[2**40, 3], [2**62, 2**62]])
    assert negatives.products(a, a).tolist() == [[min(2**80 + 9, 2**63 - 1), 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    assert negatives.products(np.array([[2**31, -1]]), np.array([[2**31 - 1, 5, 7]])).tolist() == [[2**31 * (2**31 - 1) - 5]]
