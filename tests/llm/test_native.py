"""Sharding, mixing, decontamination and URL rules against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, mixing, sharding, urls
from tests.llm.conftest import rows

MASK = (1 << 64) - 1


def jump(key: int, shards: int) -> int:
    b, j, key = -1, 0, key & MASK
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & MASK
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 64, 65, 5000])
def test_jump_matches_the_loop(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 12345678901, *range(40, 90)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), shards)["at"].alias("s"))
    assert {r.k: r.s for r in got.collect()} == {k: jump(k, shards) for k in keys}


def test_sharded_documents(awkward):
    got = sharding.sharded_documents(awkward).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17))
                   for r in awkward.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_keeps_columns_and_takes_empty_tables(clashing, no_docs):
    out = sharding.assign(clashing, "doc_id", 4)
    assert set(out.columns) == set(clashing.columns) | {"grown_shard"} and out.count() == clashing.count()
    assert sharding.sharded_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(clashing, "doc_id", 0)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mix(docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += size_of(r.text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left, total = budget - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total >= 2 * sizes[s]}
        if not over:
            target.update({s: weight[s] * left / total for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        open_ -= over
    copies = []
    for s in order:
        mine = sorted((hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, size_of(r.text))
                      for r in docs if r.source == s)
        end = 0
        for turn in (0, 1):
            for _, doc, n in mine:
                end += n
                if n and target[s]:
                    copies.append((end / target[s], order.index(s), doc, n))
    taken, total = Counter(), 0
    for _, s, doc, n in sorted(copies):
        total += n
        if total > budget:
            break
        taken[doc, order[s]] += n
    return sizes, target, taken


def test_mix_matches_brute_force(awkward):
    docs = awkward.collect()
    sizes, target, taken = brute_mix(docs)
    got = mixing.mix(awkward).collect()
    assert len(got) == len(docs)
    again = Counter()
    for r in got:
        assert r["size"] * 2 >= r.taken and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        again[-1 if r.doc_id is None else r.doc_id, r.source] += r.taken
    assert {k: v for k, v in again.items() if v} == dict(taken)
    assert sum(again.values()) <= 1.5 * sum(sizes.values())


def test_mixed_documents_keep_columns(clashing, no_docs):
    plan = {(r.doc_id, r.source): r.passes for r in mixing.mix(clashing).collect()}
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    unique = Counter((r.doc_id, r.source) for r in clashing.collect())
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert all(got[k] == plan[k] for k, n in unique.items() if n == 1)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mix_of_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert rows(mixing.mix(docs), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0)]


def brute_contained(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for item in items:
        q = words(item.text)
        k = min(5, len(q))
        if not q:
            continue
        want = {tuple(q[i:i + k]) for i in range(len(q) - k + 1)}
        for d in docs:
            w = words(d.text)
            share = len(want & {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) / len(want)
            if share >= 0.8 - 1e-9:
                out.add((d.doc_id, item.item_id, round(share, 9)))
    return out


def test_contained_matches_brute_force(awkward, clashing, items):
    want = brute_contained(awkward.collect(), items.collect())
    assert {i for _, i, _ in want} >= {0, 4, 5}
    for docs in (awkward, clashing):
        got = decontaminate.contained(docs, items)
        assert {(r.doc_id, r.item_id, round(r.containment, 9)) for r in got.collect()} == want
    clean = decontaminate.clean_documents(clashing, items)
    dirty = {d for d, _, _ in want}
    assert clean.columns == clashing.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in awkward.collect() if r.doc_id not in dirty)


def test_large_index_leaves_documents_unbroadcast(spark, awkward, items, monkeypatch):
    """The planner takes the shingles of few documents for as small as the documents."""
    index = spark.range(100).select(F.xxhash64("id").alias("h"), F.col("id").alias("class"))
    grams = spark.range(50).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("h"))

    def plan():
        return grams.join(decontaminate._sized(index), "h")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    want = rows(decontaminate.contained(awkward, items), "doc_id", "item_id", "n_shingles", "n_found")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    assert rows(decontaminate.contained(awkward, items), "doc_id", "item_id", "n_shingles", "n_found") == want and want


def test_contained_without_rows(spark, awkward, no_docs, items):
    none = spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string")
    for docs, tests in ((no_docs, items), (awkward, none), (awkward, none.limit(0))):
        assert decontaminate.contained(docs, tests).count() == 0
    assert decontaminate.clean_documents(awkward, none).count() == awkward.count()


def test_partly_held_items(spark):
    """The threshold is on distinct shingles of the item, to the shingle."""
    item = [f"w{i}" for i in range(24)]                       # 20 shingles
    docs = [(cut, " ".join(item[:cut]) + " end") for cut in range(14, 25)]
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert rows(got, "doc_id", "n_found") == [(cut, cut - 4) for cut in range(20, 25)]


URLS = [
    ("http://A.Example.ORG/en/12?x=1", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("https://example.org/es", "example.org", "/es", "org/", "allow"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/de/a?b#c", "x.com", "/de/a", "com/de/", "block"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://x.org?q=/a", "x.org", "", None, "allow"),
    ("x.com/de/", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert urls.judge(pages.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    """Pages beside blocked ones of the same template are blocked; a branch
    that differs keeps its own verdict; many rare names are one wildcard."""
    pages = [("h", f"/spam/{w}", "block" if i < 30 else None) for i, w in enumerate(f"n{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    pages += [("h", f"/good/{i}", "allow" if i < 30 else None) for i in range(60)]
    forms = spark.createDataFrame(pages, "host string, path string, label string").withColumn("form", urls.path_form(F.col("path")))
    got = {r.form: (r.template, r.verdict) for r in urls.templates(forms.select("host", "form", "label")).collect()}
    assert got["/good/*"] == ("/good/*", "allow")
    assert {v for k, v in got.items() if k.startswith("/spam/")} == {("/spam/*", "block")}


def test_unlabelled_branches_take_the_share_above(spark):
    """A template without labels has the share of the branches around it; one
    label does not count at every level."""
    pages = [("bad", "/a/1", "block")] * 30 + [("bad", "/b/1", None), ("bad", "/b/c/x", None), ("bad", "/", None)]
    pages += [("mixed", "/a/1", "block")] * 30 + [("mixed", "/b/1", "allow")] * 30 + [("mixed", "/c/1", None), ("mixed", "/a/x", None)]
    pages += [("few", "/a/b/1", "block")] * 2 + [("none", "/a/1", None)]
    forms = spark.createDataFrame(pages, "host string, path string, label string").withColumn("form", urls.path_form(F.col("path")))
    got = {(r.host, r.form): r.verdict for r in urls.templates(forms.select("host", "form", "label")).collect()}
    assert got == {("bad", "/a/*"): "block", ("bad", "/b/*"): "block", ("bad", "/b/c/x"): "block", ("bad", "/"): "block",
                   ("mixed", "/a/*"): "block", ("mixed", "/b/*"): "allow", ("mixed", "/c/*"): "allow", ("mixed", "/a/x"): "block",
                   ("few", "/a/b/*"): "allow", ("none", "/a/*"): "allow"}


def _names(n: int) -> list[str]:
    return [f"n{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n)]


def test_wildcards_below_wildcards(spark):
    """Children are counted under the generalised path: names with few slugs
    each make one template together, at any depth; frequent children stay."""
    names = _names(40)
    pages = [("h", f"/user/{a}/{b}/edit") for i, a in enumerate(names) for b in names[i:i + 2]]
    pages += [("h", f"/lang/{'en' if i % 2 else 'fr'}/{a}") for i, a in enumerate(names)] + [("h", "/user"), ("h", "/"), ("k", "/user/n/x/edit")]
    forms = spark.createDataFrame(pages, "host string, form string").groupBy("host", "form").agg(F.count("*").alias("pages"))
    out = urls.generalised(forms).collect()
    assert len(out) == forms.count()
    got = {(r.host, r.form): "/".join(r.parts) for r in out}
    assert {got["h", f"/user/{a}/{b}/edit"] for i, a in enumerate(names) for b in names[i:i + 2]} == {"user/*/*/edit"}
    assert {got[h, f] for h, f in pages if f.startswith("/lang/")} == {"lang/en/*", "lang/fr/*"}
    assert (got["h", "/user"], got["h", "/"], got["k", "/user/n/x/edit"]) == ("user", "", "user/n/x/edit")


def test_url_sql_follows_the_same_law(spark):
    """A table on which the method itself blocks: pages without a rule on hosts
    whose labels are mostly blocked, nested variable segments, ties of labels."""
    import duckdb

    from tallyline.llm.sql import JUDGED

    names = _names(45)
    urls_ = [f"http://a.com/de/{a}" for a in names] + [f"http://a.com/{a}/{b}" for i, a in enumerate(names) for b in names[i:i + 2]]
    urls_ += [f"http://b.com/de/{i}" for i in range(30)] + [f"http://b.com/fr/{i}" for i in range(30)] + [f"http://b.com/{a}" for a in names]
    urls_ += [f"http://{h}.example.org/{p}/{i}" for h in "xyz" for p in ("es", "en", "de") for i in range(h == "x" and 3 or 20)]
    urls_ += [f"http://c.com/de/{a}/{i}" for i in range(3) for a in names[:20]] + ["http://c.com/", "http://c.com/shop/x/y/z?q", "http://net/de/1"]
    urls_ += [u for u, *_ in URLS]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls_)))
    assert got == set(con.execute(JUDGED).fetchall()) and len(got) == len(urls_)
    method = {v: sum(r[3] is None and r[4] == v for r in got) for v in ("allow", "block")}
    assert method["block"] >= 50 and method["allow"] >= 50
