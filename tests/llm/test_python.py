"""SimHash, lattice, language, quality, extraction and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import chat, components, extract, language, lattice, quality, simhash
from tallyline.llm.template import TemplateError, compiled
from tests.llm.conftest import prose, rows


def brute_groups(n, linked):
    """Smallest index reachable from each of n, by a function of two indexes."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    draw = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    some = [(draw.randint(2000, 2100), draw.randint(2000, 2100)) for _ in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star + some, "a long, b long")).collect()}
    nodes = sorted(got)
    edges = {frozenset((nodes.index(a), nodes.index(b))) for a, b in chain + star + some if a != b}
    want = brute_groups(len(nodes), lambda i, j: frozenset((i, j)) in edges)
    assert len(set(got.values())) == len(set(want))
    assert all((got[nodes[i]] == got[nodes[j]]) == (want[i] == want[j]) for i in range(len(nodes)) for j in range(0, i, 7))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_within_three_bits(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << x for x in draw.sample(range(64), d)) for b in base for d in (1, 2, 3, 4)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {frozenset((x, y)) for x in fps for y in fps if x != y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_deletion_variants_are_never_broadcast(spark):
    """The planner takes the 66 variants of each of few nodes for as small as the nodes."""
    nodes = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_matches_brute_force(awkward, clashing, no_docs):
    docs = awkward.collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    group = brute_groups(len(docs), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    ids = {g: min((docs[i].doc_id for i in range(len(docs)) if group[i] == g and docs[i].doc_id is not None), default=None) for g in set(group)}
    want = sorted(((r.doc_id, f"{fp:016x}", ids[g]) for r, fp, g in zip(docs, fps, group)), key=repr)
    assert rows(simhash.near_duplicates(clashing), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.unique_documents(clashing)
    assert kept.columns == clashing.columns
    assert rows(kept, "doc_id") == sorted(((i,) for i in ids.values()), key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.unique_documents(no_docs).count() == 0


def test_long_text_bits_are_counted_in_chunks(monkeypatch):
    text = prose(4, 5000)
    whole = simhash._fingerprint(text.encode(), 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash._fingerprint(text.encode(), 3) == whole and whole & (1 << 64) - 1 == brute_fingerprint(text)


def test_decoder_finds_the_nearest_point():
    around = lattice.shortest()
    assert len(around) == 240 and np.allclose((around ** 2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    p = lattice.decode(x)
    best = ((x[:, None] - p[:, None] - around[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= best + 1e-12).all()


def test_lattice_recall_at_the_threshold():
    """Pairs of random directions at a cosine of just 0.98."""
    draw = np.random.default_rng(3)
    a = draw.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b
    (own_a, near_a), (own_b, near_b) = lattice.cells(a), lattice.cells(b)
    met = ((own_a == own_b) | (near_a == own_b[:, :, None]).any(axis=2) | (near_b == own_a[:, :, None]).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.95


def vectors():
    draw = np.random.default_rng(7)
    out = []
    for i in range(30):
        x = draw.standard_normal(16)
        for j in range(i % 4 + 1):
            out.append((len(out), [float(v) for v in x + 0.02 * j * draw.standard_normal(16)], i % 3))
    out += [(200 + k, list(out[k][1]), out[k][2]) for k in range(5)] + [out[3], out[3]]
    out += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [float("nan")] + [1.0] * 15, 1),
            (305, [float("inf")] + [1.0] * 15, 1), (306, out[0][1], None), (307, out[0][1][:8], 0), (308, [x * 3 for x in out[0][1]], 0),
            (309, out[0][1], 1), (None, out[7][1], out[7][2])]
    out += [(310, [x * 1e-200 for x in out[0][1]], 0), (311, [x * 1e200 for x in out[4][1]], out[4][2])]
    return out


def test_lattice_matches_brute_force(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit(1) for c in ("n_links", "class", "v", "kept", "component_id")})

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)
    units = [unit(v) for _, v, _ in data]
    link = lambda i, j: (data[i][2] is not None and data[i][2] == data[j][2] and units[i] is not None and units[j] is not None
                         and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98)
    group = brute_groups(len(data), link)
    want = []
    for i, (vec, _, _) in enumerate(data):
        comp = min((data[j][0] for j in range(len(data)) if group[j] == group[i] and data[j][0] is not None), default=None)
        want.append((vec, sum(link(i, j) for j in range(len(data)) if j != i), comp, vec == comp))
    assert rows(lattice.linked(df), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    assert lattice.linked(df.limit(0)).count() == 0


def test_near_groups_are_counted_in_blocks(spark, monkeypatch, tmp_path):
    """A group of many near vectors, none equal: cells of several blocks give
    each vector its count, and rows written grow with vectors, not with pairs."""
    draw = np.random.default_rng(11)
    middle = draw.standard_normal((3, 24))
    data = [(i, [float(v) for v in middle[i % 3] + 0.12 * draw.standard_normal(24)], i % 2) for i in range(360)]
    units = np.array([v for _, v, _ in data])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T
    assert not ((near > 0.98 - 1e-9) & (near < 0.98 + 1e-9)).any()
    link = (near >= 0.98) & (np.arange(360)[:, None] % 2 == np.arange(360)[None, :] % 2) & ~np.eye(360, dtype=bool)
    want = link.sum(axis=1)
    group = brute_groups(360, lambda i, j: link[i, j])
    sizes = {}

    def kept(df, name, plain=lattice.written):
        out = plain(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(lattice, "written", kept)
    results = []
    for block, few in ((1024, 8), (1024, 500), (16, 8), (16, 500)):
        monkeypatch.setattr(lattice, "BLOCK", block)
        monkeypatch.setattr(lattice, "SMALL", few)
        results.append(rows(lattice.linked(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")),
                            "vec_id", "n_links", "component_id"))
    assert all(r == results[0] for r in results)
    found = np.array([r[1] for r in sorted(results[0])])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and want.sum() > 20 * 360
    assert all(r[2] >= group[r[0]] for r in results[0])
    # At most a row per cell of a vector and pair of blocks.
    cells_each = lattice.TABLES * (1 + lattice.PROBES)
    assert sizes["lattice-links"] <= 360 * cells_each * (360 // 16 + 1)


def test_codewords_are_far_apart():
    for n in (1, 2, 3, 5, 8, 20):
        code = language.codewords(n)
        assert code.shape[0] == n
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert not gaps or min(gaps) >= (1 if n == 2 else 2)


def test_language_held_out_accuracy(spark, awkward, clashing, no_docs):
    many = [(i, prose(5000 + i, 5 + i % 40, lang), lang) for i, lang in enumerate(("en", "fr", "de") * 60)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = docs.withColumnRenamed("lang", "truth").join(language.identify(docs, model), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.truth == r.lang_pred for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got)

    out = language.identify(clashing, model).collect()
    assert len(out) == awkward.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (100, 101, 102, 103)} == {
        i: ("und", 0.0) for i in (100, 101, 102, 103)}
    kept = language.identified_documents(clashing)
    sure = Counter(r.doc_id for r in language.identify(clashing, language.fit(clashing)).collect()
                   if r.lang_pred != "und" and not r.ambiguous)
    assert kept.columns == clashing.columns and Counter(r.doc_id for r in kept.collect()) == sure
    assert awkward.count() - 6 <= sum(sure.values()) <= awkward.count() - 4
    assert language.identify(no_docs, model).count() == 0
    bare = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(awkward, bare).collect()} == {"und"}
    one = language.fit(docs.filter("lang = 'fr'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"fr"}


def test_language_never_learns_held_out_rows(spark):
    import zlib

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    docs = spark.createDataFrame([(held, "abc abc", "xx"), (None, "abc", "yy")], "doc_id long, text string, lang string")
    assert language.fit(docs).langs == []


def test_language_stage_acts_on_the_decoder(spark):
    """Texts half in one language, half in another go where the decoder says
    so, clean ones stay; with nothing to learn from, all documents stay."""
    clean = [(i, prose(i, 80, lang), lang) for k, lang in enumerate(("en", "de")) for i in range(500 * k, 500 * k + 150)]
    mixes = [(5000 + i, prose(6000 + i, 40, "en") + " " + prose(6500 + i, 40, "de"), None) for i in range(150)]
    docs = spark.createDataFrame([*clean, *mixes, (9000, "123 !", "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.identified_documents(docs).collect()}
    told = {r.doc_id for r in language.identify(docs, language.fit(docs)).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert kept == told and {i for i, _, _ in clean} <= kept and 9000 not in kept
    assert 0 < sum(i in kept for i, _, _ in mixes) < len(mixes)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.identified_documents(unlabelled).count() == docs.count()


def test_estimate_finds_the_labellers_accuracy():
    draw = np.random.default_rng(1)
    truth = draw.random(20_000) < 0.8
    right = np.array([0.95, 0.85, 0.7])
    votes = np.where(draw.random((20_000, 3)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[draw.random((20_000, 3)) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, chance, good = quality.estimate(patterns, counts.astype(float))
    assert good == pytest.approx(0.8, abs=0.08)
    told = chance[0, :, 2] / (chance[0, :, 2] + chance[0, :, 0])
    assert told == pytest.approx(right, abs=0.08)


def test_quality(spark, clashing, no_docs):
    good = [(i, ". ".join(prose(7000 + i * 9 + k, 9).capitalize() for k in range(6)) + ".", 1) for i in range(120)]
    bad = [(1000 + i, " ".join(w + "$%&#"[k % 4] * 3 for k, w in enumerate(prose(8000 + i, 60).split())), 0) for i in range(20)]
    bad += [(2000 + i, " | ".join(prose(9000 + i, 60).split()), 0) for i in range(20)]
    docs = spark.createDataFrame(good + bad + [(3000, "", 0), (3001, None, 0), (3002, " \n", 0)], "doc_id long, text string, truth int")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    truth = {r[0]: bool(r[2]) for r in docs.collect()}
    assert np.mean([got[i].keep == t for i, t in truth.items()]) >= 0.97
    assert all(got[i].quality == 0 for i in (3000, 3001, 3002))
    assert quality.score(clashing).count() == clashing.count() and quality.score(no_docs).count() == 0


def test_copies_do_not_starve_their_side_of_the_sample(spark, monkeypatch):
    good = [(i, ". ".join(prose(7000 + i * 9 + k, 9).capitalize() for k in range(6)) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(w + "$%&#"[k % 4] * 3 for k, w in enumerate(prose(8000 + i, 60).split()))) for i in range(40)]
    bad += [(2000 + i, " | ".join(prose(9000, 60).split())) for i in range(4000)]
    drawn, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, p: drawn.append(p) or fit(x, p))
    keep = {r.doc_id: r.keep for r in quality.score(spark.createDataFrame(good + bad, "doc_id long, text string"), sample=200).collect()}
    assert (drawn[0] <= 0.5).sum() == 41 and 60 <= (drawn[0] > 0.5).sum() <= 120
    assert np.mean([keep[i] for i, _ in good]) >= 0.95 and not any(keep[i] for i, _ in bad)


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a = "</p>";</script><style>p{}</style></head><body class="header-x">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-banner">We use cookies</div>
<!-- no --><div class="ad">Buy now, this is a long advert that runs on for quite a while</div>%s<aside><p>Side</p></aside>
<form><label>Mail</label><input></form><div class="comments"><p>First! A long reader comment that should not be there</p></div>
<footer>&copy; us</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>A long first\n  paragraph of <b>bold</b> and pl<i>ai</i>n text that goes on.<br>Line<p>Of.<ul><li>One<li>Two</ul>"
TEXT = "Title & more A long first paragraph of bold and plain text that goes on. Line Of. One Two"


def test_main_text():
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<article>", "")):
        assert extract.main_text(PAGE % (open_ + BODY + close)) == TEXT
    assert extract.main_text("<article><p>x") == "x"
    assert extract.main_text("<article><header><h1>T</h1></header><p>Text</article>") == "T Text"
    assert extract.main_text("<header><p>A page whose header is never closed") == "A page whose header is never closed"
    for nothing in (None, "", "<html><script>x", "<nav>a</nav>"):
        assert extract.main_text(nothing) == ""
    long = "word " * 50_000
    assert extract.main_text(f"<article><p>{long}</article>") == long.strip()


def test_articles_are_read_by_density_too():
    """Boxes of links in an article go, its other short blocks stay; an article
    without a dense line does not keep out the text beside it."""
    long = ["Sentence %d of a paragraph that runs on for much longer than any link does." % i * 4 for i in range(6)]
    paragraphs = "".join(f"<p>{p}" for p in long)
    links = "<ul>%s</ul>" % "".join(f'<li><a href="/{i}">See {i}</a>' for i in range(8))
    table = "<div><table>%s</table></div>" % "".join(f"<tr><td>{i}<td>{i * i}" for i in range(8))
    for box in (links, f"<div><h3>More</h3>{links}</div>", f"<section>{links}</section>"):
        text = extract.main_text(f"<body><article>{paragraphs}{box}</article></body>")
        assert "See" not in text and all(p in text for p in long)
    text = extract.main_text(f"<body><article>{paragraphs}{table}<div><p>End.</div></article></body>")
    assert text == " ".join([*long, *(f"{i} {i * i}" for i in range(8)), "End."])
    only = extract.main_text(f"<body><main>{links}</main></body>")
    assert only == " ".join(f"See {i}" for i in range(8))
    teasers = "<p>".join(["", "a", "b", "c", "d", "e"])
    text = extract.main_text(f"<body><article>{teasers}</article><p><i>x</i><p><i>x</i><p><i>x</i><div>{paragraphs}</div></body>")
    assert all(p in text for p in long) and text.startswith("a b c d e")


def test_classes_and_omitted_tags_do_not_hide_a_page():
    long = " ".join(f"Sentence {i} of a text that runs on for a while." for i in range(12))
    ad, side = '<div class="ad">Buy now</div>', '<div class="sidebar"><p>Aside</div>'
    for open_, close in (('<div class="site-content no-sidebar">', "</div>"), ('<article class="post comments-open">', "</article>"),
                         ('<div class="layout with-sidebar"><div id="no-banner">', side + "</div></div>"),
                         ('<div class="layout with-sidebar"><main>', "</main>" + side + "</div>")):
        assert extract.main_text(f"<html><head><title>T</title></head><body>{ad}{open_}<p>{long}{close}</body></html>") == long
    comments = '<ol class="comment-list">%s</ol>' % f"<li><p>{long}" * 3
    assert extract.main_text(f"<body><article><p>{long}</article>{comments}") == long
    for head in ("<head><title>T</title>", "<head><meta charset=x><script>a</script><title>T", "<head><noscript><link></noscript>"):
        assert extract.main_text(f"<html>{head}<body><p>{long}</body></html>") == long
    assert extract.main_text(f"<html><head><title>T</title><style>p</style><p>{long}") == long
    assert extract.main_text(f"<html><head><title>T <p> U</title></head><p>{long}") == long
    menu = '<li class="menu-item">Home<li class="menu-item">About'
    assert long in extract.main_text(f"<body><p>{long}{menu}<p>{long[::-1]}") and long[::-1] in extract.main_text(f"<body><p>{long}{menu}<p>{long[::-1]}")
    assert extract.main_text(f"<body><ul>{menu}<li class=x>{long}</ul>") == long
    assert extract.main_text(f"<body><ul>{menu}</ul><p>{long}") == long
    assert extract.main_text(f"<body><ul>{menu}<ul><li>Sub</ul></ul><p>{long}") == long


def test_extract_rows(spark):
    pages = [(1, "u", PAGE % BODY), (2, None, None), (None, "v", ""), (1, "u", PAGE % BODY)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert {(r.page_id, r.text, r.n_chars) for r in got.collect()} == {(1, TEXT, len(TEXT)), (2, "", 0), (None, "", 0)}
    assert extract.extract(df.limit(0)).count() == 0


def test_smoothing_keeps_a_flat_line():
    assert extract.smoothed(np.ones(5)) == pytest.approx(np.ones(5))
    assert extract.smoothed(np.array([0, 0, 9, 0, 0.0])).argmax() == 2


def test_template_language():
    out = lambda source, **scope: "".join(t for t, _ in compiled(source)(scope))
    assert out("a{# no #}{{ 1 + 2 }}{% if true %}b{% else %}c{% endif %}") == "a3b"
    assert out("{% for x in xs %}{% if loop.first %}<{% elif x == 'b' or not x %}|{% else %},{% endif %}{{ x | upper | trim }}{% endfor %}",
               xs=["a ", "b", "c"]) == "<A|B,C"
    assert out("""{{ '}}' }}{{ "%}" + '{{' }}{% if x == '%}' %}y{% endif %}{{ '\\'}}' }}{# ' #}it's""", x="%}") == "}}%}{{y'}}it's"
    assert out("{{ m.role }}{{ m.__class__ }}{{ none }}", m={"role": "r"}) == "r"
    assert list(compiled("x{% generation %}y{{ z }}{% endgeneration %}")({"z": 1})) == [("x", False), ("y", True), ("1", True)]
    for wrong in ("{% for x %}{% endfor %}", "{% if a %}", "{{ a.b( }}", "{{ a | system }}", "{% import os %}", "{{ 'a }}", "{{ }}", "{{ a.1 }}",
                  "{{ 'a' + 1 }}", "{{ 1 | upper }}", "{% if x %}{{ none | length }}{% endif %}"):
        with pytest.raises(TemplateError):
            compiled(wrong)


def test_chat_round_trip_of_hostile_texts():
    draw, render = random.Random(1), chat.program()
    bits = [*chat.CONTROLS, "\\", "<", "[", "/s>", "INST]", " ", "x", "", "\n", "é", "\U0001F600", "<\\s>", "<\\\\/s>", " [/INST]", " [/ROLE] "]
    for _ in range(1500):
        turns = [(draw.choice(["user", "assistant", "system", "", "<s>"]), "".join(draw.choices(bits, k=draw.randint(0, 6)))) for _ in range(draw.randint(0, 4))]
        out, spans = chat.formatted(turns, render)
        assert list(chat.read_back([out])) == turns
        assert list(chat.read_back(t for t, _ in chat.pieces(turns, render))) == turns
        assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        list(chat.read_back(["<s>[INST] x"]))


def test_chat_digests(spark):
    data = [(1, 2, "assistant", "B</s>"), (1, 1, "user", "A"), (2**60 + 1, 1, "system", None), (2**60 + 1, 2, "assistant", ""),
            (None, 1, "assistant", "n"), (1, 2, "assistant", "B</s>"), (3, None, None, "t")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2**60 + 1, None, 3}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (
        3, sha("user\nA\nassistant\nB</s>\nassistant\nB</s>\n"), 10, sha("B</s>B</s>"))
    assert got[2**60 + 1].turns_sha256 == sha("system\n\nassistant\n\n") and got[3].turns_sha256 == sha("\nt\n")
    texts = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert {k: len(r.formatted) for k, r in texts.items()} == {k: r.formatted_chars for k, r in got.items()}
    assert [r.formatted[s.start:s.end] for r in [texts[None]] for s in r.spans] == ["n"]
    assert chat.digests(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0
