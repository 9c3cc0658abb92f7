"""BPE against the tokenizers library, word for word and table for table."""

from __future__ import annotations

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.loaded(f.read())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_code_point(library, vocabulary):
    """Each code point beside, inside and after letters, in texts of many."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for step in (1, 64):
        for at in range(0, len(points), 20_000):
            some = points[at:at + 20_000]
            texts = [f"a{c}B {c}{c}" for c in some[::37]] if step == 1 else ["x".join(some[i:i + 64]) for i in range(0, len(some), 64)]
            want = library.encode_batch(texts, add_special_tokens=False)
            for text, w in zip(texts, want):
                assert vocabulary.encode(text).tolist() == w.ids, ascii(text)


def test_scan_and_heap_merge_alike(library, vocabulary):
    draw = random.Random(4)
    for _ in range(400):
        word = "".join(draw.choice("aaabcdeeinorst") for _ in range(draw.choice((1, 2, 5, 9, 30, 200, bpe.SHORT, bpe.SHORT + 1, 900))))
        start = [vocabulary.inner[ord(c)] for c in word[:-1]] + [vocabulary.final[ord(word[-1])]]
        done = []
        for merge in (bpe.scanned, bpe.queued):
            parts, bounds = list(start), list(range(len(word) + 1))
            merge(parts, bounds, vocabulary.ranks)
            done.append((parts, bounds))
            pieces = [word[a:b] for a, b in zip(bounds, bounds[1:])]
            assert [vocabulary.tokens[i].removesuffix("</w>") for i in parts] == pieces
        assert done[0] == done[1] and done[0][0] == ids(library, word)


def test_special_tokens_and_round_trip(library, vocabulary):
    for text in ("<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|endoftext", "<|EndOfText|>", "x <|endoftext|>'S  y", "<|endoftext|>ΑΣ İ"):
        got = vocabulary.encode(text).tolist()
        assert got == ids(library, text)
        assert vocabulary.decode(got) == library.decode(got, skip_special_tokens=False)
    assert vocabulary.decode([0, 10**6, -1]) == "!"


def test_seen_words_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "SEEN", 6)
    seen = bpe.Seen(vocabulary.encode_word)
    for i in range(20):
        assert seen["w" + "a" * i] == vocabulary.encode_word("w" + "a" * i)
        assert len(seen) <= 3 and len(seen.older) <= 3
    assert "w" + "a" * 100 not in seen and seen["w" + "a" * 100] and "w" + "a" * 100 not in seen


def test_other_files_are_refused():
    with open(PATH, "rb") as f:
        file = json.load(f)
    file["model"]["dropout"] = 0.1
    with pytest.raises(ValueError, match="word ends"):
        bpe.Vocabulary(json.dumps(file).encode())


def brute(library, rows):
    out = set()
    for r in rows:
        want = ids(library, r.text or "")
        text = library.decode(want, skip_special_tokens=False)
        out.add((r.doc_id, len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(),
                 hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_whole_tables(spark, library, awkward, clashing, no_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in queries.op12_bpe(spark, sf).collect()} == brute(library, docs.collect())
    got = bpe.digests(clashing, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == brute(library, awkward.collect()) and got.count() == awkward.count()
    assert bpe.digests(no_docs, PATH).count() == 0


def test_real_outputs(spark, library):
    docs = spark.createDataFrame([(1, "It's  the 1st"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit("x"))
    got = {r.doc_id: r for r in bpe.encoded(docs, PATH).collect()}
    assert got[1].ids == ids(library, "It's  the 1st") and got[1].decoded == "it</w> 's</w> the</w> 1</w> st</w>"
    assert got[2].ids == [] and got[2].decoded == ""
    codec = bpe.Codec(spark, PATH)
    lists = spark.createDataFrame([([0, None, 1],), (None,)], "ids array<int>")
    assert [r.t for r in lists.select(codec.decode(F.col("ids")).alias("t")).collect()] == ['! "', None]
