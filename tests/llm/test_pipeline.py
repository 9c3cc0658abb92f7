"""The pipeline against its operators applied by hand, and awkward input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from tallyline.llm import decontaminate, language, mixing, sharding, simhash
from tests.llm.test_native import brute_contained, jump

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == [
        "op1_decontaminate", "op2_mix", "op3_simhash", "op4_lattice", "op5_language", "op6_quality", "op7_extract", "op8_chat",
        "op9_url_filter", "op10_shard", "op11_hard_negatives", "op12_bpe", "op13_merkle"]
    assert "pipeline" in names


def test_run_equals_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = corpus_pipeline.run(spark, SF)
    known = {r.doc_id for r in language.identify(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= language.CLEAR}
    first = docs.filter(docs.doc_id.isin(list(known)))
    lead = {r.component_id for r in simhash.near_duplicates(first).collect()}
    second = docs.filter(docs.doc_id.isin(list(lead)))
    dirty = {d for d, _, _ in brute_contained(second.collect(), items.collect())}
    assert dirty
    third = second.filter(~docs.doc_id.isin(list(dirty)))
    want = Counter({r.doc_id: r.passes for r in mixing.mix(third).collect() if r.passes})
    got = out.collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r.shard == jump(r.doc_id, 16) for r in got)
    assert set(out.columns) == {*docs.columns, "shard", "slot", "grown_shard"}


def test_stages_on_awkward_input(spark, clashing, no_docs):
    for docs in (clashing, no_docs):
        rows = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == docs.columns
    assert rows.count() == 0
    assert decontaminate and sharding
