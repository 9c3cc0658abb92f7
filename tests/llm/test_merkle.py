"""The Merkle manifest against a plain recursive one."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyline.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text) -> str:
    return sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def climb(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and per leaf its (left, right) siblings level by level."""
    if len(nodes) <= 1:
        return (nodes or [""])[0], [[] for _ in nodes]
    parents, sides = [], []
    for at in range(0, len(nodes), arity):
        run = nodes[at:at + arity]
        parents.append(sha("".join(run)))
        sides += [("".join(run[:i]), "".join(run[i + 1:])) for i in range(len(run))]
    top, above = climb(parents, arity)
    return top, [[side, *above[i // arity]] for i, side in enumerate(sides)]


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, arity=16) -> list[tuple]:
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = climb([leaf(r, r.text) for r in groups[s]], arity)
    root, over = climb([trees[s][0] for s in order], arity)
    out = []
    for s, up in zip(order, over):
        for r, own in zip(groups[s], trees[s][1]):
            path, node = own + up, leaf(r, r.text)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                node = leaf(r, lower(r.text))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [16, 2, 3])
def test_awkward_rows(awkward, clashing, no_docs, arity):
    got = merkle.checked_documents(clashing, arity)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(awkward.collect(), arity)
    assert merkle.checked_documents(no_docs, arity).count() == 0


def test_many_rows_copies_and_groups(spark):
    """Several levels, a third of all rows equal, a group a row, one row alone."""
    rows = [(7, "Copy", "en", "hot", 4)] * 300 + [(i, f"Text {i}", None, "hot" if i % 2 else None, i) for i in range(500)]
    rows += [(i, "X", "en", f"single{i}", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = sorted((tuple(r) for r in merkle.checked_documents(docs).collect()), key=repr)
    assert got == brute(docs.collect()) and {r[-1] for r in got} == {True, False}
    lone = docs.limit(1)
    ((_, own, subroot, root, proof, _, _),) = [tuple(r) for r in merkle.checked_documents(lone).collect()]
    assert own == subroot == root and proof == sha("")


def test_proofs_show_every_tampering(spark):
    """The real outputs: steps fold to the root from the true leaf only."""
    rows = spark.createDataFrame([(i, f"v{i}", i % 3) for i in range(60)], "k long, v string, g int")
    made = merkle.manifest(rows, F.col("g"), F.col("k"), merkle.leaf(F.col("k"), F.col("v")), 4, key=F.col("k"), v=F.col("v"))
    changed = F.when(F.col("key") % 7 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v"))
    out = made.select("key", "root", merkle.folded(merkle.leaf(F.col("key"), changed), F.col("steps")).alias("got")).collect()
    assert len(out) == 60 and len({r.root for r in out}) == 1
    assert all((r.got == r.root) == (r.key % 7 != 0) for r in out)
