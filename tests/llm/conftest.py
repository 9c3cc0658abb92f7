"""Small awkward tables the operators are tried on."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with names the operators use themselves.
CLASHES = {"shard": 7, "slot": "s", "size": 1.5, "target": "t", "fp": 3, "fingerprint": "f", "class": 1, "item": 2,
           "doc": 9, "words": "w", "hit": True, "found": 1, "passes": 4, "copy": 5, "text_hash": 6, "root": 8, "a": 1, "b": 2,
           "key": "k", "h": 1, "component_id": 11, "bucket": 3, "dropped": 2, "jumped": 4}


def prose(seed: int, n: int, lang: str = "en") -> str:
    draw = random.Random(f"{seed}-{lang}")
    parts = {"en": "the ing th er and on tion wh ed ly", "fr": "eau é è oi que en le aux ment ç", "de": "sch ung ß ü keit ver ein ö ge ch"}[lang].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rows = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(i, 40 + i, lang), lang, f"src{i % 4}", 1))
    rows += [(100, None, "en", "src0", None), (101, "", None, "src1", 0), (102, " \t\n ", "en", None, 3),
             (103, "12 34 %% !!", "en", None, 4), (104, "one", "en", "src9", 3), (105, "é\U0001F600 ß", None, "é", 4),
             (106, prose(1, 30_000), "en", "src0", 9), (107, prose(3, 43), "en", "\U0001F600", 1), (None, prose(8, 50), "en", "src2", 1),
             (108, prose(3, 43), "en", "src1", 1), (109, prose(3, 43).upper(), "en", "src1", 1)]
    return rows + [rows[5], rows[5], rows[-3]]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def items(spark):
    rows = [(0, " ".join(prose(1, 30_000).split()[5000:5030])), (1, prose(900, 30)), (2, None), (3, ""),
            (4, prose(6, 46).upper() + "!"), (5, "One."), (6, " ".join(prose(9, 49).split()[:20]) + " other words here now"), (6, prose(901, 12))]
    return spark.createDataFrame(rows, "item_id long, text string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
