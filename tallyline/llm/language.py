"""Language identification by error-correcting output codes.

Each language is a codeword of bits; one binary linear classifier per bit
learns it from hashed byte n-grams. A text's language is the codeword nearest
to the classifiers' margins: the sum of their logistic losses against the
word's bits, each weighted by the classifier's training accuracy. Wrong bits
are outvoted as in any error-correcting code. A text whose two nearest
codewords are almost equally near is flagged as ambiguous.

The classifiers are fitted in the driver on a bounded sample of labelled rows
(at most ``PER_LANGUAGE`` per language, by a hash of the id); prediction reads
every text whole, in Arrow batches.

Defined results: a null text or one without letters is ``und`` with score 0;
rows with a null id or language are never learned from; with no labelled rows
every text is ``und``; with one language every text with letters has it;
repeated rows are predicted alike; an empty table gives an empty table; other
columns are ignored (or kept, by ``identified_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import col, fresh

PER_LANGUAGE = 400    # learned rows of each language at most
FEATURES = 1 << 12    # hashed n-grams
GRAMS = (1, 2, 3)
CODE_BITS = 15        # bits of a codeword at most
STEPS = 200           # gradient steps
RIDGE = 1e-4
CLEAR = 0.6           # a lower score is ambiguous
CHUNK = 1 << 20       # bytes of a text looked at once

UNKNOWN = "und"


def _letters() -> np.ndarray:
    """What each byte counts as: lower-case letters, bytes of longer
    characters as they are, all else a space."""
    out = np.full(256, 32, dtype=np.uint64)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_TABLE = _letters()


def features(text: bytes) -> np.ndarray:
    """Square-rooted counts of the hashed n-grams of a whole text, of length 1."""
    counts = np.zeros(FEATURES)
    for at in range(0, len(text), CHUNK):
        b = _TABLE[np.frombuffer(text[at:at + CHUNK + max(GRAMS) - 1], dtype=np.uint8)]
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]   # one space for many
        gram = np.zeros(len(b), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(b) < n:
                break
            gram = gram[:len(b) - n + 1] * np.uint64(257) + b[n - 1:] + np.uint64(1)
            if n in GRAMS:
                mixed = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
                counts += np.bincount(mixed.astype(np.int64), minlength=FEATURES)
    counts = np.sqrt(counts)
    size = np.linalg.norm(counts)
    return counts / size if size else counts


def codewords(n: int, bits: int = CODE_BITS) -> np.ndarray:
    """n codewords of -1 and 1, far apart: all splits of the languages where
    they are few, else the best of many drawn codes."""
    if n <= 5:
        splits = np.arange(1, 1 << max(0, n - 1))
        return np.array([[1 if lang == n - 1 or not (s >> lang) & 1 else -1 for s in splits] for lang in range(n)]).reshape(n, len(splits))
    best, far = None, -1
    width = max(bits, 2 * int(np.ceil(np.log2(n))) + 5)
    draw = np.random.default_rng(0)
    for _ in range(500):
        code = draw.choice([-1, 1], size=(n, width))
        gap = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if gap > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, gap
    return best


class Model:
    """Languages, their codewords, and a linear classifier for each bit."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        n, bits = len(x), self.code.shape[1]
        want = self.code[y] if n else np.zeros((0, bits))
        self.w, self.b, pace = np.zeros((FEATURES, bits)), np.zeros(bits), 8.0
        # Rare languages weigh as much as frequent ones.
        row = 1.0 / np.bincount(y, minlength=len(langs))[y] / max(1, len(langs)) if n else np.zeros(0)
        vw, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(STEPS if n else 0):
            pull = want / (1 + np.exp(np.clip(want * (x @ self.w + self.b), -30, 30))) * row[:, None]
            vw = 0.9 * vw + x.T @ pull - RIDGE * self.w
            vb = 0.9 * vb + pull.sum(axis=0)
            self.w, self.b = self.w + pace * vw, self.b + pace * vb
        right = (np.sign(x @ self.w + self.b) == want).mean(axis=0) if n else np.ones(bits)
        self.trust = np.clip(right, 0.5, 1) - 0.5 + 1e-6

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its score, for each row."""
        if len(self.langs) == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = x @ self.w + self.b
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30)))
        near = -(loss * self.trust).sum(axis=2) / self.trust.sum() * self.code.shape[1]
        share = np.exp(near - near.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        return share.argmax(axis=1), share.max(axis=1)


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled rows outside the held-out fifth: those whose id hashes
    below a bound that leaves about ``per_language`` rows, then the first
    ``per_language`` of them by hash."""
    usable = docs.filter((learnable(col(doc_id)) != 0) & col(lang).isNotNull() & col(text).isNotNull())
    counts = usable.groupBy(col(lang).alias("lang")).agg(F.count("*").alias("n"))
    sides = {r["lang"]: r["n"] for r in counts.collect()}   # one row per language
    if not sides:
        return Model([], np.zeros((0, FEATURES)), np.zeros(0, dtype=int))
    langs = sorted(sides)
    mark = F.pmod(F.xxhash64(col(doc_id)), F.lit(1 << 30))
    bound = F.lit(0)
    for name in langs:
        bound = F.when(col(lang) == name, F.lit(min(1 << 30, int(1.2 * per_language / sides[name] * (1 << 30)) + 1))).otherwise(bound)
    drawn = usable.filter(mark < bound).select(col(lang).alias("lang"), mark.alias("mark"), col(text).cast("binary").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", F.xxhash64("text")))

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype("<f4").tobytes() for t in texts])

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    sample = (drawn.withColumn("turn", rank).filter(col("turn") <= per_language)
              .select("lang", "turn", F.pandas_udf(vectors, "binary")("text").alias("x")).collect())
    sample.sort(key=lambda r: (r["lang"], r["turn"]))
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in sample], dtype=float).reshape(-1, FEATURES)
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in sample], dtype=int))


def predicted(text: Column, model: Model) -> Column:
    """Struct (lang, score) for a text column."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None]
            if known and model.langs:
                for at in range(0, len(known), 1000):
                    some = known[at:at + 1000]
                    best, sure = model.predict(np.array([features(texts.iloc[i]) for i in some]))
                    lang[some], score[some] = [model.langs[k] for k in best], sure
            yield pd.DataFrame({"lang": lang, "score": score})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    lettered = F.when(text.rlike(r"\p{L}"), text.cast("binary"))
    return F.pandas_udf(run, "lang string, score double")(lettered)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""
    found = docs.select(col(doc_id), F.coalesce(learnable(col(doc_id)) == 0, F.lit(False)).alias("held_out"),
                        predicted(col(text), model).alias("found"))
    return found.select(col(doc_id), "held_out", col("found")["lang"].alias("lang_pred"), col("found")["score"].alias("score"),
                        ((col("found")["lang"] != UNKNOWN) & (col("found")["score"] < CLEAR)).alias("ambiguous"))


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language the decoder tells: texts without letters
    and ambiguous ones go. Where no language was learned, all stay."""
    model = fit(docs)
    if not model.langs:
        return docs
    (found,) = fresh(docs, "found")
    out = docs.withColumn(found, predicted(col("text"), model))
    return out.filter((col(found)["lang"] != UNKNOWN) & (col(found)["score"] >= CLEAR)).select(*[col(c) for c in docs.columns])
