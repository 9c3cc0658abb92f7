"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. They overlap
and err, and nobody says how often: expectation-maximisation over the counts
of their vote patterns (all documents; at most 3 to the number of labellers
rows) estimates each labeller's accuracy and each pattern's posterior. The
posteriors of a bounded sample then train a linear scorer over hashed words
and character n-grams, which scores every document, also those on which no
labeller votes.

Defined results: a null or blank text is of quality 0 and not kept; repeated
rows score alike; with no documents, or none that any labeller votes on, the
prior decides; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import col

SAMPLE = 4000        # documents that train the scorer, about
FEATURES = 1 << 12
PRIOR_GOOD = 0.8     # start of the share of good documents
ROUNDS = 100         # of expectation-maximisation at most
BAD_VOTE = 4.0       # good votes that a bad vote outweighs at the start
PRIOR_WEIGHT = 0.01  # weight of the prior chances, as a share of all documents
START = ((0.02, 0.38, 0.6), (0.4, 0.4, 0.2))   # prior chances of votes (bad, none, good) on good and on bad documents
STEPS = 150
RIDGE = 1e-4
WORDS = 10           # words from which a text speaks for itself
KEEP = 0.5           # quality from which a document is kept


LABELLERS = ("signs", "sentences", "bars", "plain", "digits", "capitals", "long_words", "repeated_lines", "repeated_words")

_SIGNS = np.frombuffer(b"#$%&*@^~<>{}[]|\\=+_", dtype=np.uint8)
_PLAIN = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz .,\n", dtype=np.uint8)


def votes(text: bytes | None) -> str:
    """The labellers' votes, one sign each: + good, - bad, 0 none.

    They look at counts of bytes, words and lines of the whole text; shares are
    of characters (bytes that begin one) or of words.
    """
    text = text or b""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = max(1, int(n.sum() - n[128:192].sum()))
    words, lines = text.split(), text.split(b"\n")
    many = max(1, len(words))
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    signs, plain = n[_SIGNS].sum() / chars, n[_PLAIN].sum() / chars
    good_bad = (
        (signs < 0.005, signs > 0.04),
        (ends > 0 and 3 <= many / max(1, ends) <= 40, many > 30 and ends * 150 < many),
        (False, n[ord("|")] / many > 0.1),
        (plain > 0.85, many > 20 and plain < 0.6),
        (False, many > 20 and n[48:58].sum() / chars > 0.15),
        (False, chars > 40 and n[65:91].sum() / chars > 0.3),
        (False, chars > 40 and chars / many > 15),
        (False, len(lines) > 4 and len(set(lines)) * 2 < len(lines)),
        (False, many > 20 and len(set(words)) * 5 < many),
    )
    return "".join("-" if bad else "+" if good else "0" for good, bad in good_bad)


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern; each labeller's chances of its
    votes (bad, none, good) on good and on bad documents; the share of good
    ones. Votes are independent given the class. The start is a vote count in
    which a bad vote outweighs ``BAD_VOTE`` good ones, as good votes are
    given more freely."""
    votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)   # pattern, labeller, vote
    total = max(1.0, counts.sum())
    post = 1 / (1 + np.exp(-(votes[:, :, 2].sum(axis=1) - BAD_VOTE * votes[:, :, 0].sum(axis=1) + 0.5)))
    chance, good = np.zeros((2, patterns.shape[1], 3)), PRIOR_GOOD
    for _ in range(ROUNDS):
        for side, weight in ((0, counts * post), (1, counts * (1 - post))):
            seen = np.einsum("p,plv->lv", weight, votes) + PRIOR_WEIGHT * total * np.array(START[side])
            chance[side] = seen / seen.sum(axis=1, keepdims=True)
        good = float((counts @ post + PRIOR_WEIGHT * total * PRIOR_GOOD) / (counts.sum() + PRIOR_WEIGHT * total))
        log = np.einsum("plv,slv->ps", votes, np.log(chance)) + np.log([good, 1 - good])
        fresh = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
        moved = np.abs(fresh - post).max() if len(post) else 0.0
        post = fresh
        if moved < 1e-6:
            break
    return post, chance, good


_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(text: bytes) -> np.ndarray:
    """Square-rooted counts of hashed shapes of one to four signs, of length 1
    (a word counts as one sign, so that what is learned is how a text is
    written), and the shares of repeated words."""
    out = np.zeros(FEATURES)
    words = text.split()
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    rare = 1 - len(set(words)) / max(1, len(words))
    for at in range(0, len(text), 1 << 20):
        b = np.frombuffer(text[at:at + (1 << 20) + 3], dtype=np.uint8).astype(np.uint64)
        if not len(b):
            break
        shape = np.where(_WORDY[b], np.uint64(97), b)
        shape = shape[np.concatenate(([True], (shape[1:] != shape[:-1]) | (shape[1:] != 97)))]   # a word is one sign
        gram = np.zeros(len(shape), dtype=np.uint64)
        for n in range(1, 5):
            if len(shape) < n:
                break
            gram = gram[:len(shape) - n + 1] * np.uint64(257) + shape[n - 1:] + np.uint64(1)
            out += np.bincount(((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    out = np.sqrt(out)
    size = np.linalg.norm(out)
    out = out / size if size else out
    out[0], out[1] = again, rare * rare
    return out


def fit(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors (soft labels), both classes of equal weight."""
    w, b = np.zeros(FEATURES), 0.0
    if not len(x):
        return w, float(np.log(PRIOR_GOOD / (1 - PRIOR_GOOD)))
    side = good > 0.5
    rows = np.where(side, 0.5 / max(1, side.sum()), 0.5 / max(1, (~side).sum()))
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(STEPS):
        pull = (good - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) * rows
        vw, vb = 0.9 * vw + x.T @ pull - RIDGE * w, 0.9 * vb + pull.sum()
        w, b = w + 8.0 * vw, b + 8.0 * vb
    return w, float(b)


def _vote_column(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([votes(t) for t in texts], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text.cast("binary"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, quality, keep) of every row. The posterior is null
    where no labeller votes; the quality is the trained scorer's."""
    rows = docs.select(col(doc_id).alias("doc"), col(text).alias("text"))
    texts = rows.groupBy(F.xxhash64("text").alias("h"), col("text").isNotNull().alias("told"), _vote_column(col("text")).alias("pattern")).agg(F.count("*").alias("n"))
    counted = texts.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.when(col("told"), 1)).alias("texts")).collect()   # at most 3^labellers rows
    counted.sort(key=lambda r: r["pattern"])
    signs = np.array([["-0+".index(c) - 1 for c in r["pattern"]] for r in counted], dtype=int).reshape(-1, len(LABELLERS))
    n = np.array([r["n"] for r in counted], dtype=float)
    post, _, prior = estimate(signs, n)
    posterior = {r["pattern"]: (float(p) if (s != 0).any() else None) for r, p, s in zip(counted, post, signs)}

    # About half of the sample from either side, by a hash of the text; copies
    # of one text are counted and drawn once, or a group of copies would fill
    # the sample or leave its side without one.
    sides = {True: 0.0, False: 0.0}
    for r in counted:
        if posterior[r["pattern"]] is not None:
            sides[posterior[r["pattern"]] > 0.5] += r["texts"]
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    bound = {side: min(1 << 30, int(sample / 2 / max(1.0, size) * (1 << 30)) + 1) for side, size in sides.items()}

    def drawn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for marks, texts in batches:
            told = [posterior.get(votes(t)) for t in texts]
            yield pd.Series(pd.array([p if p is not None and at < bound[p > 0.5] else None for p, at in zip(told, marks)], dtype="Float64"))

    drawn.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype("<f4").tobytes() for t in texts], dtype="object")

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # The side is known before the shuffle: a side taken whole does not move the other's texts.
    few = (rows.filter(col("text").isNotNull() & (mark < max(bound.values())))
           .withColumn("p", F.pandas_udf(drawn, "double")(mark, col("text").cast("binary"))).filter(col("p").isNotNull())
           .groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("text", "p")).alias("one"))
           .select("h", col("one")["p"].alias("p"), F.pandas_udf(vectors, "binary")(col("one")["text"].cast("binary")).alias("x")).collect())
    few.sort(key=lambda r: r["h"])
    x = np.array([np.frombuffer(r["x"], dtype="<f4") for r in few], dtype=float).reshape(-1, FEATURES)
    lean = float(np.log(prior / (1 - prior)))
    w, b = fit(x, np.array([r["p"] for r in few], dtype=float))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            told = [min(1.0, len(t.split()) / WORDS) if t else 0.0 for t in texts]
            # Few words say little: the prior speaks for the rest.
            margin = [s * (features(t) @ w + b) + (1 - s) * lean if s else -np.inf for s, t in zip(told, texts)]
            yield pd.DataFrame({"posterior": pd.array([posterior[votes(t)] for t in texts], dtype="Float64"),
                                "quality": [0.0 if m == -np.inf else float(1 / (1 + np.exp(-np.clip(m, -30, 30)))) for m in margin]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = rows.select("doc", F.pandas_udf(run, "posterior double, quality double")(col("text").cast("binary")).alias("s"))
    return scored.select(col("doc").alias(doc_id), col("s")["posterior"].alias("posterior"), col("s")["quality"].alias("quality"),
                         (col("s")["quality"] >= KEEP).alias("keep"))
