"""Byte-pair encoding and decoding with a public vocabulary file.

The file is the tokenizers library's JSON: a byte-level BPE whose words end in
a suffix. Text between special tokens is normalised (NFC, lower case per code
point), cut into words by the file's pattern, and each word is encoded by a
contiguous rank array: the boundaries of its parts and the rank of every
adjacent pair are held in two lists; the least rank is looked up by scanning,
its boundary is deleted and the ranks of its two neighbours are refreshed.
Scanning is quadratic in the word, so words over ``SHORT`` parts take their
minima from a heap instead (same merges, in the same order).

Spark deals the rows; a worker holds the vocabulary and the words it has
seen last (at most ``SEEN``), one batch of texts and one text's ids. Nothing is
shuffled. The driver reads the file and broadcasts it: its size does not
depend on the data.

Defined results: a null or empty text has no ids and decodes to the empty
text; special tokens inside a text are their ids, as in the library; nothing
is cut off; equal rows have equal results; an empty table gives an empty
table; other columns are ignored. Ids outside the vocabulary and null ids
decode to nothing; a null list of ids decodes to null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyline.llm.common import col

SHORT = 256          # parts of a word that are scanned; longer words use a heap
SEEN = 500_000       # words whose ids a worker remembers
SEEN_CHARS = 64      # longer words are not remembered
LIST_CHARS = 1 << 20  # longer texts are cut into words one at a time
SLICE = 4 << 20      # bytes of text whose results a worker holds at once
NONE = 1 << 62       # the rank of a pair that never merges
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1

# Steps of the file that this module carries out.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# Unicode white space.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where printable in
    Latin-1, else the next unused code point from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def library_words(text: str, pattern: str) -> list[str]:
    """The words of a text with signs newer than Python's Unicode tables:
    normalised and cut by the library, whose tables decide what a letter is."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
    cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(normal)
    return [word for word, _ in cut]


class Seen(dict):
    """Ids of words, computed when missing. Two generations: when the younger
    is full it becomes the older, whose words are taken over as they recur."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= SEEN_CHARS:
            if 2 * len(self) >= SEEN:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A vocabulary file, ready to encode and decode."""

    def __init__(self, source: bytes):
        file = json.loads(source)
        model, cut = file["model"], file["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
                or model.get("ignore_merges") or model.get("dropout") or file.get("decoder")
                or file["normalizer"].get("normalizers") != NORMALISERS or cut[1:] != [BYTES]
                or (cut[0]["type"], cut[0]["behavior"], cut[0]["invert"]) != ("Split", "Removed", True)):
            raise ValueError("not a byte-level BPE file with word ends")
        for t in file["added_tokens"]:
            if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        # By pair of ids: the rank, and below it the id of what the pair becomes.
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {self.ids[a] << ID_BITS | self.ids[b]: rank << ID_BITS | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.inner = [self.ids[s] for s in byte_signs()]
        self.final = [self.ids[s + self.suffix] for s in byte_signs()]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in chain(self.ids.items(), self.special.items())}
        names = sorted(self.special, key=len, reverse=True)
        self.between = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # White space is never part of a word here, so runs of it need no replacing.
        self.pattern = cut[0]["pattern"]["Regex"]
        self.words = regex.compile(self.pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.known: set[str] = set()
        self.seen = Seen(self.encode_word)

    def parts(self, word: str) -> tuple[list[int], list[int]]:
        """The ids of a word's parts and the bytes they begin and end at."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        bounds = list(range(len(data) + 1))
        (scanned if len(data) <= SHORT else queued)(ids, bounds, self.ranks)
        return ids, bounds

    def encode_word(self, word: str) -> tuple[int, ...]:
        return tuple(self.parts(word)[0])

    def _newer(self, text: str) -> bool:
        """Whether a text has signs that Python's Unicode tables do not know."""
        unseen = set(text) - self.known
        new = {c for c in unseen if unicodedata.category(c) == "Cn"}
        self.known |= unseen - new
        return bool(new)

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        if not text.isascii():
            if self._newer(text):
                return map(self.seen.__getitem__, library_words(text, self.pattern))
            # A sigma's lower case does not depend on its place in the word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if len(text) <= LIST_CHARS:
            return map(self.seen.__getitem__, self.words.findall(text))
        return (self.seen[m.group()] for m in self.words.finditer(text))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, np.int32)
        if self.between is None or not self.between.search(text):
            parts = self._plain(text)
        else:
            parts = chain.from_iterable([(self.special[p],)] if p in self.special else self._plain(p)
                                        for p in self.between.split(text))
        return np.fromiter(chain.from_iterable(parts), dtype=np.int32)

    def decode(self, ids) -> str:
        """The tokens of the ids, joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def scanned(ids: list[int], bounds: list[int], ranks: dict[int, int]) -> None:
    """Merge the pair of least rank, leftmost first, until no pair merges.
    ``bounds`` are the parts' boundaries, ``ids`` the part after each."""
    rank = ranks.get
    row = [rank(a << ID_BITS | b, NONE) for a, b in zip(ids, ids[1:])]
    while row:
        least = min(row)
        if least == NONE:
            break
        at = row.index(least)
        part = ids[at] = least & ID_MASK
        del bounds[at + 1], ids[at + 1], row[at]
        if at < len(row):
            row[at] = rank(part << ID_BITS | ids[at + 1], NONE)
        if at:
            row[at - 1] = rank(ids[at - 1] << ID_BITS | part, NONE)


def queued(ids: list[int], bounds: list[int], ranks: dict[int, int]) -> None:
    """The same for a long word, minima from a heap."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(at: int) -> int:
        return ranks.get(ids[at] << ID_BITS | ids[after[at]], NONE) if after[at] < n else NONE

    heap = [(r, at) for at in range(n) if (r := rank(at)) != NONE]
    heapq.heapify(heap)
    while heap:
        r, at = heapq.heappop(heap)
        if not alive[at] or rank(at) != r:
            continue
        gone = after[at]
        ids[at], alive[gone], after[at] = r & ID_MASK, False, after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        for p in (at, before[at]):
            if p >= 0 and (new := rank(p)) != NONE:
                heapq.heappush(heap, (new, p))
    bounds[:] = [*(bounds[at] for at in range(n) if alive[at]), bounds[n]]
    ids[:] = [ids[at] for at in range(n) if alive[at]]


_LOADED: dict[str, Vocabulary] = {}


def loaded(source: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes; a worker parses each file once."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


class Codec:
    """Column expressions that encode and decode with the file at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.source = spark.sparkContext.broadcast(f.read())

    def encode(self, text: Column) -> Column:
        """array<int> of a text column."""
        source = self.source

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = loaded(source.value)
            for texts in batches:
                yield pd.Series([vocabulary.encode(t) for t in texts], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """The text of a column of id lists."""
        source = self.source

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = loaded(source.value)
            for lists in batches:
                yield pd.Series([None if x is None else vocabulary.decode(x.tolist()) for x in lists], dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string")(ids)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its text and the text
    read back from them, in one pass of one worker per task."""
    codec = Codec(docs.sparkSession, path)
    source = codec.source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for batch in batches:
            for part in slices(batch):
                ids = [vocabulary.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                decoded = pa.array([vocabulary.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], ["id", "ids", "decoded"])

    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text"))
    schema = StructType([rows.schema["id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return rows.mapInArrow(run, schema).select(col("id").alias(doc_id), "ids", "decoded")


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts (the second column) have about ``most``
    bytes, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text per document."""
    done = encoded(docs, path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(col("decoded").cast("binary"), 256).alias("decoded_sha256"))
