"""Chat formatting with a compiled template.

Turns are rendered one after the other as their rows arrive, sorted, from the
shuffle; texts are escaped so that no control string inside a text can be
taken for the template's own, and reading the output back undoes it exactly. A
conversation is never gathered: its rows stream through one task, and neither
rendering nor reading back keeps more than one turn.

Escaping: inside a text, a control string gets a backslash after its first
character, and one more if it has some there already.

Defined results: a null text or role is empty; rows of one turn number are
ordered by role and text; repeated rows are turns of their own; rows with a
null conversation id form one conversation; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import col
from tallyline.llm.template import Piece, compiled

# The control strings, in the order they occur in a turn.
CONTROLS = ("<s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "</s>")
TEMPLATE = (
    "{% for m in messages %}<s>"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[ROLE] {{ m.role | escape }} [/ROLE] {{ m.text | escape }}"
    "{% endif %}</s>{% endfor %}"
)
# The reader's view of the same turns.
_TURN = re.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[OUT\] (?P<out>.*?)|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<text>.*?))</s>", re.S)

_FIRST = "".join(sorted({c[0] for c in CONTROLS}))
_RAW = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))


def _plain(text: str) -> bool:
    """No character that begins a control string: nothing to escape or undo."""
    return not any(c in text for c in _FIRST)


def escape(text: str) -> str:
    return text if _plain(text) else _RAW.sub(lambda m: "\\".join(_halves(m)), text)


def unescape(text: str) -> str:
    return text if _plain(text) else _RAW.sub(lambda m: _halves(m)[0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _halves(m: re.Match) -> tuple[str, str]:
    return m[0][:1], m[0][1:]


def program(template: str = TEMPLATE) -> Callable[[dict], Iterator[Piece]]:
    return compiled(template, {"escape": escape})


def pieces(turns: Iterable[tuple[str | None, str | None]], render: Callable[[dict], Iterator[Piece]]) -> Iterator[Piece]:
    """Pieces of the formatted conversation and whether each is to be learnt."""
    return render({"messages": ({"role": role or "", "text": text or ""} for role, text in turns)})


def formatted(turns: Iterable[tuple[str | None, str | None]],
              render: Callable[[dict], Iterator[Piece]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the spans to be learnt."""
    out, spans, at = [], [], 0
    for text, learnt in pieces(turns, render):
        if learnt:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


def read_back(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a formatted conversation of the default
    template that arrives in parts; a turn is given as soon as it is whole."""
    held = ""
    for part in parts:
        held += part
        if not part.endswith("</s>") and "</s><s>" not in held:
            continue
        at = 0
        while m := _TURN.match(held, at):
            if m["user"] is not None:
                yield "user", unescape(m["user"])
            elif m["out"] is not None:
                yield "assistant", unescape(m["out"])
            else:
                yield unescape(m["role"]), unescape(m["text"])
            at = m.end()
        held = held[at:]
    if held:
        raise ValueError(f"not a formatted conversation: {held[:80]!r}")


class _Digest:
    """What is read back from a conversation's output, turn by turn."""

    def __init__(self):
        self.turns, self.all = 0, hashlib.sha256()
        self.loss_chars, self.loss, self.chars = 0, hashlib.sha256(), 0

    def watched(self, out: Iterator[Piece]) -> Iterator[str]:
        for text, learnt in out:
            self.chars += len(text)
            if learnt:
                plain = unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
            yield text

    def read(self, out: Iterator[Piece]) -> "_Digest":
        for role, text in read_back(self.watched(out)):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        return self


def _sorted(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    # Ids travel as text: whole numbers beside nulls stay exact.
    named = rows.select(col(conv_id).cast("string").alias("conv_id"), col(turn).alias("turn"), col(role).cast("string").alias("role"),
                        col(text).cast("string").alias("text"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple[str | None, str | None]]]]:
    rows = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"], b["role"], b["text"]))
    for conv, turns in itertools.groupby(rows, key=lambda x: x[0]):
        yield conv, ((r, t) for _, r, t in turns)


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): each conversation as one text, with the
    [start, end) spans (code points) a model is to learn."""
    ordered = _sorted(rows, conv_id, turn, role, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = program(template)
        for conv, turns in _conversations(batches):
            out, spans = formatted(turns, render)
            yield pd.DataFrame({"conv_id": [conv], "formatted": [out],
                                "spans": [[{"start": a, "end": b} for a, b in spans]]})

    out = ordered.mapInPandas(run, "conv_id string, formatted string, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumn("conv_id", col("conv_id").cast(rows.schema[conv_id].dataType))


def digests(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, what reading its formatted text back gives."""
    ordered = _sorted(rows, conv_id, turn, role, text)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, render = [], program()
        for conv, turns in _conversations(batches):
            d = _Digest().read(pieces(turns, render))
            held.append((conv, d.turns, d.all.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars))
            if len(held) >= 4096:
                yield pd.DataFrame(held, columns=names)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    out = ordered.mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                   "loss_sha256 string, formatted_chars bigint")
    return out.withColumn("conv_id", col("conv_id").cast(rows.schema[conv_id].dataType))
