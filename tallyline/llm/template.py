"""A small sandboxed template language, compiled to Python closures.

    {{ expression | filter }}            text
    {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   what a model is to learn
    {# comment #}

Expressions have strings, numbers, true/false/none, names, fields (``m.role``
reads a dictionary key, never an attribute), ``loop.first``, ``loop.index``,
==, !=, and, or, not, +, and the filters of a fixed list; there is nothing
else to reach. Source becomes tokens, tokens a syntax tree, constants in the
tree are folded (adjacent text joined, branches with constant tests decided),
and the tree becomes generator closures: they yield (text, learnt) pieces one
after the other, so a loop over an endless iterator needs no memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template's source is wrong."""


# A tag ends at its first closing sign outside the strings in it.
_INSIDE = r"""(?>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|.)*?"""
_TAGS = re.compile(rf"(\{{\{{{_INSIDE}\}}\}}|\{{%{_INSIDE}%\}}|\{{#.*?#\}})", re.S)
_WORDS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.()+]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_KEYWORDS = frozenset(("and", "in", "not", "or", *_CONSTANTS))
BUILT_IN: dict[str, Callable[[Any], Any]] = {"length": len, "lower": str.lower, "trim": str.strip, "upper": str.upper}


class _Expression:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str, filters: dict):
        self.source, self.filters, self.words, at = source, filters, [], 0
        while source[at:].strip():
            m = _WORDS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in {source!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        found = self.peek() in wanted
        self.at += found
        return found

    def whole(self):
        tree = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r} in {self.source!r}")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.sum()
        for sign in ("==", "!="):
            if self.take(sign):
                return (sign, left, self.sum())
        return left

    def sum(self):
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        tree = self.atom()
        while self.peek() in ("|", "."):
            dot = self.words[self.at][1] == "."
            self.at += 1
            if self.at >= len(self.words) or self.words[self.at][0] != "name":
                raise TemplateError(f"a name must follow in {self.source!r}")
            name = self.words[self.at][1]
            self.at += 1
            if not dot and name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            tree = ("field", tree, name) if dot else ("filter", tree, name)
        return tree

    def atom(self):
        if self.at >= len(self.words):
            raise TemplateError(f"expression ends early: {self.source!r}")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(word))
        if word == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"missing ) in {self.source!r}")
            return tree
        if kind == "name" and word in _CONSTANTS:
            return ("const", _CONSTANTS[word])
        if kind == "name" and word not in _KEYWORDS:
            return ("name", word)
        raise TemplateError(f"unexpected {word!r} in {self.source!r}")


def parse(source: str, filters: dict) -> list[tuple]:
    """Syntax tree of a template: a list of nodes."""
    parts = [p for p in _TAGS.split(source) if p]
    at = 0

    def expression(text: str):
        return _Expression(text, filters).whole()

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(("show", expression(part[2:-2])))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, part[2:-2].strip()
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"wrong loop: {part}")
                    out.append(("for", m[1], expression(m[2]), block("endfor")[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "generation":
                    out.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {part}")
            else:
                out.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return out, ""

    def branch(test: str) -> tuple:
        then, end = block("endif", "else", "elif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            return ("if", expression(test), then, [branch(rest)])
        return ("if", expression(test), then, block("endif")[0] if word == "else" else [])

    return block()[0]


def _constant(tree: tuple, filters: dict) -> tuple:
    try:
        return ("const", _closure(tree, filters)({}))
    except (TypeError, ValueError, AttributeError) as wrong:
        raise TemplateError(f"a constant expression has no value: {wrong}") from wrong


def _fold_expression(tree: tuple, filters: dict) -> tuple:
    if tree[0] in ("const", "name"):
        return tree
    if tree[0] in ("field", "filter"):
        folded = (tree[0], _fold_expression(tree[1], filters), tree[2])
        return _constant(folded, filters) if tree[0] == "filter" and folded[1][0] == "const" else folded
    folded = (tree[0], *(_fold_expression(x, filters) for x in tree[1:]))
    return _constant(folded, filters) if all(x[0] == "const" for x in folded[1:]) else folded


def fold(nodes: list[tuple], filters: dict) -> list[tuple]:
    """The tree with constants evaluated, decided branches inlined and
    neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "show":
            tree = _fold_expression(node[1], filters)
            add(("text", _text(tree[1])) if tree[0] == "const" else ("show", tree))
        elif node[0] == "for":
            add(("for", node[1], _fold_expression(node[2], filters), fold(node[3], filters)))
        elif node[0] == "generation":
            add(("generation", fold(node[1], filters)))
        elif node[0] == "if":
            test = _fold_expression(node[1], filters)
            if test[0] == "const":
                for x in fold(node[2] if test[1] else node[3], filters):
                    add(x)
            else:
                add(("if", test, fold(node[2], filters), fold(node[3], filters)))
        else:
            add(node)
    return out


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _closure(tree: tuple, filters: dict) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, value=tree[1]: value
    if kind == "name":
        return lambda scope, name=tree[1]: scope.get(name)
    if kind == "field":
        inner, name = _closure(tree[1], filters), tree[2]

        def field(scope):
            value = inner(scope)
            return value.get(name) if isinstance(value, dict) else None
        return field
    if kind == "filter":
        inner, made = _closure(tree[1], filters), filters[tree[2]]
        return lambda scope: made(inner(scope))
    sides = [_closure(x, filters) for x in tree[1:]]
    if kind == "not":
        return lambda scope: not sides[0](scope)
    left, right = sides
    return {
        "and": lambda scope: left(scope) and right(scope),
        "or": lambda scope: left(scope) or right(scope),
        "==": lambda scope: left(scope) == right(scope),
        "!=": lambda scope: left(scope) != right(scope),
        "+": lambda scope: left(scope) + right(scope),
    }[kind]


def _generator(nodes: list[tuple], filters: dict, learnt: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda scope, piece=(node[1], learnt): iter((piece,)))
        elif node[0] == "show":
            steps.append(lambda scope, value=_closure(node[1], filters): iter(((_text(value(scope)), learnt),)))
        elif node[0] == "generation":
            steps.append(_generator(node[1], filters, True))
        elif node[0] == "if":
            test, then, other = _closure(node[1], filters), _generator(node[2], filters, learnt), _generator(node[3], filters, learnt)
            steps.append(lambda scope, test=test, then=then, other=other: then(scope) if test(scope) else other(scope))
        else:
            steps.append(_loop(node[1], _closure(node[2], filters), _generator(node[3], filters, learnt)))

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)
    return run


def _loop(name: str, rows: Callable[[dict], Any], body: Callable[[dict], Iterator[Piece]]):
    def run(scope: dict) -> Iterator[Piece]:
        for i, row in enumerate(rows(scope) or ()):
            yield from body({**scope, name: row, "loop": {"index": i + 1, "first": i == 0}})
    return run


def compiled(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[dict], Iterator[Piece]]:
    """A function from a scope (names to values) to an iterator of pieces."""
    filters = {**BUILT_IN, **(filters or {})}
    return _generator(fold(parse(source, filters), filters), filters, False)
