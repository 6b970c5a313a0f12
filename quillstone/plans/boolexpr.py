"""The boolean search language: text to a tree, a tree to a Spark condition.

An expression is alternatives, parted by OR, of operands that all must hold, parted by AND or nothing (a comma is
nothing); an operand is a term or a bracketed expression, after any number of NOTs.  The operators are the words and, or,
not in any case and the signs & && | || !; what stands in double quotes is one term, even an operator's name.

One pass reads it: every open bracket keeps its alternatives so far, so nesting costs no recursion.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


Node = Term | Not | And | Or

# The signs and words of the language.
OPERATORS = {"and": "AND", "&": "AND", "&&": "AND", "or": "OR", "|": "OR", "||": "OR", "not": "NOT", "!": "NOT", "(": "OPEN", "（": "OPEN", ")": "CLOSE", "）": "CLOSE"}
_TOKEN = re.compile(r'"(?P<quoted>[^"]*)"?|&&?|\|\|?|[!()（）]|[^\s,"&|!()（）]+')


class _Level:
    """What an open bracket (or the whole text) holds so far; ``waits``: an operand must come next."""

    def __init__(self):
        self.alternatives: list[list[Node]] = [[]]
        self.negations, self.waits = 0, True

    def operand(self, node: Node) -> None:
        self.alternatives[-1].append(reduce(lambda n, _: Not(n), range(self.negations), node))
        self.negations, self.waits = 0, False

    def operator(self, kind: str, shown: str) -> None:
        if kind == "NOT":
            self.negations += 1
        elif self.waits:
            raise ValueError(f"{shown!r} stands where a term is expected")
        elif kind == "OR":
            self.alternatives.append([])
        self.waits = True

    def node(self) -> Node:
        if self.waits:
            raise ValueError("the expression ends, or a bracket closes, where a term is expected")
        return joined(Or, (joined(And, operands) for operands in self.alternatives))


def parse(text: str) -> Node:
    """Raises ValueError for an empty, unbalanced or otherwise broken expression."""
    levels = [_Level()]
    for token in _TOKEN.finditer(text):
        shown, quoted = token[0], token["quoted"]
        kind = "TERM" if quoted is not None else OPERATORS.get(shown.lower(), "TERM")
        if kind == "TERM":
            levels[-1].operand(Term(shown if quoted is None else quoted))
        elif kind == "OPEN":
            levels.append(_Level())
        elif kind == "CLOSE":
            inner = levels.pop().node()
            if not levels:
                raise ValueError("a bracket closes that was never opened")
            levels[-1].operand(inner)
        else:
            levels[-1].operator(kind, shown)
    if len(levels) > 1:
        raise ValueError("a bracket isn't closed")
    return levels[0].node()


def joined(kind: type[And] | type[Or], nodes: Iterable[Node]) -> Node | None:
    """All nodes under one of the kind; a single one stays as it is, none gives None."""
    found = tuple(nodes)
    return kind(found) if len(found) > 1 else next(iter(found), None)


def from_keywords(keywords: list[str], match: str = "any") -> Node | None:
    """The keywords as terms, of which any or all must hold."""
    return joined(Or if match == "any" else And, map(Term, keywords))


def split_keywords(values: list[str]) -> list[str]:
    """Split at commas, not at spaces; empty ones go."""
    return [k for v in values for k in (p.strip() for p in v.split(",")) if k]


def positive_terms(tree: Node) -> list[str]:
    """The leaves that stand under no NOT, from left to right."""
    found, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, Term):
            found.append(node.text)
        elif not isinstance(node, Not):
            todo += node.children[::-1]
    return found


def condition(node: Node, leaf: Callable[[str], Column]) -> Column:
    """The tree as a three-valued condition."""
    if isinstance(node, Term):
        return leaf(node.text)
    if isinstance(node, Not):
        return ~condition(node.child, leaf)
    out = condition(node.children[0], leaf)
    for c in node.children[1:]:
        out = out & condition(c, leaf) if isinstance(node, And) else out | condition(c, leaf)
    return out


def searchable(node: Node) -> bool:
    """Whether a full-text index can answer it: no OR over a NOT, no AND of nothing but NOTs, no NOT at the top or twice."""
    if isinstance(node, Term):
        return True
    if isinstance(node, Not):
        return False
    if isinstance(node, Or):
        return all(searchable(c) for c in node.children)
    positive = [c for c in node.children if not isinstance(c, Not)]
    return bool(positive) and all(searchable(c) for c in positive) and all(searchable(c.child) for c in node.children if isinstance(c, Not))
