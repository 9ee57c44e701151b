"""Boolean queries: text to tree, tree to predicate.

Grammar: ``or := and ('|' and)*``, ``and := not ('&' not)*``, ``not := '!' not | '(' or ')' | word``. Operators may be
doubled (``&&``, ``||``). Only the space separates words, so ``foo-bar`` is one word. Every malformed query is a ValueError.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = frozenset("&|!()")


@dataclass(frozen=True)
class Word:
    term: str


@dataclass(frozen=True)
class Not:
    of: "Node"


@dataclass(frozen=True)
class And:
    parts: tuple["Node", ...]


@dataclass(frozen=True)
class Or:
    parts: tuple["Node", ...]


Node = Word | Not | And | Or


def lex(query: str) -> list[str]:
    """Words and single-character operators, in order."""
    out: list[str] = []
    word = ""
    i = 0
    while i < len(query):
        ch = query[i]
        if ch == " " or ch in MARKS:
            if word:
                out.append(word)
                word = ""
            if ch in MARKS:
                out.append(ch)
                if ch in "&|" and query[i + 1 : i + 2] == ch:
                    i += 1
        else:
            word += ch
        i += 1
    if word:
        out.append(word)
    return out


class _Reader:
    def __init__(self, items: list[str], norm: Callable[[str], str]):
        self.items, self.at, self.norm = items, 0, norm

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self) -> str | None:
        item = self.peek()
        self.at += 1
        return item

    def chain(self, mark: str, part: Callable[[], Node], make) -> Node:
        parts = [part()]
        while self.peek() == mark:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def either(self) -> Node:
        return self.chain("|", self.both, Or)

    def both(self) -> Node:
        return self.chain("&", self.unit, And)

    def unit(self) -> Node:
        item = self.take()
        if item == "!":
            return Not(self.unit())
        if item == "(":
            inner = self.either()
            if self.take() != ")":
                raise ValueError("unclosed parenthesis")
            return inner
        if item is None or item in MARKS:
            raise ValueError(f"a word was expected, not {item or 'the end'}")
        return Word(self.norm(item))


def parse(query: str, norm: Callable[[str], str] = str.lower, empty_word: str | None = None) -> Node:
    """Tree of a query. ``norm`` maps a word to its index term; ``empty_word`` stands for an empty query."""
    items = lex(query)
    if not items and empty_word is not None:
        items = [empty_word]
    reader = _Reader(items, norm)
    tree = reader.either()
    if reader.peek() is not None:
        raise ValueError(f"unexpected {reader.peek()!r}")
    return tree


def words(tree: Node) -> Counter:
    """Each term and how often the query names it, also under NOT."""
    if isinstance(tree, Word):
        return Counter([tree.term])
    if isinstance(tree, Not):
        return words(tree.of)
    return sum(map(words, tree.parts), Counter())


def holds(tree: Node, has: Callable[[str], bool]) -> bool:
    """Truth of a query for a document."""
    if isinstance(tree, Word):
        return has(tree.term)
    if isinstance(tree, Not):
        return not holds(tree.of, has)
    return (all if isinstance(tree, And) else any)(holds(p, has) for p in tree.parts)


def needs_universe(tree: Node) -> bool:
    """Whether documents without any of the words can match: only then are all documents read."""
    return holds(tree, lambda _: False)


def predicate(tree: Node, has: Callable[[str], Column]) -> Column:
    """The query as one Catalyst predicate over per-term flags."""
    if isinstance(tree, Word):
        return has(tree.term)
    if isinstance(tree, Not):
        return ~predicate(tree.of, has)
    parts = [predicate(p, has) for p in tree.parts]
    return reduce((lambda a, b: a & b) if isinstance(tree, And) else (lambda a, b: a | b), parts)


def to_rpn(tree: Node) -> list[str]:
    """Postfix form, for display and for tests."""
    if isinstance(tree, Word):
        return [tree.term]
    if isinstance(tree, Not):
        return [*to_rpn(tree.of), "!"]
    mark = "&" if isinstance(tree, And) else "|"
    out = to_rpn(tree.parts[0])
    for p in tree.parts[1:]:
        out += [*to_rpn(p), mark]
    return out


def random_query(rng: random.Random, vocabulary: list[str], depth: int = 3) -> str:
    """A random well-formed query over a vocabulary."""
    if depth == 0 or rng.random() < 0.3:
        return ("!" if rng.random() < 0.25 else "") + rng.choice(vocabulary)
    inner = f" {rng.choice(['&&', '||', '&', '|'])} ".join(
        random_query(rng, vocabulary, depth - 1) for _ in range(rng.randint(2, 3))
    )
    return f"{'!' if rng.random() < 0.2 else ''}({inner})"
