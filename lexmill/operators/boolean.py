"""Boolean queries: a small language read into a tree.

    any     = all { "OR" all }
    all     = one { ["AND"] one }
    one     = "NOT" one | "(" any ")" | quoted phrase | words

Operators are written in capitals. Words that stand together are one operand, which asks for all of them; operands that
stand side by side are joined as by AND. A quote without a partner is white space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column


class QueryError(ValueError):
    """The query is none of this language."""


@dataclass(frozen=True)
class Operand:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class All:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Node, ...]


Node = Operand | Not | All | Any
_SIGNS = ("AND", "OR", "NOT", "(", ")")


def lexemes(query: str) -> Iterator[tuple[str, str]]:
    """(kind, text): a sign is its own kind, else ``phrase`` or ``word``."""
    at = 0
    while at < len(query):
        c = query[at]
        if c.isspace():
            at += 1
        elif c in "()":
            yield c, c
            at += 1
        elif c == '"':
            close = query.find('"', at + 1)
            if close > at + 1:
                yield "phrase", query[at + 1 : close]
                at = close
            at += 1
        else:
            end = next((i for i in range(at, len(query)) if query[i].isspace() or query[i] in '()"'), len(query))
            word, at = query[at:end], end
            yield (word if word in _SIGNS else "word"), word


def parse(query: str) -> Node:
    """The tree of a query; :class:`QueryError` where it is malformed or its brackets don't match."""
    rest = [*lexemes(query), ("end", "")]
    rest.reverse()

    def take(kind: str) -> str | None:
        return rest.pop()[1] if rest[-1][0] == kind else None

    def one() -> Node:
        if take("NOT") is not None:
            return Not(one())
        if take("(") is not None:
            inner = any_()
            if take(")") is None:
                raise QueryError(f"a bracket stays open in {query!r}")
            return inner
        if (phrase := take("phrase")) is not None:
            return Operand(phrase, True)
        words = []
        while (word := take("word")) is not None:
            words.append(word)
        if not words:
            raise QueryError(f"an operand is missing in {query!r}" if rest[-1][0] != "end" or query.strip() else "the query is empty")
        return Operand(" ".join(words))

    def all_() -> Node:
        parts = [one()]
        while take("AND") is not None or rest[-1][0] in ("NOT", "(", "phrase", "word"):
            parts.append(one())
        return All(tuple(parts)) if len(parts) > 1 else parts[0]

    def any_() -> Node:
        parts = [all_()]
        while take("OR") is not None:
            parts.append(all_())
        return Any(tuple(parts)) if len(parts) > 1 else parts[0]

    tree = any_()
    if rest[-1][0] != "end":
        raise QueryError(f"a bracket closes none in {query!r}")
    return tree


def operands(tree: Node, positive: bool = False) -> list[Operand]:
    """The distinct operands in order; with ``positive`` without those below a NOT."""
    if isinstance(tree, Operand):
        return [tree]
    parts = tree.parts if isinstance(tree, All | Any) else () if positive else (tree.part,)
    return list(dict.fromkeys(o for p in parts for o in operands(p, positive)))


def condition(tree: Node, holds: Callable[[Operand], Column]) -> Column:
    if isinstance(tree, Operand):
        return holds(tree)
    if isinstance(tree, Not):
        return ~condition(tree.part, holds)
    parts = [condition(p, holds) for p in tree.parts]
    return reduce((lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b), parts)


def without_hits(tree: Node) -> bool:
    """Does the query hold for a document that none of its operands holds for?"""
    if isinstance(tree, Operand):
        return False
    if isinstance(tree, Not):
        return not without_hits(tree.part)
    return (all if isinstance(tree, All) else any)(map(without_hits, tree.parts))
