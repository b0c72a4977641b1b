"""Terms as preorder text: ``symbol/arity`` for each node, parents before children, separated by spaces.

A symbol's first character says what it is: ``?`` a schematic variable, ``%`` a free one, ``'`` a type variable, ``\\`` a binder
with its cosmetic name, ``#`` a bound index; all others are constants. A node's arguments follow it, so a sub-term is a
stretch of nodes, and its length follows from the arities in one pass from the right."""

from __future__ import annotations

import functools
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIABLES = ("?", "%", "'")


class Term(NamedTuple):
    """Shared by equal shapes, so never changed."""

    symbols: tuple[str, ...]
    arity: tuple[int, ...]
    size: list[int]


@functools.lru_cache(65_536)
def _node(text: str) -> tuple[str, int] | None:
    symbol, _, n = text.rpartition("/")
    return (symbol, int(n)) if symbol and n.isdigit() else None


@functools.lru_cache(65_536)
def written(text: str) -> str | None:
    """A node as it is always written; None for what is no node."""
    node = _node(text)
    return node and f"{node[0]}/{node[1]}"


def _sizes(arity: tuple[int, ...]) -> list[int] | None:
    size = [1] * len(arity)
    for i in range(len(arity) - 1, -1, -1):
        for _ in range(arity[i]):
            if i + size[i] >= len(arity):
                return None
            size[i] += size[i + size[i]]
    return size if arity and size[0] == len(arity) else None


#: Many terms have one shape; long ones are not kept.
_SHORT = 64
_sizes_of_short = functools.lru_cache(65_536)(_sizes)


def parse(text: str | None) -> Term | None:
    """None for a text that is no single term."""
    nodes = [*map(_node, (text or "").split())]
    if not nodes or None in nodes:
        return None
    symbols, arity = zip(*nodes, strict=True)
    size = (_sizes_of_short if len(arity) <= _SHORT else _sizes)(arity)
    return Term(symbols, arity, size) if size else None


def normal(term: Term) -> str:
    """Variables of all kinds numbered by first occurrence, one counter for terms and types; binders without their names."""
    number: dict[str, int] = {}
    out = []
    for symbol, n in zip(term.symbols, term.arity, strict=True):
        if symbol[0] in VARIABLES:
            symbol = f"{symbol[0]}{number.setdefault(symbol, len(number))}"
        out.append(f"{symbol[0] if symbol[0] == chr(92) else symbol}/{n}")
    return " ".join(out)


def match_at(pattern: Term, term: Term, at: int) -> dict[str, str] | None:
    """What the pattern's schematic variables stand for if it is the sub-term at this node."""
    bound = bound_at(pattern, term, at)
    return None if bound is None else {v: " ".join(f"{s}/{k}" for s, k in zip(term.symbols[a:b], term.arity[a:b], strict=True)) for v, (a, b) in bound.items()}


def bound_at(pattern: Term, term: Term, at: int) -> dict[str, tuple[int, int]] | None:
    """As ``match_at``, by the first node and the one after the last."""
    bound: dict[str, tuple[int, int]] = {}
    i = 0
    while i < len(pattern.symbols):
        symbol, n = pattern.symbols[i], pattern.arity[i]
        if at >= len(term.symbols):
            return None
        if symbol[0] == "?" and not n:
            here = (at, at + term.size[at])
            a, b = bound.setdefault(symbol, here)
            if (a, b) != here and (term.symbols[a:b], term.arity[a:b]) != (term.symbols[at : here[1]], term.arity[at : here[1]]):
                return None
            at = here[1]
        elif symbol == term.symbols[at] and n == term.arity[at]:
            at += 1
        else:
            return None
        i += 1
    return bound


def nodes(term: Term, pattern: bool = False) -> set[tuple[str, int]]:
    """Symbols with their arity, of all that is no pattern variable."""
    return {x for x in zip(term.symbols, term.arity, strict=True) if not (pattern and x[0][0] == "?" and not x[1])}


def features(term: Term, pattern: bool = False) -> set[str]:
    """Paths of length one, ``parent.place.child``, and single symbols, of all that is no pattern variable. A term has every
    feature of a pattern that it holds."""
    free = lambda i: pattern and term.symbols[i][0] == "?" and not term.arity[i]
    out = set()
    for i, (symbol, n) in enumerate(zip(term.symbols, term.arity, strict=True)):
        if free(i):
            continue
        out.add(f"{symbol}/{n}")
        at = i + 1
        for place in range(n):
            if not free(at):
                out.add(f"{symbol}/{n}.{place}.{term.symbols[at]}/{term.arity[at]}")
            at += term.size[at]
    return out


def _conclusion(term: Term, at: int) -> tuple[list[int], int]:
    """Premises and conclusion of the statement at a node, below its quantifiers (``all``) and implications (``imp``)."""
    premises = []
    while True:
        symbol, n = term.symbols[at], term.arity[at]
        if symbol == "all" and n == 1 or symbol[0] == "\\" and n == 1:
            at += 1
        elif symbol == "imp" and n == 2:
            premises.append(at + 1)
            at += 1 + term.size[at + 1]
        else:
            return premises, at


def _head(term: Term, at: int) -> str | None:
    if term.symbols[at] == "judgment" and term.arity[at] == 1:
        at += 1
    return term.symbols[at] if term.symbols[at][0] == "?" else None


def is_rule(term: Term) -> bool:
    """The conclusion's head is a schematic variable that some premise comes to as well."""
    premises, conclusion = _conclusion(term, 0)
    head = _head(term, conclusion)
    return head is not None and any(_head(term, _conclusion(term, p)[1]) == head for p in premises)


@F.pandas_udf(T.StringType())
def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: normal(x) if (x := parse(t)) else None)


@F.pandas_udf(T.BooleanType())
def _is_rule(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: is_rule(x) if (x := parse(t)) else None)


def alpha_normal(term: Column) -> Column:
    """The term up to the names of its variables; null for what is no term."""
    return _normal(term)


def alpha_digest(term: Column) -> Column:
    """128 bits of the normal form, as hex."""
    return F.md5(alpha_normal(term))


def rule_shape(term: Column) -> Column:
    return _is_rule(term)
