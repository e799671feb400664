"""The query-expression tree: nodes, validation, traversal, rewriting and JSON."""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from .errors import LexloomError


@dataclass(frozen=True)
class CountStats:
    """Statistics of a term or group in a collection."""

    collection_frequency: int = 0
    document_frequency: int = 0
    collection_length: int = 0
    document_count: int = 0

    def average_doc_length(self) -> float:
        return self.collection_length / self.document_count if self.document_count else 0.0


@dataclass(frozen=True)
class Node:
    """A query node."""

    def children_of(self) -> tuple[Node, ...]:
        out: list[Node] = []
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                out.append(v)
            elif f.name == "children":
                out += v
        return tuple(out)


@dataclass(frozen=True)
class _Many(Node):
    children: tuple[Node, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "children", tuple(self.children))


@dataclass(frozen=True)
class Require(Node):
    """Documents of ``value`` that ``cond`` matches too."""

    cond: Node
    value: Node


@dataclass(frozen=True)
class Reject(Node):
    """Documents of ``value`` that ``cond`` doesn't match."""

    cond: Node
    value: Node


@dataclass(frozen=True)
class Must(Node):
    """Scores ``value`` where both match."""

    cond: Node
    value: Node


class And(_Many):
    """All children match; scores add up."""


class Or(_Many):
    """Any child matches; scores add up."""


@dataclass(frozen=True)
class Not(Node):
    """Documents that the child doesn't match; score 0."""

    child: Node


class AlwaysMatch(Node):
    """Every document, with score 0."""


class NeverMatch(Node):
    """No document."""


class Sum(_Many):
    """The sum of the children's scores."""


@dataclass(frozen=True)
class Combine(_Many):
    """The weighted sum of the children's scores, child by weight; extra ones of either don't count."""

    weights: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "weights", tuple(self.weights))


class Mult(_Many):
    """The product of the children's scores."""


class Max(_Many):
    """The largest of the children's scores."""


@dataclass(frozen=True)
class Weighted(Node):
    weight: float
    child: Node


@dataclass(frozen=True)
class Text(Node):
    """A term as it stands in the index: nothing lower-cases or stems it."""

    term: str
    field: str | None = None
    stats_field: str | None = None
    data_needed: str | None = None


@dataclass(frozen=True)
class Lengths(Node):
    """The length of the field in every document."""

    field: str


@dataclass(frozen=True)
class LongParam(Node):
    """An integer column as score, ``missing`` where it is null."""

    field: str
    missing: int


@dataclass(frozen=True)
class FloatParam(Node):
    """A floating-point column as score, ``missing`` where it is null."""

    field: str
    missing: float


@dataclass(frozen=True)
class OrderedWindow(_Many):
    """Children in order, each at most ``step`` after the one before."""

    step: int = 1


@dataclass(frozen=True)
class UnorderedWindow(_Many):
    """Children in any order within ``width`` words; None: within the document."""

    width: int | None = None


class Synonym(_Many):
    """Children counted as one term."""


@dataclass(frozen=True)
class BM25(Node):
    child: Node
    b: float | None = None
    k: float | None = None
    stats: CountStats | None = None


@dataclass(frozen=True)
class LinearQL(Node):
    """Jelinek-Mercer query likelihood; ``lambda_`` weighs the document model."""

    child: Node
    lambda_: float | None = None
    stats: CountStats | None = None


@dataclass(frozen=True)
class DirQL(Node):
    """Query likelihood with Dirichlet smoothing."""

    child: Node
    mu: float | None = None
    stats: CountStats | None = None


NODES: dict[str, type[Node]] = {
    c.__name__: c
    for c in (Require, Reject, Must, And, Or, Not, AlwaysMatch, NeverMatch, Sum, Combine, Mult, Max, Weighted, Text, Lengths, LongParam, FloatParam, OrderedWindow, UnorderedWindow, Synonym, BM25, LinearQL, DirQL)
}


def term(text: str, field: str | None = None) -> Text:
    return Text(text, field)


def phrase(*terms: str, field: str | None = None) -> OrderedWindow:
    return OrderedWindow(tuple(Text(t, field) for t in terms), 1)


def bm25(child: Node | str, b: float | None = None, k: float | None = None, stats: CountStats | None = None) -> BM25:
    return BM25(Text(child) if isinstance(child, str) else child, b, k, stats)


def weighted(weight: float, child: Node) -> Weighted:
    return Weighted(weight, child)


def bag_of_words(terms: list[str], field: str | None = None) -> Combine:
    """BM25 of each term (repeated ones too), added up."""
    return Combine(tuple(BM25(Text(t, field)) for t in terms), (1.0,) * len(terms))


def walk(expr: Node) -> Iterator[Node]:
    """All nodes in pre-order."""
    yield expr
    for c in expr.children_of():
        yield from walk(c)


def find_fields(expr: Node) -> set[str]:
    """Fields whose statistics the terms use; terms without a field name none."""
    return {f for n in walk(expr) if isinstance(n, Text) and (f := n.stats_field or n.field)}


@dataclass(frozen=True)
class Fault:
    """What is wrong with a node."""

    kind: str
    value: Any = None

    def __str__(self) -> str:
        return self.kind if self.value is None else f"{self.kind}({self.value})"


def _numbers(*values: float | None) -> Iterator[Fault]:
    for v in values:
        if v is not None and math.isnan(v):
            yield Fault("NaNWeight")
        elif v is not None and math.isinf(v):
            yield Fault("InfiniteWeight")


def _statistics(s: CountStats | None) -> Iterator[Fault]:
    if s is None:
        return
    if s.collection_frequency < s.document_frequency:
        yield Fault("BadFrequencies", s)
    if s.collection_length < s.document_count:
        yield Fault("BadLengths", s)
    if s.document_frequency > s.document_count:
        yield Fault("BadDocProb", s)
    if s.collection_frequency > s.collection_length:
        yield Fault("BadTermProb", s)


def validate(expr: Node) -> list[Fault]:
    """All faults, in pre-order."""
    out: list[Fault] = []
    for n in walk(expr):
        if isinstance(n, Combine):
            out += _numbers(*n.weights)
        elif isinstance(n, Weighted):
            if n.weight < 0:
                out.append(Fault("NegativeWeight", n.weight))
            out += _numbers(n.weight)
        elif isinstance(n, Text) and not n.term:
            out.append(Fault("EmptyTerm"))
        elif isinstance(n, OrderedWindow) and n.step <= 0:
            out.append(Fault("OrderedWindowBadStep", n.step))
        elif isinstance(n, UnorderedWindow) and n.width is not None and n.width <= 1:
            out.append(Fault("UnorderedWindowBadWidth", n.width))
        elif isinstance(n, BM25):
            out += [*_numbers(n.b, n.k), *_statistics(n.stats)]
        elif isinstance(n, LinearQL):
            out += [*_numbers(n.lambda_), *_statistics(n.stats)]
        elif isinstance(n, DirQL):
            out += [*_numbers(n.mu), *_statistics(n.stats)]
    return out


def simplify(expr: Node) -> Node:
    """Rewrite boolean nodes without a change of matches or scores.

    Nested And in And and Or in Or are flattened; NeverMatch disappears from Or and makes
    And NeverMatch; AlwaysMatch disappears from And (an And of nothing else is AlwaysMatch);
    one child stands for itself.
    """
    if not isinstance(expr, (And, Or)):
        changes: dict[str, Any] = {}
        for f in dataclasses.fields(expr):
            v = getattr(expr, f.name)
            if isinstance(v, Node):
                changes[f.name] = simplify(v)
            elif f.name == "children":
                changes[f.name] = tuple(map(simplify, v))
        return dataclasses.replace(expr, **changes) if changes else expr
    kind = type(expr)
    flat: list[Node] = []
    for c in map(simplify, expr.children):
        flat += c.children if type(c) is kind else [c]
    if kind is And:
        if any(isinstance(c, NeverMatch) for c in flat):
            return NeverMatch()
        rest = [c for c in flat if not isinstance(c, AlwaysMatch)]
        if not rest:
            return AlwaysMatch() if flat else NeverMatch()
    else:
        rest = [c for c in flat if not isinstance(c, NeverMatch)]
        if not rest:
            return NeverMatch()
    return rest[0] if len(rest) == 1 else kind(tuple(rest))


def to_dict(expr: Node) -> Any:
    """Externally tagged, as {"BM25": {"child": ...}}; nodes without parts are strings."""
    name = type(expr).__name__
    parts = dataclasses.fields(expr)
    if not parts:
        return name
    out: dict[str, Any] = {}
    for f in parts:
        v = getattr(expr, f.name)
        if isinstance(v, Node):
            v = to_dict(v)
        elif f.name == "children":
            v = [to_dict(c) for c in v]
        elif isinstance(v, tuple):
            v = list(v)
        elif isinstance(v, CountStats):
            v = dataclasses.asdict(v)
        out[f.name.rstrip("_")] = v
    return {name: out}


def from_dict(data: Any) -> Node:
    if isinstance(data, str):
        data = {data: {}}
    if not isinstance(data, dict) or len(data) != 1:
        raise LexloomError(f"not a query node: {data!r}")
    (name, parts), = data.items()
    kind = NODES.get(name)
    if kind is None:
        raise LexloomError(f"unknown query node: {name}")
    values: dict[str, Any] = {}
    for f in dataclasses.fields(kind):
        key = f.name.rstrip("_")
        if key not in parts:
            if f.default is dataclasses.MISSING:
                raise LexloomError(f"{name} lacks {key}")
            continue
        v = parts[key]
        if f.name in ("child", "cond", "value"):
            v = from_dict(v)
        elif f.name == "children":
            v = tuple(from_dict(c) for c in v)
        elif f.name == "stats" and v is not None:
            v = CountStats(**v)
        values[f.name] = v
    return kind(**values)


def to_json(expr: Node) -> str:
    return json.dumps(to_dict(expr), ensure_ascii=False)


def from_json(text: str) -> Node:
    return from_dict(json.loads(text))
