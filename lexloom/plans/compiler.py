"""Compile a query-expression tree to one DataFrame plan.

All terms of the tree are read in one scan of the postings and pivoted by one aggregation to
a row for each document with a count (and positions, where a window needs them) for each term.
On that row the whole tree is Column arithmetic: what matches, and what it scores.  A tree
that can match documents without any of its terms starts from the documents table instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import expr as X
from ..errors import LexloomError, QueryValidationError
from ..fields import Field
from ..functions.columns import ordered_starts, unordered_starts
from ..operators.index import Index

B, K = 0.75, 1.2
LAMBDA, MU = 0.3, 1500.0

_COUNTED = (X.Text, X.Synonym, X.OrderedWindow, X.UnorderedWindow)
_OPEN = (X.Not, X.AlwaysMatch, X.Lengths, X.LongParam, X.FloatParam)


@dataclass
class Plan:
    """A compiled query."""

    index: Index
    expr: X.Node
    #: terms by field, and the column of each
    terms: dict[tuple[Field, str], int] = field(default_factory=dict)
    with_positions: set[int] = field(default_factory=set)
    length_fields: dict[str, str] = field(default_factory=dict)
    #: counted nodes whose collection statistics are needed
    stats: dict[int, tuple[X.Node, str]] = field(default_factory=dict)
    params: set[str] = field(default_factory=set)
    #: windows, inner ones first, and the column of each
    windows: dict[int, tuple[X.Node, str]] = field(default_factory=dict)

    # -- what the tree needs

    def collect(self, node: X.Node, windowed: bool = False) -> None:
        if isinstance(node, X.Text):
            at = self.terms.setdefault((self.index.field(node.field), node.term), len(self.terms))
            if windowed:
                self.with_positions.add(at)
            if node.stats_field:
                self.terms.setdefault((self.index.field(node.stats_field), node.term), len(self.terms))
        if isinstance(node, X.Lengths):
            self.length(node.field)
        if isinstance(node, (X.LongParam, X.FloatParam)):
            if node.field not in self.index.documents.columns:
                raise LexloomError(f"no such column: {node.field}")
            self.params.add(node.field)
        if isinstance(node, (X.BM25, X.LinearQL, X.DirQL)):
            if not isinstance(node.child, _COUNTED):
                raise LexloomError(f"{type(node).__name__} needs a term, synonym or window, not {type(node.child).__name__}")
            fields = X.find_fields(node)
            if len(fields) > 1:
                raise LexloomError(f"{type(node).__name__} over more than one field: {', '.join(sorted(fields))}")
            self.length(next(iter(fields), None))
            self.stats.setdefault(id(node), (node.child, f"s{len(self.stats)}"))
        inside = windowed or isinstance(node, (X.OrderedWindow, X.UnorderedWindow))
        for c in node.children_of():
            self.collect(c, inside)
        if isinstance(node, X.OrderedWindow) and node.children or isinstance(node, X.UnorderedWindow) and node.children and node.width is not None:
            self.windows.setdefault(id(node), (node, f"win{len(self.windows)}"))

    def length(self, name: str | None) -> str:
        f = Field.parse(name).name
        if f not in {x.name for x in self.index.fields}:
            self.index.lengths_of(name)
        return self.length_fields.setdefault(f, f"len{len(self.length_fields)}")

    # -- columns of a row

    def tf(self, node: X.Node) -> Column:
        if isinstance(node, X.Text):
            return F.coalesce(F.col(f"tf{self.terms[self.index.field(node.field), node.term]}"), F.lit(0))
        if isinstance(node, X.Synonym):
            return reduce(Column.__add__, map(self.tf, node.children), F.lit(0))
        if isinstance(node, X.UnorderedWindow) and node.width is None:
            return _least(list(map(self.tf, node.children)))
        if isinstance(node, (X.OrderedWindow, X.UnorderedWindow)):
            return F.size(self.positions(node))
        if isinstance(node, X.Lengths):
            return self.length_of(node.field)
        raise LexloomError(f"{type(node).__name__} has no count")

    def positions(self, node: X.Node) -> Column:
        none = F.array().cast("array<int>")
        if isinstance(node, X.Text):
            return F.coalesce(F.col(f"pos{self.terms[self.index.field(node.field), node.term]}"), none)
        if isinstance(node, X.Synonym):
            return F.array_sort(F.array_distinct(F.concat(*map(self.positions, node.children)))) if node.children else none
        if id(node) in self.windows:
            return F.coalesce(F.col(self.windows[id(node)][1]), none)
        if isinstance(node, (X.OrderedWindow, X.UnorderedWindow)):
            if not node.children:
                return none
            own = [self.positions(c) for c in node.children]
            return F.when(_every([F.size(o) > 0 for o in own]), F.array_sort(F.array_distinct(F.concat(*own)))).otherwise(none)
        raise LexloomError(f"{type(node).__name__} has no positions")

    def length_of(self, name: str | None) -> Column:
        return F.coalesce(F.col(self.length(name)), F.lit(0))

    def matches(self, node: X.Node) -> Column:
        if isinstance(node, _COUNTED):
            return self.tf(node) > 0
        if isinstance(node, (X.AlwaysMatch, X.Lengths, X.LongParam, X.FloatParam)):
            return F.lit(True)
        if isinstance(node, X.NeverMatch):
            return F.lit(False)
        if isinstance(node, X.And):
            return _every(list(map(self.matches, node.children))) if node.children else F.lit(False)
        if isinstance(node, X.Not):
            return ~self.matches(node.child)
        if isinstance(node, (X.Require, X.Must)):
            return self.matches(node.cond) & self.matches(node.value)
        if isinstance(node, X.Reject):
            return ~self.matches(node.cond) & self.matches(node.value)
        if isinstance(node, (X.LinearQL, X.DirQL)):
            return self.matches(node.child) & (self.statistic(node, "cf") > 0)
        if isinstance(node, (X.BM25, X.Weighted)):
            return self.matches(node.child)
        return reduce(Column.__or__, map(self.matches, node.children_of()), F.lit(False))

    def statistic(self, node: X.BM25 | X.LinearQL | X.DirQL, what: str) -> Column:
        if node.stats is not None:
            s = node.stats
            return F.lit(float({"cf": s.collection_frequency, "df": s.document_frequency, "cl": s.collection_length, "n": s.document_count}[what]))
        name = self.stats[id(node)][1] if what in ("cf", "df") else self.length(next(iter(X.find_fields(node)), None))
        return F.col(f"{name}_{what}").cast("double")

    def score(self, node: X.Node) -> Column:
        zero = F.lit(0.0)
        if isinstance(node, X.BM25):
            b, k = (B if node.b is None else node.b), (K if node.k is None else node.k)
            tf = self.tf(node.child).cast("double")
            n, df, cl = (self.statistic(node, w) for w in ("n", "df", "cl"))
            average = F.when(n > 0, cl / n).otherwise(zero)
            length = self.length_of(next(iter(X.find_fields(node)), None)).cast("double")
            relative = F.when(average > 0, length / average).otherwise(zero)
            under = tf + F.lit(k) * (F.lit(1.0 - b) + F.lit(b) * relative)
            return F.when((tf > 0) & (under != 0), F.log(n / (df + F.lit(0.5))) * tf * F.lit(k + 1.0) / under).otherwise(zero)
        if isinstance(node, X.DirQL):
            mu = MU if node.mu is None else node.mu
            length = self.length_of(next(iter(X.find_fields(node)), None)).cast("double")
            background = self.statistic(node, "cf") / self.statistic(node, "cl")
            return F.when(self.statistic(node, "cf") > 0, F.log((self.tf(node.child) + F.lit(mu) * background) / (length + F.lit(mu)))).otherwise(zero)
        if isinstance(node, X.LinearQL):
            weight = LAMBDA if node.lambda_ is None else node.lambda_
            length = self.length_of(next(iter(X.find_fields(node)), None)).cast("double")
            own = F.when(length > 0, self.tf(node.child) / length).otherwise(zero)
            background = self.statistic(node, "cf") / self.statistic(node, "cl")
            return F.when(self.statistic(node, "cf") > 0, F.log(F.lit(weight) * own + F.lit(1 - weight) * background)).otherwise(zero)
        if isinstance(node, (X.And, X.Or, X.Sum)):
            return reduce(Column.__add__, map(self.score, node.children), zero)
        if isinstance(node, X.Combine):
            return reduce(Column.__add__, (self.score(c) * F.lit(float(w)) for c, w in zip(node.children, node.weights, strict=False)), zero)
        if isinstance(node, X.Mult):
            return reduce(Column.__mul__, map(self.score, node.children), F.lit(1.0)) if node.children else zero
        if isinstance(node, X.Max):
            own = list(map(self.score, node.children))
            return F.greatest(*own) if len(own) > 1 else own[0] if own else zero
        if isinstance(node, X.Weighted):
            return self.score(node.child) * F.lit(float(node.weight))
        if isinstance(node, (X.Require, X.Reject, X.Must)):
            return self.score(node.value)
        if isinstance(node, (X.Not, X.AlwaysMatch, X.NeverMatch)):
            return zero
        if isinstance(node, (X.LongParam, X.FloatParam)):
            return F.coalesce(F.col(node.field), F.lit(node.missing)).cast("double")
        return self.tf(node).cast("double")

    # -- the plan

    def is_open(self) -> bool:
        return any(isinstance(n, _OPEN) for n in X.walk(self.expr))

    def own_lengths(self) -> str | None:
        """The column of the lengths where postings have all that are asked for: every row then comes from terms of that one field."""
        names = {f.name for f, _ in self.terms}
        if self.is_open() or "length" not in self.index.postings.columns or set(self.length_fields) != names or len(names) != 1:
            return None
        return self.length_fields[names.pop()]

    def counted(self, length: str | None = None) -> DataFrame:
        """A row for each document that holds a term of the tree, with its length under that name."""
        if not self.terms:
            return self.index.documents.limit(0).select("doc_id")
        by_field: dict[Field, list[tuple[str, int]]] = {}
        for (f, t), k in self.terms.items():
            by_field.setdefault(f, []).append((t, k))
        wanted = reduce(Column.__or__, ((F.col("stemmer") == f.stemmer) & (F.col("field") == f.name) & F.col("term").isin([t for t, _ in own]) for f, own in by_field.items()))
        out = []
        for (f, t), k in self.terms.items():
            is_it = (F.col("term") == t) & (F.col("field") == f.name) & (F.col("stemmer") == f.stemmer)
            out.append(F.sum(F.when(is_it, F.col("tf"))).alias(f"tf{k}"))
            if k in self.with_positions:
                out.append(F.first(F.when(is_it, F.col("positions")), ignorenulls=True).alias(f"pos{k}"))
        if length:
            out.append(F.first("length", ignorenulls=True).alias(length))
        found = self.index.postings.where(wanted).groupBy("doc_id").agg(*out)
        # each window is computed once, however often the tree refers to it
        for node, name in self.windows.values():
            own = [self.positions(c) for c in node.children]
            found = found.withColumn(name, ordered_starts(own, node.step) if isinstance(node, X.OrderedWindow) else unordered_starts(own, node.width))
        return found

    def statistics(self, counted: DataFrame) -> DataFrame | None:
        """One row: collection statistics of all counted nodes and fields."""
        out: DataFrame | None = None
        wanted, stored = [], []
        for node, name in self.stats.values():
            if isinstance(node, X.Text) and self.index.stored_vocabulary is not None:
                f = self.index.field(node.stats_field or node.field)
                is_it = (F.col("stemmer") == f.stemmer) & (F.col("field") == f.name) & (F.col("term") == node.term)
                stored += [(is_it, F.coalesce(F.sum(F.when(is_it, F.col(what))), F.lit(0)).alias(f"{name}_{what}")) for what in ("df", "cf")]
                continue
            tf = self._statistics_tf(node)
            wanted += [F.count_if(tf > 0).alias(f"{name}_df"), F.coalesce(F.sum(tf), F.lit(0)).alias(f"{name}_cf")]
        if wanted:
            out = counted.agg(*wanted)
        if stored:
            # what single terms count is in the vocabulary
            own = self.index.stored_vocabulary.where(reduce(Column.__or__, (w for w, _ in stored))).agg(*(c for _, c in stored))
            out = own if out is None else out.crossJoin(own)
        for f, name in self.length_fields.items():
            known = self.index.field_stats().where(F.col("field") == f)
            own = known.agg(F.coalesce(F.sum("document_count"), F.lit(0)).alias(f"{name}_n"), F.coalesce(F.sum("collection_length"), F.lit(0)).alias(f"{name}_cl"))
            out = own if out is None else out.crossJoin(own)
        return out

    def _statistics_tf(self, node: X.Node) -> Column:
        if isinstance(node, X.Text) and node.stats_field:
            return F.coalesce(F.col(f"tf{self.terms[self.index.field(node.stats_field), node.term]}"), F.lit(0))
        return self.tf(node)

    def rows(self, doc_id: int | None = None) -> DataFrame:
        """A row for each document in question, with all columns that the tree refers to."""
        length = self.own_lengths() if doc_id is None else None
        counted = self.counted(length)
        stats = self.statistics(counted) if self.stats else None
        rows = counted
        if doc_id is not None:
            one = F.col("doc_id") == doc_id
            rows = self.index.documents.where(one).select("doc_id", *sorted(self.params)).join(counted.where(one), "doc_id", "left")
        elif self.is_open():
            rows = self.index.documents.select("doc_id", *sorted(self.params)).join(counted, "doc_id", "left")
        for f, name in self.length_fields.items():
            if name == length:
                continue
            own = self.index.lengths.where(F.col("field") == f).select("doc_id", F.col("length").alias(name))
            rows = rows.join(own, "doc_id", "left")
        # one row, whatever the size of the collection
        return rows.crossJoin(F.broadcast(stats)) if stats is not None else rows


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(0)


def _every(columns: list[Column]) -> Column:
    return reduce(Column.__and__, columns)


def plan(index: Index, expr: X.Node) -> Plan:
    """Validate and analyse a query."""
    faults = X.validate(expr)
    if faults:
        raise QueryValidationError(faults)
    p = Plan(index, X.simplify(expr))
    p.collect(p.expr)
    return p


def matching(index: Index, expr: X.Node) -> DataFrame:
    """(doc_id) of what the query matches."""
    p = plan(index, expr)
    return p.rows().where(p.matches(p.expr)).select("doc_id")


def counts(index: Index, expr: X.Node) -> DataFrame:
    """(doc_id, tf) of a term, synonym, window or lengths."""
    p = plan(index, expr)
    return p.rows().where(p.matches(p.expr)).select("doc_id", p.tf(p.expr).cast("int").alias("tf"))


def scores(index: Index, expr: X.Node, raw_counts: bool = False) -> DataFrame:
    """(doc_id, score) of what the query matches.

    A bare count has no score of its own; with ``raw_counts`` it scores itself.
    """
    p = plan(index, expr)
    if not raw_counts and any(isinstance(n, (*_COUNTED, X.Lengths)) for n in _scored(p.expr)):
        raise LexloomError("a bare count has no score: wrap it in BM25, LinearQL or DirQL, or ask for raw counts")
    return p.rows().where(p.matches(p.expr)).select("doc_id", p.score(p.expr).alias("score"))


def _scored(node: X.Node) -> list[X.Node]:
    """Nodes whose scores count."""
    if isinstance(node, (X.BM25, X.LinearQL, X.DirQL, X.Not)):
        return []
    if isinstance(node, (X.Require, X.Reject, X.Must)):
        return _scored(node.value)
    if isinstance(node, _COUNTED):
        return [node]
    return [node, *(x for c in node.children_of() for x in _scored(c))]
