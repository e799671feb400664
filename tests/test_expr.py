import math
import random

import pytest

from lexloom import expr as X
from lexloom.errors import LexloomError, UnknownIndexPartError, UnknownStemmerError
from lexloom.fields import Field


def samples():
    t = X.term("a")
    return [
        X.Require(t, X.bm25("b")), X.Reject(t, X.bm25("b")), X.Must(t, X.bm25("b")), X.And((t, t)), X.Or((t,)), X.Not(t), X.AlwaysMatch(), X.NeverMatch(), X.Sum((X.bm25("x"),)),
        X.Combine((X.bm25("x"),), (0.5,)), X.Mult((X.bm25("x"),)), X.Max((X.bm25("x"),)), X.weighted(2.0, X.bm25("x")), X.Text("a", "title.krovetz", "title", "Counts"), X.Lengths("title"),
        X.LongParam("n", 3), X.FloatParam("q", 0.5), X.phrase("a", "b"), X.UnorderedWindow((t,), None), X.UnorderedWindow((t, t), 8), X.Synonym((t, t)),
        X.BM25(t, 0.3, 1.1, X.CountStats(9, 3, 100, 10)), X.LinearQL(t, 0.4), X.DirQL(t, 1000.0),
    ]


@pytest.mark.parametrize("node", samples(), ids=lambda n: type(n).__name__)
def test_json_round_trip(node):
    assert X.from_json(X.to_json(node)) == node


def test_json_shape():
    assert X.to_dict(X.bm25("a"))["BM25"]["child"]["Text"]["term"] == "a"
    assert X.to_dict(X.LinearQL(X.term("a"), 0.1))["LinearQL"]["lambda"] == 0.1
    assert X.to_dict(X.AlwaysMatch()) == "AlwaysMatch"
    for bad in ('{"Nope": {}}', '{"Not": {}}', "[1]"):
        with pytest.raises(LexloomError):
            X.from_json(bad)


def test_all_faults_are_reported():
    bad = X.Sum((
        X.term(""), X.OrderedWindow((), 0), X.UnorderedWindow((), 1), X.weighted(-1.0, X.term("a")), X.Combine((), (math.nan, math.inf, -3.0)), X.BM25(X.term("a"), math.inf, math.nan),
        X.LinearQL(X.term("a"), math.nan), X.DirQL(X.term("a"), None, X.CountStats(1, 2, 0, 1)),
    ))
    kinds = [f.kind for f in X.validate(bad)]
    assert kinds == ["EmptyTerm", "OrderedWindowBadStep", "UnorderedWindowBadWidth", "NegativeWeight", "NaNWeight", "InfiniteWeight", "InfiniteWeight", "NaNWeight", "NaNWeight", "BadFrequencies", "BadLengths", "BadDocProb", "BadTermProb"]
    assert X.validate(X.bag_of_words(["a", "b"])) == []


def test_find_fields():
    assert X.find_fields(X.Sum((X.Text("a", "t"), X.Text("b", "t", "u"), X.Text("c")))) == {"t", "u"}


def evaluate(node, words):
    if isinstance(node, X.Text):
        return node.term in words
    if isinstance(node, X.And):
        return bool(node.children) and all(evaluate(c, words) for c in node.children)
    if isinstance(node, X.Or):
        return any(evaluate(c, words) for c in node.children)
    if isinstance(node, X.Not):
        return not evaluate(node.child, words)
    return isinstance(node, X.AlwaysMatch)


def test_simplify_keeps_what_matches():
    rng = random.Random(1)

    def tree(depth):
        kind = rng.choice([X.And, X.Or, X.Not, X.Text, X.AlwaysMatch, X.NeverMatch]) if depth else X.Text
        if kind in (X.And, X.Or):
            return kind(tuple(tree(depth - 1) for _ in range(rng.randrange(1, 4))))
        return X.Not(tree(depth - 1)) if kind is X.Not else kind(rng.choice("abc")) if kind is X.Text else kind()

    for _ in range(300):
        t = tree(4)
        s = X.simplify(t)
        assert all(evaluate(t, w) == evaluate(s, w) for w in ("", "a", "b", "ab", "abc", "c"))
    assert X.simplify(X.And((X.AlwaysMatch(), X.AlwaysMatch()))) == X.AlwaysMatch()
    assert X.simplify(X.Or((X.Or((X.term("a"), X.NeverMatch())), X.term("b")))) == X.Or((X.term("a"), X.term("b")))


def test_field_names():
    assert Field.parse(None) == Field.parse("document") == Field()
    assert Field.parse("title") == Field("title") and Field.parse("title.krovetz") == Field("title", "krovetz") and Field.parse("title.porter") == Field("title", "porter")
    assert Field.parse("postings.krovetz") == Field("document", "krovetz") and Field.parse("field.porter.x") == Field("x", "porter") and Field.parse("field.x") == Field("x") and Field.parse("postings") == Field()
    for bad in ("a.b.c", "field.a.b.c", "field.other.x"):
        with pytest.raises(UnknownIndexPartError):
            Field.parse(bad)
    with pytest.raises(UnknownStemmerError):
        Field.parse("title.lovins")


def test_statistics_average():
    assert X.CountStats(collection_length=10, document_count=4).average_doc_length() == 2.5
    assert X.CountStats().average_doc_length() == 0.0
