"""The index and the compiler against brute force on random documents."""

import math
import random
from dataclasses import replace

import pytest

from lexloom import expr as X
from lexloom import search
from lexloom.errors import LexloomError, MissingFieldError, QueryValidationError
from lexloom.fields import Field
from lexloom.functions import stemmers
from lexloom.operators.index import FieldSpec, IndexSchema, build_index, open_index, write_index
from lexloom.plans import compiler
from lexloom.streaming.segments import append_segment, stream_into_index

RNG = random.Random(11)
DOCS = [(d, " ".join(RNG.choice("abcde") for _ in range(RNG.randrange(0, 14))), RNG.choice([None, 3, 7]), RNG.choice(["en", "fr", None])) for d in range(60)]
BODY = {d: t.split() for d, t, _, _ in DOCS}
AVG = sum(map(len, BODY.values())) / len(BODY)


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, body string, size int, lang string")
    return build_index(df, IndexSchema().declare("body").declare("size", "sparse_int").declare("lang", "categorical", stored=True)).cache()


def t(term):
    return X.Text(term, "body")


def starts_ordered(words, terms, step):
    def reach(p, rest):
        return not rest or any(words[q] == rest[0] and reach(q, rest[1:]) for q in range(p + 1, min(len(words), p + step + 1)))

    return [p for p, w in enumerate(words) if w == terms[0] and reach(p, terms[1:])]


def starts_unordered(words, terms, width):
    return [p for p, w in enumerate(words) if w in terms and all(x in words[p : p + width] for x in terms)]


def count(node, words):
    if isinstance(node, X.Text):
        return words.count(node.term)
    terms = [c.term for c in node.children]
    if isinstance(node, X.Synonym):
        return sum(map(words.count, terms))
    if isinstance(node, X.OrderedWindow):
        return len(starts_ordered(words, terms, node.step))
    return min(map(words.count, terms)) if node.width is None else len(starts_unordered(words, terms, node.width))


COUNTED = [t("a"), t("zz"), X.Synonym((t("a"), t("b"))), X.OrderedWindow((t("a"), t("b")), 1), X.OrderedWindow((t("a"), t("b"), t("a")), 3), X.UnorderedWindow((t("a"), t("b"), t("c")), 4), X.UnorderedWindow((t("d"), t("e")))]


@pytest.mark.parametrize("node", COUNTED, ids=repr)
def test_counts(index, node):
    want = {d: n for d, w in BODY.items() if (n := count(node, w))}
    assert {r.doc_id: r.tf for r in compiler.counts(index, node).collect()} == want


def bm25(node, words, k=1.2, b=0.75):
    tf, df = count(node, words), sum(count(node, w) > 0 for w in BODY.values())
    return math.log(len(BODY) / (df + 0.5)) * tf * (k + 1) / (tf + k * (1 - b + b * len(words) / AVG)) if tf else 0.0


@pytest.mark.parametrize("node", COUNTED, ids=repr)
def test_bm25(index, node):
    want = {d: bm25(node, w, 1.5, 0.5) for d, w in BODY.items() if count(node, w)}
    assert {r.doc_id: r.score for r in compiler.scores(index, X.BM25(node, 0.5, 1.5)).collect()} == pytest.approx(want)


def matches(node, d):
    words = BODY[d]
    if isinstance(node, X.And):
        return all(matches(c, d) for c in node.children)
    if isinstance(node, X.Or):
        return any(matches(c, d) for c in node.children)
    if isinstance(node, X.Not):
        return not matches(node.child, d)
    if isinstance(node, (X.Require, X.Must)):
        return matches(node.cond, d) and matches(node.value, d)
    if isinstance(node, X.Reject):
        return not matches(node.cond, d) and matches(node.value, d)
    if isinstance(node, (X.AlwaysMatch, X.NeverMatch)):
        return isinstance(node, X.AlwaysMatch)
    return count(node, words) > 0


def test_random_boolean_trees(index):
    rng = random.Random(3)

    def tree(depth):
        kind = rng.choice(["and", "or", "not", "req", "rej", "must", "leaf", "all", "none"]) if depth else "leaf"
        many = lambda: tuple(tree(depth - 1) for _ in range(rng.randrange(1, 3)))
        two = lambda: (tree(depth - 1), tree(depth - 1))
        return {"and": lambda: X.And(many()), "or": lambda: X.Or(many()), "not": lambda: X.Not(tree(depth - 1)), "req": lambda: X.Require(*two()), "rej": lambda: X.Reject(*two()), "must": lambda: X.Must(*two()), "leaf": lambda: rng.choice(COUNTED), "all": X.AlwaysMatch, "none": X.NeverMatch}[kind]()

    for _ in range(12):
        node = tree(3)
        assert {r.doc_id for r in compiler.matching(index, node).collect()} == {d for d in BODY if matches(node, d)}, node


def test_query_likelihood(index):
    cl = sum(map(len, BODY.values()))
    cf = {x: sum(w.count(x) for w in BODY.values()) for x in "ab"}
    some = {d: w for d, w in BODY.items() if set(w) & {"a", "b"}}
    dirichlet = {d: sum(math.log((w.count(x) + 20 * cf[x] / cl) / (len(w) + 20)) for x in "ab") for d, w in some.items()}
    assert {r.doc_id: r.score for r in compiler.scores(index, X.Sum((X.DirQL(t("a"), 20.0), X.DirQL(t("b"), 20.0)))).collect()} == pytest.approx(dirichlet)
    linear = {d: sum(math.log(0.3 * w.count(x) / len(w) + 0.7 * cf[x] / cl) for x in "ab") for d, w in some.items()}
    assert {r.doc_id: r.score for r in compiler.scores(index, X.Sum((X.LinearQL(t("a")), X.LinearQL(t("b")), X.LinearQL(t("zz"))))).collect()} == pytest.approx(linear)


def test_arithmetic(index):
    a, b = X.BM25(t("a")), X.BM25(t("b"))
    some = [d for d, w in BODY.items() if set(w) & {"a", "b"}]
    for node, f in [(X.Combine((a, b, a), (2.0, -1.0)), lambda x, y: 2 * x - y), (X.Max((a, b)), max), (X.Mult((a, b)), lambda x, y: x * y), (X.Or((a, b)), lambda x, y: x + y), (X.Weighted(3.0, X.Sum((a, b))), lambda x, y: 3 * (x + y))]:
        want = {d: f(bm25(t("a"), BODY[d]), bm25(t("b"), BODY[d])) for d in some}
        assert {r.doc_id: r.score for r in compiler.scores(index, node).collect()} == pytest.approx(want)
    sizes = {d: float(n or 5) for d, _, n, _ in DOCS}
    assert {r.doc_id: r.score for r in compiler.scores(index, X.LongParam("size", 5)).collect()} == sizes
    assert {r.doc_id: r.tf for r in compiler.counts(index, X.Lengths("body")).collect()} == {d: len(w) for d, w in BODY.items() if True}


def test_statistics_can_be_given(index):
    s = X.CountStats(100, 50, 1000, 200)
    got = {r.doc_id: r.score for r in compiler.scores(index, X.BM25(t("a"), stats=s)).collect()}
    want = {d: math.log(200 / 50.5) * (n := w.count("a")) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / 5)) for d, w in BODY.items() if "a" in w}
    assert got == pytest.approx(want)


def test_top_k_order(spark):
    df = spark.createDataFrame([(1, 0.6), (2, 0.8), (3, 0.7), (4, 0.8), (5, float("nan"))], "doc_id long, score double")
    assert [r.doc_id for r in search.top(df, 10).collect()] == [2, 4, 3, 1, 5]
    assert [r.doc_id for r in search.top(df, 2).collect()] == [2, 4]


def test_search_and_batch_agree(spark, index):
    queries = spark.createDataFrame([("q1", "a b a"), ("q2", "e zz"), ("q3", "!!"), ("q4", None)], "query_id string, text string")
    got = {}
    for r in search.search_batch(index, queries, 5, "body").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    for q, text in (("q1", "a b a"), ("q2", "e zz")):
        assert [(r.doc_id, round(r.score, 9)) for r in search.search_text(index, text, 5, "body").collect()] == got[q]
    assert set(got) == {"q1", "q2"}
    assert search.search(index, []).count() == 0


def test_explain(index):
    node = X.Combine((X.BM25(t("a")), X.BM25(t("b"))), (1.0, 2.0))
    d = next(d for d, w in BODY.items() if "a" in w and "b" not in w)
    rows = search.explain(index, node, d).collect()
    assert [(r.path, r.node, r.matched) for r in rows] == [("0", "Combine", True), ("0.0", "BM25", True), ("0.0.0", "Text", True), ("0.1", "BM25", False), ("0.1.0", "Text", False)]
    assert rows[0].score == pytest.approx(bm25(t("a"), BODY[d])) and f"tf={BODY[d].count('a')}" in rows[2].info


def test_errors(index):
    with pytest.raises(QueryValidationError) as e:
        compiler.scores(index, X.Sum((X.term(""), X.BM25(X.term(""), math.nan))))
    assert len(e.value.faults) == 3
    with pytest.raises(MissingFieldError):
        compiler.matching(index, X.Text("a", "nofield"))
    with pytest.raises(LexloomError, match="bare count"):
        compiler.scores(index, t("a"))
    assert {r.score for r in compiler.scores(index, t("a"), raw_counts=True).collect()} == {float(w.count("a")) for w in BODY.values() if "a" in w}
    with pytest.raises(LexloomError, match="more than one field"):
        compiler.scores(index, X.BM25(X.Synonym((t("a"), X.Text("en", "lang")))))
    with pytest.raises(LexloomError):
        FieldSpec("nokind")
    assert str(LexloomError("bad").with_context("here")) == "here: bad"


def test_two_documents(spark):
    df = spark.createDataFrame([(0, "doc0", "hello world hello"), (1, "doc1", "hello yolo yolo yolo"), (None, "x", "lost"), (2, "doc2", None)], "doc_id long, id string, body string")
    i = build_index(df, IndexSchema().declare("id", "categorical", stored=True).declare("body", stored=True), name="id")
    got = {(r.term, r.doc_id): r.positions for r in i.postings.where("field = 'body'").collect()}
    assert got == {("hello", 0): [0, 2], ("world", 0): [1], ("hello", 1): [0], ("yolo", 1): [1, 2, 3]}
    assert {r.term: (r.df, r.cf, r.max_tf) for r in i.vocabulary().where("field = 'body'").collect()} == {"hello": (2, 3, 2), "world": (1, 1, 1), "yolo": (1, 3, 3)}
    assert {r.doc_id: r.length for r in i.lengths_of("body").collect()} == {0: 3, 1: 4, 2: 0}
    assert i.lookup_id("doc1").first().doc_id == 1 and i.lookup_name(0).first().name == "doc0" and i.lookup_document(1).first().body.startswith("hello yolo")
    s = i.field_stats().first()
    assert (s.document_count, s.nonzero, s.collection_length, s.min_length, s.max_length) == (3, 2, 7, 0, 4)


def test_written_index_and_segments(spark, tmp_path, index):
    df = spark.createDataFrame(DOCS, "doc_id long, body string, size int, lang string")
    schema = IndexSchema().declare("body").declare("size", "sparse_int").declare("lang", "categorical", stored=True)
    path = f"file://{tmp_path}/index"
    for k in range(3):
        write_index(build_index(df.where(f"doc_id % 3 = {k}"), schema), path, k)
    opened = open_index(spark, path)
    for node in (X.BM25(t("a")), X.Combine((X.BM25(X.phrase("a", "b", field="body")), X.BM25(t("c"))), (1.0, 2.0))):
        assert {r.doc_id: r.score for r in compiler.scores(opened, node).collect()} == pytest.approx({r.doc_id: r.score for r in compiler.scores(index, node).collect()})
    plan = opened.postings_of("a", "body", "Counts")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,a)" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    # a segment that is delivered again replaces itself
    append_segment(df.where("doc_id % 3 = 1"), schema, path, 1)
    assert open_index(spark, path).documents.count() == len(DOCS)


def test_streamed_index(spark, tmp_path):
    df = spark.createDataFrame([(k, f"term{k % 3} shared") for k in range(9)], "doc_id long, body string")
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    schema = IndexSchema().declare("body")
    for k in range(2):
        df.where(f"doc_id % 2 = {k}").write.mode("append").parquet(source)
        q = stream_into_index(spark.readStream.schema(df.schema).parquet(source), schema, path, f"file://{tmp_path}/state", availableNow=True)
        q.awaitTermination()
    opened = open_index(spark, path)
    assert {r.doc_id for r in opened.postings_of("shared", "body").collect()} == set(range(9))


def test_stemmed_view(spark):
    df = spark.createDataFrame([(1, "hoped hopes hoping"), (2, "hope")], "doc_id long, body string")
    i = build_index(df, IndexSchema().declare("body"))
    view = i.with_stems(stemmers.stem_vocabulary(i.postings, stemmers.porter2), "porter", "body")
    assert Field("body", "porter") in view.fields
    assert {r.doc_id: r.positions for r in view.postings_of("hope", "body.porter").collect()} == {1: [0, 1, 2], 2: [0]}
    assert {r.doc_id for r in compiler.scores(view, X.BM25(X.Text("hope", "body.porter"))).collect()} == {1, 2}
    assert [r.doc_id for r in view.postings_of("hope", "body").collect()] == [2]


def test_levels(spark):
    df = spark.createDataFrame([(1, "a a b")], "doc_id long, body string")
    for level, want in (("Docs", (1, None)), ("Counts", (2, None)), ("Positions", (2, [0, 1]))):
        i = build_index(df, IndexSchema().declare("body", level=level))
        r = i.postings.where("term = 'a'").first()
        assert (r.tf, r.positions) == want


def test_one_scan_and_one_shuffle_for_a_bag_of_words(spark, index):
    df = spark.createDataFrame(DOCS, "doc_id long, body string, size int, lang string")
    lazy = build_index(df, IndexSchema().declare("body"))
    rows = compiler.plan(lazy, X.Or(tuple(map(t, "abcd")))).counted()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 2 and "BroadcastNestedLoopJoin" not in plan


def jobs(spark, of):
    """What ran since: names of the operators in the plans of a lazy result."""
    return of._jdf.queryExecution().executedPlan().toString()


def test_written_without_a_shuffle_of_postings(spark, tmp_path):
    """A segment is written where it was made, sorted by term inside a batch; lengths come from the same pass."""
    df = spark.createDataFrame([(d, t) for d, t, _, _ in DOCS], "doc_id long, body string").repartition(3)
    lazy = build_index(df, IndexSchema().declare("body"))
    write_index(lazy, str(tmp_path / "i"))
    i = open_index(spark, str(tmp_path / "i"))
    assert {r.doc_id: r.length for r in i.lengths_of("body").collect()} == {d: len(w) for d, w in BODY.items()}
    assert i.postings.where("length IS NULL OR term IS NULL").count() == 0
    assert {(r.term, r.doc_id): r.length for r in i.postings.collect()} == {(x, d): len(w) for d, w in BODY.items() for x in w}
    for part in (tmp_path / "i" / "postings" / "segment=0" / "stemmer=__HIVE_DEFAULT_PARTITION__" / "field=body").glob("*.parquet"):
        terms = [r.term for r in spark.read.parquet(f"file://{part}").where("term IS NOT NULL").collect()]
        assert terms == sorted(terms)


def test_term_lengths_are_stored(spark, index, tmp_path):
    write_index(index, str(tmp_path / "i"))
    i = open_index(spark, str(tmp_path / "i"))
    got = i.term_lengths()
    assert "Join" not in jobs(spark, got)
    want = {x: (min(len(w) for w in BODY.values() if x in w), max(len(w) for w in BODY.values() if x in w)) for x in "abcde"}
    assert {r.term: (r.min_length, r.max_length) for r in got.where("field = 'body'").collect()} == want
    assert got.where("field = 'lang'").count() == 0


def test_scores_read_the_postings_once(spark, index, tmp_path):
    write_index(index, str(tmp_path / "i"))
    i = open_index(spark, str(tmp_path / "i"))
    node = X.Require(t("a"), X.BM25(t("b")))
    got = compiler.scores(i, node)
    plan = jobs(spark, got)
    assert plan.count("FileScan parquet") == 3  # postings, vocabulary, statistics
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx({d: bm25(t("b"), w) for d, w in BODY.items() if {"a", "b"} <= set(w)})


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_batch_stays_in_its_part(spark, index, tmp_path, monkeypatch, cells):
    """The k best of each query, ties by doc_id, whatever part of the documents is scored at a time."""
    write_index(index, str(tmp_path / "i"))
    i = open_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([("q1", "a b b"), ("q2", "e"), ("q3", "zz"), (None, "a"), ("q4", None), ("q5", "c zz d")], "query_id string, text string")
    monkeypatch.setattr(search, "BATCH_WEIGHTS", 0)
    want = search.search_batch(i, asked, 4, "body")
    assert "Join" in jobs(spark, want) and "MapInArrow" not in jobs(spark, want)
    monkeypatch.setattr(search, "BATCH_WEIGHTS", 1000)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "PRODUCTS", cells)
    got = search.search_batch(i, asked, 4, "body")
    assert "MapInArrow" in jobs(spark, got)
    plain = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) == 12


def test_stems_of_one_term_read_no_postings(spark, tmp_path):
    df = spark.createDataFrame([(1, "runs running ran"), (2, "run the"), (3, "the the")], "doc_id long, body string")
    write_index(build_index(df, IndexSchema().declare("body")), str(tmp_path / "i"))
    i = open_index(spark, str(tmp_path / "i"))
    got = i.stem_counts(stemmers.stem_vocabulary(i.vocabulary(), stemmers.porter2), "body")
    assert {(r.term, r.df, r.cf) for r in got.collect()} == {("run", 2, 3), ("ran", 1, 1), ("the", 2, 3)}
    # the others come from the vocabulary alone
    bare = replace(i, postings=i.postings.limit(0)).stem_counts(stemmers.stem_vocabulary(i.vocabulary(), stemmers.porter2), "body")
    assert {(r.term, r.df, r.cf) for r in bare.collect()} == {("ran", 1, 1), ("the", 2, 3)}
