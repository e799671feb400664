"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import automaton, decontaminate, embeddings, langid, minhash, packing, pii, secrets, suffix_array, wrappers

CLASH = "anchor string, segment int, hub long, bucket string, shard string, blob_id int, path string, own int, wanted string, group_id string, of string, n_shards string, tile int, host string, stream string, draw string, content string, is_first string, start_word string, __dropped int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

PASSAGE = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"long{k * 7919 % 100003} tail{k}" for k in range(60_000))
SECRET = 'token = "0123456789abcdef0123456789abcdef01234567"'


def rows():
    texts = [
        (1, f"begin here {PASSAGE} and so on", "en"), (2, f"another one {PASSAGE} until the end", "en"), (3, None, "en"), (None, f"no id {PASSAGE}", "en"), (4, "", "en"), (5, "   \n\t ", None),
        (6, LONG, "en"), (7, "x", "en"), (7, "x", "en"), (8, "Der Hund und die Katze sind im Haus " * 4, "de"), (9, "Der Hund und die Katze sind im Haus " * 4, "de"), (10, SECRET, "en"),
        (11, "mail to anna.smith@mail.example.com or +1 (743) 555-3824 from 8.196.197.208", None), (12, "😀 \U0001f600 ---", "en"), (13, LONG, "en"), (None, None, None),
    ]
    return [(i, t, lang, "src", None if t is None else len(t), *([None] * (len(NAMES) - 5))) for i, t, lang in texts]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, edge, empty):
    bench = spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (3, "", 0), (4, "x", 0), (None, "word1", 0), (5, PASSAGE, 1), (6, "!!", 0)], "item_id long, text string, doc_id long")
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contamination(edge, bench).collect()}
    assert found == {(1, 1, 0), (2, 1, 0), (1, 5, 0), (2, 5, 0), (7, 4, 0)}
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns
    assert kept.count() == len(rows()) - 4
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edge, bench.limit(0)).count() == 0


def test_language(spark, edge, empty):
    model = langid.fit(edge)
    found = {(r.doc_id, r.language, r.accepted) for r in langid.identify(edge, model).collect()}
    assert langid.identify(edge, model).count() == len(rows())
    assert {(3, "und", False), (4, "und", False), (5, "und", False), (12, "und", False), (8, "de", True)} <= found
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} & {3, 4, 5, 12} == set()
    assert langid.fit(empty) is None
    assert langid.keep_identified(empty).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.language for r in langid.identify(unlabelled, langid.fit(unlabelled)).collect()} == {"und"}


def test_packing(edge, empty):
    got = packing.retrieval_packing(edge, window=100).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.end_word - r.start_word
    want = {r[0]: len(r[1].split()) for r in rows() if r[0] is not None and r[1] and r[1].split()}
    assert words == want
    assert packing.retrieval_packing(empty).count() == 0


@pytest.mark.parametrize("dedup", [automaton.substring_dedup, suffix_array.suffix_array_dedup])
def test_substrings(edge, empty, dedup):
    found = dedup(edge).collect()
    # rows without an id hold no window; 1 and 2 share a passage, 6 and 13 are copies
    assert {r.doc_id for r in found} == {1, 2, 6, 13}
    assert dedup(empty).count() == 0


def test_removed_text(edge):
    text = {r.doc_id: r.text for r in automaton.substring_dedup(edge).collect()}
    assert text[1] == rows()[0][1]
    assert text[2] == "another one until the end"
    assert text[13] == ""


def test_minhash(edge, empty):
    got = {(r.doc_id, r.group_id, r.group_size, r.keep) for r in minhash.minhash_groups(edge).collect()}
    assert {(6, 6, 2, True), (13, 6, 2, False), (8, 8, 2, True), (9, 8, 2, False), (1, 1, 2, True), (2, 1, 2, False)} == got
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len(rows()) - 3
    assert minhash.minhash_groups(empty).count() == 0


def test_pii(edge, empty):
    got = {r.doc_id: r for r in pii.replace_personal_data(edge).collect() if r.doc_id is not None}
    assert got[11].n_replaced == 3
    assert not any(x in got[11].text for x in ("anna.smith", "555-3824", "8.196.197.208"))
    assert got[3].text is None and got[4].text == "" and got[6].text == LONG and got[1].text == rows()[0][1]
    assert pii.replace_personal_data(edge).count() == len(rows())
    assert pii.replace_personal_data(empty).count() == 0
    # exceptions by a join instead of a broadcast give the same
    joined = {(r.doc_id, r.text) for r in pii.replace_personal_data(edge, broadcast_rows=-1).collect()}
    assert joined == {(r.doc_id, r.text) for r in pii.replace_personal_data(edge).collect()}


def test_secrets(edge, empty):
    got = secrets.secret_scan(edge).collect()
    assert [(r.doc_id, r.path, r.rule, r.n_matches) for r in got] == [(10, "src/10", "assigned-credential", 1)]
    kept = secrets.drop_secrets(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len(rows()) - 1
    assert secrets.secret_scan(empty).count() == 0
    assert secrets.drop_secrets(empty).count() == 0


def test_wrappers(spark):
    schema = "page_id long, url string, html string, host string, stream string, stats int, of string, slot int"
    pages = [(1, "http://a.example/1", "<html><body><p>one</p></body></html>"), (2, "http://a.example/2", "<html><body><p>two</p></body></html>"), (3, None, None), (4, "http://a.example/3", ""), (None, "x", "<p>no id"), (5, "http://b.example", "<" * 5000), (1, "http://a.example/1", "<html><body><p>one</p></body></html>")]
    df = spark.createDataFrame([(*p, *([None] * 5)) for p in pages], schema)
    got = sorted(((r.page_id or 0), r.host, r.text) for r in wrappers.extract(df).collect())
    assert (1, "a.example", "one") in got and (2, "a.example", "two") in got and (3, "", "") in got and (4, "a.example", "") in got and (0, "", "no id") in got
    assert len(got) == len(pages)
    assert wrappers.extract(df.limit(0)).count() == 0
    wrappers_limit, wrappers.BROADCAST_CHARS = wrappers.BROADCAST_CHARS, -1
    try:
        assert sorted(((r.page_id or 0), r.host, r.text) for r in wrappers.extract(df).collect()) == got
    finally:
        wrappers.BROADCAST_CHARS = wrappers_limit


def test_embeddings(spark):
    schema = "vec_id long, embedding array<float>, label int, tile int, v string, home int, guest string, cell int"
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (None, [1.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 0.0]), (7, [1.0]), (8, [0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(*v, *([None] * 6)) for v in vectors], schema)
    got = {(r.vec_id, r.first_id, r.n_partners, r.keep) for r in embeddings.embedding_near_dedup(df).collect()}
    assert got == {(1, 2, 1, True), (2, 1, 1, False), (7, None, 0, True), (8, None, 0, True)}
    assert embeddings.embedding_near_dedup(df.limit(0)).count() == 0
