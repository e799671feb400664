import pytest

from lexloom.functions import columns, markup, stemmers

GOLD = [
    ("This is a bit of regular, tag-free English.", "this is a bit of regular tag free english", [0, 5, 8, 10, 14, 17, 26, 30, 35], [4, 7, 9, 13, 16, 24, 29, 34, 42]),
    ("This is a bit of regular, tag-free English.<!-- comments are skipped -->", "this is a bit of regular tag free english", None, None),
    ("&gt;home&lt;", "home", [4], [8]),
    ('This is a bit of <i>regular</i>, <a href="foo">tagged</a> English.', "this is a bit of regular tagged english", [0, 5, 8, 10, 14, 20, 47, 58], [4, 7, 9, 13, 16, 27, 53, 65]),
    ("U.S.A. umass.edu ph.d. 3.14 a.bc it's", "usa umass edu ph d 14 bc its", None, None),
    ("x <b><i>y</i></b>foo bar", "x y foo bar", None, None),
    ("a <style>p{m:0}</style>b <script>var t='</p>'</script>c", "a b c", None, None),
    ("a <?php hidden ?>b <!DOCTYPE html>c", "a b c", None, None),
    ("open <!-- never closed", "open", None, None),
    ("a < b & c <", "a", None, None),
    ("cafÉ " + "x" * 100 + " “my", "café “my", None, None),
    ('<x tokenizetagcontent="false">hidden <y>too</y></x>shown', "shown", None, None),
    ("", "", None, None),
]


@pytest.mark.parametrize("text,terms,begin,end", GOLD)
def test_markup_terms(text, terms, begin, end):
    d = markup.tokenize(text)
    assert d.terms == terms.split()
    if begin:
        assert (d.term_char_begin, d.term_char_end) == (begin, end)


def test_tags():
    d = markup.tokenize('<doc a=1 B="two words" c><p>one two</p> <br/>three <p>four', ["doc", "p", "br"])
    got = [(t.name, t.attributes, t.begin, t.end) for t in d.tags]
    # tags that are never closed hold nothing
    assert got == [("p", {}, 0, 2), ("doc", {"a": "1", "b": "two words", "c": ""}, 0, 0), ("br", {}, 2, 2), ("p", {}, 3, 3)]


def test_markup_columns(spark):
    df = spark.createDataFrame([(1, "<p>Hello World</p>"), (2, None)], "id long, text string")
    rows = {r.id: r for r in df.select("id", markup.markup_terms("text").alias("terms"), markup.markup_document("text", ["p"]).alias("d")).collect()}
    assert rows[1].terms == ["hello", "world"] and rows[2].terms is None
    assert rows[1].d.tags[0].name == "p" and rows[2].d.terms == []


def test_native_tokenizers(spark):
    df = spark.createDataFrame([("  The quick fox  jumps&amp;ok ",), ("",)], "text string")
    got = df.select(columns.whitespace_tokens("text"), columns.unicode_tokens("text"), columns.skip_entities("text")).collect()
    assert got[0][0] == ["the", "quick", "fox", "jumps&amp;ok"] and got[0][1] == ["the", "quick", "fox", "jumps", "amp", "ok"] and "jumps ok" in got[0][2]
    assert got[1][0] == []


def test_gaps_round_trip(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],), ([5, 5, 9],)], "v array<int>")
    got = df.select(columns.gaps("v").alias("g"), "v").select("g", columns.ungap("g"), "v").collect()
    assert got[0][0] == [1, 1, 1, 1] and all(list(r[1]) == list(r[2]) for r in got)
    with pytest.raises(Exception, match="sorted"):
        spark.createDataFrame([([3, 1],)], "v array<int>").select(columns.gaps("v")).collect()


def test_tag_order(spark):
    df = spark.createDataFrame([([(2, 3), (1, 2), (1, 5)],)], "t array<struct<begin:int,end:int>>")
    assert [tuple(t) for t in df.select(columns.sort_tags("t")).first()[0]] == [(1, 5), (1, 2), (2, 3)]


WORDS = "aide aid cross lacrosse die age step aging flee special ability capacity immune positive reduce compensate determine injunction bibliography amplify eliminate item have grow regulate hypo warehouse pause people hat throw require quiet methodical canonical".split()
LEXICON = stemmers.lexicon([(w, None, False) for w in WORDS] + [("fled", "flee", True), ("aging", "age", True), ("died", "die", True), ("aide", "aide", True)])


@pytest.mark.parametrize("word,stem", [
    ("aides", "aide"), ("aided", "aid"), ("crosses", "cross"), ("lacrosse", "lacrosse"), ("fled", "flee"), ("died", "die"), ("aging", "age"), ("positivity", "positive"), ("immunity", "immune"),
    ("capacity", "capacity"), ("amplification", "amplify"), ("elimination", "eliminate"), ("bibliographical", "bibliography"), ("injunctive", "injunction"), ("determinative", "determine"),
    ("compensable", "compensate"), ("canonic", "canonical"), ("cookies", "cooky"), ("x", "x"), ("Cafés", "cafés"), ("a1s", "a1s"), ("steps", "step"), ("stepping", "step"), ("growing", "grow"), ("methodically", "methodical"),
])
def test_dictionary_stemmer(word, stem):
    assert stemmers.Krovetz(LEXICON)(word) == stem


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("consigning", "consign"), ("hopping", "hop"), ("hoped", "hope"), ("relational", "relat"), ("happiness", "happi"), ("skies", "sky"), ("dying", "die"), ("generously", "generous"), ("electricity", "electr"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("youth's", "youth")])
def test_suffix_stemmer(word, stem):
    assert stemmers.porter2(word) == stem


def test_vocabulary_is_stemmed_once(spark):
    df = spark.createDataFrame([("hoped",), ("hoped",), (None,), ("hopping",)], "term string")
    assert {tuple(r) for r in stemmers.stem_vocabulary(df, stemmers.porter2).collect()} == {("hoped", "hope"), ("hopping", "hop")}
    assert {r[1] for r in stemmers.stem_vocabulary(df, stemmers.null_stem).collect()} == {"hoped", "hopping"}


def test_sums_of_long_gaps_are_one_pass(spark):
    """Each step copied what was summed up so far."""
    rows = [(1, list(range(0, 600_000, 3))), (2, []), (3, None), (4, [5]), (5, [-2, 0, 0])]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    got = df.select("k", columns.ungap(columns.gaps("v")).alias("v"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.v for r in got.collect()} == dict(rows)
    odd = spark.createDataFrame([([1, None, 2],), (None,)], "v array<bigint>").select(columns.ungap("v").alias("v"))
    assert [r.v for r in odd.collect()] == [[1, None, None], None]


def test_gaps_are_one_pass(spark):
    df = spark.createDataFrame([([4, 4, 9],), ([3, None, 5],), (None,), ([],)], "v array<int>")
    got = df.select(columns.gaps("v").alias("v"))
    assert [r.v for r in got.collect()] == [[4, 0, 5], [3, None, None], None, []]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") == 1 and "zip_with" not in plan


def test_tokens_of_pages_are_made_in_slices(spark):
    """Python objects of one slice exist at a time, however many pages a batch has."""
    import pyarrow as pa

    own = ["a" * 1000, None, "b" * (2 * markup.SLICE), *(["c" * 5000] * 500)]
    parts = list(markup._slices(pa.array(own)))
    assert [t for part in parts for t in part] == [t or "" for t in own]
    assert all(sum(map(len, part[:-1])) < markup.SLICE for part in parts) and len(parts) > 9
    pages = spark.createDataFrame([(k, f"<p class='x'>word{k} and</p>" * 3000 if k % 3 else None) for k in range(30)], "k int, html string").coalesce(1)
    got = {r.k: r.d for r in pages.select("k", markup.markup_document("html", ("p",)).alias("d")).collect()}
    assert all(len(got[k].terms) == (6000 if k % 3 else 0) and len(got[k].tags) == (3000 if k % 3 else 0) for k in range(30))
    assert got[1].tags[0].attributes == {"class": "x"} and got[1].terms[:2] == ["word1", "and"]
