"""The pipeline's stages, each against what its operator says, and SQL oracles of the operators."""

import duckdb
import pytest

import corpus_pipeline
from lexloom.llm import decontaminate, langid, minhash, registry, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "retrieval_packing"]
    drops = [
        lambda d: {r.doc_id for r in langid.identify(d, langid.fit(d)).where("NOT accepted").collect()},
        lambda d: {r.doc_id for r in minhash.minhash_groups(d).where("NOT keep").collect()},
        lambda d: {r.doc_id for r in decontaminate.contamination(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()},
        lambda d: {r.doc_id for r in secrets.secret_scan(d).collect()},
    ]
    for (_, stage), dropped in zip(corpus_pipeline.STAGES, drops, strict=False):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert ids(kept) == ids(docs) - dropped(docs)
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(packed) == ids(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))


def run_over(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_empty_table(spark, tmp_path):
    assert run_over(spark, tmp_path, spark.read.parquet(f"{SF}/documents.parquet").limit(0)) == []


def test_edge_cases(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, window_id int, content string, `__out` int, blob_id int"
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    words = lambda p, n: " ".join(f"{p}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{p}" for k in range(n))
    texts = [
        (100, words("the", 40), "en"), (101, words("the", 40), "en"), (102, words("ing", 30), "en"), (102, words("ing", 30), "en"), (103, None, "en"), (104, "", "en"), (105, "123 !", None),
        (None, words("and", 30), "en"), (106, f"{words('wh', 20)} {passage} {words('oo', 20)}", "en"), (107, f"{words('on', 25)} token = 0123456789abcdef0123456789abcdef", "en"), (108, words("long", 30000), "en"),
        *((200 + k, f"{words('der', 20 + k)} {words('sch', 9 + k)}", "de") for k in range(3)), (109, words("of", 35), "en"), (109, words("or", 35), "en"),
    ]
    rows = [(i, t, lang, "s", None if t is None else len(t), None, None, None, None) for i, t, lang in texts]
    got = run_over(spark, tmp_path, spark.createDataFrame(rows, schema))
    ids = {r.doc_id for r in got}
    assert {100, 102, 108, 109} <= ids and not ids & {101, 103, 104, 105, 106, 107, None}
    assert sum(r.end_word - r.start_word for r in got if r.doc_id == 108) == 30000
    assert sum(r.end_word - r.start_word for r in got if r.doc_id == 102) == 30
    assert sum(r.end_word - r.start_word for r in got if r.doc_id == 109) == 70


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
