"""Ranked search, batches of queries, score explanations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import expr as X
from .errors import LexloomError
from .functions.columns import whitespace_tokens
from .functions.markup import tokenize_to_terms
from .operators.index import TOKENIZERS, Index
from .plans import compiler
from .storage import materialize

TOP = 1000


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents: score descending, then doc_id; a NaN score counts as the lowest."""
    order = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    return scored.orderBy(order.desc(), F.col("doc_id").asc()).limit(k)


def search(index: Index, query: X.Node | list[str], k: int = TOP, raw_counts: bool = False) -> DataFrame:
    """(doc_id, score) of the k best documents for an expression, or for terms by BM25."""
    if isinstance(query, list):
        query = X.bag_of_words(query)
    if isinstance(query, X.Combine) and not query.children:
        query = X.NeverMatch()
    return top(compiler.scores(index, query, raw_counts), k)


def query_terms(index: Index, text: str, field: str | None = None, markup: bool = True) -> list[str]:
    """Terms of a free-text query: by the markup tokenizer, or as the field's own tokenizer splits."""
    if markup:
        return tokenize_to_terms(text)
    spec = index.schema.fields.get(index.field(field).name) if index.schema else None
    tokens = TOKENIZERS[spec.tokenizer if spec else "whitespace"]
    return list(index.spark.createDataFrame([(text,)], "text string").select(tokens(F.col("text")).alias("terms")).first()["terms"] or [])


def search_text(index: Index, text: str, k: int = TOP, field: str | None = None, markup: bool = False) -> DataFrame:
    """Free text: terms, BM25 of each, added up."""
    return search(index, X.bag_of_words(query_terms(index, text, field, markup), field), k)


def search_counted(index: Index, query: X.Node | list[str], k: int = TOP) -> tuple[DataFrame, int]:
    """The k best documents, and how many were scored in all."""
    if isinstance(query, list):
        query = X.bag_of_words(query)
    scored = materialize(compiler.scores(index, query), "search-scored")
    return top(scored, k), scored.count()


def estimate_df(index: Index, node: X.Node) -> DataFrame:
    """(low, high): bounds of how many documents a counted node or filter matches, from the vocabulary alone."""
    terms = {(index.field(n.field), n.term) for n in X.walk(node) if isinstance(n, X.Text)}
    wanted = reduce(Column.__or__, ((F.col("stemmer") == f.stemmer) & (F.col("field") == f.name) & (F.col("term") == t) for f, t in terms), F.lit(False))
    df = F.coalesce("df", F.lit(0))
    every = [F.coalesce(F.max(F.when((F.col("stemmer") == f.stemmer) & (F.col("field") == f.name) & (F.col("term") == t), df)), F.lit(0)) for f, t in sorted(terms)]
    if isinstance(node, (X.Text, X.And, X.OrderedWindow, X.UnorderedWindow)) and all(isinstance(c, X.Text) for c in node.children_of()) and every:
        low = every[0] if isinstance(node, X.Text) else F.lit(0).cast("long")
        return index.vocabulary().where(wanted).agg(low.alias("low"), (F.least(*every) if len(every) > 1 else every[0]).alias("high"))
    if isinstance(node, (X.Or, X.Synonym)) and all(isinstance(c, X.Text) for c in node.children_of()) and every:
        return index.vocabulary().where(wanted).agg((F.greatest(*every) if len(every) > 1 else every[0]).alias("low"), reduce(Column.__add__, every).alias("high"))
    raise LexloomError(f"no estimate for {type(node).__name__}")


def search_batch(index: Index, queries: DataFrame, k: int = TOP, field: str | None = None, b: float = compiler.B, k1: float = compiler.K, tokens=whitespace_tokens) -> DataFrame:
    """(query_id, doc_id, score, rank) for a table of queries (query_id, text), by BM25.

    Only postings of terms of the queries are read; a stored index gives their document counts and the statistics.
    """
    f = index.field(field)
    wanted = queries.where("query_id IS NOT NULL AND text IS NOT NULL").select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    own = (F.col("stemmer") == f.stemmer) & (F.col("field") == f.name)
    postings = index.postings.where(own).select("term", "doc_id", "tf", *(["length"] if "length" in index.postings.columns else []))
    known = index.field_stats().where(F.col("field") == f.name)
    stats = known.agg(F.coalesce(F.sum("document_count"), F.lit(0)).alias("n"), F.coalesce(F.sum("collection_length"), F.lit(0)).alias("cl"))
    df = index.vocabulary().where(own).select("term", "df")
    if "length" not in postings.columns:
        postings = postings.join(index.lengths_of(field), "doc_id")
    asked = wanted.limit(BATCH_WEIGHTS + 1).collect() if k <= BATCH_TOP else []
    if asked and len(asked) <= BATCH_WEIGHTS:
        totals = _best_of_parts(index.spark, asked, queries.schema["query_id"].dataType, postings, df, stats, k, b, k1)
    else:
        scored = postings.join(wanted.join(df, "term"), "term").crossJoin(F.broadcast(stats))
        tf = F.col("tf").cast("double")
        relative = F.when(F.col("cl") > 0, F.col("length") / (F.col("cl") / F.col("n"))).otherwise(F.lit(0.0))
        value = F.col("times") * F.log(F.col("n") / (F.col("df") + F.lit(0.5))) * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * relative))
        totals = scored.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Terms of queries, and results of a query, up to which all queries are scored at once against a part of the documents; beyond them pairs are joined.
BATCH_WEIGHTS, BATCH_TOP = 1_000_000, 1_000
#: Scores, and products that are added up to them, in memory at a time.
CELLS, PRODUCTS = 1 << 20, 1 << 21


def _best_of_parts(spark, asked: list, kind, postings: DataFrame, df: DataFrame, stats: DataFrame, k: int, b: float, k1: float) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of each query in each part of the documents, every document scored.

    Postings of the queries' terms are parted by document; pairs of queries and documents stay inside a part.
    """
    terms = sorted({r["term"] for r in asked})
    code = {t: c for c, t in enumerate(terms)}
    ids = list(dict.fromkeys(r["query_id"] for r in asked))
    number = {q: i for i, q in enumerate(ids)}
    codes = F.broadcast(spark.createDataFrame(list(code.items()), "term string, code int"))
    frequency = np.zeros(len(terms))
    for r in df.join(codes, "term").select("code", "df").collect():
        frequency[r["code"]] = r["df"]
    n, cl = stats.first()
    asked = sorted((code[r["term"]], number[r["query_id"]], r["times"]) for r in asked)
    at, query, times = (np.array([x[j] for x in asked]) for j in range(3))
    with np.errstate(divide="ignore"):
        weight = times * np.log(n / (frequency[at] + 0.5))
    first = np.searchsorted(at, np.arange(len(terms) + 1))
    score = _scorer(first, query, weight, len(ids), k, b, k1, cl / n if cl else 0.0)
    parts = postings.join(codes, "term").select("doc_id", "code", F.col("tf").cast("double").alias("tf"), F.col("length").cast("double").alias("length")).repartition("doc_id").sortWithinPartitions("doc_id")
    found = parts.mapInArrow(score, "query int, doc_id long, score double")
    names = spark.createDataFrame([(i, q) for q, i in number.items()], StructType([StructField("query", IntegerType()), StructField("query_id", kind)]))
    return found.join(F.broadcast(names), "query").select("query_id", "doc_id", "score")


def _scorer(first: np.ndarray, query: np.ndarray, weight: np.ndarray, n_queries: int, k: int, b: float, k1: float, average: float):
    """Scores rows (doc_id, code, tf, length) that are sorted by doc_id; queries of a term lie between its places in ``first``."""

    def rounded(x: float) -> Decimal:
        return Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP) if math.isfinite(x) else Decimal("-Infinity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each query the best so far; no other score below its floor can be among them, whatever ties rounding makes
        best: dict[int, list[tuple[float, int]]] = {}
        floor = np.full(n_queries, -np.inf)

        def prune(q: int) -> None:
            own = best[q]
            if len(own) > k:
                own.sort(key=lambda x: (-rounded(x[0]), x[1]))
                del own[k:]
                floor[q] = own[-1][0] - 2e-9

        def add(docs: np.ndarray, codes: np.ndarray, tf: np.ndarray, length: np.ndarray) -> None:
            names, row = np.unique(docs, return_inverse=True)
            relative = length / average if average else np.zeros(len(length))
            part = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * relative))
            sizes = first[codes + 1] - first[codes]
            each = np.repeat(np.arange(len(codes)), sizes)
            place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[codes][each]
            cell = row[each] * n_queries + query[place]
            total = np.bincount(cell, weight[place] * part[each], len(names) * n_queries).reshape(len(names), n_queries)
            total[np.bincount(cell, minlength=total.size).reshape(total.shape) == 0] = np.nan
            if len(names) > k:
                bound = np.maximum(floor, -np.partition(-np.nan_to_num(total, nan=-np.inf), k - 1, axis=0)[k - 1] - 2e-9)
            else:
                bound = floor
            touched = set()
            for r, q in zip(*np.nonzero(total >= bound), strict=True):
                best.setdefault(int(q), []).append((float(total[r, q]), int(names[r])))
                touched.add(int(q))
            for q in touched:
                prune(q)

        def chunks(block: list[np.ndarray]) -> None:
            docs = block[0]
            starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            products = np.append(0, np.cumsum(first[block[1] + 1] - first[block[1]]))
            most = max(CELLS // n_queries, 1)
            i = 0
            while i < len(starts):
                j = min(i + most, len(starts))
                fits = np.searchsorted(products[np.append(starts[i + 1 : j], starts[j] if j < len(starts) else len(docs))], products[starts[i]] + PRODUCTS, "right")
                j = i + max(int(fits), 1)
                add(*(c[starts[i] : starts[j] if j < len(starts) else len(docs)] for c in block))
                i = j

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            block = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                block = [np.append(h, c) for h, c in zip(held, block, strict=True)]
            # the last document may go on in the next batch
            last = int(np.searchsorted(block[0], block[0][-1]))
            held = [c[last:].copy() for c in block]
            if last:
                chunks([c[:last] for c in block])
        if held is not None:
            chunks(held)
        rows = [(q, d, s) for q, own in best.items() for s, d in own]
        if rows:
            q, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["query", "doc_id", "score"])

    return run


def explain(index: Index, query: X.Node, doc_id: int) -> DataFrame:
    """(doc_id, path, depth, node, matched, score, info) of every node of the query for one document, in pre-order."""
    p = compiler.plan(index, query)
    out = []

    def visit(node: X.Node, path: str, depth: int) -> None:
        name = type(node).__name__
        counted = isinstance(node, (*compiler._COUNTED, X.Lengths))
        info = [F.lit(name)]
        if isinstance(node, X.Text):
            info.append(F.lit(f" {node.term!r} in {index.field(node.field).name}"))
        if counted:
            info += [F.lit(" tf="), p.tf(node).cast("string")]
        if isinstance(node, (X.BM25, X.LinearQL, X.DirQL)):
            for what in ("df", "cf", "n", "cl"):
                info += [F.lit(f" {what}="), p.statistic(node, what).cast("long").cast("string")]
        out.append(F.struct(
            F.lit(path).alias("path"), F.lit(depth).alias("depth"), F.lit(name).alias("node"), p.matches(node).alias("matched"),
            p.score(node).alias("score"), F.concat(*info).alias("info"),
        ))
        for k, c in enumerate(node.children_of()):
            visit(c, f"{path}.{k}", depth + 1)

    visit(p.expr, "0", 0)
    rows = p.rows(doc_id)
    # places keep the pre-order, whatever the paths look like as text
    return rows.select("doc_id", F.posexplode(F.array(*out)).alias("place", "x")).orderBy("place").select("doc_id", "x.*")
