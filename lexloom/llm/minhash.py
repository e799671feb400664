"""MinHash near-dedup by one-permutation hashing with optimal densification.

A document is the set of its runs of ``SHINGLE`` lower-cased words (the whole text when
shorter).  One 64-bit hash of each shingle chooses one of ``BINS`` bins and a value; each
bin keeps its smallest value.  An empty bin copies a bin that a 2-universal hash of (bin,
attempt) picks, attempt after attempt, until that one is not empty, which keeps bins of two
sets equal with probability of their Jaccard similarity.  ``ROWS`` bins make a band; equal
bands put documents in one bucket.  Each bucket is a star: every member is compared with the
smallest doc_id in it, so there are fewer candidate edges than rows.  Members that fail
against their hub are compared among themselves, leader by leader, until none is left: no
bucket is capped.  A bucket with more than ``BLOCK`` of those is cut into blocks, and each two blocks of it are led in a task
of their own, so no task holds more than two blocks and no two members are left out.  Edges with enough equal bins are joined
to groups by taking minima along edges and through pointers.

Exact copies (same lower-cased words) collapse first and count as one text; edges are between texts.
Nulls: rows without doc_id or text are left out; texts without words are left out (they are
never duplicates).  Very long texts are read whole.  Rows with the same doc_id and text count once; a doc_id with different texts
is one document that has the near copies of all of them.  Only ``doc_id`` and ``text``
are read, so other columns never clash.  Ties: the smallest doc_id stays.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexloom.storage import materialize

from .sides import without
from .vectext import Stretch, Words, chunks, mix, signed

SHINGLE = 3
BINS = 160
ROWS = 4
THRESHOLD = 0.5
#: Members of a bucket in one block.
BLOCK = 4096
_EMPTY = np.uint32(0xFFFFFFFF)

SIGNED = "doc_id long, content long, signature binary"


def densify(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins of non-empty rows from bins that a 2-universal hash picks."""
    n, bins = sig.shape
    out = sig.copy()
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 1
    while len(row):
        picked = (mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0xC2B2AE3D27D4EB4F % (1 << 64))) % np.uint64(bins)).astype(np.int64)
        ok = filled[row, picked]
        out[row[ok], col[ok]] = sig[row[ok], picked[ok]]
        row, col = row[~ok], col[~ok]
        attempt += 1
    return out


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, and a hash of the words of each row (0: no words)."""
    words = Words(data, offs, lower=True)
    sums = Stretch(words.hashes())
    n = np.diff(words.bounds)
    at = np.arange(len(words.row))
    left = words.bounds[1:][words.row] - at
    ok = (left >= size) | (at == words.bounds[:-1][words.row])
    at = at[ok]
    hashes = sums.hash(at, at + np.minimum(left[ok], size))
    whole = np.where(n > 0, sums.hash(words.bounds[:-1], words.bounds[1:]), np.uint64(0))
    return words.row[at], hashes, whole


def signatures(data: np.ndarray, offs: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x bins, uint32) and content hashes of a chunk."""
    n = len(offs) - 1
    row, h, whole = shingles(data, offs, size)
    sig = np.full(n * bins, _EMPTY, np.uint32)
    slot = row * bins + ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
    value = (h & np.uint64(0xFFFFFFFE)).astype(np.uint32)
    np.minimum.at(sig, slot, value)
    sig = sig.reshape(n, bins)
    return densify(sig, sig != _EMPTY), whole


def _emit(size: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offs in chunks(batch.column(1)):
                sig, whole = signatures(data, offs, size, bins)
                ok = whole != 0
                if ok.any():
                    rows = [r.tobytes() for r in sig[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(ok)][ok]), pa.array(signed(whole[ok])), pa.array(rows, pa.binary())], names=["doc_id", "content", "signature"])

    return run


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            bands = sig.shape[1] // rows
            h = np.zeros((batch.num_rows, bands), np.uint64)
            h += np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(rows):
                h = mix(h ^ sig[:, k : bands * rows : rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(signed(h.reshape(-1)))], names=["content", "bucket"])

    return run


def _equal_share(a: pd.Series, b: pd.Series) -> np.ndarray:
    if not len(a):
        return np.zeros(0)
    x = np.frombuffer(b"".join(a), np.uint32).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint32).reshape(len(b), -1)
    return (x == y).mean(1)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_equal_share(a, b))


def leaders(sig: np.ndarray, threshold: float, split: int | None = None) -> list[tuple[int, int, float]]:
    """(member, leader, similarity): rows in turn lead all later rows that are near and led by none.

    ``split``: rows before it lead, and lead only those from it on; both were led among themselves elsewhere.
    """
    out, rest = [], np.arange(split or 0, len(sig))
    own = iter(range(split)) if split is not None else None
    while len(rest) > (1 if own is None else 0):
        if own is None:
            first, rest = int(rest[0]), rest[1:]
        elif (first := next(own, None)) is None:
            break
        near = (sig[rest] == sig[first]).mean(1)
        out += [(int(i), first, float(x)) for i, x in zip(rest, near, strict=True) if x >= threshold]
        rest = rest[near < threshold]
    return out


def _lead(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["late", "doc_id", "content"], kind="stable")
        keys = pdf["content"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(keys), -1)
        late = pdf["late"].to_numpy()
        found = leaders(sig, threshold, int((~late).sum()) if late.any() else None)
        return pd.DataFrame({"a": keys[[j for _, j, _ in found]], "b": keys[[i for i, _, _ in found]], "jaccard": [x for _, _, x in found]})

    return run


def components(edges: DataFrame, label: str) -> DataFrame:
    """(doc_id, group_id) of all ends of edges (a, b); group_id is the smallest in the component.

    Each round a node takes the smallest label among its neighbours', then the label of
    its label; it ends when no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group_id")).withColumnRenamed("a", "doc_id"), f"{label}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["doc_id"]).groupBy("a").agg(F.min("group_id").alias("near"))
        stepped = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.col("group_id").alias("old"), F.least("group_id", "near").alias("mid"))
        of = labels.select(F.col("doc_id").alias("at"), F.col("group_id").alias("jump"))
        stepped = materialize(stepped.join(of, stepped["mid"] == of["at"]).select("doc_id", "old", F.least("mid", "jump").alias("group_id")), f"{label}-labels")
        labels = stepped.select("doc_id", "group_id")
        if stepped.where("group_id <> old").isEmpty():
            return labels


def near_edges(texts: DataFrame, rows: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b, jaccard) between texts (content, doc_id, signature) of equal buckets that are near."""
    banded = texts.select("content", "signature").mapInArrow(_bands(rows), "content long, bucket long")
    named = materialize(banded.join(texts.select("content", "doc_id"), "content"), "minhash-buckets")
    # aggregated before it moves, so that a hot bucket is a row a task
    hubs = named.groupBy("bucket").agg(F.min(F.struct("doc_id", "content")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("hub.content").alias("hub"))
    starred = materialize(named.join(hubs, "bucket").where("hub <> content"), "minhash-stars")
    pairs = starred.select(F.col("hub").alias("a"), F.col("content").alias("b")).distinct()
    left = texts.select(F.col("content").alias("a"), F.col("signature").alias("x"))
    right = texts.select(F.col("content").alias("b"), F.col("signature").alias("y"))
    scored = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", similarity("x", "y").alias("jaccard")), "minhash-scored")
    near = scored.where(F.col("jaccard") >= threshold)
    # the rest: members that are not near their hub, bucket by bucket
    far = scored.where(F.col("jaccard") < threshold).select(F.col("a").alias("hub"), F.col("b").alias("content"))
    rest = materialize(starred.join(far, ["hub", "content"], "left_semi").select("bucket", "content", "doc_id"), "minhash-rest")
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("content").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # buckets with the same members need one look
    once = sizes.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    many = rest.join(once, "bucket").withColumn("own", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = many.select("bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).alias("late"), "content", "doc_id")
    led = met.join(texts.select("content", "signature"), "content").groupBy("bucket", "first", "second").applyInPandas(_lead(threshold), "a long, b long, jaccard double")
    return near.union(led).distinct()


def minhash_groups(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of the documents that have a near or exact copy.

    ``group_id`` is the smallest doc_id of the group and the one that stays.
    """
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_docs = materialize(source.mapInArrow(_emit(shingle, bins), SIGNED), "minhash-signatures")
    heads = all_docs.groupBy("content").agg(F.min("doc_id").alias("head"))
    copies = materialize(all_docs.select("doc_id", "content").join(heads, "content").select("content", "doc_id", "head").distinct(), "minhash-copies")
    # texts of one content have one signature
    first = all_docs.join(heads.select("content", F.col("head").alias("doc_id")), ["content", "doc_id"], "left_semi")
    texts = materialize(first.groupBy("content", "doc_id").agg(F.first("signature").alias("signature")), "minhash-texts")
    name = texts.select("content", "doc_id")
    near = near_edges(texts, rows, threshold, block).select("a", "b")
    near = near.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    exact = copies.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    labels = components(near.union(exact), "minhash")
    size = labels.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return labels.join(size, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, **params: float) -> DataFrame:
    """Documents without the near and exact copies of an earlier one; all columns and other rows stay."""
    drop = minhash_groups(docs, **params).where("NOT keep").select("doc_id")
    return without(docs, docs["doc_id"].cast("long"), drop)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
