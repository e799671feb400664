"""Candidate passages that repeat across documents, shared by the two substring operators.

A *window* is ``length`` consecutive words (split on ASCII white space, compared byte for
byte).  A window repeats when it occurs in at least two documents.  To find all such
windows without moving the corpus, every document is winnowed: among each ``length``
words, the smallest hash of ``gram`` consecutive words is an anchor, so two equal windows
always have equal anchors.  A window belongs to its smallest anchor, and the *segment* of an
anchor is the words of the windows that belong to it, so all copies of a window meet in one group.
Only anchors travel, each with hashes of three stretches around it, one of which lies in any
window that holds the anchor.  Anchors without a stretch of another document are dropped; the
words of the others are fetched once for each distinct segment and sent to the anchor's shard.  There
the exact structure (suffix array or suffix automaton) decides; hashes only ever select
candidates.

A row is a (doc_id, text) pair: rows with one doc_id and different texts are one document, so a window that only they
hold doesn't repeat, and each has spans of its own; a hash of the text tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import materialize

from .vectext import SPACE_CLASS, Stretch, Words, chunks, signed, sliding

LENGTH = 50
GRAM = 16
#: Bytes of documents whose anchors are found at a time; the arrays of one piece take about 50 times that.
ANCHOR_BYTES = 512 << 10
#: Words of segments that one shard structure holds at most, unless one anchor alone has more.
SHARD_WORDS = 600_000

ANCHORS = "anchor long, segment long, doc_id long, text_hash long, start long, n_words int, h0 long, h1 long, h2 long"
_STRETCHES = ("h0", "h1", "h2")
SEGMENTS = "anchor long, segment long, min_doc long, max_doc long, words string"
RUNS = "anchor long, segment long, lo int, hi int, first_doc long"


def anchors_of(ids: np.ndarray, texts: np.ndarray, data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray | pa.Array]:
    """The anchors of a chunk of documents."""
    words = Words(data, offs)
    n, width = len(words.start), length - gram + 1
    empty = {"anchor": np.zeros(0, np.int64), "segment": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "text_hash": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n_words": np.zeros(0, np.int32)}
    empty |= {h: np.zeros(0, np.int64) for h in _STRETCHES}
    if n < length:
        return empty
    sums = Stretch(words.hashes())
    at = np.arange(n - gram + 1)
    grams = sums.hash(at, at + gram)
    low = sliding(grams, width, True)
    last = words.bounds[1:][words.row[: len(low)]]
    low[np.arange(len(low)) + length > last] = 0
    padded = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    picked = np.flatnonzero(sliding(padded, width, False) == grams)
    if not len(picked):
        return empty
    row = words.row[picked]
    # the windows whose smallest gram this is: a run of starts that ends at the anchor or before
    first = np.full(len(picked), -1, np.int64)
    last_start = np.full(len(picked), -1, np.int64)
    own = grams[picked]
    for back in range(width):
        start = picked - back
        ok = (start >= 0) & (start < len(low))
        ok[ok] = low[start[ok]] == own[ok]
        first = np.where(ok, start, first)
        last_start = np.where(ok & (last_start < 0), start, last_start)
    end = last_start + length
    most = length - gram
    stretches = {}
    for name, before, after in zip(_STRETCHES, (0, most // 3 + 1, 2 * most // 3 + 1), (most - most // 3, most - 2 * most // 3, 0), strict=True):
        a, b = picked - before, picked + gram + after
        inside = (a >= first) & (b <= end)
        hashes = signed(sums.hash(np.where(inside, a, 0), np.where(inside, b, 0)))
        stretches[name] = pa.array(hashes, mask=~inside)
    body = sums.hash(first, end) ^ (np.uint64(0x9E3779B97F4A7C15) * (picked - first + 1).astype(np.uint64))
    return {"anchor": signed(grams[picked]), "segment": signed(body), "doc_id": ids[row], "text_hash": texts[row], "start": first - words.bounds[row], "n_words": (end - first).astype(np.int32)} | stretches


def _emit_anchors(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, data, offs in chunks(batch.column(2), ANCHOR_BYTES):
                own = slice(lo, lo + len(offs) - 1)
                found = anchors_of(ids[own], texts[own], data, offs, length, gram)
                if len(found["anchor"]):
                    yield pa.RecordBatch.from_pydict(found)

    return run


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two documents have the keys; all keys begin with the anchor, so rows move once."""
    same = Window.partitionBy(*keys)
    return rows.withColumn("shared", F.min("doc_id").over(same) < F.max("doc_id").over(same))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of all rows with both."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _repeating(found: DataFrame) -> DataFrame:
    """The anchors with a stretch that two documents have; all of an anchor meet in one task, in one order for the anchor and its first stretch."""
    kept = _shared(found.repartition("anchor").sortWithinPartitions("anchor", _STRETCHES[0]), ["anchor"]).where("shared")
    hits = []
    for h in _STRETCHES:
        kept = _shared(kept, ["anchor", h]).withColumnRenamed("shared", f"shared_{h}")
        hits.append(F.col(h).isNotNull() & F.col(f"shared_{h}"))
    return kept.where(hits[0] | hits[1] | hits[2]).select("anchor", "segment", "doc_id", "text_hash", "start", "n_words")


def candidates(docs: DataFrame, length: int, gram: int, label: str) -> DataFrame:
    """Stored anchors with a stretch that occurs in two documents or more."""
    found = rows_of(docs).mapInArrow(_emit_anchors(length, gram), ANCHORS)
    return materialize(_repeating(found), label)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        size = 0
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            words = text.as_py().encode().split()
            for w in wanted.as_py():
                piece = b" ".join(words[w["start"] : w["start"] + w["n_words"]])
                size += len(piece)
                for column, value in zip(out, (w["anchor"], w["segment"], w["min_doc"], w["max_doc"], piece.decode()), strict=True):
                    column.append(value)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["anchor", "segment", "min_doc", "max_doc", "words"])
                out, size = [[], [], [], [], []], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["anchor", "segment", "min_doc", "max_doc", "words"])


def segments(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The text of every distinct candidate segment, with its first and last document.

    A segment whose anchor has no other segment and which one document alone holds can't
    repeat; there is none, since its anchor would not be a candidate.
    """
    each = found.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "text_hash", "start", "n_words")).alias("at"), F.max("doc_id").alias("max_doc"))
    wanted = each.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("anchor", "segment", F.col("at.doc_id").alias("min_doc"), "max_doc", F.col("at.start").alias("start"), F.col("at.n_words").alias("n_words"))).alias("wanted")
    )
    texts = rows_of(docs).join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("text", "wanted")
    return texts.mapInArrow(_cut, SEGMENTS)


def in_shards(rows: DataFrame, runs_of: Callable[..., tuple[np.ndarray, ...]], length: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Apply an exact structure to each shard of segments; a shard is a run of whole anchors.

    ``runs_of(words, bounds, min_doc, max_doc, length)`` gets integer words, the bounds of
    the segments among them, and their documents; it returns arrays (segment, offset,
    first document) of the windows that repeat.
    """

    def shard(columns: list[pa.Array]) -> pa.RecordBatch | None:
        anchor, segment, low, high = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
        parts, sizes = [], []
        for _, data, offs in chunks(columns[4]):
            words = Words(data, offs)
            parts.append(words.hashes())
            sizes.append(np.diff(words.bounds))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        which, offset, first = runs_of(np.unique(np.concatenate(parts), return_inverse=True)[1], bounds, low, high, length)
        if not len(which):
            return None
        order = np.lexsort((offset, which))
        which, offset, first = which[order], offset[order], first[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1) | (first[1:] != first[:-1])
        at = np.flatnonzero(new)
        till = np.append(at[1:], len(new)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[which[at]]), pa.array(segment[which[at]]), pa.array(offset[at].astype(np.int32)), pa.array((offset[till] + length).astype(np.int32)), pa.array(first[at])],
            names=["anchor", "segment", "lo", "hi", "first_doc"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            weight = np.cumsum(batch.column(5).to_numpy())
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            lo = done = 0
            if held and size >= shard_words and keys[0] != held[-1].column(0)[-1].as_py():
                if (out := shard(_joined(held))) is not None:
                    yield out
                held, size = [], 0
            # a shard ends only where an anchor ends
            while (k := int(np.searchsorted(weight[cuts - 1], shard_words - size + done))) < len(cuts):
                held.append(batch.slice(lo, int(cuts[k]) - lo))
                if (out := shard(_joined(held))) is not None:
                    yield out
                held, size, lo = [], 0, int(cuts[k])
                done = int(weight[lo - 1])
                cuts = cuts[k + 1 :]
            held.append(batch.slice(lo))
            size += int(weight[-1]) - done
        if held and (out := shard(_joined(held))) is not None:
            yield out

    routed = rows.withColumn("size", F.size(F.split("words", " "))).repartition("anchor").sortWithinPartitions("anchor", "segment")
    return routed.mapInArrow(run, RUNS)


def _joined(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.Table.from_batches(held).columns[:5]]


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals [start_word, end_word) of each key, where they touch or overlap."""
    by = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = parts.withColumn("new", F.when(before >= F.col("start_word"), 0).otherwise(1))
    cut = cut.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc").alias("first_doc_id")).drop("island")


def spans(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans (doc_id, text_hash, is_first, start_word, end_word, n_words, first_doc_id) of all documents."""
    each = found.join(runs.hint("shuffle_hash"), ["anchor", "segment"]).select(
        "doc_id", "text_hash", (F.col("first_doc") == F.col("doc_id")).alias("is_first"), (F.col("start") + F.col("lo")).alias("start_word"), (F.col("start") + F.col("hi")).alias("end_word"), "first_doc"
    )
    each = each.groupBy("doc_id", "text_hash", "is_first", "start_word", "end_word").agg(F.min("first_doc").alias("first_doc"))
    return merged(each, ["doc_id", "text_hash", "is_first"]).select("doc_id", "text_hash", "is_first", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


#: Windows by brute force: every one is spelled out, so it is for small tables only.
WINDOWS_SQL = f"""
WITH w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE_CLASS}'), lambda x: x <> '') AS ws
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), g AS (
  SELECT doc_id, text, unnest(range(0, len(ws) - {LENGTH} + 1)) AS s, ws FROM w WHERE len(ws) >= {LENGTH}
), h AS (
  SELECT doc_id, text, s, array_to_string(ws[s + 1 : s + {LENGTH}], ' ') AS gram FROM g
), r AS (
  SELECT gram, min(doc_id) AS first_doc FROM h GROUP BY gram HAVING min(doc_id) < max(doc_id)
), p AS (
  SELECT doc_id, text, first_doc = doc_id AS is_first, s AS a, s + {LENGTH} AS b, first_doc FROM h JOIN r USING (gram)
), q AS (
  SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_id, text, is_first ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM p
), i AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, text, is_first ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM q
), spans AS (
  SELECT doc_id, text, is_first, min(a)::BIGINT AS start_word, max(b)::BIGINT AS end_word, (max(b) - min(a))::BIGINT AS n_words, min(first_doc) AS first_doc_id
  FROM i GROUP BY doc_id, text, is_first, island
)
"""
SPANS_SQL = WINDOWS_SQL + "SELECT * EXCLUDE (text) FROM spans"
