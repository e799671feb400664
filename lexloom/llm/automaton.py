"""Substring dedup with suffix automata of reference shards.

A suffix automaton of a shard of reference texts is streamed over by documents: at each word
it gives the matching statistic, the length of the longest stretch that ends there and
occurs in the reference.  Where it reaches ``length`` words, that window repeats; the union of
such windows are the maximal spans above the threshold.

Two uses:

* :func:`remove_matches` takes a reference table.  Its automata are broadcast, one
  shard of at most ``SHARD_BYTES`` of text at a time, and every document is streamed whole.
* :func:`substring_dedup` takes the corpus as its own reference.  To broadcast automata of
  the whole corpus would move it to every executor, so they are built where the candidate
  segments of their shard are (see ``repeats``), which are all that can match there, and the
  segments are streamed over them.  States know the first and the last document of their
  stretch: a text always matches itself, so only states of two documents count.

The first document (by doc_id) that holds a window keeps it; it is removed from later ones.

Nulls: documents without id or text, and texts of fewer than ``length`` words (empty ones too), have no
windows and no row in the result.  Very long texts are streamed whole.  Repeated rows give one row; rows of one doc_id with different texts
are one document with a row for each text.  Ties: rows of the first document all keep their windows, also where it holds one twice.  Only
``doc_id`` and ``text`` are read, so other columns never clash.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .vectext import Words, chunks

#: Words of segments that one automaton is built of, unless one anchor alone has more.
SHARD_WORDS = 200_000
#: Reference text of one broadcast automaton.
SHARD_BYTES = 2 << 20

CLEANED = "doc_id long, n_words long, n_removed long, removed_start array<long>, removed_end array<long>, first_start array<long>, first_end array<long>, text string"


class Automaton:
    """A suffix automaton of several sequences of integers; states know their first and last document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.low = [1 << 62]
        self.high = [-1 << 62]

    def add(self, words: Sequence[int], low: int, high: int) -> None:
        """Add a sequence that documents from ``low`` to ``high`` hold."""
        nxt, link, size, lows, highs = self.next, self.link, self.size, self.low, self.high
        last = 0
        for w in words:
            q = nxt[last].get(w)
            p = last
            if q is not None and size[q] == size[p] + 1:
                last = q
            else:
                if q is None:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    size.append(size[p] + 1)
                    lows.append(1 << 62)
                    highs.append(-1 << 62)
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                else:
                    cur = -1
                if p >= 0:
                    q = nxt[p][w]
                    if size[q] == size[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        link.append(link[q])
                        size.append(size[p] + 1)
                        lows.append(1 << 62)
                        highs.append(-1 << 62)
                        while p >= 0 and nxt[p].get(w) == q:
                            nxt[p][w] = clone
                            p = link[p]
                        link[q] = clone
                        if cur >= 0:
                            link[cur] = clone
                        else:
                            cur = clone
                last = cur
            if low < lows[last]:
                lows[last] = low
            if high > highs[last]:
                highs[last] = high

    def finish(self) -> None:
        """Give every state the documents of all stretches that end with its own."""
        low, high, link = self.low, self.high, self.link
        for v in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            p = link[v]
            if low[v] < low[p]:
                low[p] = low[v]
            if high[v] > high[p]:
                high[p] = high[v]

    def stream(self, words: Sequence[int], length: int, others: bool) -> Iterator[tuple[int, int]]:
        """(end, first document) of each window of ``length`` words that matches.

        ``others``: only stretches that two documents hold.
        """
        nxt, link, size, low, high = self.next, self.link, self.size, self.low, self.high
        v = n = 0
        for at, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = size[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            while others and v and low[v] == high[v]:
                v = link[v]
                n = size[v]
            if n >= length:
                while size[link[v]] >= length:
                    v = link[v]
                    n = size[v]
                yield at + 1, low[v]


def repeated_windows(words: np.ndarray, bounds: np.ndarray, min_doc: np.ndarray, max_doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, first document) of each window that two documents hold."""
    sam = Automaton()
    cut = [words[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    for own, low, high in zip(cut, min_doc.tolist(), max_doc.tolist(), strict=True):
        sam.add(own, low, high)
    sam.finish()
    found = [(k, end - length, first) for k, own in enumerate(cut) for end, first in sam.stream(own, length, True)]
    which, offset, first = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
    return which, offset, first


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
        new = [k == 0 and key != before or k > 0 and key != keys[k - 1] for k, key in enumerate(keys)]
        before = keys[-1] if keys else before
        batch = batch.filter(pa.array(new, pa.bool_()))
        out: list[tuple] = []
        spans = batch.column(2).to_pylist()
        for lo, data, offs in chunks(batch.column(1)):
            words = Words(data, offs)
            whole = data.tobytes()
            for r in range(len(offs) - 1):
                a, b = int(words.bounds[r]), int(words.bounds[r + 1])
                starts = np.append(words.start[a:b], offs[r + 1])
                removed = sorted((s["start_word"], s["end_word"]) for s in spans[lo + r] if not s["is_first"])
                kept = sorted((s["start_word"], s["end_word"]) for s in spans[lo + r] if s["is_first"])
                parts, at = [], int(offs[r])
                for x, y in removed:
                    parts.append(whole[at : int(starts[x])])
                    at = int(starts[y])
                parts.append(whole[at : int(offs[r + 1])])
                out.append((b - a, sum(y - x for x, y in removed), *([s[k] for s in own] for own in (removed, kept) for k in (0, 1)), b"".join(parts).decode()))
        if out:
            n, gone, *bounds, text = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), *(pa.array(b, pa.list_(pa.int64())) for b in bounds), pa.array(text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed_start", "removed_end", "first_start", "first_end", "text"],
            )


def substring_dedup(docs: DataFrame, length: int = repeats.LENGTH, gram: int = repeats.GRAM) -> DataFrame:
    """Documents that hold a window which another document holds too, without those that an earlier one holds.

    Columns: doc_id, n_words, n_removed, the bounds of the spans that were removed and of those
    of which this document is the first, and the text that is left (a word goes with the white space
    after it).
    """
    found = repeats.candidates(docs, length, gram, "automaton")
    runs = repeats.in_shards(repeats.segments(docs, found), repeated_windows, length, SHARD_WORDS)
    spans = repeats.spans(found, runs)
    return _cleaned(repeats.rows_of(docs), spans)


def _cleaned(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``CLEANED`` rows of the texts (doc_id, text_hash, text) that have spans."""
    own = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("is_first", "start_word", "end_word")).alias("spans"))
    joined = texts.join(own.hint("shuffle_hash"), ["doc_id", "text_hash"])
    # repeated rows lie in one task, next to each other
    rows = joined.select("doc_id", "text", "spans", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    return rows.mapInArrow(_clean, CLEANED)


def _match(held, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam, names = held.value
        for batch in batches:
            for lo, data, offs in chunks(batch.column(2)):
                words = Words(data, offs)
                hashes = words.hashes()
                place = np.minimum(np.searchsorted(names, hashes), max(len(names) - 1, 0))
                ids = np.where(names[place] == hashes, place, -1) if len(names) else np.full(len(hashes), -1)
                rows = []
                for r in range(len(offs) - 1):
                    ends = [e for e, _ in sam.stream(ids[words.bounds[r] : words.bounds[r + 1]].tolist(), length, False)]
                    rows += [(batch.column(0)[lo + r].as_py(), batch.column(1)[lo + r].as_py(), e - length, e) for e in ends]
                if rows:
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "start_word", "end_word"])

    return run


def remove_matches(docs: DataFrame, reference: DataFrame, length: int = repeats.LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents that share a window with the reference (column ``text``), without it; columns as above."""
    spark = docs.sparkSession
    texts = repeats.rows_of(docs)
    known = reference.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // shard_bytes))
    found = None
    for k in range(passes):
        own = pa.array([r[0] for r in known.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).toLocalIterator()], pa.string())
        sam, pieces = Automaton(), []
        for _, data, offs in chunks(own):
            words = Words(data, offs)
            pieces.append((words.hashes(), words.bounds))
        names = np.unique(np.concatenate([h for h, _ in pieces])) if pieces else np.zeros(0, np.uint64)
        for hashes, bounds in pieces:
            ids = np.searchsorted(names, hashes).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                sam.add(ids[a:b], 0, 0)
        some = texts.mapInArrow(_match(spark.sparkContext.broadcast((sam, names)), length), "doc_id long, text_hash long, start_word long, end_word long")
        found = some if found is None else found.union(some)
    spans = repeats.merged(found.distinct().withColumn("first_doc", F.lit(0)), ["doc_id", "text_hash"])
    return _cleaned(texts, spans.withColumn("is_first", F.lit(False)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = (
    repeats.WINDOWS_SQL
    + """, s AS (
  SELECT doc_id, text, list(start_word ORDER BY start_word) FILTER (NOT is_first) AS ra, list(end_word ORDER BY start_word) FILTER (NOT is_first) AS rb,
    list(start_word ORDER BY start_word) FILTER (is_first) AS fa, list(end_word ORDER BY start_word) FILTER (is_first) AS fb
  FROM spans GROUP BY doc_id, text
), t AS (
  SELECT doc_id, coalesce(ra, []) AS removed_start, coalesce(rb, []) AS removed_end, coalesce(fa, []) AS first_start, coalesce(fb, []) AS first_end,
    text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+[ \\t\\n\\r\\f\\x0B]*') AS units
  FROM s
)
SELECT doc_id, len(units)::BIGINT AS n_words, coalesce(list_sum(removed_end) - list_sum(removed_start), 0)::BIGINT AS n_removed, removed_start, removed_end, first_start, first_end,
  regexp_extract(text, '^[ \\t\\n\\r\\f\\x0B]*') || array_to_string(list_filter(units, lambda u, i:
    len(list_filter(removed_start, lambda x: x < i)) = len(list_filter(removed_end, lambda x: x < i))), '') AS text
FROM t
"""
)
