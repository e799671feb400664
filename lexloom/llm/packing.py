"""Retrieval packing: windows of ``WINDOW`` words filled with lexically near documents.

Seeds are the documents whose doc_id is divisible by ``EVERY``.  A seed's text is a query against
all other documents of its language; they are ranked by BM25 (lower-cased white-space words, statistics of the whole
language), exactly: every document meets every seed of its language.  A document is taken by one seed, for all others
it is used: by the one where its score is the largest share of what that seed can score (the root of the seed's score for
itself, so that long seeds don't take everything; ties: the smallest seed).  A seed opens a
window; its documents come in order of score (ties: doc_id) and each one that fits goes into the window.  Those that
don't fit open the seed's next windows in the same way.  Documents that share no weighted term
with any seed fill windows among themselves.  A document longer than a window first fills
windows of its own; what is left of it is packed like any document.  So every word of
every document lies in exactly one window.

How it runs: the inverted index is over the seeds, in shards of at most ``SHARD_BYTES`` of text; a shard is broadcast and
the documents stream over it, once for the document counts of its terms and once for the scores, so a score costs the same
whether the seed or the document is looked up, and texts never move.  Terms that many seeds of a shard hold are summed up by a matrix
product, others through their postings.  Scores are whole numbers of 1/``SCALE``, so they don't depend on the order of sums.  Only ids,
sizes and scores are shuffled.  Work grows with seeds times documents; equal seeds are scored once and share what
they take by a hash.  A seed with more than ``GROUP`` documents is split by a hash of their ids, the seed stays in the first part.

Nulls: rows without doc_id or text, and texts without words, fill no window.  Rows of one
doc_id, text and language count once (each counts in the statistics); with different texts each is packed.  A null
language is a language of its own, other than ''.  Very long texts are cut into windows, whole.  Ties are settled as
stated.  Only ``doc_id``, ``text`` and ``lang`` are read, so other columns never clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import materialize

from .vectext import Words, chunks, mix, ranges

WINDOW = 2048
EVERY = 100
#: Text of the seeds of one broadcast shard; more seeds take several passes.
SHARD_BYTES = 48 << 20
#: Documents of one seed that are ranked in one task.
GROUP = 4096
K1, B = 1.2, 0.75
SCALE = 256

PACKED = "window_id string, slot int, doc_id long, start_word long, end_word long, score double"
TAKEN = "doc_id long, h long, lang long, n_words long, seed_id long, seed_h long, score long, share double"

#: A term that this share of a shard's seeds hold goes through the matrix product.
_DENSE = 1 / 12
_BITS = 22
_CELLS = 1 << 21
_POSTINGS = 1 << 22


def term_keys(data: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a chunk and a key of each, of its language."""
    words = Words(data, offs, lower=True)
    return words, words.hashes() ^ mix(lang.view(np.uint64).copy())[words.row]


class Vocabulary:
    """Sorted term keys, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._bits = np.zeros(1 << _BITS, bool)
        self._bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the known terms of each row, by row and place."""
        at = np.flatnonzero(self._bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.searchsorted(self.keys, keys[at])
        place[place == len(self.keys)] = 0
        ok = self.keys[place] == keys[at] if len(self.keys) else np.zeros(len(at), bool)
        row, place = words.row[at[ok]], place[ok]
        both, tf = np.unique(row * max(len(self.keys), 1) + place, return_counts=True)
        return both // max(len(self.keys), 1), both % max(len(self.keys), 1), tf


@dataclass
class Block:
    """Index of the different seeds of one language of a shard."""

    #: seeds of each text, (doc_id, h) in order, one text after another
    ids: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    inverse: np.ndarray
    average: float
    #: place of a term to its number among the dense ones; -1: through postings
    dense: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    presence: np.ndarray


@dataclass
class Shard:
    vocabulary: Vocabulary
    idf: np.ndarray
    blocks: dict[int, Block]
    every: int


def impacts(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """BM25 weights of terms in documents, in whole steps."""
    norm = K1 * (1 - B + B * length / max(average, 1e-9))
    return np.floor(SCALE * idf * tf * (K1 + 1) / (tf + norm) + 0.5)


def seed_terms(seeds: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Vocabulary of (lang, doc_id, h, text) rows, the (place, count) terms of each, and their lengths."""
    found, sizes = [], []
    for lo, data, offs in chunks(pa.array([s[3] for s in seeds], pa.string())):
        lang = np.array([s[0] for s in seeds[lo : lo + len(offs) - 1]], np.int64)
        words, keys = term_keys(data, offs, lang)
        sizes += np.diff(words.bounds).tolist()
        found += [np.unique(keys[a:b], return_counts=True) for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
    vocabulary = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)
    return vocabulary, [(np.searchsorted(vocabulary, k), n) for k, n in found], np.array(sizes, np.int64)


def index_seeds(seeds: list[tuple[int, int, int, str]], terms: tuple, df: np.ndarray, totals: dict[int, tuple[int, int]], every: int) -> Shard:
    """Index of (lang, doc_id, h, text) rows, in order; df by place; totals: documents and words by language."""
    vocabulary, own, sizes = terms
    n_docs = np.zeros(len(vocabulary), np.int64)
    by_lang: dict[int, dict[int, list[int]]] = {}
    for k, (lang, _, h, _) in enumerate(seeds):
        n_docs[own[k][0]] = totals[lang][0]
        by_lang.setdefault(lang, {}).setdefault(h, []).append(k)
    idf = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    blocks = {}
    for lang, same in by_lang.items():
        members = list(same.values())
        average = totals[lang][1] / totals[lang][0]
        place, holder, best = [], [], []
        for r, ks in enumerate(members):
            p, n = own[ks[0]]
            p, n = p[idf[p] > 0], n[idf[p] > 0]
            place.append(p)
            holder.append(np.full(len(p), r))
            best.append(float(impacts(idf[p], n, sizes[ks[0]], average).sum()))
        p, r = np.concatenate(place), np.concatenate(holder)
        order = np.lexsort((r, p))
        p, r = p[order], r[order].astype(np.int32)
        first = np.searchsorted(p, np.arange(len(vocabulary) + 1))
        count = np.diff(first)
        often = np.flatnonzero((count >= _DENSE * len(members)) & (count > 0))
        dense = np.full(len(vocabulary), -1, np.int32)
        dense[often] = np.arange(len(often))
        presence = np.zeros((len(often), len(members)), np.float32)
        hit = dense[p] >= 0
        presence[dense[p[hit]], r[hit]] = 1
        flat = [k for ks in members for k in ks]
        blocks[lang] = Block(
            np.array([seeds[k][1] for k in flat], np.int64), np.array([seeds[k][2] for k in flat], np.int64), np.append(0, np.cumsum([len(ks) for ks in members])),
            1 / np.sqrt(np.maximum(best, 1.0)), average, dense, first, r, presence,
        )
    return Shard(Vocabulary(vocabulary), idf, blocks, every)


def best_seeds(block: Block, row: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n rows: the text of the seed that takes it (-1: none), its score, and that as a share."""
    width = len(block.inverse)
    dense = block.dense[place]
    postings = np.where(dense >= 0, 0, block.first[place + 1] - block.first[place])
    work = np.bincount(row, postings + 1, minlength=n).cumsum()
    bounds = np.searchsorted(row, np.arange(n + 1))
    best, score, share = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
    step, lo = max(1, _CELLS // width), 0
    while lo < n:
        before = work[lo - 1] if lo else 0
        hi = min(lo + step, max(lo + 1, int(np.searchsorted(work, before + _POSTINGS, "right"))), n)
        part = slice(bounds[lo], bounds[hi])
        r, p, w, d, m = row[part] - lo, place[part], weight[part], dense[part], postings[part]
        total = np.bincount(np.repeat(r, m) * width + block.holders[ranges(block.first[p], m)], np.repeat(w, m), minlength=(hi - lo) * width).reshape(hi - lo, width).astype(float)
        if len(block.presence):
            own = np.zeros((hi - lo, len(block.presence)))
            often = d >= 0
            own[r[often], d[often]] = w[often]
            # sums of whole numbers below 2**24 are exact in single precision
            total += own.astype(np.float32) @ block.presence if own.sum(1).max() < 1 << 24 else own @ block.presence.astype(np.float64)
        shares = total * block.inverse
        top = shares.argmax(1)
        at = np.arange(hi - lo)
        found = total[at, top] > 0
        best[lo:hi][found] = top[found]
        score[lo:hi][found] = total[at, top][found]
        share[lo:hi][found] = shares[at, top][found]
        lo = hi
    return best, score, share


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value
        df = np.zeros(len(held.keys), np.int64)
        totals: dict[int, list[int]] = {}
        for batch in batches:
            lang = batch.column(2).to_numpy()
            for lo, data, offs in chunks(batch.column(3)):
                own = lang[lo : lo + len(offs) - 1]
                words, keys = term_keys(data, offs, own)
                df += np.bincount(held.find(words, keys)[1], minlength=len(df))
                sizes = np.diff(words.bounds)
                for code in np.unique(own[sizes > 0]):
                    mine = sizes[own == code]
                    have = totals.setdefault(int(code), [0, 0])
                    have[0] += int((mine > 0).sum())
                    have[1] += int(mine.sum())
        at = np.flatnonzero(df)
        kind = np.concatenate([np.zeros(len(at)), np.ones(len(totals)), np.full(len(totals), 2)]).astype(np.int32)
        key = np.concatenate([at, list(totals), list(totals)]).astype(np.int64)
        n = np.concatenate([df[at], [v[0] for v in totals.values()], [v[1] for v in totals.values()]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

    return run


def _take(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held.value
        for batch in batches:
            ids, hashes, lang = (batch.column(c).to_numpy() for c in range(3))
            for lo, data, offs in chunks(batch.column(3)):
                hi = lo + len(offs) - 1
                own = lang[lo:hi]
                words, keys = term_keys(data, offs, own)
                sizes = np.diff(words.bounds)
                row, place, tf = shard.vocabulary.find(words, keys)
                seed, seed_h, score, share = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.full(hi - lo, -1.0)
                is_seed = (ids[lo:hi] % shard.every == 0) & (sizes > 0)
                for code in np.unique(own).tolist():
                    block = shard.blocks.get(code)
                    if block is None:
                        continue
                    which = np.flatnonzero((own == code) & (sizes > 0) & ~is_seed)
                    number = np.full(hi - lo, -1)
                    number[which] = np.arange(len(which))
                    mine = (number[row] >= 0) & (shard.idf[place] > 0)
                    weight = impacts(shard.idf[place[mine]], tf[mine], sizes[row[mine]], block.average)
                    best, points, part = best_seeds(block, number[row[mine]], place[mine], weight, len(which))
                    found = best >= 0
                    which, best = which[found], best[found]
                    # seeds with equal texts share what they take
                    member = block.bounds[best] + (mix((ids[lo:hi][which] ^ hashes[lo:hi][which]).view(np.uint64)) % np.diff(block.bounds)[best].astype(np.uint64)).astype(np.int64)
                    seed[which], seed_h[which], score[which], share[which] = block.ids[member], block.hashes[member], points[found], part[found]
                seed[is_seed], seed_h[is_seed], share[is_seed] = ids[lo:hi][is_seed], hashes[lo:hi][is_seed], np.inf
                ok = sizes > 0
                none = ~(share[ok] > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi][ok]), pa.array(hashes[lo:hi][ok]), pa.array(own[ok]), pa.array(sizes[ok].astype(np.int64)), pa.array(seed[ok], mask=none), pa.array(seed_h[ok], mask=none),
                        pa.array(score[ok].astype(np.int64)), pa.array(share[ok]),
                    ],
                    names=["doc_id", "h", "lang", "n_words", "seed_id", "seed_h", "score", "share"],
                )

    return run


def fill_windows(sizes: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(window, slot, row, start, end) of rows in order of rank."""
    out, count, pending = [], 0, []
    for r, n in enumerate(sizes):
        for k in range(n // window):
            out.append((count, 0, r, k * window, (k + 1) * window))
            count += 1
        if n % window:
            pending.append(r)
    while pending:
        space, slot, left = window, 0, []
        for r in pending:
            n = sizes[r] % window
            if n <= space:
                out.append((count, slot, r, sizes[r] - n, sizes[r]))
                space -= n
                slot += 1
            else:
                left.append(r)
        pending = left
        count += 1
    return out


def _fill(window: int):
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lang, seed, seed_h, part, ids, sizes, score, *_ = (c.to_pylist() for c in pa.Table.from_batches(held).columns)
        of = "none" if seed[0] is None else f"{seed[0]}.{seed_h[0] & (1 << 64) - 1:016x}"
        rows = fill_windows(sizes, window)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{of}.{lang[0] & (1 << 64) - 1:016x}.{part[0]}.{k}" for k, *_ in rows], pa.string()), pa.array([s for _, s, *_ in rows], pa.int32()), pa.array([ids[r] for _, _, r, *_ in rows], pa.int64()),
                pa.array([a for *_, a, _ in rows], pa.int64()), pa.array([b for *_, b in rows], pa.int64()), pa.array([score[r] / SCALE for _, _, r, *_ in rows], pa.float64()),
            ],
            names=["window_id", "slot", "doc_id", "start_word", "end_word", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group; a group may span batches
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            lo = 0
            for hi in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
                if hi == lo:
                    continue
                if held and keys[lo] != key:
                    yield packed(held)
                    held = []
                key = keys[lo]
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield packed(held)

    return run


def taken(docs: DataFrame, every: int = EVERY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``TAKEN``: each document with words once, and the seed that takes it; null where none does."""
    spark = docs.sparkSession
    lang = F.xxhash64(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit(0).cast("long")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("h"), "lang", "text")
    seeds = rows.where(F.col("doc_id") % every == 0)
    passes = max(1, -(-int(seeds.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // shard_bytes))
    found = None
    for k in range(passes):
        own = sorted({(r["lang"], r["doc_id"], r["h"], r["text"]) for r in seeds.where(F.pmod("h", F.lit(passes)) == k).toLocalIterator()}, key=lambda s: s[:3])
        terms = seed_terms(own)
        df, totals = np.zeros(len(terms[0]), np.int64), {}
        if own:
            counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(Vocabulary(terms[0]))), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
            kind, key, n = (c.to_numpy() for c in counted.columns)
            df[key[kind == 0]] = n[kind == 0]
            words = dict(zip(key[kind == 2].tolist(), n[kind == 2].tolist(), strict=True))
            totals = {code: (m, words[code]) for code, m in zip(key[kind == 1].tolist(), n[kind == 1].tolist(), strict=True)}
        keep = [j for j in range(len(own)) if terms[2][j]]
        shard = index_seeds([own[j] for j in keep], (terms[0], [terms[1][j] for j in keep], terms[2][keep]), df, totals, every)
        some = rows.mapInArrow(_take(spark.sparkContext.broadcast(shard)), TAKEN)
        found = some if found is None else found.union(some)
    order = F.struct(-F.col("share"), "seed_id", "seed_h", "score", "n_words", "share")
    best = found.groupBy("doc_id", "h", "lang").agg(F.min(order).alias("x"))
    return best.select("doc_id", "h", "lang", "x.n_words", "x.seed_id", "x.seed_h", "x.score", "x.share")


def retrieval_packing(docs: DataFrame, window: int = WINDOW, every: int = EVERY, shard_bytes: int = SHARD_BYTES, group: int = GROUP) -> DataFrame:
    """(window_id, slot, doc_id, start_word, end_word, score); score is that of the window's seed.  The result doesn't depend on shard_bytes."""
    found = materialize(taken(docs, every, shard_bytes), "packing-taken")
    keys = ["lang", "seed_id", "seed_h"]
    # hot seeds are few: any has thousands of documents
    hot = found.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > group).select(*(F.col(k).alias(f"of_{k}") for k in keys), F.ceil(F.col("n") / group).alias("parts"))
    joined = found.join(hot, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("seed_id").eqNullSafe(F.col("of_seed_id")) & F.col("seed_h").eqNullSafe(F.col("of_seed_h")), "left")
    is_seed = F.col("share") == float("inf")
    part = F.when(F.col("parts").isNull() | is_seed, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")))
    rows = joined.select(*keys, part.alias("part"), "doc_id", "n_words", "score", "h", is_seed.alias("is_seed"))
    placed = rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part", F.col("is_seed").desc(), F.col("score").desc(), "doc_id", "h")
    return placed.mapInArrow(_fill(window), PACKED)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
