"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (ASCII and Latin-1 letters to lower case, every run of other ASCII
characters to one blank) and compared as UTF-8 code units.  A benchmark item is cut into
pieces of ``PIECE`` units, half overlapping; a shorter item is one piece.  A text region
within ``e`` edits of a piece of ``m`` units shares at least ``m - q + 1 - q * e`` q-grams
with it, all on diagonals (text offset less piece offset) that differ by at most ``e``.
Shared q-grams are therefore counted in diagonal bands that overlap by ``e``; bands that
reach the bound are verified by banded alignment.  ``e`` is ``RATE`` of the piece, less
where the bound would otherwise be below one.  Pieces shorter than ``q`` units hold no q-gram; they match only
exactly (``RATE`` gives any piece below 1 / ``RATE`` units a budget of none anyway) and as whole words, as shorter ones lie inside common words.
Equal pieces are searched once.  Texts and items that repeat a few q-grams over and over meet in many places: these are
counted ``_MEETINGS`` at a time, so memory stays bounded.

Nulls: rows without doc_id or text, and items without item_id or text, are left out; so are
items without letters or digits.  Empty texts match nothing, very long ones are searched whole.  Items with equal text each
report.  Repeated rows of a document report once, rows of one doc_id with different texts as one document.  Ties: of
several places of a piece the one with the fewest edits counts.  Only ``doc_id`` and ``text``
(``item_id`` and ``text``) are read, so other columns never clash.  Empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sides import without
from .vectext import chunks, mix, ranges

Q = 12
PIECE = 96
RATE = 0.05
#: Benchmark text that one broadcast index holds; more text is handled in several passes.
INDEX_BYTES = 8 << 20
_BITS = 22
#: Meetings of a text's and the index's q-grams that are counted at a time.
_MEETINGS = 1 << 22

FOUND = "doc_id long, item_id long, piece int, edits int"

_MAP = np.full(256, 32, np.uint8)
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _MAP[_r.start : _r.stop] = np.arange(_r.start, _r.stop)
_MAP[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code units and offsets; each text begins and ends with one blank."""
    n = len(offs) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    row_shift = np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    mapped = _MAP[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    mapped[upper] += 32
    out[np.arange(len(data)) + row_shift] = mapped
    begin = offs[:-1] + 2 * np.arange(n)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[begin] = True
    sums = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return out[keep], sums[np.append(begin, len(out))]


def gram_codes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of every ``q`` (8 to 16) consecutive units."""
    n = len(data) - 7
    if n <= q - 8:
        return np.zeros(0, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.empty(n + 7 - (n + 7) % 8 + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded[k : k + (len(padded) - k) // 8 * 8].tobytes(), "<u8")
        eight[k::8][: len(part)] = part[: len(eight[k::8])]
    eight = eight[:n]
    rest = q - 8
    return (eight[: n - rest] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[rest:] * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[rest:] >> np.uint64(29)))


@dataclass
class Pieces:
    """An index of benchmark pieces."""

    item: np.ndarray
    number: np.ndarray
    start: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    data: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    #: places of equal pieces, from bounds[k] on for the one that stands for them at its own place k
    bounds: np.ndarray
    equal: np.ndarray
    short: list[tuple[int, bytes]]
    q: int


def index_pieces(items: list[tuple[int, str]], q: int = Q, piece: int = PIECE, rate: float = RATE) -> Pieces:
    item, number, texts, short = [], [], [], []
    for item_id, text in sorted(items):
        raw = np.frombuffer(text.encode(), np.uint8)
        norm = bytes(normalise(raw, np.array([0, len(raw)]))[0]).strip()
        if not norm:
            continue
        if len(norm) < q:
            short.append((item_id, b" " + norm + b" "))
            continue
        starts = list(range(0, max(1, len(norm) - piece + 1), piece // 2))
        if len(norm) > piece and starts[-1] + piece < len(norm):
            starts.append(len(norm) - piece)
        for k, s in enumerate(starts):
            item.append(item_id)
            number.append(k)
            texts.append(norm[s : s + piece])
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes, owner, offset = [], [], []
    same: dict[bytes, list[int]] = {}
    for k, t in enumerate(texts):
        same.setdefault(t, []).append(k)
        if same[t][0] < k:
            continue
        c = gram_codes(np.frombuffer(t, np.uint8), q)
        codes.append(c)
        owner.append(np.full(len(c), k))
        offset.append(np.arange(len(c)))
    equal = [same.get(t, []) if same[t][0] == k else [] for k, t in enumerate(texts)]
    every = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    unique, first = np.unique(every[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(mix(unique) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    none = np.zeros(0, np.int64)
    budget = np.minimum((size * rate).astype(np.int64), (size - q) // q)
    return Pieces(
        np.array(item, np.int64), np.array(number, np.int32), start, size, np.maximum(budget, 0), data, unique, np.append(first, len(every)),
        np.concatenate(owner)[order] if owner else none, np.concatenate(offset)[order] if offset else none, bitmap,
        np.append(0, np.cumsum([len(e) for e in equal])).astype(np.int64), np.array([k for e in equal for k in e], np.int64), short, q,
    )


def banded_edits(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, diagonal: np.ndarray, width: int, pieces: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fewest edits that turn each piece into a stretch of text on diagonals [diagonal, diagonal + width).

    One row of the band for all candidates at a time; lo and hi bound each candidate's text.
    """
    n = len(diagonal)
    big = np.int32(1 << 20)
    shift = np.arange(width, dtype=np.int32)
    # cell (i, d): first i units of the piece against text that ends at diagonal + d + i
    at = diagonal[:, None] + shift
    row = np.where((at >= lo[:, None]) & (at <= hi[:, None]), np.int32(0), big)
    best = np.full(n, big, np.int32)
    limit = max(len(text) - 1, 0)
    for i in range(1, int(size.max()) + 1):
        live = size >= i
        unit = pieces[np.minimum(start + i - 1, len(pieces) - 1)]
        end = at + i
        ok = (end >= lo[:, None]) & (end <= hi[:, None])
        last = np.clip(end - 1, 0, limit)
        step = row + (text[last] != unit[:, None])
        step[(end - 1 < lo[:, None])] = big
        up = np.full_like(row, big)
        up[:, :-1] = row[:, 1:] + 1
        step = np.where(ok, np.minimum(step, up), big)
        step = np.minimum.accumulate(step - shift, axis=1) + shift
        step = np.where(ok, step, big)
        row = np.where(live[:, None], step, row)
        best = np.where(size == i, row.min(1), best)
    return best


def matches(data: np.ndarray, offs: np.ndarray, index: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, edits) of the pieces found in each text of a chunk."""
    none = np.zeros(0, np.int64)
    if not len(index.codes):
        return none, none, none
    text, bounds = normalise(data, offs)
    codes = gram_codes(text, index.q)
    hit = np.flatnonzero(index.bitmap[(mix(codes) >> np.uint64(64 - _BITS)).astype(np.int64)])
    place = np.searchsorted(index.codes, codes[hit])
    place[place == len(index.codes)] = 0
    same = index.codes[place] == codes[hit]
    hit, place = hit[same], place[same]
    row = np.searchsorted(bounds, hit, "right") - 1
    same = hit + index.q <= bounds[row + 1]
    hit, place, row = hit[same], place[same], row[same]
    counts = index.first[place + 1] - index.first[place]
    need = index.size - index.q + 1 - index.q * index.budget
    most = int(index.budget.max())
    pitch = max(8, most + 1)
    upto = np.cumsum(counts)
    held, lo = [], 0
    while lo < len(hit):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _MEETINGS, "right")))
        # whole texts where possible
        whole = int(np.searchsorted(row, row[hi - 1])) if hi < len(hit) and row[hi] == row[hi - 1] else hi
        split = whole <= lo or lo > 0 and row[lo - 1] == row[lo]
        hi = hi if whole <= lo else whole
        at = ranges(index.first[place[lo:hi]], counts[lo:hi])
        owner = index.owner[at]
        key = np.repeat(row[lo:hi], counts[lo:hi]) * len(index.item) + owner
        diagonal = np.repeat(hit[lo:hi], counts[lo:hi]) - index.offset[at]
        if not split:
            # a text with too few shared q-grams in all has too few in every band
            kinds, inverse, total = np.unique(key, return_inverse=True, return_counts=True)
            enough = (total >= need[kinds % len(index.item)])[inverse]
            key, diagonal = key[enough], diagonal[enough]
        band = diagonal // pitch
        also = diagonal - band * pitch < most
        held.append(_runs(np.concatenate([key, key[also]]), np.concatenate([band, band[also] - 1]), None))
        lo = hi
    if not held:
        return none, none, none
    key, band, shared = _runs(*(np.concatenate(c) for c in zip(*held, strict=True))) if len(held) > 1 else held[0]
    owner = key % len(index.item)
    first = np.arange(len(key))
    first = first[shared >= need[owner[first]]]
    out_row, out_piece, out_edits = [], [], []
    for part in np.array_split(first, max(1, len(first) // 20_000)):
        if not len(part):
            continue
        own, rows = owner[part], key[part] // len(index.item)
        edits = banded_edits(text, bounds[rows], bounds[rows + 1], band[part] * pitch - most, pitch + 3 * most + 1, index.data, index.start[own], index.size[own])
        ok = edits <= index.budget[own]
        out_row.append(rows[ok])
        out_piece.append(own[ok])
        out_edits.append(edits[ok])
    if not out_row:
        return none, none, none
    row, piece, edits = np.concatenate(out_row), np.concatenate(out_piece), np.concatenate(out_edits)
    times = index.bounds[piece + 1] - index.bounds[piece]
    return np.repeat(row, times), index.equal[ranges(index.bounds[piece], times)], np.repeat(edits, times)


def _runs(key: np.ndarray, band: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, band), sorted, and their counts (or sums of n)."""
    order = np.lexsort((band, key))
    key, band = key[order], band[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
    at = np.flatnonzero(new)
    total = np.diff(np.append(at, len(key))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return key[at], band[at], total


def _scan(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offs in chunks(batch.column(1)):
                row, piece, edits = matches(data, offs, held)
                doc, item, number = ids[lo + row], held.item[piece], held.number[piece]
                if held.short:
                    text, bounds = normalise(data, offs)
                    whole = text.tobytes()
                    for item_id, pattern in held.short:
                        at, hits = whole.find(pattern), []
                        while at >= 0:
                            k = int(np.searchsorted(bounds, at, "right")) - 1
                            if at + len(pattern) <= bounds[k + 1]:
                                hits.append(ids[lo + k])
                            at = whole.find(pattern, at + 1)
                        doc, item = np.append(doc, hits).astype(np.int64), np.append(item, np.full(len(hits), item_id)).astype(np.int64)
                        number, edits = np.append(number, np.zeros(len(hits))).astype(np.int32), np.append(edits, np.zeros(len(hits))).astype(np.int32)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(number.astype(np.int32)), pa.array(edits.astype(np.int32))], names=["doc_id", "item_id", "piece", "edits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, piece: int = PIECE, rate: float = RATE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, n_pieces, edits): the items found in each document, by how many pieces and how few edits."""
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // index_bytes))
    found = None
    for k in range(passes):
        own = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).toLocalIterator()]
        index = spark.sparkContext.broadcast(index_pieces(own, q, piece, rate))
        some = texts.mapInArrow(_scan(index), FOUND)
        found = some if found is None else found.union(some)
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("piece").cast("int").alias("n_pieces"), F.min("edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params: float) -> DataFrame:
    """Documents in which no benchmark item is found; all columns and other rows stay."""
    bad = contamination(docs, benchmark, **params).select("doc_id").distinct()
    return without(docs, docs["doc_id"].cast("long"), bad)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
