"""Suffix-array dedup: spans of at least ``length`` words that occur in two documents or more.

Each shard's segments become one integer string with a distinct separator after every
segment.  Its suffix array comes from induced sorting: suffixes are classified, the
leftmost-smaller (LMS) substrings are sorted by inducing and named, repeated names
recurse, and the array is induced from the sorted LMS suffixes.  Inducing is linear and
sequential by nature; here a *frontier* of slots that are already filled is induced at a
time, which gives the same array with few vector operations; where the frontier is short, as on runs of equal words, slot
follows slot.  Common prefixes are computed
in text order (permuted), each starting from the bound its left neighbour gives.

Nulls: documents without id or text have no windows.  Empty and short texts have none.  Very long texts are handled whole, uniform
ones too.  Repeated rows count once; rows of one doc_id with different texts are one document, with spans of each text.
Ties: all spans of the first document are first.  Only ``doc_id`` and ``text`` are
read, so other columns never clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats

_BLOCK = 1 << 15
#: A frontier shorter than this is followed slot by slot, so many slots at a time.
_FEW = 16
_STRIDE = 512


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type (smaller than the one to its right); the last one is."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    rising = s[change] < s[change + 1]
    upto = np.searchsorted(change, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = rising[np.minimum(upto, len(change) - 1)] if len(change) else False
    return out


def _place(heads: np.ndarray, chars: np.ndarray, step: int) -> np.ndarray:
    """Slots for chars in turn, from each bucket's head on; moves the heads."""
    order = np.argsort(chars, kind="stable")
    sorted_ = chars[order]
    first = np.ones(len(sorted_), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(sorted_)))
    rank = np.arange(len(sorted_)) - np.repeat(at, counts)
    slots = np.empty(len(chars), np.int64)
    slots[order] = heads[sorted_] + step * rank
    heads[sorted_[at]] += step * counts
    return slots


def _follow(s: np.ndarray, stype: np.ndarray, order: np.ndarray, heads: np.ndarray, at: int, step: int) -> int:
    """Induce from one slot after another, up to ``_STRIDE`` of them; the next place."""
    end = min(len(order), at + _STRIDE) if step > 0 else max(0, at - _STRIDE)
    while at != end:
        before = order.item(at if step > 0 else at - 1) - 1
        if before >= 0 and stype.item(before) == (step < 0):
            c = s.item(before)
            slot = heads.item(c)
            order[slot] = before
            heads[c] = slot + step
        at += step
    return at


def _induce(s: np.ndarray, stype: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes, or of LMS substrings, from LMS suffixes in the given order."""
    n, sigma = len(s), int(s.max()) + 1
    n_l = np.bincount(s[~stype], minlength=sigma)
    n_lms = np.bincount(s[lms], minlength=sigma)
    begin = np.zeros(sigma, np.int64)
    np.cumsum((n_l + n_lms)[:-1], out=begin[1:])
    order = np.full(int((n_l + n_lms).sum()), -1, np.int64)
    order[_place(begin + n_l, s[lms], 1)] = lms
    heads, at = begin.copy(), 0
    while at < len(order):
        run = order[at : at + _BLOCK]
        if len(run) > _FEW and (run[:_FEW] < 0).any():
            at = _follow(s, stype, order, heads, at, 1)
            continue
        gaps = run < 0
        stop = int(gaps.argmax())
        if gaps[stop]:
            run = run[:stop]
        at += len(run)
        before = run[run > 0] - 1
        before = before[~stype[before]]
        if len(before):
            order[_place(heads, s[before], 1)] = before
    is_l = ~stype[order]
    large = order[is_l]
    n_s = np.bincount(s[stype], minlength=sigma)
    begin[0] = 0
    np.cumsum((n_l + n_s)[:-1], out=begin[1:])
    out = np.full(n, -1, np.int64)
    out[_place(begin.copy(), s[large], 1)] = large
    tails = begin + n_l + n_s - 1
    out[0] = n - 1
    at = n
    tails[s[n - 1]] -= 1
    while at > 0:
        run = out[max(0, at - _BLOCK) : at]
        if len(run) > _FEW and (run[-_FEW:] < 0).any():
            at = _follow(s, stype, out, tails, at, -1)
            continue
        gaps = run[::-1] < 0
        stop = int(gaps.argmax())
        if gaps[stop]:
            run = run[len(run) - stop :]
        at -= len(run)
        before = run[::-1]
        before = before[before > 0] - 1
        before = before[stype[before]]
        if len(before):
            out[_place(tails, s[before], -1)] = before
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers that end in a unique smallest one."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    stype = _types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = stype[1:] & ~stype[:-1]
    lms = np.flatnonzero(is_lms)
    order = _induce(s, stype, lms)
    by = order[is_lms[order]]
    # names: equal LMS substrings (up to and with the next LMS position) share one
    ends = np.append(lms[1:], n - 1)
    rank = np.empty(n, np.int64)
    rank[lms] = np.arange(len(lms))
    size = (ends - lms)[rank[by]] + 1
    same = np.zeros(len(by), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    at = 0
    while len(live):
        a, b = by[live - 1] + at, by[live] + at
        done = size[live] == at
        same[live[done]] = True
        ok = ~done
        a, b, live = a[ok], b[ok], live[ok]
        keep = (s[a] == s[b]) & (stype[a] == stype[b])
        live = live[keep]
        at += 1
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(by):
        reduced = np.empty(len(lms), np.int64)
        reduced[rank[by]] = names
        by = lms[suffix_array(reduced)]
    return _induce(s, stype, by)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, stride: int = 8) -> np.ndarray:
    """lcp[i] of sa[i-1] and sa[i], counted up to ``most``, through permuted order."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)

    def extend(live: np.ndarray) -> None:
        while len(live):
            a, b = live + plcp[live], phi[live] + plcp[live]
            ok = (plcp[live] < most) & (np.maximum(a, b) < n)
            live, a, b = live[ok], a[ok], b[ok]
            live = live[s[a] == s[b]]
            plcp[live] += 1

    at = np.arange(0, n, stride)
    extend(at[phi[at] >= 0])
    rest = np.arange(n)
    rest = rest[(rest % stride != 0) & (phi >= 0)]
    # a suffix shares with its own predecessor at least what an earlier one shares, less the distance
    plcp[rest] = np.maximum(0, plcp[rest - rest % stride] - rest % stride)
    extend(rest)
    return plcp[sa]


def repeated_windows(words: np.ndarray, bounds: np.ndarray, min_doc: np.ndarray, max_doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, first document) of each window that two documents hold."""
    k = len(bounds) - 1
    sizes = np.diff(bounds)
    total = int(bounds[-1])
    s = np.empty(total + k + 1, np.int64)
    segment = np.repeat(np.arange(k), sizes)
    at = np.arange(total) + segment
    s[at] = words + k + 1
    seps = bounds[1:] + np.arange(k)
    s[seps] = np.arange(k) + 1
    s[-1] = 0
    owner = np.full(len(s), -1, np.int64)
    owner[at] = segment
    offset = np.zeros(len(s), np.int64)
    offset[at] = np.arange(total) - bounds[:-1][segment]
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa, length)
    full = owner[sa] >= 0
    full[full] = sizes[owner[sa[full]]] - offset[sa[full]] >= length
    rows = np.flatnonzero(full)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none
    # suffixes in between two full ones that are equal for ``length`` words are full themselves
    new = lcp[rows] < length
    new[0] = True
    starts = np.flatnonzero(new)
    own = owner[sa[rows]]
    low = np.minimum.reduceat(min_doc[own], starts)
    high = np.maximum.reduceat(max_doc[own], starts)
    group = np.cumsum(new) - 1
    hit = (low < high)[group]
    return own[hit], offset[sa[rows[hit]]], low[group[hit]]


def suffix_array_dedup(docs: DataFrame, length: int = repeats.LENGTH, gram: int = repeats.GRAM) -> DataFrame:
    """All maximal spans of words covered by windows that repeat across documents.

    ``is_first`` tells the spans that stay (no earlier document holds those windows) from
    the duplicates; ``start_word`` and ``end_word`` count white-space separated words.
    """
    found = repeats.candidates(docs, length, gram, "suffix-array")
    rows = repeats.segments(docs, found)
    return repeats.spans(found, repeats.in_shards(rows, repeated_windows, length)).drop("text_hash")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = repeats.SPANS_SQL
