"""Column functions: tokenizers and gaps stay inside the JVM, sums of gaps and windows of positions are one pass over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-cased words between (Unicode) white space."""
    return F.filter(F.split(F.lower(_column(text)), WHITE_SPACE), lambda t: t != "")


def unicode_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits of any script."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def skip_entities(text: Column | str) -> Column:
    """Character references such as ``&amp;`` replaced by a blank."""
    return F.regexp_replace(_column(text), r"&[a-z0-9#]*;", " ")


def gaps(sorted_values: Column | str) -> Column:
    """Differences of a sorted array, from 0 on; an unsorted one fails."""
    v = _column(sorted_values)

    def step(x: Column, i: Column) -> Column:
        before = F.get(v, i - 1)
        return F.when(i == 0, x).when(x < before, F.raise_error(F.lit("values aren't sorted"))).otherwise(x - before)

    return F.transform(v, step)


def ungap(differences: Column | str) -> Column:
    """The inverse of :func:`gaps`, in one pass over Arrow arrays."""

    def sums(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        if flat.null_count:
            return pa.array([None if own is None else _sums(own) for own in lists.to_pylist()], pa.list_(pa.int64()))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        total = np.append(0, np.cumsum(flat.to_numpy(zero_copy_only=False)))
        own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(total[1:] - np.repeat(total[bounds[:-1]], sizes), pa.int64()))
        return pc.if_else(lists.is_valid(), own, pa.nulls(len(own), own.type)) if lists.null_count else own

    return F.arrow_udf(sums, "array<bigint>")(_column(differences).cast("array<bigint>"))


def _sums(differences: list[int | None]) -> list[int | None]:
    """Running sums; from a null on they are null."""
    out, at = [], 0
    for d in differences:
        at = None if at is None or d is None else at + d
        out.append(at)
    return out


#: Rows are told apart by what lies above the bits of a position.
_ROW = 32


def _keys(lists: pa.Array) -> np.ndarray:
    """(row, position) of sorted lists as sorted integers; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(lists)), sizes) << _ROW) + lists.flatten().to_numpy(zero_copy_only=False)


def _lists(keys: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(keys >> _ROW, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys & ((1 << _ROW) - 1)).astype(np.int32)))


def _passed(of: Callable[[list[np.ndarray]], np.ndarray], columns: list[Column]) -> Column:
    def run(*lists: pa.Array) -> pa.Array:
        return _lists(of([_keys(own) for own in lists]), len(lists[0]))

    return F.arrow_udf(run, "array<int>")(*columns)


def ordered_starts(positions: list[Column], step: int) -> Column:
    """Positions of the first child from which a chain reaches the last, each within ``step`` of the one before."""

    def of(own: list[np.ndarray]) -> np.ndarray:
        good = own[-1]
        for keys in reversed(own[:-1]):
            after = np.append(good, np.iinfo(np.int64).max)[np.searchsorted(good, keys, "right")]
            good = keys[after - keys <= step]
        return good

    return _passed(of, positions)


def unordered_starts(positions: list[Column], width: int) -> Column:
    """Positions of any child with every child at that position or in the ``width - 1`` after it."""

    def of(own: list[np.ndarray]) -> np.ndarray:
        every = np.unique(np.concatenate(own))
        for keys in own:
            after = np.append(keys, np.iinfo(np.int64).max)[np.searchsorted(keys, every)]
            every = every[after - every < width]
        return every

    return _passed(of, positions)


def sort_tags(tags: Column | str) -> Column:
    """Tags by begin, the longest first."""
    return F.array_sort(
        _column(tags),
        lambda a, b: F.when(a["begin"] < b["begin"], -1).when(a["begin"] > b["begin"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0),
    )
