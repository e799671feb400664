"""Embedding near-dedup by PCA-ordered tiled comparison; exact.

Vectors are scaled to length one and rotated onto the principal axes of all of them, the
axis with the most energy first, which leaves every cosine as it is.  Rows are cut into tiles of
about ``TILE`` rows that are near on the two leading axes.  Two tiles are compared only
if their bounding boxes on the leading axes come within sqrt(2 - 2 t) of each other, since
vectors with cosine t or more are that near.  Comparing tiles, dot products are summed over the leading
axes first; what the remaining axes can still add is at most the product of the two suffix
norms, and a pair is dropped as soon as that can't reach the threshold.

Equal vectors are one row of the comparison, however many ids hold them: each of these has the others as partners and what
the one row has, so a hot group of copies costs no pairs.

Nulls: rows without id or vector, with a null or non-finite element, or of length zero are
left out; all others have a row in the result, with partners or without.  Vectors are compared with those of the same number of elements, each width by
itself.  Very long vectors are compared whole.  Repeated rows count once; an id with different vectors has the partners of all of them, none
of them itself.  Only
``vec_id`` and ``embedding`` are read, so other columns never clash.  Ties: the smallest id
is the first.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.storage import materialize

THRESHOLD = 0.95
TILE = 2048
#: Leading axes after which pairs are dropped; the last stop is the whole vector.
STOPS = (8, 16, 32)
#: Axes of the bounding boxes.
BOX = 8
#: Sums of squares and products in double precision are off by far less.
SLACK = 1e-9
_BLOCK = 1024

PARTNERS = "row long, first_id long, n long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(-1, width)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _moments(width: int):
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(1), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "v"])

    return run


def _rotate(axes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.ascontiguousarray(_matrix(batch.column(1), width) @ axes.value)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), width).cast(pa.list_(pa.float64()))
                second = m[:, 1] if width > 1 else np.zeros(len(m))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(m[:, 0]), pa.array(second), flat], names=["row", "vec_id", "copies", "c0", "c1", "v"])

    return run


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, stops: tuple[int, ...] = STOPS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) of unit vectors whose dot product reaches the threshold."""
    width = a.shape[1]
    cuts = [s for s in stops if s < width] + [width]
    first = cuts[0]

    def suffix(m: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (m[:, at:] ** 2).sum(1)))

    dots = a[:, :first] @ b[:, :first].T
    if first == width:
        return np.nonzero(dots >= threshold)
    i, j = np.nonzero(dots + suffix(a, first)[:, None] * suffix(b, first) >= threshold - SLACK)
    sums = dots[i, j]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if not len(i):
            break
        sums = sums + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
        bound = threshold if hi == width else threshold - SLACK
        reach = sums if hi == width else sums + suffix(a, hi)[i] * suffix(b, hi)[j]
        ok = reach >= bound
        i, j, sums = i[ok], j[ok], sums[ok]
    return i, j


#: Of a tile's rows: their row keys, ids, numbers of copies, vectors.
_Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _partners(own: _Rows, other: _Rows, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row with partners: its key, the smallest partner id, and how many ids hold its partners."""
    order = np.lexsort((other[1][cols], rows))
    rows, cols = rows[order], cols[order]
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    return own[0][rows[at]], other[1][cols[at]], np.add.reduceat(other[2][cols], at)


def _compare(threshold: float, width: int):
    def pairs(a: _Rows, b: _Rows, own: bool) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(a[0]), _BLOCK):
            for y in range(0, len(b[0]), _BLOCK):
                i, j = near_pairs(a[3][x : x + _BLOCK], b[3][y : y + _BLOCK], threshold)
                i, j = i + x, j + y
                ok = a[1][i] != b[1][j]
                i, j = i[ok], j[ok]
                if len(i):
                    parts = [_partners(a, b, i, j)] + ([] if own else [_partners(b, a, j, i)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=["row", "first_id", "n"])

    def joined(parts: list[_Rows]) -> _Rows:
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are sorted by home tile, the tile's own rows first
        home, parts, whole = None, [], None
        for batch in batches:
            tile, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            held = (*(batch.column(c).to_numpy() for c in (2, 3, 4)), batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (guest[1:] != guest[:-1])) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(tile)), strict=True):
                if lo == hi:
                    continue
                if tile[lo] != home:
                    if parts and whole is None:
                        h = joined(parts)
                        yield from pairs(h, h, True)
                    home, parts, whole = tile[lo], [], None
                some = tuple(c[lo:hi] for c in held)
                if not guest[lo]:
                    parts.append(some)
                    continue
                if whole is None:
                    whole = joined(parts)
                    yield from pairs(whole, whole, True)
                yield from pairs(whole, some, False)
        if parts and whole is None:
            h = joined(parts)
            yield from pairs(h, h, True)

    return run


def embedding_near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, first_id, n_partners, keep) of every vector; partners have cosine ``threshold`` or more.

    ``first_id`` is the smallest partner, null where there is none; a vector stays if that is larger than its own id or there is none.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0))
    # equal vectors meet by 128 bits of hashes, so only ids travel; an id with several vectors stands for itself
    marked = rows.select("vec_id", F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding").alias("h1"), F.size("embedding").alias("width"))
    known = materialize(marked.distinct(), "embeddings-ids")
    several = known.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("alone"))
    keyed = materialize(known.join(several, "vec_id", "left"), "embeddings-keys")
    kinds = keyed.groupBy("h0", "h1", "alone").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies"), F.first("width").alias("width"))
    same = lambda a, b: (a["h0"] == b["h0"]) & (a["h1"] == b["h1"]) & a["alone"].eqNullSafe(b["alone"])
    kinds = materialize(kinds.withColumn("row", F.xxhash64("h0", "h1", "head")), "embeddings-kinds")
    second = keyed.join(kinds.drop("width"), same(keyed, kinds)).where(keyed["vec_id"] != kinds["head"]).groupBy("row").agg(F.min("vec_id").alias("second"))
    # the vector of a kind is that of its head
    one = kinds.select("row", F.col("head").alias("vec_id"), "copies", F.col("h0").alias("k0"), F.col("h1").alias("k1"))
    held = rows.withColumn("k0", F.xxhash64("embedding")).withColumn("k1", F.xxhash64(F.lit(1), "embedding"))
    distinct = held.join(one, ["vec_id", "k0", "k1"]).groupBy("row", "vec_id", "copies").agg(F.first("embedding").alias("embedding")).select("row", "embedding", "vec_id", "copies")
    distinct = materialize(distinct, "embeddings-distinct")
    widths = kinds.groupBy("width").agg(F.count("*")).orderBy("width").collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], "vec_id long, first_id long, n_partners long, keep boolean")
    found = reduce(DataFrame.union, [_partners_of_width(distinct.where(F.size("embedding") == width), width, n, threshold, tile) for width, n in widths])
    near = found.groupBy("row").agg(F.min("first_id").alias("near_id"), F.sum("n").alias("n"))
    every = keyed.join(kinds.drop("width"), same(keyed, kinds)).select(keyed["vec_id"], "row", "head", "copies").join(near, "row", "left").join(second, "row", "left")
    # copies are partners of each other: the head's first one is the second of them
    own = F.when(F.col("vec_id") == F.col("head"), F.col("second")).otherwise(F.col("head"))
    each = every.select("vec_id", F.least("near_id", own).alias("first_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    first = each.groupBy("vec_id").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n_partners"))
    return first.withColumn("keep", F.coalesce(F.col("first_id") > F.col("vec_id"), F.lit(True)))


def _partners_of_width(rows: DataFrame, width: int, n: int, threshold: float, tile: int) -> DataFrame:
    """``PARTNERS`` among n vectors of one width."""
    spark = rows.sparkSession
    moments = np.zeros((width, width))
    for i, j, v in rows.mapInArrow(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        moments[i, j] = moments[j, i] = v
    axes = np.linalg.eigh(moments)[1][:, ::-1]
    turned = materialize(rows.mapInArrow(_rotate(spark.sparkContext.broadcast(np.ascontiguousarray(axes)), width), "row long, vec_id long, copies long, c0 double, c1 double, v array<double>"), "embeddings-rotated")

    # tiles: strips of equal counts on the first axis, and of those on the second
    kept = ("row", "vec_id", "copies", "v")
    strips = max(1, int(np.ceil(np.sqrt(n / tile))))
    if strips > 1:
        shares = [k / strips for k in range(1, strips)]
        cuts = turned.agg(F.percentile_approx("c0", shares, 100 * strips).alias("cuts"))
        placed = turned.crossJoin(F.broadcast(cuts)).withColumn("s0", F.size(F.filter("cuts", lambda x: x < F.col("c0")))).drop("cuts")
        inner = placed.groupBy("s0").agg(F.percentile_approx("c1", shares, 100 * strips).alias("cuts")).withColumnRenamed("s0", "s")
        placed = placed.join(inner, F.col("s0") == F.col("s")).withColumn("tile", F.col("s0") * strips + F.size(F.filter("cuts", lambda x: x < F.col("c1")))).select("tile", *kept)
    else:
        placed = turned.select(F.lit(0).alias("tile"), *kept)
    placed = materialize(placed, "embeddings-tiles")

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    dims = min(BOX, width)
    box = placed.groupBy("tile").agg(*(f(F.element_at("v", k + 1)).alias(f"{n_}{k}") for k in range(dims) for n_, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda c: F.floor(c / reach)
    a = box.select(*(F.col(c).alias(f"a_{c}") for c in box.columns)).withColumn("cell", F.explode(F.sequence(cell(F.col("a_lo0") - reach), cell(F.col("a_hi0") + reach))))
    b = box.select(*(F.col(c).alias(f"b_{c}") for c in box.columns)).withColumn("cell", F.explode(F.sequence(cell(F.col("b_lo0")), cell(F.col("b_hi0")))))
    apart = sum((F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) ** 2 for k in range(dims)), F.lit(0.0))
    met = a.join(b, "cell").where((F.col("a_tile") < F.col("b_tile")) & (apart <= reach * reach)).select(F.col("a_tile").alias("home"), F.col("b_tile").alias("of")).distinct()
    guests = placed.join(met, placed["tile"] == met["of"]).select("home", F.lit(True).alias("guest"), *kept)
    both = placed.select(F.col("tile").alias("home"), F.lit(False).alias("guest"), *kept).union(guests)
    return both.repartition("home").sortWithinPartitions("home", "guest", "vec_id").mapInArrow(_compare(threshold, width), PARTNERS)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), n AS (
  SELECT vec_id, min(other) AS first_id, count(*) AS n FROM p GROUP BY vec_id
)
SELECT DISTINCT vec_id, first_id, coalesce(n, 0)::BIGINT AS n_partners, coalesce(first_id > vec_id, true) AS keep FROM v LEFT JOIN n USING (vec_id)
"""
