"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed character n-grams (1 to 3 characters, lower case, runs of anything but
letters as one blank), weighted by term frequency (share of the text's n-grams) times inverse document frequency.  Document frequencies count every document of the
table.  Weights are trained by follow-the-regularised-leader (FTRL-proximal) with an
elastic net, which leaves most of them at zero, on a bounded sample of labelled rows
(``SAMPLE``, chosen by a hash of their ids); every fifth row of that sample is held out and fits one
temperature that calibrates the probabilities (fewer than five rows hold none out, and it stays at 1).  Only counts of hashed features leave the executors, no
texts, so the sample is bounded in bytes too.  Every document is then scored whole.

A document is accepted when its most probable language has at least ``LEAST`` calibrated
probability.

Nulls: a null label is no label; a null text, like one without letters, has no language: it
is reported as ``und`` with probability 0 and not accepted.  Very long texts are scored whole.  Ties take the language that
sorts first.  Repeated rows are scored each, and count each in the document frequencies.  Only ``doc_id``, ``text`` and ``lang`` are
read, so other columns never clash.  Empty or unlabelled tables have no language to learn:
every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectext import chunks

ORDERS = (1, 2, 3)
BITS = 15
NONE = 1 << BITS
#: At most about so many labelled rows train and calibrate the model.
SAMPLE = 2000
EPOCHS = 3
LEAST = 0.5
#: FTRL-proximal: learning rate, its smoothing, elastic net.
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.002, 0.0001
_CODES = 1 << 16


def _letters() -> np.ndarray:
    """Lower-cased letter of each 16-bit code point, 32 for anything else."""
    out = np.full(_CODES, 32, np.uint16)
    for code in range(_CODES):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_TABLE: list[np.ndarray] = []


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of a chunk, their offsets, and whether each text has a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    # characters beyond the first plane take two units here, and both count as blank
    units = np.cumsum(((data & 0xC0) != 0x80) + (data >= 0xF0).view(np.int8), dtype=np.int32)
    starts = np.where(offs > 0, units[offs - 1] if len(units) else 0, 0)
    code = _TABLE[0][np.frombuffer(data.tobytes().decode().encode("utf-16-le"), np.uint16)]
    letter = code != 32
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    sums = np.zeros(len(code) + 1, np.int32)
    np.cumsum(keep, out=sums[1:])
    code = code[keep]
    bounds = sums[starts].astype(np.int64)
    sums = np.zeros(len(code) + 1, np.int32)
    np.cumsum(code != 32, out=sums[1:])
    return code, bounds, sums[bounds[1:]] > sums[bounds[:-1]]


def features(chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed feature of each order's n-gram at every position; NONE where it would leave its text."""
    n = len(chars)
    out = np.full((len(ORDERS), n), NONE, np.int32)
    h = np.zeros(n, np.uint32)
    for order in range(1, ORDERS[-1] + 1):
        if n < order:
            break
        h = h[: n - order + 1] * np.uint32(0x01000193) + chars[order - 1 :]
        if order in ORDERS:
            row = out[ORDERS.index(order)]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            row[: n - order + 1] = mixed >> np.uint32(32 - BITS)
            for back in range(1, order):
                crossing = bounds[1:] - back
                row[crossing[crossing >= 0]] = NONE
    return out


def counts_of(feat: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Occurrences of each feature in one text."""
    return np.bincount(feat[:, lo:hi].ravel(), minlength=NONE + 1)[:NONE]


@dataclass
class Model:
    """Weights already multiplied by inverse document frequencies; one column for each language."""

    languages: list[str]
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text of a chunk, and whether it has letters."""
        chars, bounds, some = characters(data, offs)
        feat = features(chars, bounds)
        out = np.tile(self.bias, (len(offs) - 1, 1))
        for r in np.flatnonzero(some):
            n = counts_of(feat, bounds[r], bounds[r + 1])
            out[r] += (n.astype(np.float32) @ self.weights) / max(1, n.sum())
        return out, some

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, some = self.logits(data, offs)
        return softmax(z / self.temperature), some


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal with an elastic net over rows (language, features, their shares of the text) in turn, then one temperature."""
    languages = sorted({lang for lang, *_ in rows})
    k, d = len(languages), len(idf)
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    vectors = [(np.append(i, d), np.append(v * idf[i], 1.0), languages.index(lang)) for lang, i, v in rows if len(i)]
    held = vectors[4::5]
    used = [v for j, v in enumerate(vectors) if j % 5 != 4]

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, v, y in used:
            w = weights(i)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    full = weights(np.arange(d + 1))
    scores = np.array([v @ full[i] for i, v, _ in held]) if held else np.zeros((0, k))
    truth = np.array([y for *_, y in held], np.int64)
    # scores grow well beyond 1 once divided: the grid holds temperatures from 0.02 to 5
    grid = np.exp(np.linspace(np.log(0.02), np.log(5.0), 120))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() if held else 0.0 for t in grid]
    best = float(grid[int(np.argmin(loss))]) if held else 1.0
    return Model(languages, (full[:d] * idf[:, None]).astype(np.float32), full[d], best)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, data, offs in chunks(batch.column(0)):
            chars, bounds, some = characters(data, offs)
            feat = features(chars, bounds)
            for r in np.flatnonzero(some):
                total += counts_of(feat, bounds[r], bounds[r + 1]) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "df"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offs in chunks(batch.column(3)):
            chars, bounds, some = characters(data, offs)
            feat = features(chars, bounds)
            found = []
            for r in range(len(offs) - 1):
                n = counts_of(feat, bounds[r], bounds[r + 1]) if some[r] else np.zeros(0, np.int64)
                at = np.flatnonzero(n)
                found.append((at.tolist(), n[at].tolist()))
            at, n = zip(*found, strict=True)
            m = len(found)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, m) for c in range(3)), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], names=["draw", "doc_id", "lang", "at", "n"]
            )


def _predict(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        names = np.array([*held.languages, "und"]) if held else np.array(["und"])
        for batch in batches:
            for lo, data, offs in chunks(batch.column(1)):
                m = len(offs) - 1
                if held is None:
                    best, p = np.zeros(m, np.int64), np.zeros(m)
                else:
                    probs, some = held.probabilities(data, offs)
                    best = np.where(some, probs.argmax(1), len(held.languages))
                    p = np.where(some, probs.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, m), pa.array(names[best]), pa.array(np.round(p, 6)), pa.array(p >= least)],
                    names=["doc_id", "language", "probability", "accepted"],
                )

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model | None:
    """Train on about ``sample`` labelled rows of ``docs``, with document frequencies of all of it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    df = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    labelled = texts.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    total, rows = texts.agg(F.count("text"), F.count(F.when(F.col("lang").isNotNull(), F.col("text")))).first()
    if not rows:
        return None
    share = min(1.0, sample / rows)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = labelled.select(draw.alias("draw"), "doc_id", "lang", "text").where(F.col("draw") < int(share * (1 << 30)))
    sampled = drawn.mapInArrow(_sampled, "draw long, doc_id long, lang string, at array<int>, n array<long>").toArrow().to_pylist()
    chosen = sorted((r["draw"], r["doc_id"], r["lang"], r["at"], r["n"]) for r in sampled)
    counts = np.zeros(1 << BITS)
    for feature, n in df.collect():
        counts[feature] = n
    idf = np.log((1 + total) / (1 + counts)) + 1
    vectors = [(lang, np.array(at, np.int64), np.array(n, float) / max(1, sum(n))) for _, _, lang, at, n in chosen]
    return train(vectors, idf, epochs) if chosen else None


def identify(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """(doc_id, language, probability, accepted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(held, least), "doc_id long, language string, probability double, accepted boolean")


def _accepted(model, least: float):
    predict = _predict(model, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])
            ok = pa.concat_arrays([b.column(3) for b in predict(iter([both]))]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(ok)

    return run


def keep_identified(docs: DataFrame, least: float = LEAST, **params: int) -> DataFrame:
    """The rows whose language is accepted, with all their columns; no row moves."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, **params))
    return docs.mapInArrow(_accepted(held, least), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
