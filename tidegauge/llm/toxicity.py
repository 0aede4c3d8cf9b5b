"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. A bounded, hash-ordered sample of labelled rows (``sample``) is featurised on the executors:
   every distinct character n-gram of the whole lower-cased text falls into a hash bucket.
2. Per bucket, documents of either label are counted. The log-count ratio over its standard error, less
   ``chance`` (as far as it gets by chance in one of twenty buckets), scales the feature; buckets within chance
   scale to zero, at any number of rows. A document's features are scaled to length one.
3. A logistic regression is fitted on the scaled features. What reaches the driver is a scale per bucket and, of
   the ``sample`` rows, the numbers of their buckets beyond chance.
4. Scoring reads every whole text once with two tables of known size and needs no shuffle.

Defined results: a null or empty text gets the score of a text without features. Labels that are
null are not learnt from; of repeated labels of one document the larger counts, and each of its rows
is learnt from. Without both labels in the sample the score is the smoothed share of label 1. A null
``doc_id`` keeps its row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import texts
from tidegauge.session import cut_lineage

SLICE = 1 << 20
ENTRIES = 1 << 18


@dataclass(frozen=True)
class ToxicityConfig:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    #: Labelled rows that the fit uses at most, chosen by a hash of their id.
    sample: int = 8192
    smoothing: float = 1.0
    chance: float = 2.0
    #: Penalty on all weights together; over the rows, that of one row.
    penalty: float = 0.1
    steps: int = 400


@dataclass(frozen=True)
class ToxicityModel:
    config: ToxicityConfig
    used: np.ndarray  # buckets beyond chance, ascending
    scales: np.ndarray  # of each of them
    weights: np.ndarray  # scale times fitted weight
    intercept: float
    fitted_rows: int = 0


def buckets(text: str | None, config: ToxicityConfig) -> Iterator[np.ndarray]:
    """Bucket numbers of the character n-grams of a text, in slices of bounded size."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    most = max(config.sizes)
    shift = np.uint32(32 - config.bits)
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + most - 1]
        for size in config.sizes:
            n = min(SLICE, len(part) - size + 1)
            if n <= 0:
                continue
            code = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(size):
                code *= np.uint32(0x01000193)
                code ^= part[k : k + n]
                code *= np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            yield code >> shift


def present(text: str | None, config: ToxicityConfig) -> np.ndarray:
    marks = np.zeros(1 << config.bits, bool)
    for found in buckets(text, config):
        marks[found] = True
    return np.flatnonzero(marks)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """The sample: (doc_id, text, toxic) of labelled rows outside the held-out fifth.

    At most ``config.sample`` ids, all of which have a document, are broadcast, so the texts are not shuffled.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(config.sample)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """The model of the sample; see the module's text. The driver gets the scales of buckets beyond chance."""
    rows = training_rows(docs, labels, config)
    size = 1 << config.bits

    def read(batches):
        for batch in batches:
            found = [present(t.as_py(), config).astype("<i4").tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary()), batch["toxic"]], names=["doc_id", "buckets", "toxic"])

    sample = cut_lineage(rows.mapInArrow(read, "doc_id long, buckets binary, toxic int"))
    sums = sample.agg(F.count_if(F.col("toxic") != 1).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).first()
    n0, n1 = float(sums["n0"]), float(sums["n1"])
    if not n0 or not n1:
        none = np.zeros(0)
        return ToxicityModel(config, none.astype(np.int64), none, none, float(np.log((n1 + 0.5) / (n0 + 1.0))), int(n0 + n1))

    def counted(batches):
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for found, label in zip(batch["buckets"].to_pylist(), batch["toxic"].to_pylist()):
                counts[int(label == 1), np.frombuffer(found, "<i4")] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            arrays = [pa.array(part, pa.int32()), pa.array(counts[0, part]), pa.array(counts[1, part])]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "n0", "n1"])

    counts = sample.select("buckets", "toxic").mapInArrow(counted, "bucket int, n0 long, n1 long")
    table = counts.groupBy("bucket").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    table = table.select("bucket", scaled_ratio(F.col("c0"), F.col("c1"), n0, n1, config).alias("scale")).where("scale <> 0").toArrow()
    table = table.sort_by("bucket")
    used, scales = table["bucket"].to_numpy().astype(np.int64), table["scale"].to_numpy().astype(np.float64)

    def selected(batches):
        slots = _slots(used, config)
        for batch in batches:
            found = [slots[np.frombuffer(b, "<i4")] for b in batch["buckets"].to_pylist()]
            kept = pa.array([(f[f >= 0]).astype("<i4").tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([kept, batch["toxic"]], names=["slots", "toxic"])

    at, sizes, y = _placed(sample.select("buckets", "toxic").mapInArrow(selected, "slots binary, toxic int").toArrow())
    pa.default_memory_pool().release_unused()
    weights, intercept = _logistic(at, sizes, y, scales, config)
    return ToxicityModel(config, used, scales, scales * weights, intercept, int(n0 + n1))


def _slots(used: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """The place of every bucket among the used ones, or -1."""
    slots = np.full(1 << config.bits, -1, np.int32)
    slots[used] = np.arange(len(used), dtype=np.int32)
    return slots


def _placed(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all rows in one array, the number of each row's places, and whether each is toxic.

    Rows stand in the order of a digest of their places, so that sums don't depend on arrival order. They are copied
    once, from Arrow's memory.
    """
    views = [v.as_buffer() for chunk in found["slots"].chunks for v in chunk]
    labels = np.array([label == 1 for label in found["toxic"].to_pylist()], np.float64)
    digests = [blake2b(v, digest_size=16).digest() for v in views]
    order = sorted(range(len(views)), key=lambda i: (digests[i], labels[i]))
    sizes = np.array([views[i].size // 4 for i in order], np.int64)
    at, end = np.empty(sizes.sum(), np.int32), 0
    for i, size in zip(order, sizes):
        at[end : end + size] = np.frombuffer(views[i], "<i4")
        end += size
    return at, sizes, labels[order]


def _logistic(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, scales: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on scaled buckets, rows of length one, by accelerated gradient steps.

    ``at`` and ``sizes`` come from :func:`_placed`. Places are the only thing kept for each; a row's length and the
    scales are applied to sums, ``ENTRIES`` places at a time.
    """
    n, size = len(y), len(scales)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)  # rows with a bucket
    blocks = [b for b in np.split(some, np.flatnonzero(np.diff(starts[some] // ENTRIES)) + 1) if len(b)]

    def row_sums(of_place: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for b in blocks:
            first, end = starts[b[0]], starts[b[-1]] + sizes[b[-1]]
            out[b] = np.add.reduceat(of_place[at[first:end]], starts[b] - first)
        return out

    def place_sums(of_row: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for b in blocks:
            first, end = starts[b[0]], starts[b[-1]] + sizes[b[-1]]
            out += np.bincount(at[first:end], np.repeat(of_row[b], sizes[b]), size)
        return out

    shrink = 1.0 / np.sqrt(np.where(sizes > 0, row_sums(scales * scales), 1.0))
    penalty = config.penalty / n
    step = 1.0 / (0.25 * 2.0 + penalty)
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    vw, vb = np.zeros(size), 0.0
    for k in range(config.steps):
        momentum = k / (k + 3.0)
        aw, ab = w + momentum * vw, b + momentum * vb
        error = 1.0 / (1.0 + np.exp(-np.clip(shrink * row_sums(scales * aw) + ab, -30, 30))) - y
        nw = aw - step * (scales * place_sums(shrink * error) / n + penalty * aw)
        nb = ab - step * float(error.mean())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def scaled_ratio(c0: Column, c1: Column, n0: float, n1: float, config: ToxicityConfig) -> Column:
    """Scale of a bucket that ``c0`` and ``c1`` documents of either label hold: the logarithm of the ratio of their
    smoothed shares over its standard error, less ``chance`` towards zero."""
    a, b, spread = c1 + config.smoothing, c0 + config.smoothing, 2 * config.smoothing
    ratio = (F.log(a / (n1 + spread)) - F.log(b / (n0 + spread))) / F.sqrt(1 / a + 1 / b)
    return F.signum(ratio) * F.greatest(F.abs(ratio) - config.chance, F.lit(0.0))


def scored(text: Column, model: ToxicityModel) -> Column:
    """The score of a text column, between 0 and 1."""
    config, used, scales, weights, intercept = model.config, model.used, model.scales, model.weights, model.intercept

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        slots, sums = _slots(used, config), []
        for text in batch:
            found = [slots[b] for b in buckets(text.as_py(), config)]
            at = np.unique(np.concatenate([np.zeros(0, np.int32), *(f[f >= 0] for f in found)]))
            sums.append(weights[at].sum() / (np.sqrt(scales[at] @ scales[at]) or 1.0))
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(sums, np.float64) + intercept, -500, 500))))

    return run(text)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one pass, no shuffle."""
    out = texts(docs).select("doc_id", scored(F.col("text"), model).alias("score"))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def passing(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score under ``least``; no shuffle."""
    rows = docs.select(F.struct("*").alias("row"), scored(F.col("text").cast("string"), model).alias("score"))
    return rows.where(F.col("score") < least).select("row.*")
