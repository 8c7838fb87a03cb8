"""Quality classifier: naive Bayes support vectors (operator 8).

Features are indicators of n-grams: byte trigrams, and n-grams over word shapes
in which a word equal to the one before it is a symbol of its own; all hashed
to BUCKETS.  Each indicator is scaled by the log of its class ratio (naive
Bayes), a linear hinge-loss model is fitted on the scaled, length-normalised
vectors by dual coordinate descent, and its margin is mapped to a probability.

The model is fitted on at most TRAIN_ROWS labelled rows that aren't held out
(the first by a hash of the id, half of them per class as far as they go).  What
reaches the driver are their n-grams, taken by the executors: one row an id, of
at most BUCKETS / 8 bytes, whatever the length of the text.  Scoring is one pass
over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import textops
from chunkweave.session import small_batches

U64 = np.uint64
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
TRAIN_ROWS = 4000
EPOCHS = 30
#: Values of scaled examples that the driver keeps between epochs; beyond, they are made when needed.
KEPT_VALUES = 1 << 24
SHAPE_GRAMS = 4
CUTOFF = 0.7
_CLASS = np.full(256, 4, np.uint64)  # 4: letters beyond ASCII; the rest by kind
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 5
_CLASS[:0x21] = 0


def _shapes(words: textops.Words) -> np.ndarray:
    """A small code per word: which kinds of characters it has, its first kind, and whether it repeats the one before."""
    body = words.body
    if not len(words.start):
        return np.zeros(0, U64)
    kinds = np.zeros(len(words.start), U64)
    for k in range(1, 6):
        sums = np.concatenate(([0], np.cumsum(_CLASS[body] == k, dtype=np.int64)))
        kinds |= (sums[words.end] > sums[words.start]).astype(U64) << U64(k)
    code = kinds | (_CLASS[body[words.start]] << U64(8)) | (_CLASS[body[words.end - 1]] << U64(12))
    own = words.hashes(fold=False)
    again = np.zeros(len(own), bool)
    again[1:] = own[1:] == own[:-1]
    begins = words.bounds[:-1][words.count > 0]
    again[begins] = False
    code[again] = U64(1 << 20)
    return textops.mix(code + U64(77))


def indicators(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the different n-grams of each text, sorted by both."""
    n = len(offsets) - 1
    keys = []
    if len(body) >= 3:
        wide = body.astype(np.int64)
        gram = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
        size = np.maximum(np.diff(offsets) - 2, 0)
        at = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        row = np.repeat(np.arange(n), size)
        bucket = ((gram[at].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKET_BITS)).astype(np.int64)
        keys.append(row << BUCKET_BITS | bucket)
    words = textops.Words(body, offsets)
    shapes = _shapes(words)
    for k in range(1, SHAPE_GRAMS + 1):
        found, bounds = textops.windows(shapes, words.bounds, k, whole=False)
        row = np.repeat(np.arange(n), np.diff(bounds))
        keys.append(row << BUCKET_BITS | (textops.mix(found + U64(k)) >> U64(64 - BUCKET_BITS)).astype(np.int64))
    flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if len(flat):
        flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
    return flat >> BUCKET_BITS, flat & (BUCKETS - 1)


@dataclass
class Model:
    """weight and norm hold w*r and r*r of each bucket."""

    weight: np.ndarray
    norm: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = indicators(body, offsets)
        n = len(offsets) - 1
        dot = np.bincount(row, self.weight[bucket], n)
        square = np.bincount(row, self.norm[bucket], n)
        return dot / np.sqrt(np.maximum(square, 1e-9)) + self.bias

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(body, offsets) + self.shift, -35, 35)))


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights and bias by dual coordinate descent.

    Example i has the values ratio[rows[i]], scaled to length one.  Each step takes one example
    and moves its multiplier, kept in [0, cost i], to where the projected
    gradient of the dual vanishes.  It ends when no gradient of an epoch
    exceeds 1e-3, or after `epochs`.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    kept = [_unit(ratio[r]).astype(np.float32) for r in rows] if sum(map(len, rows)) <= KEPT_VALUES else None
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            r = rows[i]
            v = kept[i] if kept else _unit(ratio[r])
            slack = y[i] * (float(w[r] @ v) + bias) - 1
            projected = min(slack, 0) if alpha[i] == 0 else max(slack, 0) if alpha[i] == cost[i] else slack
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - slack / 2, 0), cost[i])  # 2: a vector of length one, and the bias as a constant feature
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * v
                bias += step
        if worst < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic map, by Newton steps on smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-12)
        grad = np.array([g @ margin + 1e-3 * a, g.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def gram_bytes(texts: pa.Array) -> list[bytes]:
    """The buckets of each text: as numbers, or as a bit each where that is shorter."""
    out = []
    for _, _, body, offsets in textops.chunks(texts, 1 << 18):
        row, bucket = indicators(body, offsets)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = bucket[a:b]
            if len(own) * 4 < BUCKETS // 8:
                out.append(own.astype("<i4").tobytes())
            else:
                flags = np.zeros(BUCKETS, bool)
                flags[own] = True
                out.append(np.packbits(flags).tobytes())
    return out


def gram_buckets(packed: bytes) -> np.ndarray:
    """What `gram_bytes` packed."""
    if len(packed) < BUCKETS // 8:
        return np.frombuffer(packed, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))).astype(np.int32)


def fit(grams: list[bytes], labels: list[int], cost: float = 1.0, smooth: float = 1.0, epochs: int = EPOCHS) -> Model:
    """A model of quality 1 against 0.  With one class, or no rows, all texts score 1 resp. 0, or 0.5."""
    if len(set(labels)) < 2:
        sure = 0.0 if not labels else 10.0 if labels[0] == 1 else -10.0
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, sure)
    order = np.random.default_rng(3).permutation(len(grams))
    rows, y = [gram_buckets(grams[i]) for i in order], np.where(np.array(labels)[order] == 1, 1.0, -1.0)

    def count(idx: np.ndarray, sign: float) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for i in idx:
            if y[i] == sign:
                out[rows[i]] += 1  # the buckets of an example differ
        return out

    def train(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        p, q = count(idx, 1.0) + smooth, count(idx, -1.0) + smooth
        n1, n0 = max((y[idx] > 0).sum(), 1), max((y[idx] < 0).sum(), 1)
        r = np.log((p / (n1 + 2 * smooth)) / (q / (n0 + 2 * smooth)))
        each = np.where(y[idx] > 0, cost * len(idx) / (2 * n1), cost * len(idx) / (2 * n0))
        w, bias = dual_descent([rows[i] for i in idx], r, y[idx], each, epochs)
        return w, r, bias

    # the map to probabilities is fitted on margins of rows that a model hasn't seen
    folds = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for f in range(3):
        idx = np.flatnonzero(folds != f)
        if len(set(y[idx])) < 2:
            idx = np.arange(len(y))
        w, r, bias = train(idx)
        for i in np.flatnonzero(folds == f):
            margin[i] = float(w[rows[i]] @ _unit(r[rows[i]])) + bias
    slope, shift = _platt(margin, y, np.ones(len(y)))
    w, r, bias = train(np.arange(len(y)))
    return Model((w * r).astype(np.float64), r * r, bias, max(slope, 1e-3), shift)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> list:
    """At most `rows` (doc_id, quality, grams), first by a hash of the id; of a repeated id one."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64("doc_id")
    some = None
    for q in (0, 1):
        part = known.filter(F.col("quality") == q).orderBy(rank, "doc_id").limit(rows // 2)
        some = part if some is None else some.union(part)
    picked = docs.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")  # at most `rows` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gram_bytes(batch.column(2)), pa.binary())], names=["doc_id", "quality", "grams"])

    return picked.mapInArrow(run, "doc_id long, quality int, grams binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("grams").alias("grams")).collect()


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Every whole text is scored; a null text counts as empty.  Labels with a null
    id or quality are left out, an id labelled both ways counts as 0, repeated
    rows are scored each (one of them is learnt from).  Without usable labels of both classes every text gets
    the score of the one class seen, or 0.5.  A null id is not held out.
    """
    shared = shared_model(spark, docs, labels, train_rows, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch_scores(shared.value, batch.column(1)))], names=["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def shared_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS):
    """The fitted model, broadcast: 2 x BUCKETS numbers whatever the input's size."""
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = sorted(training_rows(own, known, train_rows), key=lambda r: r["doc_id"])
    return spark.sparkContext.broadcast(fit([bytes(r["grams"]) for r in sample], [r["quality"] for r in sample], epochs=epochs))


def batch_scores(model: Model, texts: pa.Array) -> np.ndarray:
    parts = [model.scores(body, offsets) for _, _, body, offsets in textops.chunks(texts, 1 << 18)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows predicted 1, with all their columns; no shuffle."""
    shared = shared_model(spark, docs, labels, train_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.filter(pa.array(batch_scores(shared.value, texts) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
