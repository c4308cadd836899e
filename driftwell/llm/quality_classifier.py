"""A quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

1. Words (runs of letters, or of ASCII punctuation; case kept) fall into ``buckets`` hash buckets. A bucket has a fixed sparse
   index vector of +1 and -1; its word vector is the sum of the index vectors two places left and right of it over the whole
   corpus. Each task sums its own texts, and Spark sums a bucket's rows.
2. A document is the mean, and the mean square, of its words' unit vectors, with rare buckets weighted up, the logarithm of
   its length and its share of distinct words.
3. A network with one hidden layer learns from about ``most`` labelled rows at most, those whose ids have the least hashes; it
   is small, and fitted on the driver. A fifth of those rows set the temperature that calibrates its probabilities.

The vectors have a fixed size, so they go to all tasks whatever the corpus. Null and empty texts are vectors of zeros and get
a score like any other. Rows with a null id or label are scored but not learned from. With fewer than ``LEAST`` labelled rows
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import MARKS, saved, slices, small_batches, word_hashes

LEAST = 20


def index_vectors(buckets: int, width: int, ones: int = 4) -> np.ndarray:
    """A sparse vector of +1 and -1 for each bucket, the same in every process."""
    rng = np.random.default_rng(11)
    out = np.zeros((buckets, width), np.int8)
    for _ in range(ones):
        out[np.arange(buckets), rng.integers(0, width, buckets)] += rng.choice(np.array([-1, 1], np.int8), buckets)
    return out


def _tokens(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes(texts, lower=False, kinds=MARKS)
    return (words % np.uint64(buckets)).astype(np.int32), first


def _contexts(buckets: int, width: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(buckets, width)
        total, often = np.zeros((buckets, width)), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                ids, first = _tokens(texts.slice(a, b - a), buckets)
                if not len(ids):
                    continue
                doc = np.repeat(np.arange(b - a), np.diff(first))
                near = np.zeros((len(ids), width), np.int8)
                for k in range(1, min(reach, len(ids) - 1) + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    near[k:] += index[ids[:-k]] * same
                    near[:-k] += index[ids[k:]] * same
                for d in range(width):
                    total[:, d] += np.bincount(ids, weights=near[:, d], minlength=buckets)
                often += np.bincount(ids, minlength=buckets)
        full = np.flatnonzero(often)
        if len(full):
            columns = [pa.array(full.astype(np.int32)), pa.array(often[full]), *(pa.array(total[full, d].astype(np.int64)) for d in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "often", *(f"v{d}" for d in range(width))])

    return run


def word_vectors(docs: DataFrame, text: str = "text", buckets: int = 2**14, width: int = 32, reach: int = 2) -> np.ndarray:
    """Each bucket's weighted unit vector; the weight of a bucket with a share p of all words is 0.001 / (0.001 + p)."""
    small_batches(docs.sparkSession)
    names = [f"v{d}" for d in range(width)]
    schema = "bucket int, often long, " + ", ".join(f"{c} long" for c in names)
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contexts(buckets, width, reach), schema)
    found = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("often", *names))).toPandas()
    out = np.zeros((buckets, width), np.float32)
    if len(found):
        v = found[names].to_numpy(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        share = found["often"].to_numpy(float) / found["often"].sum()
        out[found["bucket"].to_numpy()] = v * (1e-3 / (1e-3 + share))[:, None]
    return out


def _pooled(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        buckets, width = table.shape
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids, first = _tokens(texts.slice(a, b - a), buckets)
                n = np.diff(first)
                x = np.zeros((b - a, 2 * width + 2), np.float32)
                full = np.flatnonzero(n)
                if len(full):
                    v = table[ids]
                    x[full, :width] = np.add.reduceat(v, first[full]) / n[full, None]
                    x[full, width : 2 * width] = np.add.reduceat(v * v, first[full]) / n[full, None]
                    x[full, -2] = np.log1p(n[full])
                    doc = np.repeat(np.arange(b - a, dtype=np.int64), n)
                    kinds = np.unique(doc * buckets + ids) // buckets
                    x[full, -1] = np.bincount(kinds, minlength=b - a)[full] / n[full]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows], names=["id", "x"])

    return run


class Network:
    """Features -> tanh layer -> one logit, divided by a temperature."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], temperature: float = 1.0):
        self.mean, self.scale, self.weights, self.temperature = mean, scale, weights, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature is the best on the rest."""
    width = x.shape[1]
    rng = np.random.default_rng(3)
    if len(y) < LEAST or y.min() == y.max():
        p = 0.5 if len(y) < LEAST else (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.float64(np.log(p / (1 - p)))])
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    w = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            step += 1
            z = (x[batch] - mean) / scale
            h = np.tanh(z @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -50, 50))) - y[batch]) / len(batch)
            back = np.outer(error, w[2]) * (1 - h * h)
            grad = [z.T @ back + decay * w[0], back.sum(0), h.T @ error + decay * w[2], error.sum()]
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, w)
    z = net.logit(x[held])
    loss = lambda t: np.logaddexp(0, -np.where(y[held] > 0, z, -z) / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def scored(
    docs: DataFrame, labels: DataFrame, learn: str, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, buckets: int = 2**14, width: int = 32
) -> DataFrame:
    """(id, score) of each row of ``docs``; rows of ``labels`` (id, label) for which the SQL condition ``learn`` holds are learned from. Ids are whole numbers, or what casts to them."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text, buckets, width))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    x = saved(rows.mapInArrow(_pooled(vectors), "id long, x array<float>"))
    known = labels.where(learn).where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(label).cast("double").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    sample = x.join(known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)), "id").toPandas().sort_values(["id", "y"])
    net = fit(np.array(sample["x"].tolist(), np.float64).reshape(-1, 2 * width + 2), sample["y"].to_numpy(float))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "score": net.probability(np.array(p["x"].tolist(), np.float64)).reshape(-1)}) if len(p) else pd.DataFrame({"id": p["id"], "score": []})

    return x.mapInPandas(score, "id long, score double").withColumnRenamed("id", id)
