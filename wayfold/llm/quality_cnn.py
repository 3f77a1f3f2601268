"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of eight bytes slide over the whole text by four; each overlapping chunk is max-pooled
over its positions; the means and maxima of the chunks' values combine into one probability.

Defined results: null and empty texts are one chunk of zeros and have its score; repeated rows get equal scores; ties at
the threshold count as 1; an empty table gives no rows, and without labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, durable, fold_of, read, text_slices, text_view, tidy

STRIDE = 4  # filters cover 2 * STRIDE bytes
DIM = 8
FILTERS = 24
CHUNK, HOP = 64, 56  # positions: 256 bytes, of which 32 are shared with the next chunk
#: Bounds of the training sample, as expected values: labelled rows, and bytes of all their texts (whole ones).
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 12 << 20
#: Bytes of texts that one training step takes in (one text at least).
STEP_BYTES = 1 << 18
EPOCHS = 8
THRESHOLD = 0.3


def chunks_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes padded with zeros to whole positions (rows x STRIDE, one spare row a text), first position of each chunk,
    and chunks before each text. Each text has one chunk at least; the last chunk ends where the text ends."""
    size = np.diff(off)
    rows = np.maximum(1, -(-size // STRIDE)) + 1
    begin = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(begin[-1] * STRIDE, np.uint8)
    shift = begin[:-1] * STRIDE - off[:-1]
    flat[np.arange(len(data)) + np.repeat(shift, size)] = data
    n = np.maximum(1, -(-(rows - 1 - (CHUNK - HOP)) // HOP))
    before = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(before[-1]) - np.repeat(before[:-1], n)
    return flat.reshape(-1, STRIDE), np.stack([np.repeat(begin[:-1], n) + k * HOP, np.repeat(begin[1:] - 1, n)], 1), before


@dataclass
class ByteConv:
    emb: np.ndarray
    w: np.ndarray  # 2 * STRIDE * DIM x FILTERS
    b: np.ndarray
    v: np.ndarray  # 2 * FILTERS
    c: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 5) -> ByteConv:
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.7, (256, DIM)).astype(np.float32)
        w = r.normal(0, 1 / np.sqrt(2 * STRIDE * DIM), (2 * STRIDE * DIM, FILTERS)).astype(np.float32)
        z = lambda n: np.zeros(n, np.float32)
        return cls(emb, w, z(FILTERS), z(2 * FILTERS), z(1), z(2 * FILTERS), z(2 * FILTERS) + 1)

    def positions(self, grid: np.ndarray) -> np.ndarray:
        x = self.emb[grid].reshape(len(grid), -1)
        half = STRIDE * DIM
        y = x @ self.w[:half] + self.b
        y[:-1] += x[1:] @ self.w[half:]
        return np.maximum(y, 0, out=y)

    def pool(self, y: np.ndarray, spans: np.ndarray) -> np.ndarray:
        edges = np.stack([spans[:, 0], np.minimum(spans[:, 0] + CHUNK, spans[:, 1])], 1).ravel()
        return np.maximum.reduceat(y, edges, axis=0)[::2]

    @staticmethod
    def gather(pooled: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = np.diff(before)[:, None]
        return np.concatenate([np.add.reduceat(pooled, before[:-1], axis=0) / n, np.maximum.reduceat(pooled, before[:-1], axis=0)], 1)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros(0)
        grid, spans, before = chunks_of(data, off)
        f = (self.gather(self.pool(self.positions(grid), spans), before) - self.mean) / self.std
        return 1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -30, 30).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteConv:
        """Adam on the logistic loss; gradients flow through the positions and chunks that the maxima chose."""
        r = np.random.default_rng(seed)
        params = [self.emb, self.w, self.b, self.v, self.c]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        half, prior = STRIDE * DIM, np.clip(labels.mean(), 0.01, 0.99)
        self.c[:] = np.log(prior / (1 - prior))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            size = np.cumsum([len(texts[i]) for i in order])
            hi = 0
            while hi < len(order):
                lo, hi = hi, max(hi + 1, min(hi + batch, int(np.searchsorted(size, (size[hi - 1] if hi else 0) + STEP_BYTES))))
                pick = order[lo:hi]
                off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
                grid, spans, before = chunks_of(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), off)
                y = self.positions(grid)
                at = np.minimum(spans[:, :1] + np.arange(CHUNK), spans[:, 1:] - 1)
                window = y[at]
                arg = window.argmax(1)
                pooled = np.take_along_axis(window, arg[:, None], 1)[:, 0]
                raw = self.gather(pooled, before)
                if epoch == 0 and lo == 0:
                    self.mean[:], self.std[:] = raw.mean(0), raw.std(0) + 0.1
                f = (raw - self.mean) / self.std
                p = 1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -30, 30)))
                d = ((p - labels[pick]) / len(pick)).astype(np.float32)
                df = d[:, None] * self.v / self.std
                n, owner = np.diff(before), np.repeat(np.arange(len(pick)), np.diff(before))
                dp = (df[:, :FILTERS] / n[:, None])[owner]
                top = pooled == raw[owner, FILTERS:]
                dp = (dp + df[owner, FILTERS:] * top) * (pooled > 0)
                where = np.take_along_axis(at, arg, 1)
                gw, ge = np.zeros_like(self.w), np.zeros_like(self.emb)
                follow = np.minimum(where + 1, len(grid) - 1)
                for j in range(FILTERS):
                    bytes_ = np.concatenate([grid[where[:, j]], grid[follow[:, j]]], 1)
                    x = self.emb[bytes_].reshape(len(bytes_), -1)
                    gw[:, j] = x.T @ dp[:, j]
                    back = np.outer(dp[:, j], self.w[:, j]).reshape(-1, DIM)
                    for k in range(DIM):
                        ge[:, k] += np.bincount(bytes_.ravel(), back[:, k], 256).astype(np.float32)
                grads = [ge, gw, dp.sum(0), f.T @ d + 1e-4 * self.v, np.array([d.sum()])]
                step += 1
                for q, g, m, s in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    q -= (rate / (1 + epoch / 4) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = SAMPLE_ROWS) -> ByteConv:
    """Train on a hashed sample of labelled ids (see the bounds above) with all chunks of their texts, however long. An id
    counts once: its largest label, and of several texts the smallest. Without labels all scores are 0.5."""
    y = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = y.count()
    y = bounded_sample(y, "doc_id", 2 * sample_rows, total, "cnn")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    rows = durable(d.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    share = min(1.0, sample_rows / max(n.n, 1), SAMPLE_BYTES / max(n.b or 1, 1))
    rows = bounded_sample(rows, "doc_id", int(2**20 * share), 2**20, "cnn step").toPandas().sort_values("doc_id")
    model = ByteConv.fresh()
    return model.train([t.encode() for t in rows.text], rows.y.to_numpy(np.float32)) if len(rows) else model


def scorer(spark: SparkSession, model: ByteConv):
    """A column function over Arrow strings: text -> score (null texts are empty)."""
    shared = spark.sparkContext.broadcast(model)  # some ten kilobytes

    def run(texts: pa.Array) -> pa.Array:
        data, off = text_view(texts)
        parts = [shared.value.score(part, o) for _, _, part, o in text_slices(data, off)]
        tidy()
        return pa.array(np.concatenate(parts or [np.zeros(0)]))

    return F.arrow_udf(run, "double").asNondeterministic()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold_of(F.col("doc_id")) == 0
    model = fit(d, read(spark, sf_dir, "labels").where(~held))
    d = d.select("doc_id", held.alias("held_out"), scorer(spark, model)(F.col("text")).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
