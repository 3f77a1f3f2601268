"""Approximate nearest neighbours by inner product: inverted file of coarse centroids, product-quantised residuals,
asymmetric distance tables and exact reranking.

Vectors that are null, zero, or that hold null or non-finite components take no part; neither do rows with a null id.
Vectors of each length have an index of their own and are searched among their like. An empty table gives no rows. Equal
scores are ordered by the smaller id, and rows that repeat an id are candidates of their own (never of their own id).
Other columns of the table are not looked at, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, durable, read, tidy

#: Training sample, vectors a cell aims at, cells at least (of big enough tables) and at most; bytes a vector's code has.
SAMPLE = 16_384
SAMPLE_PER_CELL = 16
CELL_TARGET = 1000
MIN_CELLS = 64
MAX_CELLS = 4096
SUBSPACES = 16
#: Share of true neighbours that the visited cells hold, queries it is measured with (against all rows), and candidates
#: per visited block that are scored exactly, beside those within MARGIN quantisation errors of the k-th.
COVER = 0.94
COVER_QUERIES = 256
RERANK = 60
MARGIN = 1.0
#: Vectors and queries that one task step holds together; hot cells are dealt over several steps.
BLOCK = 2048
QUERY_BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; empty centroids move to far points. Fewer points than k: padded copies."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32).copy()
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(c)
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        c[full] = sums[full] / n[full, None]
        if len(full) < k:
            c[n == 0] = x[rng.choice(len(x), k - len(full))]
    return c


@dataclass
class Quantiser:
    """coarse: cells x dim; books: subspaces x 256 x dim / subspaces (the last subspace padded with zeros)."""

    coarse: np.ndarray
    books: np.ndarray

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    @classmethod
    def train(cls, x: np.ndarray, cells: int, seed: int = 7) -> Quantiser:
        coarse = kmeans(x, cells, 8, seed)
        rest = x - coarse[cls._nearest(x, coarse)]
        m = min(SUBSPACES, x.shape[1])
        width = -(-x.shape[1] // m)
        rest = np.pad(rest, ((0, 0), (0, m * width - x.shape[1])))
        books = np.stack([kmeans(rest[:, i * width : (i + 1) * width], 256, 6, seed + i) for i in range(m)])
        return cls(coarse, books)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + 4096] @ c.T * 2 - (c * c).sum(1)).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self._nearest(x, self.coarse)
        rest = np.pad(x - self.coarse[cell], ((0, 0), (0, self.padded - x.shape[1])))
        width = self.books.shape[2]
        codes = [self._nearest(rest[:, i * width : (i + 1) * width], b) for i, b in enumerate(self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def error(self, x: np.ndarray, seed: int = 13) -> float:
        """Standard deviation of approximate from exact scores between sample vectors."""
        cell, code = self.encode(x)
        rest = np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], 1)[:, : x.shape[1]]
        q = x[np.random.default_rng(seed).choice(len(x), min(COVER_QUERIES, len(x)), replace=False)]
        return float(np.std(q @ (x - self.coarse[cell] - rest).T))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: queries x subspaces x 256 inner products of a query's part with each centroid."""
        q = np.pad(q, ((0, 0), (0, self.padded - q.shape[1]))).reshape(len(q), self.books.shape[0], -1)
        return np.einsum("qmw,mkw->qmk", q, self.books, optimize=True).astype(np.float32)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, and no others."""
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_of(near: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row (the smallest, if there are fewer)."""
    return np.partition(near, near.shape[1] - min(k, near.shape[1]), axis=1)[:, near.shape[1] - min(k, near.shape[1])]


def probes_for(d: DataFrame, model, ids: np.ndarray, q: np.ndarray, k: int, cover: float) -> int:
    """Cells to visit, best first, so that ``cover`` of the true k nearest rows of some queries are met: one exact pass over
    all rows with COVER_QUERIES queries, of which each batch keeps k rows a query."""
    shared = d.sparkSession.sparkContext.broadcast((ids, q))  # COVER_QUERIES vectors

    def run(batches):
        own, qs = shared.value
        for b in batches:
            v = _matrix(b.column("v")).astype(np.float32)
            if len(v):
                cell = model.value._nearest(v, model.value.coarse)
                score = qs @ v.T
                score[own[:, None] == np.asarray(b.column("vec_id"))[None]] = -np.inf
                row, col = np.nonzero((score >= top_of(score, k)[:, None]) & np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(cell[col].astype(np.int32)), pa.array(score[row, col].astype(np.float64)), b.column("vec_id").take(pa.array(col))], names=["query", "cell", "score", "vec_id"])

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = d.mapInArrow(run, "query int, cell int, score double, vec_id long").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    found = best.select("query", "cell").toPandas()  # COVER_QUERIES * k rows
    if found.empty:
        return len(model.value.coarse)
    place = np.argsort(np.argsort(-(q @ model.value.coarse.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(place[found["query"].to_numpy(), found.cell.to_numpy()], cover, method="higher")) + 1


def search(df: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row but the query's own, for each row that ``queries`` (a
    condition on vec_id) selects. All rows are indexed; the index is trained on a bounded hashed sample. The number of
    cells a query visits is calibrated against all rows unless ``probes`` gives it (few where vectors cluster, most where
    they don't); where those cells hold too few rows, further ones are visited until there are k."""
    d = usable(df, vec_id, embedding)
    sizes = sorted((r.n, r["count"]) for r in d.groupBy(F.size("v").alias("n")).count().collect())  # a row a length
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, total in sizes:
        found = search_like(d.where(F.size("v") == n) if len(sizes) > 1 else d, total, queries, k, probes, rerank)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def search_like(d: DataFrame, total: int, queries, k: int, probes: int | None, rerank: int) -> DataFrame:
    """search() among ``total`` vectors of one length (vec_id, v)."""
    spark = d.sparkSession
    cells = int(min(MAX_CELLS, max(total // CELL_TARGET, min(MIN_CELLS, max(4, total // 4)))))
    bound = max(SAMPLE, SAMPLE_PER_CELL * cells)
    once = d.groupBy("vec_id").agg(F.min("v").alias("v"))  # rows that share an id count once in the sample
    sample = bounded_sample(once, "vec_id", bound, total, "ivf").toPandas()
    if sample.empty:
        sample = once.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).toPandas()
    sample = sample.sort_values("vec_id")
    x = np.stack(sample.v.to_numpy()).astype(np.float32)
    quantiser = Quantiser.train(x, cells)
    margin = MARGIN * quantiser.error(x)
    model = spark.sparkContext.broadcast(quantiser)
    if probes is None:
        some = np.random.default_rng(11).choice(len(x), min(COVER_QUERIES, len(x)), replace=False)
        probes = probes_for(d, model, sample.vec_id.to_numpy()[some], x[some], k, COVER)
    probes = min(cells, probes)

    def index(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            cell, code = model.value.encode(v.astype(np.float32)) if len(v) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "cell", "code", "v"])

    def visit(batches):
        for b in batches:
            raw = b.column("v").to_pylist()
            if raw:
                q = np.stack([np.frombuffer(r) for r in raw]).astype(np.float32)
                order = np.argsort(-(q @ model.value.coarse.T), axis=1, kind="stable")
                enough = (np.cumsum(sizes.value[order], axis=1) < k + 1).sum(1) + 1
                n = np.minimum(np.maximum(probes, enough), order.shape[1])
                row = np.repeat(np.arange(len(q)), n)
                cell = order[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column("vec_id"))[row]), pa.array(cell.astype(np.int32)), pa.array([raw[i] for i in row], pa.binary())], names=["query_id", "cell", "q"])

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(rows) and len(asked):
            ids = np.asarray(rows.column("vec_id"))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            v = np.frombuffer(b"".join(rows.column("v").to_pylist())).reshape(len(ids), -1)[order]
            all_ids = np.asarray(asked.column("query_id"))
            all_qs = np.frombuffer(b"".join(asked.column("q").to_pylist())).reshape(len(all_ids), -1)
            for lo in range(0, len(all_ids), 128):
                qid, qs = all_ids[lo : lo + 128], all_qs[lo : lo + 128]
                table = model.value.tables(qs.astype(np.float32))
                near = np.zeros((len(qid), len(ids)), np.float32)
                for j in range(code.shape[1]):
                    near += np.take(table[:, j], code[:, j], axis=1)
                own = ids[None] == qid[:, None]
                near[own] = -np.inf
                take = ~own
                if len(ids) > max(rerank, k):  # near copies differ by less than the codes tell: all of them are scored
                    take &= near >= np.minimum(top_of(near, rerank), top_of(near, k) - margin)[:, None]
                row, col = np.nonzero(take)
                # the same order of additions for each row: equal vectors tie
                exact = np.concatenate([(v[col[i : i + 16384]] * qs[row[i : i + 16384]]).sum(1) for i in range(0, len(row), 16384)] or [np.zeros(0)])
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                for o, a in zip(out, (qid[row[best]], ids[col[best]], exact[best])):
                    o.append(a)
        cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        tidy()
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    indexed = durable(d.mapInArrow(index, "vec_id long, cell int, code binary, v binary"))
    held = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # one row a cell: MAX_CELLS at most
    sizes = spark.sparkContext.broadcast(np.array([held.get(c, 0) for c in range(cells)]))
    visits = durable(indexed.where(queries(F.col("vec_id"))).select("vec_id", "v").mapInArrow(visit, "query_id long, cell int, q binary"))
    deal = indexed.groupBy("cell").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    asked = visits.groupBy("cell").count().withColumn("turns", F.ceil(F.col("count") / QUERY_BLOCK).cast("int")).drop("count")
    deal = F.broadcast(durable(deal.join(asked, "cell")))  # one row a cell
    rows = indexed.join(deal, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "code", "v")
    asks = visits.join(deal, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "turns").cast("int").alias("turn"), "query_id", "q")
    key = ["cell", "block", "turn"]
    found = rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(scan, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
