"""Whitening of embeddings from the weighted covariance of their distinct vectors.

Components become whole numbers x = floor(scale * c) + shift, so that equal vectors meet exactly. Equal vectors are one
group with a weight (its rows, or one); sums are whole numbers, the covariance is a weighted product of the centred
groups, and each group is whitened once. Rows get their group's values by a join; groups of many rows are broadcast
there (HOT of them at most), the others shuffle.

Defined results: vectors that are null or hold null or non-finite entries are dropped; zero vectors and rows with a null
id take part like others, and repeated rows count each. Vectors of each length are a fit of their own (an empty vector
has no component). Entries beyond 2 ** 62 / scale saturate. A component without variance has a null ``whitened`` (what is
to be scaled is 0), and ``explained`` is null where nothing varies. A deviation that no long holds is null. An empty table
gives no rows. Other columns of the table are not looked at, whatever their names are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, tidy

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries of all covariance matrices together (one a vector length) that the driver takes: 8,192 dimensions.
MAX_ENTRIES = 1 << 26
#: Groups with at least 1 / HOT of all rows, so HOT at most, are broadcast to their rows.
HOT = 512
#: Below this share of the largest one an eigenvalue is rounding.
FLAT = 1e-12
_SAFE = 1 << 62


def matrices(batches, column: str, dtype=np.int64):
    """Rows x length matrices of an Arrow list column, with the positions of their rows: one for each length."""
    for b in batches:
        arr = b.column(column)
        off = np.asarray(arr.offsets, dtype=np.int64)
        flat, size = np.asarray(arr.values, dtype=dtype), np.diff(off)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            yield b, rows, flat[off[rows][:, None] + np.arange(n)]


def _sums(batches):
    """Weight and weighted sums, one row a length and task; whole numbers of any size."""
    total: dict[int, list] = {}
    for b, rows, x in matrices(batches, "x"):
        w = np.asarray(b.column("weight"))[rows]
        big = x.size and int(np.abs(x - SHIFT).max()) * int(w.sum()) >= _SAFE
        part = ((x - SHIFT).astype(object) * w[:, None] if big else (x - SHIFT) * w[:, None]).sum(0)
        old = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
        old[0] += int(w.sum())
        old[1] = old[1] + part.astype(object)
    for size, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n]), pa.array([[str(v) for v in s]], pa.list_(pa.string()))], names=["size", "n", "sums"])


def totals(groups: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each vector length the weight n and the exact sums of x - SHIFT. One row a length and dimension comes to the
    driver."""
    parts = groups.select("x", "weight").mapInArrow(_sums, "size int, n long, sums array<string>")
    n = {r["size"]: r.n for r in parts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    if sum(d * d for d in n) > MAX_ENTRIES:
        raise ValueError(f"covariances of these lengths have more than {MAX_ENTRIES} entries: {sorted(n)[-5:]}")
    each = parts.select("size", F.posexplode("sums").alias("at", "s")).groupBy("size", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    out = {d: (w, np.zeros(d, object)) for d, w in n.items()}
    for r in each.collect():
        out[r["size"]][1][r["at"]] = int(r.s)
    return out


def covariance(groups: DataFrame, column: str, centre: dict[int, np.ndarray], shift: float = 0.0) -> dict[int, np.ndarray]:
    """Weighted covariance of ``column`` (arrays) for each vector length ``size``, by products of centred slices in tasks.
    Rows of the tasks' matrices are summed in groups of their own; one matrix a length comes to the driver."""
    shared = groups.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            sizes = np.asarray(b.column("size"))
            for _, rows, x in matrices([b], column, np.float64 if shift == 0 else np.int64):
                for size in np.unique(sizes[rows]) if x.shape[1] else ():
                    at = rows[sizes[rows] == size]
                    w = np.asarray(b.column("weight"))[at].astype(np.float64)
                    centred = (x[sizes[rows] == size] - (0 if shift == 0 else SHIFT)).astype(np.float64) - shared.value[size]
                    held = total.setdefault(int(size), [0.0, np.zeros((x.shape[1],) * 2)])
                    held[0] += w.sum()
                    held[1] += (centred * w[:, None]).T @ centred
        for size, (w, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([w] * len(m), pa.float64()), pa.array(list(m), pa.list_(pa.float64()))], names=["size", "at", "w", "m"])
        tidy()

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        m = np.stack(rows.column("m").to_numpy())
        exact = [math.fsum(c) for c in m.T]  # whatever the order of the tasks
        return pa.table([rows.column("size").slice(0, 1), rows.column("at").slice(0, 1), pa.array([math.fsum(rows.column("w").to_pylist())]), pa.array([exact], pa.list_(pa.float64()))], names=["size", "at", "w", "m"])

    schema = "size int, at int, w double, m array<double>"
    summed = groups.select("size", "weight", column).mapInArrow(run, schema).groupBy("size", "at").applyInArrow(add, schema)
    out: dict[int, dict] = {}
    for r in summed.collect():
        out.setdefault(r["size"], {})[r["at"]] = np.asarray(r.m) / r.w
    return {size: np.stack([rows[i] for i in range(len(rows))]) for size, rows in out.items()}


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors (columns) by falling eigenvalue, 1 / sqrt(eigenvalue) (nan without variance), shares of the trace."""
    value, vector = np.linalg.eigh((v + v.T) / 2)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    trace = float(np.trace(v))
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(value > FLAT * max(value[0], 0.0), 1 / np.sqrt(value), np.nan)
        share = np.maximum(value, 0) / trace if trace > 0 else np.full(len(value), np.nan)
    return vector, rate, share


def _exact_deviation(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * (x - SHIFT) - s) ** 2: null where no long holds it."""
    far = int(np.abs(x - SHIFT).max(initial=0)) * n + max(map(abs, s), default=0)
    if far * far * max(1, x.shape[1]) < _SAFE:
        return pa.array((((x - SHIFT) * n - s.astype(np.int64)) ** 2).sum(1))
    exact = (((x - SHIFT).astype(object) * n - s) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def points(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, x of the rows that take part."""
    c = F.col(embedding).cast("array<double>")
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("c", lambda v: F.floor(F.greatest(F.lit(-float(_SAFE)), F.least(F.lit(float(_SAFE)), v * scale))).cast("long") + SHIFT)
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & fine)
    return d.select("vec_id", whole.alias("x"))


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, by: str = "count") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: ``most`` components a row at most.

    by: ``count`` fits all rows (a group weighs as much as it has rows), ``one`` fits each distinct vector once; n is the
    fit's weight. deviation is the exact sum of (n * x - S) ** 2, identity_error the largest absolute entry of the fitted
    rows' whitened covariance minus the identity (of components with variance).
    """
    spark = df.sparkSession
    rows = points(df, vec_id, embedding, scale)
    weight: Column = F.col("held") if by == "count" else F.lit(1).cast("long")
    groups = durable(rows.groupBy("x").agg(F.count(F.lit(1)).alias("held")).select("x", F.size("x").alias("size"), "held", weight.alias("weight")))
    fits = totals(groups)
    centre = {d: np.array([float(v) / n for v in s]) for d, (n, s) in fits.items()}
    models = {d: components_of(v, most) for d, v in covariance(groups, "x", centre, SHIFT).items()}
    shared = spark.sparkContext.broadcast((fits, centre, models))

    def run(batches):
        fits, centre, models = shared.value
        for b, at, x in matrices(batches, "x"):
            size = x.shape[1]
            if size:
                n, s = fits[size]
                vector, rate, _ = models[size]
                y = ((x - SHIFT).astype(np.float64) - centre[size]) @ vector * rate
                out = pa.array(list(y), pa.list_(pa.float64()))
                took = [b.column(c).take(pa.array(at)) for c in ("x", "size", "held", "weight")]
                yield pa.RecordBatch.from_arrays([*took, _exact_deviation(x, n, s), out], names=["x", "size", "held", "weight", "deviation", "y"])
        tidy()

    done = durable(groups.mapInArrow(run, "x array<long>, size int, held long, weight long, deviation long, y array<double>"))
    fine = {d: np.flatnonzero(np.isfinite(rate)) for d, (_, rate, _) in models.items()}
    spread = covariance(done, "y", {d: np.where(np.isfinite(m[1]), 0.0, 0.0) for d, m in models.items()})
    error = max([float(np.abs(c[np.ix_(fine[d], fine[d])] - np.eye(len(fine[d]))).max(initial=0)) for d, c in spread.items()], default=0.0)
    return _joined(rows, done, {d: (fits[d][0], share) for d, (_, _, share) in models.items()}, error)


def _joined(rows: DataFrame, done: DataFrame, fits: dict, error: float) -> DataFrame:
    """Rows with their group's values, one row a component."""
    spark = rows.sparkSession
    size = durable(done.groupBy("size").agg(F.sum("held").alias("held")))
    total = size.agg(F.sum("held")).first()[0] or 0
    values = done.select(F.col("x").alias("gx"), "size", "deviation", "y", (F.col("held") * HOT >= max(total, 1)).alias("hot"), "held")
    same = F.col("x") == F.col("gx")
    hot = F.broadcast(values.where((F.col("held") > 1) & F.col("hot")))  # HOT groups at most, by their share of the rows
    near = rows.join(hot, same, "left")
    cold = values.where((F.col("held") == 1) | ~F.col("hot"))
    got = near.where("gx is not null").unionByName(near.where("gx is null").select("vec_id", "x").join(cold, same))
    plan = spark.createDataFrame([(d, n, [None if math.isnan(v) else float(v) for v in share]) for d, (n, share) in fits.items()], "size int, n long, share array<double>")
    got = got.join(F.broadcast(plan), "size")  # a row a length, bounded by MAX_ENTRIES
    each = got.select("vec_id", "n", "deviation", "share", F.posexplode("y").alias("at", "whitened"))
    value = F.when(F.isnan("whitened"), None).otherwise(F.col("whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", value.alias("whitened"), F.get("share", F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
