"""Nearest-node and range joins on grid cells; never a raw product of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_reading_order
from .graph import durable


def _cell(c: str, size: float):
    return F.floor(F.col(c) / size).cast("long")


def _descend(places: DataFrame, nodes: DataFrame, size: float, levels: int = 12) -> DataFrame:
    """id, node_id, distance_m of the nearest node of the same floor, however far it is. Cells of ``size`` metres are
    gathered by four by four, level over level. A place starts with the few widest cells of its floor; at each level it
    keeps those whose box begins no farther away than the nearest box ends, and goes on with the cells inside them, so
    that it never meets all nodes of a floor. nodes: floor_id, node_id, nx, nz."""
    sides = {"x0": F.min, "x1": F.max, "z0": F.min, "z1": F.max}
    finest = nodes.withColumns({"cx": _cell("nx", size), "cz": _cell("nz", size)})
    cells = [durable(finest.groupBy("floor_id", "cx", "cz").agg(*[f(f"n{c[0]}").alias(c) for c, f in sides.items()]))]
    for _ in range(levels):
        wider = cells[-1].withColumns({c: F.floor(F.col(c) / 4).cast("long") for c in ("cx", "cz")})
        cells.append(wider.groupBy("floor_id", "cx", "cz").agg(*[f(c).alias(c) for c, f in sides.items()]))
    asks = places.select("id", "floor_id", "x", "z")
    d = asks.join(cells[-1], "floor_id")
    off = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"))
    end = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    for level in range(levels, -1, -1):
        d = d.withColumns({"near": F.sqrt(off("x") ** 2 + off("z") ** 2), "far": F.sqrt(end("x") ** 2 + end("z") ** 2)})
        d = d.withColumn("most", F.min("far").over(Window.partitionBy("id"))).where(F.col("near") <= F.col("most") * (1 + 1e-9))
        d = d.select("id", "floor_id", "x", "z", "cx", "cz")
        if level:
            inner = cells[level - 1].withColumns({"px": F.floor(F.col("cx") / 4).cast("long"), "pz": F.floor(F.col("cz") / 4).cast("long")})
            d = d.withColumnsRenamed({"cx": "px", "cz": "pz"}).join(inner, ["floor_id", "px", "pz"])
    d = d.join(finest, ["floor_id", "cx", "cz"]).withColumn("d", F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("z") - F.col("nz")) ** 2))
    return d.groupBy("id").agg(_nearest("node_id")).select("id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("distance_m"))


def _placed():
    return (F.abs("x") < 1e15) & (F.abs("z") < 1e15)


def _nearest(c: str):
    return F.min(F.struct("d", *in_reading_order(c))).alias("b")


def _finer(nodes: DataFrame, first: float, most: int = 8) -> int:
    """How many times cells of ``first`` metres must be quartered until a node shares its cell with few others."""
    held = nodes.groupBy("floor_id", _cell("nx", first).alias("cx"), _cell("nz", first).alias("cz")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    near = held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return next((k for k in range(most) if near <= 8 * 16**k), most)


def nearest_node(places: DataFrame, nodes: DataFrame, first: float = 8.0, rounds: int = 4) -> DataFrame:
    """places with node_id, distance_m of the nearest node on the same floor in the plane (ties: first id in reading order).

    Looks in the nine cells around a place; what has no node within a cell's width tries again with cells four times
    as wide; where nodes lie densely the first cells are smaller, so that a place doesn't meet all nodes around it. What is left after the last round narrows its search from wide cells down. Places on floors without nodes
    get nulls; so do places without coordinates (null, not finite, or 10^15 m and more), and such nodes aren't found.
    """
    n = nodes.where(_placed()).select("floor_id", F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("z").alias("nz"))
    # nodes of one spot are one, by their first id
    n = n.groupBy("floor_id", "nx", "nz").agg(F.min(F.struct(*in_reading_order("node_id"))).alias("f")).select("floor_id", F.col("f.node_id").alias("node_id"), "nx", "nz")
    n = durable(n)
    left, found = places.where(_placed()), []
    for k in range(-_finer(n, first), rounds):
        size = first * 4.0**k
        around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
        asks = left.withColumn("cx", _cell("x", size)).withColumn("cz", _cell("z", size)).withColumn("dx", around).withColumn("dz", around)
        asks = asks.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cz", F.col("cz") + F.col("dz"))
        d = asks.join(n.withColumn("cx", _cell("nx", size)).withColumn("cz", _cell("nz", size)), ["floor_id", "cx", "cz"])
        d = d.withColumn("d", F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("z") - F.col("nz")) ** 2)).where(F.col("d") <= size)
        best = durable(d.groupBy("id").agg(_nearest("node_id")).select("id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("distance_m")))
        found.append(best)
        left = durable(left.join(best, "id", "left_anti"))
        if not left.limit(1).count():
            break
    else:
        found.append(_descend(left, n, size))
    return places.join(reduce(DataFrame.unionByName, found), "id", "left")


def near_pairs(points: DataFrame, tolerance: float) -> DataFrame:
    """a, b (a < b): points of one floor within a distance in space. A point meets its own and the following cells."""
    p = points.select("id", "floor_id", "x", "y", "z", *[_cell(c, tolerance).alias(f"c{c}") for c in "xyz"])
    steps = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    q = p.withColumn("s", F.explode(steps)).select(F.col("id").alias("b"), "floor_id", *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"], *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = p.join(q, ["floor_id", "cx", "cy", "cz"]).where(F.col("id") < F.col("b"))
    gap = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 + (F.col("z") - F.col("bz")) ** 2)
    return d.withColumn("distance_m", gap).where(F.col("distance_m") <= tolerance).select(F.col("id").alias("a"), "b", "distance_m")


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def _candidates(points: DataFrame, places: DataFrame, tolerance: float, levels: int = 5) -> DataFrame:
    """id, place_id, d: for each point the few places among which its nearest one within the tolerance is. Places of one spot
    are one, by their first id in reading order. Cells of the tolerance's width hold four by four smaller ones, level under
    level; a point goes on with those whose box begins no farther away than the nearest box ends, so that it doesn't
    meet all places around it, however densely they lie."""
    sides = {"x0": ("px", F.min), "x1": ("px", F.max), "z0": ("pz", F.min), "z1": ("pz", F.max)}
    finite = (F.abs("x") < float("inf")) & (F.abs("z") < float("inf"))
    spots = places.where(finite).select(F.col("id").alias("place_id"), F.col("x").alias("px"), F.col("z").alias("pz"))
    spots = spots.groupBy("px", "pz").agg(F.min(F.struct(*in_reading_order("place_id"))).alias("f")).select("px", "pz", F.col("f.place_id").alias("place_id"))
    size = tolerance / 4**levels
    spots = durable(spots.withColumns({"cx": _cell("px", size), "cz": _cell("pz", size)}))
    cells = [spots.groupBy("cx", "cz").agg(*[f(c).alias(n) for n, (c, f) in sides.items()])]
    for _ in range(levels):
        wider = cells[-1].withColumns({c: F.floor(F.col(c) / 4).cast("long") for c in ("cx", "cz")})
        cells.append(durable(wider.groupBy("cx", "cz").agg(*[f(n).alias(n) for n, (_, f) in sides.items()])))
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    asks = points.where(finite).select("id", "x", "z").withColumn("dx", around).withColumn("dz", around)
    d = asks.select("id", "x", "z", (_cell("x", tolerance) + F.col("dx")).alias("cx"), (_cell("z", tolerance) + F.col("dz")).alias("cz")).join(cells[-1], ["cx", "cz"])
    off = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"))
    end = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    for level in range(levels, -1, -1):
        d = d.withColumns({"near": F.sqrt(off("x") ** 2 + off("z") ** 2), "far": F.sqrt(end("x") ** 2 + end("z") ** 2)}).where(F.col("near") <= tolerance * (1 + 1e-9))
        d = d.select("id", "x", "z", "cx", "cz", "near", "far").withColumn("most", F.min("far").over(Window.partitionBy("id"))).where(F.col("near") <= F.col("most") * (1 + 1e-9))
        d = d.select("id", "x", "z", "cx", "cz")
        if level:
            inner = cells[level - 1].withColumns({"ox": F.floor(F.col("cx") / 4).cast("long"), "oz": F.floor(F.col("cz") / 4).cast("long")})
            d = d.withColumnsRenamed({"cx": "ox", "cz": "oz"}).join(inner, ["ox", "oz"])
    d = d.join(spots, ["cx", "cz"])
    return d.select("id", "place_id", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("z") - F.col("pz")) ** 2).alias("d"))


def nearest_within(points: DataFrame, places: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """id, place_id, distance_m of the nearest place in the plane, on any floor, within a distance (ties: first id in
    reading order);
    points without one give no row."""
    d = _candidates(points, places, tolerance).where(F.col("d") <= tolerance)
    return d.groupBy("id").agg(_nearest("place_id")).select("id", F.col("b.place_id").alias("place_id"), F.col("b.d").alias("distance_m"))
