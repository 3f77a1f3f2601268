"""Geometry on arrays of points (struct<x, z> or struct<x, y, z>), with array functions; grids of inner points in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import lonlat_to_local


def _pairs(points: Column, f) -> Column:
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), f)).otherwise(F.array().cast("array<double>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def length_3d(points: Column) -> Column:
    d = lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))
    return _total(_pairs(points, d))


def localised(points: Column, lon0: float, lat0: float, elevation: Column) -> Column:
    """A line or ring of degrees (longitude in x, latitude in z) in local metres at an elevation."""
    local = lambda p: lonlat_to_local(p.x, p.z, lon0, lat0, elevation)
    return F.transform(points, lambda p: F.struct(*[local(p)[c].alias(c) for c in "xyz"]))


def localised_parts(parts: Column, lon0: float, lat0: float, elevation: Column) -> Column:
    """localised for the parts of a geometry."""
    return F.transform(parts, lambda part: localised(part, lon0, lat0, elevation))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring."""
    return _total(_pairs(ring, lambda a, b: a.x * b.z - b.x * a.z)) / 2


def ring_centroid(ring: Column) -> Column:
    """Centroid of a closed ring; its fields are null where the ring has no area."""
    twice = F.nullif(_total(_pairs(ring, lambda a, b: a.x * b.z - b.x * a.z)), F.lit(0.0))
    x = _total(_pairs(ring, lambda a, b: (a.x + b.x) * (a.x * b.z - b.x * a.z)))
    z = _total(_pairs(ring, lambda a, b: (a.z + b.z) * (a.x * b.z - b.x * a.z)))
    return F.struct((x / (3 * twice)).alias("x"), (z / (3 * twice)).alias("z"))


def inside(x: Column, z: Column, ring: Column) -> Column:
    """Even-odd rule; the ring may be open or closed."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1))
    crosses = lambda p, q: F.when((p.z > z) != (q.z > z), x < (q.x - p.x) * (z - p.z) / (q.z - p.z) + p.x).otherwise(False)
    return F.aggregate(F.zip_with(ring, before, crosses), F.lit(False), lambda a, c: a != c)


def inside_rings(x: Column, z: Column, rings: Column) -> Column:
    """Even-odd rule over all rings of a polygon: a hole's inside is outside."""
    return F.aggregate(rings, F.lit(False), lambda a, r: a != inside(x, z, r))


def largest_ring(rings: Column) -> Column:
    """The ring with the largest area, of equal ones the first."""
    sized = F.transform(rings, lambda r, i: F.struct((-F.abs(ring_area(r))).alias("a"), i.alias("i"), r.alias("r")))
    return F.element_at(F.array_sort(sized), 1)["r"]


def boundary_distance(x: Column, z: Column, ring: Column) -> Column:
    def d(a, b):
        dx, dz = b.x - a.x, b.z - a.z
        size = dx * dx + dz * dz
        t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a.x) * dx + (z - a.z) * dz) / size)))
        return (x - a.x - t * dx) * (x - a.x - t * dx) + (z - a.z - t * dz) * (z - a.z - t * dz)

    return F.sqrt(F.array_min(_pairs(ring, d)))


def midpoint(points: Column) -> Column:
    """The point half way along a line in the plane."""
    steps = _pairs(points, lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z)))
    half = _total(steps) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.lit(1).alias("i"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("rest"))

    def walk(s, d):
        hit = s["at"].isNull() & (s["done"] + d >= half)
        return F.struct((s["done"] + d).alias("done"), (s["i"] + 1).alias("i"), F.when(hit, s["i"]).otherwise(s["at"]).alias("at"), F.when(hit, F.when(d == 0, 0.0).otherwise((half - s["done"]) / d)).otherwise(s["rest"]).alias("rest"))

    s = F.aggregate(steps, start, walk)
    a, b = F.try_element_at(points, s["at"]), F.try_element_at(points, s["at"] + 1)
    last = F.element_at(points, -1)
    mix = lambda k: F.coalesce(a[k] + (b[k] - a[k]) * s["rest"], last[k])
    return F.struct(mix("x").alias("x"), mix("z").alias("z"))


def arrow(points: Column) -> Column:
    """struct(x, y, z, ux, uy, uz): the point half way along a line in space and the direction there; null for lines
    without length."""
    steps = _pairs(points, lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)))
    start = F.struct(F.lit(0.0).alias("done"), F.lit(1).alias("i"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("rest"), F.lit(1.0).alias("long"))

    def found(m):
        def walk(s, d):
            hit = s["at"].isNull() & (d > 0) & (s["done"] + d >= m["half"])
            keep = lambda new, old: F.when(hit, new).otherwise(s[old]).alias(old)
            return F.struct((s["done"] + d).alias("done"), (s["i"] + 1).alias("i"), keep(s["i"], "at"), keep((m["half"] - s["done"]) / F.nullif(d, F.lit(0.0)), "rest"), keep(d, "long"))

        return F.struct(m["points"].alias("points"), F.aggregate(m["steps"], start, walk).alias("s"))

    def placed(m):
        s = m["s"]
        a, b = F.try_element_at(m["points"], s["at"]), F.try_element_at(m["points"], s["at"] + 1)
        at = [(a[k] + (b[k] - a[k]) * s["rest"]).alias(k) for k in "xyz"]
        return F.when(s["at"].isNotNull(), F.struct(*at, *[((b[k] - a[k]) / s["long"]).alias(f"u{k}") for k in "xyz"]))

    measured = _once(F.struct(points.alias("points"), steps.alias("steps")), lambda m: F.struct(m["points"].alias("points"), m["steps"].alias("steps"), (_total(m["steps"]) / 2).alias("half")))
    return _once(_once(measured, found), placed)


def joined(lines: Column) -> Column:
    """One line of successive lines that meet: each but the first without its first point."""
    return F.flatten(F.transform(lines, lambda g, i: F.when(i == 0, g).otherwise(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))))))


def envelope(ring: Column, height: float) -> Column:
    """Segments (struct a, b) of the walls over a ring, closed or open: each side's top and one edge a corner. Rings of
    under three corners have none."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = (F.size(ring) > 2) & (first.x == last.x) & (first.z == last.z)
    p = F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    up = lambda q: F.struct(q.x.alias("x"), (q.y + height).alias("y"), q.z.alias("z"))
    line = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    turned = F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1))
    sides = F.zip_with(p, turned, lambda a, b: F.array(line(up(a), up(b)), line(F.struct(a.x.alias("x"), a.y.alias("y"), a.z.alias("z")), up(a))))
    return F.when(F.size(p) >= 3, F.flatten(sides))


GRID = 32  # candidates a side


def representative_point(kind: Column, points: Column, rings: Column) -> Column:
    """struct(x, z) that stands for a geometry: a point itself, the middle of a line (points), a polygon's inner point."""
    first = F.element_at(points, 1)
    return F.when(kind == "Point", F.struct(first.x.alias("x"), first.z.alias("z"))).when(kind == "PolyLine", midpoint(points)).when(kind == "Polygon", interior_point(largest_ring(rings), rings))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, not wherever f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _odd(rings: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, for points in numpy."""
    odd = np.zeros(len(x), bool)
    for px, pz in rings:
        for i in range(len(px)):
            ax, az, bx, bz = px[i - 1], pz[i - 1], px[i], pz[i]
            if az != bz:
                odd ^= ((bz > z) != (az > z)) & (x < (ax - bx) * (z - bz) / (az - bz) + bx)
    return odd


def grid_centre(rings: list[tuple[np.ndarray, np.ndarray]], xs: np.ndarray, zs: np.ndarray) -> tuple[float, float] | None:
    """Of the centres of a grid over the bounds of (xs, zs), the one inside the rings that is farthest from them."""
    if not np.isfinite([xs.min(), xs.max(), zs.min(), zs.max()]).all():
        return None
    n = np.arange(GRID * GRID)
    x = xs.min() + (n % GRID + 0.5) * (xs.max() - xs.min()) / GRID
    z = zs.min() + (n // GRID + 0.5) * (zs.max() - zs.min()) / GRID
    near = np.full(len(n), np.inf)
    for px, pz in rings:
        for i in range(1, len(px)):
            ax, az, dx, dz = px[i - 1], pz[i - 1], px[i] - px[i - 1], pz[i] - pz[i - 1]
            size = dx * dx + dz * dz
            t = np.clip(((x - ax) * dx + (z - az) * dz) / size, 0.0, 1.0) if size != 0 else 0.0
            near = np.minimum(near, (x - ax - t * dx) * (x - ax - t * dx) + (z - az - t * dz) * (z - az - t * dz))
    inner = np.flatnonzero(_odd(rings, x, z))
    if not len(inner):
        return None
    best = inner[np.lexsort((z[inner], x[inner], -np.sqrt(near[inner])))[0]]
    return float(x[best]), float(z[best])


def inner_point(rings: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float] | None:
    """The centroid of the largest ring if it is inside the rings, else the centre of a grid; sums run along the ring."""
    sizes, best = [], 0
    for px, pz in rings:
        parts = [a * d - c * b for a, b, c, d in zip(px[:-1].tolist(), pz[:-1].tolist(), px[1:].tolist(), pz[1:].tolist())]
        total = 0.0
        for v in parts:
            total += v
        sizes.append((total, parts))
        if abs(total / 2) > abs(sizes[best][0] / 2):
            best = len(sizes) - 1
    (px, pz), (twice, parts) = rings[best], sizes[best]
    if twice != 0 and np.isfinite(twice):
        x = z = 0.0
        for i, v in enumerate(parts):
            x += float(px[i] + px[i + 1]) * v
            z += float(pz[i] + pz[i + 1]) * v
        x, z = x / (3 * twice), z / (3 * twice)
        if _odd(rings, np.array([x]), np.array([z]))[0]:
            return x, z
    return grid_centre(rings, px, pz)


def inner_points():
    """A column function: rings -> inner_point of each polygon."""

    def run(rings: pa.Array) -> pa.Array:
        ends = lambda lists: np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        outer, parts = ends(rings), rings.flatten()
        inner, points = ends(parts), parts.flatten()
        px, pz = (pc.struct_field(points, k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in "xz")
        out = []
        for i in range(len(rings)):
            cut = [slice(inner[r], inner[r + 1]) for r in range(outer[i], outer[i + 1]) if inner[r + 1] > inner[r]]
            out.append(inner_point([(px[s], pz[s]) for s in cut]) if cut else None)
        return pa.array([None if c is None else {"x": c[0], "z": c[1]} for c in out], pa.struct([("x", pa.float64()), ("z", pa.float64())]))

    return F.arrow_udf(run, "struct<x: double, z: double>").asNondeterministic()


def interior_point(ring: Column, rings: Column | None = None) -> Column:
    """struct(x, z) inside a ring (or, given all rings of a polygon of which it is the largest, inside the polygon): its
    centroid if that is inside, else, of the centres of a grid over its bounds, the inner one farthest from the boundary
    (ties: smaller x, then z), else the middle of the line. Only rings whose centroid is outside build the grid."""
    return F.coalesce(inner_points()(F.array(ring) if rings is None else rings), midpoint(ring))
