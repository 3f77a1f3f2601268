"""Segments, bounds and centres of what a map shows. Lines are arrays of points (struct x, y, z)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .spatial import bounds

ROUTE_MARGIN_M, STEP_MARGIN_M = 18.0, 10.0


def shown_floor(c: str = "floor_id") -> Column:
    """Features without a floor are shown on B1."""
    return F.coalesce(c, F.lit("B1"))


def _display(p: Column, stacked: bool, lift: float = 0.0) -> Column:
    y = scalars.stacked_elevation(p.y) if stacked else p.y
    return F.struct(p.x.alias("x"), (y + F.lit(lift)).alias("y"), p.z.alias("z"))


def exploded(rows: DataFrame, lines: str, *keep: str, stacked: bool = False, lift: float = 0.0) -> DataFrame:
    """keep, part and seg (from 0), a, b: a row for each segment of each line in the column ``lines``."""
    parts = rows.select(*keep, F.posexplode(lines).alias("part", "line")).where(F.size("line") > 1)
    pair = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(_display(a, stacked, lift).alias("a"), _display(b, stacked, lift).alias("b")))
    return parts.select(*keep, "part", F.posexplode(pair).alias("seg", "s")).select(*keep, "part", "seg", "s.a", "s.b")


def feature_segments(features: DataFrame, layers: list[str], floors: list[str], stacked: bool = False) -> DataFrame:
    """id, layer, part, seg, a, b of the lines and polygons (column parts; points have none) of some layers and floors."""
    d = features.where(F.col("layer").isin(layers) & shown_floor().isin(floors) & F.col("parts").isNotNull())
    return exploded(d, "parts", "id", "layer", stacked=stacked)


def outdoor(features: DataFrame) -> DataFrame:
    """Features whose source floor is an outer one."""
    return features.where(F.lower("source_floor").endswith("out"))


def emphasised(features: DataFrame, styles: DataFrame, emphasis: str) -> DataFrame:
    """Spaces whose category is drawn with an emphasis. styles: code, emphasis."""
    wanted = styles.where(F.col("emphasis") == emphasis).select(F.col("code").alias("style_code"))
    return features.where("layer = 'Space'").join(wanted, scalars.category_code(F.col("category")) == F.col("style_code"), "left_semi")


def network_segments(edges: DataFrame, nodes: DataFrame, floors: list[str], stacked: bool = False, lift: float = 0.0) -> DataFrame:
    """id, context, part, seg, a, b of the edges with both ends on shown floors."""
    shown = nodes.where(F.col("floor_id").isin(floors))
    at = lambda end: shown.select(F.col("id").alias(f"{end}_id"), F.struct("x", "y", "z").alias(end), F.col("in_out").alias(f"{end}_place"))
    d = edges.join(at("from"), "from_id").join(at("to"), "to_id")
    ends = F.array("from_place", "to_place")
    context = F.when(F.array_contains(ends, "outside"), "outside").when(F.array_contains(ends, "boundary"), "boundary").otherwise("inside")
    return exploded(d.select("id", context.alias("context"), F.array(F.array("from", "to")).alias("lines")), "lines", "id", "context", stacked=stacked, lift=lift)


def highlighted(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The segments of chosen ids (column id)."""
    return segments.join(chosen.select("id").distinct(), "id", "left_semi")


def points_of(rows: DataFrame, lines: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.flatten(lines)).alias("p")).select(*keep, "p.x", "p.y", "p.z")


def widened(b: DataFrame, margin: float) -> DataFrame:
    """Bounds with a margin in the plane; heights stay."""
    return b.withColumns({f"{side}_{c}": F.col(f"{side}_{c}") + (-margin if side == "min" else margin) for side in ("min", "max") for c in "xz"})


def bounds_of_floors(features: DataFrame, floors: list[str], whole: DataFrame) -> DataFrame:
    """One row: the bounds of the features of some floors, or ``whole`` (one row of bounds) where they have no point."""
    points = F.when(F.col("parts").isNull(), F.array(F.struct("x", "y", "z"))).otherwise(F.flatten("parts"))
    found = bounds(features.where(shown_floor().isin(floors)).select(F.explode(points).alias("p")).select("p.*"))
    other = whole.select(*[F.col(c).alias(f"whole_{c}") for c in found.columns])
    return found.crossJoin(F.broadcast(other)).select(*[F.coalesce(c, f"whole_{c}").alias(c) for c in found.columns])  # single rows


def route_bounds(walk: DataFrame) -> DataFrame:
    """request_id and the bounds of each route, with a margin."""
    return widened(bounds(_ends(walk), "request_id"), ROUTE_MARGIN_M)


def step_bounds(steps: DataFrame, walk: DataFrame) -> DataFrame:
    """request_id, step_no and the bounds, with a margin, of the steps that walk along arcs."""
    arcs = _ends(walk.withColumn("edge", F.regexp_replace("id", ":reverse$", "")), "edge")
    d = steps.select("request_id", "step_no", F.explode("edge_ids").alias("edge")).join(arcs, ["request_id", "edge"])
    return widened(bounds(d, "request_id", "step_no"), STEP_MARGIN_M)


def _ends(walk: DataFrame, *keep: str) -> DataFrame:
    one = lambda i: walk.select("request_id", *keep, *[F.col(f"{c}{i}").alias(c) for c in "xyz"])
    return reduce(DataFrame.unionByName, [one(0), one(1)])


def centre(b: DataFrame) -> DataFrame:
    """One row x, y, z: what moves the middle of the bounds to the origin."""
    return b.select((-(F.col("min_x") + F.col("max_x")) / 2).alias("x"), F.lit(0.0).alias("y"), (-(F.col("min_z") + F.col("max_z")) / 2).alias("z"))
