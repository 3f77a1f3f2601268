"""Rules that datasets must keep: map features, places, reviewed networks. Each gives issues: source_id, code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import quality

# Fixed values of the data model.
FEATURE_LAYERS = ["Floor", "Space", "Opening", "Facility", "Fixture", "Drawing", "TWSI_Line", "TWSI_Point"]
PLACE_CATEGORIES = ["gate", "connector", "toilet", "elevator", "escalator", "stairs", "slope", "entrance", "exit", "information", "waiting-room", "nursing-room", "atm", "locker", "ticket-office"]
SLICE_M = 2000.0
SAME_M = 0.001


def _text(c: str) -> Column:
    return F.trim(c) != ""


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def feature_issues(features: DataFrame) -> DataFrame:
    """features: id, source_record, layer, gtype, parts (array of arrays of points x, y, z), category, area,
    source_floor. Polygons need three points a part, lines two, points one part with one point."""
    least = F.when(F.col("gtype") == "Polygon", 3).when(F.col("gtype") == "PolyLine", 2).otherwise(1)
    inner = F.flatten("parts")
    facility = F.coalesce(F.col("layer") == "Facility", F.lit(False))
    rules = {
        "id-missing": _text("id"),
        "record-not-positive": F.col("source_record") >= 1,
        "layer-unknown": F.col("layer").isin(FEATURE_LAYERS),
        "geometry-unknown": F.col("gtype").isin("Point", "PolyLine", "Polygon"),
        "geometry-empty": F.size("parts") > 0,
        "part-too-short": F.forall("parts", lambda p: F.size(p) >= least),
        "coordinates-not-finite": F.forall(inner, lambda p: _finite(p.x, p.y, p.z)),
        "facility-not-a-point": ~facility | (F.col("gtype") == "Point"),
        "facility-without-category": ~facility | _text("category"),
        "facility-without-area": ~facility | _text("area"),
        "facility-without-floor": ~facility | _text("source_floor"),
    }
    return quality.issues(features, "id", rules).unionByName(quality.repeated(features, "id"))


def slice_warnings(points: DataFrame, dataset: str) -> DataFrame:
    """source_id (the dataset), code: datasets whose bounds in the plane are wider than a station needs. That is a warning,
    no issue: the data stays usable. points: x, z and the dataset's column."""
    widest = F.greatest(F.max(F.abs("x")), F.max(F.abs("z")))
    wide = points.groupBy(F.col(dataset).alias("source_id")).agg(widest.alias("widest")).where(F.col("widest") > SLICE_M)
    return wide.select("source_id", F.lit("outside-slice").alias("code"))


def place_issues(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """places: id, name, category, floor_id, x, y, z, node_id, distance_m, confidence, reviewed, routable. The distance
    must be that of place and node in the plane, or in space for reviewed ones, to a centimetre."""
    at = nodes.select(F.col("id").alias("node_id"), F.col("floor_id").alias("n_floor"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    d = places.join(at, "node_id", "left")
    gap = geometry.length_3d(F.array(F.struct("x", "y", "z"), F.struct(F.col("nx").alias("x"), F.when(F.col("reviewed"), F.col("ny")).otherwise(F.col("y")).alias("y"), F.col("nz").alias("z"))))
    there = F.col("n_floor").isNotNull()
    rules = {
        "name-missing": _text("name"),
        "category-unknown": F.col("category").isin(PLACE_CATEGORIES),
        "node-missing": there,
        "floor-mismatch": ~there | (F.col("n_floor") == F.col("floor_id")),
        "distance-negative": F.col("distance_m") >= 0,
        "confidence-unknown": F.col("confidence").isin("high", "medium", "low"),
        "low-but-routable": ~(F.col("routable") & (F.col("confidence") == "low") & ~F.col("reviewed")),
        "distance-mismatch": ~there | (F.abs(gap - F.col("distance_m")) <= 0.01),
    }
    return quality.issues(d, "id", rules).unionByName(quality.repeated(places, "id"))


def reviewed_node_issues(nodes: DataFrame, official_nodes: DataFrame, floors: list[str]) -> DataFrame:
    """What reviewed nodes (id, floor_id, role) break."""
    n = nodes.join(official_nodes.select("id", F.lit(True).alias("taken")).distinct(), "id", "left")
    found = quality.issues(n, "id", {"node-id-taken": F.col("taken").isNull(), "floor-unknown": F.col("floor_id").isin(floors), "role-unknown": F.col("role").isin("gate", "turn")})
    return found.unionByName(quality.repeated(nodes, "id"))


def reviewed_edge_issues(nodes: DataFrame, edges: DataFrame, official_nodes: DataFrame, official_edges: DataFrame) -> DataFrame:
    """What reviewed edges (id, from_id, to_id, direction, kind, accessibility, distance_m, and perhaps points) break. Lines
    have two points, which are those of the nodes they name; ids of nodes are unique."""
    every = nodes.select("id", "floor_id", "x", "y", "z").unionByName(official_nodes.select("id", "floor_id", "x", "y", "z"))
    end = lambda e: every.select(F.col("id").alias(f"{e}_id"), F.col("floor_id").alias(f"{e}_floor"), F.struct("x", "y", "z").alias(e))
    taken = official_edges.select("id", F.lit(True).alias("taken")).distinct()
    d = edges.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left").join(taken, "id", "left")
    both = F.col("from").isNotNull() & F.col("to").isNotNull()
    rules = {
        "edge-id-taken": F.col("taken").isNull(),
        "end-missing": both,
        "leaves-floor": ~both | (F.col("from_floor") == F.col("to_floor")),
        "not-both-ways": F.col("direction") == "both",
        "kind-unknown": F.col("kind").isin("corridor", "gate"),
        "accessibility-claimed": F.col("accessibility") == "unknown",
        "distance-not-positive": F.col("distance_m") > 0,
        "distance-mismatch": ~both | (F.abs(geometry.length_3d(F.array("from", "to")) - F.col("distance_m")) <= SAME_M),
    }
    if "points" in edges.columns:
        same = lambda p, q: (F.abs(p.x - q.x) <= SAME_M) & (F.abs(p.y - q.y) <= SAME_M) & (F.abs(p.z - q.z) <= SAME_M)
        rules["not-two-points"] = F.size("points") == 2
        rules["ends-mismatch"] = ~both | (same(F.get("points", F.lit(0)), F.col("from")) & same(F.get("points", F.lit(1)), F.col("to")))
    return quality.issues(d, "id", rules).unionByName(quality.repeated(edges, "id"))


def attachment_issues(nodes: DataFrame, attachments: DataFrame) -> DataFrame:
    """What attachments (place_id, node_id) of places to reviewed gates break."""
    a = attachments.join(nodes.select(F.col("id").alias("node_id"), "role"), "node_id", "left")
    found = quality.issues(a, "place_id", {"not-a-gate": F.col("role") == "gate"})
    twice = quality.repeated(attachments, "place_id").select("source_id", F.lit("place-attached-twice").alias("code"))
    return found.unionByName(twice).unionByName(quality.repeated(attachments, "node_id").select("source_id", F.lit("gate-attached-twice").alias("code")))


def reviewed_issues(nodes: DataFrame, edges: DataFrame, attachments: DataFrame, official_nodes: DataFrame, official_edges: DataFrame, floors: list[str]) -> DataFrame:
    """What a reviewed network breaks. nodes: id, floor_id, role, x, y, z; edges and attachments as above."""
    found = reviewed_node_issues(nodes, official_nodes, floors).unionByName(reviewed_edge_issues(nodes, edges, official_nodes, official_edges))
    return found.unionByName(attachment_issues(nodes, attachments))
