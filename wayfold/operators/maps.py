"""Features of maps: walls, category audits, presence; overlays, sub-networks and the validation summary of a network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from . import graph, spatial

WALL_M = 4.0


def walls(polygons: DataFrame) -> DataFrame:
    """id, floor_id, segment (a, b) of the walls over polygons (id, layer, floor_id, ring). Fixtures stand in only on
    floors that have neither Floor nor Space polygons; polygons without a floor have none."""
    main = F.col("layer").isin("Floor", "Space")
    shown = polygons.where(F.col("floor_id").isNotNull())
    built = shown.where(main).select("floor_id").distinct()  # one row a floor
    spare = shown.where(F.col("layer") == "Fixture").join(built, "floor_id", "left_anti")
    both = shown.where(main).unionByName(spare.select(*shown.columns))
    return both.select("id", "floor_id", F.explode(geometry.envelope(F.col("ring"), WALL_M)).alias("segment"))


def audit(features: DataFrame, examples: int = 5) -> DataFrame:
    """layer, code, records, named, without_floor, without_point, bounds, floors (map of counts) and the first ids by
    source record of each category; a missing category is ``(missing)``. Counts are made by floor first, so that a hot
    category meets in few rows."""
    code = scalars.category_code(F.col("category"))
    f = features.withColumn("code", F.when(code == "", "(missing)").otherwise(code))
    one = F.count(F.lit(1))
    named = F.count(F.when(F.trim("name") != "", 1))
    edges = [g(c).alias(f"{n}_{c}") for c in "xz" for g, n in ((F.min, "min"), (F.max, "max"))]
    fine = f.groupBy("layer", "code", F.coalesce("floor_id", F.lit("(missing)")).alias("floor")).agg(one.alias("n"), named.alias("named"), F.count(F.when(F.col("x").isNull(), 1)).alias("no_point"), *edges)
    floors = F.map_from_entries(F.array_sort(F.collect_list(F.struct("floor", "n"))))
    missing = F.coalesce(F.sum(F.when(F.col("floor") == "(missing)", F.col("n"))), F.lit(0))
    again = [g(f"{n}_{c}").alias(f"{n}_{c}") for c in "xz" for g, n in ((F.min, "min"), (F.max, "max"))]
    whole = fine.groupBy("layer", "code").agg(F.sum("n").alias("records"), F.sum("named").alias("named"), missing.alias("without_floor"), F.sum("no_point").alias("without_point"), *again, floors.alias("floors"))
    nth = F.row_number().over(Window.partitionBy("layer", "code").orderBy("source_record", "id"))
    first = f.select("layer", "code", "source_record", "id").withColumn("nth", nth).where(F.col("nth") <= examples)
    first = first.groupBy("layer", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda s: s["id"]).alias("examples"))
    return whole.join(first, ["layer", "code"])


def presence(df: DataFrame, floors: list[str], sections: dict[str, Column]) -> DataFrame:
    """section, key, n: what occurs on the shown floors."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), c.cast("string").alias("key")) for s, c in sections.items()]))
    return df.where(F.col("floor_id").isin(floors)).select(pairs.alias("p")).where("p.key is not null").groupBy("p.section", "p.key").agg(F.count(F.lit(1)).alias("n"))


def overlay_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reviewed edges (id, from_id, to_id) measured between their ends: id, from_id, to_id, floor_id, distance_m,
    points, problem (start-missing, end-missing, floor-mismatch; null: usable)."""
    at = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("floor_id").alias(f"{end}_floor"), F.struct("x", "y", "z").alias(end))
    d = edges.join(at("from"), "from_id", "left").join(at("to"), "to_id", "left").withColumn("points", F.array("from", "to"))
    problem = F.when(F.col("from").isNull(), "start-missing").when(F.col("to").isNull(), "end-missing").when(~F.col("from_floor").eqNullSafe(F.col("to_floor")), "floor-mismatch")
    length = F.when(F.col("from").isNotNull() & F.col("to").isNotNull(), geometry.length_3d(F.col("points")))
    return d.select("id", "from_id", "to_id", F.col("from_floor").alias("floor_id"), length.alias("distance_m"), "points", problem.alias("problem"))


def induced(nodes: DataFrame, edges: DataFrame, floors: list[str], west: float, north: float, east: float, south: float) -> DataFrame:
    """id, kind, floor_from, floor_to of the edges between floors with both ends in a box of the plane."""
    inside = F.col("floor_id").isin(floors) & F.col("x").between(west, east) & F.col("z").between(north, south)
    at = lambda end: nodes.where(inside).select(F.col("id").alias(f"{end}_id"), F.col("floor_id").alias(f"floor_{end}"))
    d = edges.join(at("from"), "from_id").join(at("to"), "to_id")
    return d.where("floor_from != floor_to").select("id", "kind", "floor_from", "floor_to")


def rule_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, severity, code of edges: unknown codes, negative distances, missing ends. One missing end is a link
    over the boundary of the selection, a warning; two are an error."""
    d = graph.with_endpoints(edges, nodes, "left")
    a, b = F.col("a_floor_id").isNull(), F.col("b_floor_id").isNull()
    rule = lambda when, severity, code: F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    found = [
        rule(~F.col("direction").isin("both", "forward", "reverse"), "error", "direction-unknown"),
        rule(~F.col("kind").isin("corridor", "stairs", "elevator", "escalator", "ramp"), "error", "kind-unknown"),
        rule(~(F.col("source_m") >= 0), "error", "distance-negative"),
        rule(a & b, "error", "both-ends-missing"),
        rule(a != b, "warning", "boundary-link"),
    ]
    return d.select(F.col("id").alias("source_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("source_id", "i.*")


def validation_summary(nodes: DataFrame, edges: DataFrame, ready: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """metric, value of a network: sizes, components, isolated and repeated nodes, near pairs, edges with missing ends,
    one-way edges, accessibility, connectors between floors. ready: edges as routing_edges gives them."""
    long = lambda df, *cols: df.agg(*[c.alias(n) for n, c in cols]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n, _ in cols])).alias("m")).select("m.*")
    one = F.count(F.lit(1))
    when = lambda c: F.count(F.when(c, 1))
    cross = F.col("floor_from") != F.col("floor_to")
    ready = graph.stored(ready)  # six counts read it
    ids = nodes.groupBy("id").agg(one.alias("n"))
    used = ready.select(F.col("from_id").alias("id")).unionByName(ready.select(F.col("to_id").alias("id"))).distinct()
    roots = graph.components(ready).where("id = root")
    parts = [
        long(nodes, ("nodes", one), ("floors", F.count_distinct("floor_id")), ("facilities", F.count_distinct("facility_id"))),
        long(ids, ("duplicate_nodes", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))),
        long(edges, ("edges", one), ("one_way_edges", when(F.col("direction") != "both"))),
        long(graph.rejected(edges, nodes), ("invalid_references", one)),
        long(ready, *[(f"access_{a}", when(F.col("accessibility") == a)) for a in ("yes", "no", "unknown")], *[(f"vertical_{k}", when(cross & (F.col("kind") == k))) for k in ("stairs", "escalator", "elevator")]),
        long(roots, ("linked_components", one)),
        long(nodes.join(used, "id", "left_anti"), ("single_nodes", one)),
        long(graph.isolated(nodes, edges), ("isolated_nodes", one)),
        long(spatial.near_pairs(nodes, tolerance), ("near_pairs", one)),
    ]
    return reduce(DataFrame.unionByName, parts)
