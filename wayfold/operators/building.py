"""Places, networks and ids that map layers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, geometry, scalars
from .graph import ranked
from .spatial import nearest_node


def resolved(features: DataFrame) -> DataFrame:
    """features (id, layer, category) with code, name_ja, name_en, role, group, shape, known of their category; codes
    that no table has are unknown."""
    table = features.sparkSession.createDataFrame(categories.category_rows(), categories.COLUMNS)
    d = features.withColumn("code", scalars.category_code(F.col("category"))).join(F.broadcast(table), ["layer", "code"], "left")  # some hundred rows
    known = F.col("role").isNotNull()
    shape = F.when(F.col("layer") == "Facility", "point-marker").when(F.col("layer") == "Space", "surface").otherwise("solid")
    rest = {"name_ja": F.lit(categories.UNKNOWN[0]), "name_en": F.lit(categories.UNKNOWN[1]), "role": F.lit("unknown"), "group": F.lit("unknown"), "shape": shape}
    return d.select(*features.columns, "code", *[F.coalesce(c, v).alias(c) for c, v in rest.items()], known.alias("known"))


def drawn_as(features: DataFrame) -> DataFrame:
    """layer, style, n: spaces and fixtures by how they are drawn."""
    group, shape = F.col("group"), F.col("shape")
    kind = F.when(shape == "thin-barrier", "thin").when(shape == "low-solid", "low").otherwise("solid")
    fixture = F.coalesce(
        categories.looked_up(F.col("code"), categories.FIXTURE_GROUPS),
        F.when(group == "furniture", F.concat(F.lit("furniture-"), F.when(shape == "low-solid", "low").otherwise("solid"))),
        F.when(group == "barrier", F.concat(F.lit("barrier-"), kind)),
        F.when(group.isin("column", "wall", "fixture"), group),
        F.lit("unknown"),
    )
    d = resolved(features.where(F.col("layer").isin("Space", "Fixture")))
    return d.select("layer", F.when(F.col("layer") == "Space", group).otherwise(fixture).alias("style")).groupBy("layer", "style").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(features: DataFrame, base: str = "base_id", record: str = "source_record") -> DataFrame:
    """features with id: the base id for the first record that has it, else base id and record number; clash: two
    records still share an id."""
    first = features.groupBy(F.col(base).alias("__base")).agg(F.min(record).alias("__first"))
    d = features.join(first, F.col(base).eqNullSafe(F.col("__base")))
    d = d.withColumn("id", F.when(F.col(record) == F.col("__first"), F.col(base)).otherwise(F.concat(F.col(base), F.lit(":"), F.col(record).cast("string"))))
    twice = d.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    return d.join(twice, F.col("id").eqNullSafe(F.col("__id"))).select(*features.columns, "id", (F.col("__n") > 1).alias("clash"))


def named_places(layers: DataFrame, nodes: DataFrame, reviewed: DataFrame, attachments: DataFrame) -> DataFrame:
    """Places of named openings and spaces: id, source_id, area, name, category, floor_id, x, y, z, node_id, distance_m,
    confidence, reviewed, routable, problem (floor-mismatch of a reviewed node, no-node; null: usable).

    layers: source_id, area, layer, name, floor_id and a point x, y, z. Rows without name, point, id or category give
    none. A reviewed attachment (place_id, node_id; the first of several) overrides the nearest node of the floor, and
    counts in space; nodes of reviewed: id, floor_id, x, y, z. Low confidence without review isn't routable.
    """
    name = F.trim("name")
    category = F.when(F.col("layer") == "Opening", "gate").when(F.col("layer") == "Space", scalars.space_category(name))
    f = layers.where((name != "") & (F.col("name") != "不明") & F.col("x").isNotNull() & F.col("source_id").isNotNull())
    f = f.select(F.concat_ws(":", category, "source_id").alias("id"), "source_id", "area", name.alias("name"), category.alias("category"), "floor_id", "x", "y", "z").where("category is not null")
    near = nearest_node(f.select("id", "floor_id", "x", "z"), nodes).select("id", F.col("node_id").alias("near_id"), F.col("distance_m").alias("near_m"))
    given = attachments.groupBy(F.col("place_id").alias("id")).agg(F.min("node_id").alias("given_id"))
    given = given.join(reviewed.select(F.col("id").alias("given_id"), F.col("floor_id").alias("given_floor"), *[F.col(c).alias(f"g{c}") for c in "xyz"]), "given_id")
    d = f.join(near.dropDuplicates(["id"]), "id", "left").join(given, "id", "left")
    is_given = F.col("given_id").isNotNull()
    far = F.sqrt(sum(((F.col(c) - F.col(f"g{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    d = d.withColumn("distance_m", F.when(is_given, far).otherwise(F.col("near_m")))
    trust = F.when(is_given, "high").otherwise(scalars.confidence(F.col("distance_m")))
    problem = F.when(is_given & ~F.col("given_floor").eqNullSafe(F.col("floor_id")), "floor-mismatch").when(~is_given & F.col("near_id").isNull(), "no-node")
    return d.select("id", "source_id", "area", "name", "category", "floor_id", "x", "y", "z", F.coalesce("given_id", "near_id").alias("node_id"), "distance_m", trust.alias("confidence"), is_given.alias("reviewed"), (problem.isNull() & (trust != "low")).alias("routable"), problem.alias("problem"))


def connector(edges: DataFrame, nodes: DataFrame, preferred: str | None = None, ground: str = "0") -> DataFrame:
    """One row at most: the connector place at the ground end of the preferred edge, or else of the first elevator (by
    id) between floors: id, source_id, node_id, floor_id, x, y, z, problem (no-ground-end). edges: id, from_id, to_id,
    kind, floor_from, floor_to."""
    usable = edges.where(((F.col("kind") == "elevator") & (F.col("floor_from") != F.col("floor_to"))) | (F.col("id") == F.lit(preferred)))
    rank = F.coalesce(F.when(F.col("id") == F.lit(preferred), 0), F.lit(1))
    one = usable.agg(F.min(F.struct(rank.alias("rank"), "id", "from_id", "to_id")).alias("e")).select("e.*").where("id is not null")
    ends = one.select(F.col("id").alias("source_id"), F.posexplode(F.array("from_id", "to_id")).alias("side", "node_id"))
    found = ends.join(nodes.where(F.col("floor_id") == ground).select(F.col("id").alias("node_id"), "floor_id", "x", "y", "z"), "node_id")
    found = found.groupBy("source_id").agg(F.min_by(F.struct("node_id", "floor_id", "x", "y", "z"), F.col("node_id")).alias("n"))
    out = one.select(F.col("id").alias("source_id")).join(found, "source_id", "left")
    return out.select(F.concat(F.lit("connector:"), "source_id", F.lit(f":{ground}")).alias("id"), "source_id", "n.node_id", "n.floor_id", "n.x", "n.y", "n.z", F.when(F.col("n").isNull(), "no-ground-end").alias("problem"))


def qualified(id_: Column, area: Column, floor: Column) -> Column:
    """area:floor:id where both are known, else the id."""
    return F.when(area.isNotNull() & floor.isNotNull(), F.concat_ws(":", area, floor, id_)).otherwise(id_)


def tactile_nodes(points: DataFrame) -> DataFrame:
    """id, source_id, name, kind, floor_id, area, x, y, z of guidance points: source_id, area, source_floor, floor_id,
    name, category, x, y, z. Category 5 is a gate; blank names are null."""
    name = F.when(F.trim("name") != "", F.trim("name"))
    kind = F.when(F.col("category") == "5", "gate").otherwise("normal")
    return points.where("x is not null").select(qualified(F.col("source_id"), F.col("area"), F.col("source_floor")).alias("id"), "source_id", name.alias("name"), kind.alias("kind"), "floor_id", "area", "x", "y", "z")


def tactile_edges(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, source_id, from_id, to_id, floor_id, distance_m, points, reason of guidance lines: source_id, area,
    source_floor, floor_id, start, end, points. reason (null: usable) is malformed-geometry before missing ends. Usable
    edges go both ways, as corridors of unknown accessibility."""
    own = lambda c: qualified(F.col(c), F.col("area"), F.col("source_floor"))
    d = lines.select(own("source_id").alias("id"), "source_id", F.when(F.col("start").isNotNull(), own("start")).alias("from_id"), F.when(F.col("end").isNotNull(), own("end")).alias("to_id"), "floor_id", "points")
    ids = nodes.select("id").distinct()
    d = d.join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("a")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(True).alias("b")), "to_id", "left")
    no_a, no_b = F.col("a").isNull(), F.col("b").isNull()
    bad = F.coalesce(F.size("points") < 2, F.lit(True))
    reason = F.when(bad, "malformed-geometry").when(no_a & no_b, "missing-both-nodes").when(no_a, "missing-start-node").when(no_b, "missing-end-node")
    return d.select("id", "source_id", "from_id", "to_id", "floor_id", F.when(reason.isNull(), geometry.length_3d(F.col("points"))).alias("distance_m"), "points", reason.alias("reason"))


def workload(ids: DataFrame, profiles: list[str], pairs: int = 40) -> DataFrame:
    """pair, profile, start_id, goal_id: a fixed mix of requests over the distinct ids in their order."""
    place = ranked(ids.select("id").distinct(), [F.col("id")]).select("id", (F.col("nth") - 1).alias("at"), "of")
    asked = place.where("at = 0").select("of", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
    asked = asked.select("pair", F.explode(F.array(F.struct(F.lit("s").alias("side"), (F.col("pair") * 17 % F.col("of")).alias("at")), F.struct(F.lit("g").alias("side"), ((F.col("pair") * 43 + 29) % F.col("of")).alias("at")))).alias("q")).select("pair", "q.*")
    d = place.join(F.broadcast(asked), "at")  # two rows a pair
    d = d.groupBy("pair").agg(F.max(F.when(F.col("side") == "s", F.col("id"))).alias("start_id"), F.max(F.when(F.col("side") == "g", F.col("id"))).alias("goal_id"))
    return d.select("pair", F.explode(F.array(*map(F.lit, profiles))).alias("profile"), "start_id", "goal_id")
