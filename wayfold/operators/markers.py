"""Facility markers: candidates with review reasons, summaries, and the places that public markers become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, scalars
from .graph import ranked
from .spatial import nearest_node

ALIGNED_M = 15.0
REASONS = ["invalid-geometry", "missing-floor", "unclear-source-label", "network-misalignment", "duplicate"]


def _named(name: Column) -> Column:
    return F.coalesce(F.trim(name) != "", F.lit(False))


def candidates(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each facility of a code that has markers: id, source_record, area, code, source_name, floor_id, x, y,
    z, priority, min_zoom, node_id, distance_m, reason (null: public).

    features: id, source_record, area, layer, category, name, floor_id, x, y, z (null x: no point, which then counts as
    the origin). Of equal public markers (code, floor, place to a tenth of a metre) the first in the reading order of ids stays
    public.
    """
    code = scalars.category_code(F.col("category"))
    f = features.where("layer = 'Facility'").withColumn("code", code).withColumn("priority", categories.marker_priority(F.col("code"))).where("priority is not null")
    f = f.withColumn("no_point", F.col("x").isNull())
    f = f.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in "xyz"})
    near = nearest_node(f.where("floor_id is not null").select("id", "floor_id", "x", "z"), nodes).select("id", "node_id", "distance_m")
    f = f.join(near, "id", "left").withColumn("source_name", scalars.clear_label(F.col("name")))
    unclear = _named(F.col("name")) & F.col("source_name").isNull()
    far = F.col("node_id").isNull() | (F.col("distance_m") > ALIGNED_M)
    reason = F.when(F.col("no_point"), REASONS[0]).when(F.col("floor_id").isNull() | (F.col("floor_id") == ""), REASONS[1]).when(unclear, REASONS[2]).when(far, REASONS[3])
    f = f.withColumn("reason", reason)
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5).alias(f"t{c}")
    key = ["code", "floor_id", "tx", "tz"]
    f = f.withColumn("tx", tenth("x")).withColumn("tz", tenth("z"))
    first = f.where("reason is null").groupBy(*key).agg(F.min(F.struct(*scalars.in_reading_order("id"))).alias("f")).select(*key, F.col("f.id").alias("first_id"))
    f = f.join(first, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("id") != F.col("first_id"), REASONS[4])))
    zoom = categories.looked_up(F.col("priority"), categories.MARKER_MIN_ZOOM)
    return f.select("id", "source_record", "area", "code", "source_name", "floor_id", "x", "y", "z", "priority", zoom.alias("min_zoom"), "node_id", "distance_m", "reason")


def summary(markers: DataFrame) -> DataFrame:
    """code, candidates, public, and one count for each review reason."""
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r.replace("-", "_")) for r in REASONS]
    return markers.groupBy("code").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("reason").isNull(), 1)).alias("public"), *counts)


def promotions(features: DataFrame) -> DataFrame:
    """code, features, destination, category, excluded: what becomes of the facilities of each code. features: layer,
    category."""
    f = features.where("layer = 'Facility'").select(scalars.category_code(F.col("category")).alias("code"))
    n = f.groupBy("code").agg(F.count(F.lit(1)).alias("features"))
    return n.select("*", categories.promotion(F.col("code")).alias("p")).select("code", "features", "p.*")


def filter_options(markers: DataFrame, hidden: list[str], gates: DataFrame) -> DataFrame:
    """code, n of public markers without hidden codes, and one row ``gate`` for the rows of gates."""
    shown = markers.where(F.col("reason").isNull() & ~F.col("code").isin(hidden)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return shown.unionByName(gates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("gate").alias("code"), "n"))


def routable_places(markers: DataFrame, places: DataFrame) -> DataFrame:
    """id, place_id: the routable facility place with a marker's source id and floor (of several the smallest id).
    markers: id, source_id, floor_id; places: id, source_id, floor_id, routable."""
    p = places.where("routable").groupBy("source_id", "floor_id").agg(F.min("id").alias("place_id"))
    return markers.join(p, ["source_id", "floor_id"]).select("id", "place_id")


def promoted(markers: DataFrame) -> DataFrame:
    """Public markers of codes with a place category, as places: id, name, name_kind, category, code, area, floor_id, x,
    y, z, node_id, distance_m, confidence. Without a name of their own they are numbered in (area, floor, code) by id;
    rows with a name count too."""
    m = markers.where("reason is null").withColumn("category", categories.place_category(F.col("code"))).where("category is not null")
    key = ["area", "floor_id", "code"]
    m = ranked(m, [F.col("id")], tuple(key))
    made = F.concat(categories.name_ja(F.col("code")), F.when(F.col("of") > 1, F.concat(F.lit(" "), F.col("nth").cast("string"))).otherwise(""))
    kind = F.when(F.col("source_name").isNull(), "generated-category").otherwise("source")
    return m.select(F.concat(F.lit("facility:"), "id").alias("id"), F.coalesce("source_name", made).alias("name"), kind.alias("name_kind"), "category", "code", "area", "floor_id", "x", "y", "z", "node_id", "distance_m", scalars.confidence(F.col("distance_m")).alias("confidence"))
