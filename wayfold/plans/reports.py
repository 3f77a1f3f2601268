"""Queries over reports: category facts and totals, network documents whole and broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..sources.derived import ctes, table
from .building import KNOWN
from .registry import query

CATS = KNOWN.split(",\ngiven as")[0]
FACTS = f"""with {CATS}, f as (select layer, coalesce(nullif(upper(trim(case when layer='Fixture' then replace(category, 'B', 'C') else category end)), ''), '(missing)') as code, coalesce(trim(name) <> '', false) as has_name,
 case when source_record % 59 = 0 then 'Null' when layer = 'Facility' then 'Point' else 'Polygon' end as g, coalesce(floor_id, '(missing)') as fl, area from features),
a as (select layer, code, count(*) as records, count(*) filter (has_name) as named, count(*) filter (g = 'Null') as malformed, count(*) filter (fl = '(missing)') as no_floor from f group by all),
x as (select layer, code, string_agg(g || ':' || n, ',' order by g) as geometry_types from (select layer, code, g, count(*) as n from f group by all) group by all),
y as (select layer, code, string_agg(fl || ':' || n, ',' order by fl) as floors from (select layer, code, fl, count(*) as n from f group by all) group by all),
z as (select layer, code, string_agg(area || ':' || n, ',' order by area) as areas from (select layer, code, area, count(*) as n from f group by all) group by all),
facts as (select a.*, geometry_types, floors, areas, role is not null as known, coalesce(role, 'unknown') as role from a join x using (layer, code) join y using (layer, code) join z using (layer, code) left join cat using (layer, code))"""


def _features(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "features")
    category = F.when(F.col("layer") == "Fixture", F.regexp_replace("category", "B", "C")).otherwise(F.col("category"))
    kind = F.when(F.col("source_record") % 59 != 0, F.when(F.col("layer") == "Facility", "Point").otherwise("Polygon"))
    return f.select("layer", category.alias("category"), "name", kind.alias("geometry_type"), "floor_id", "area")


@query(f"{FACTS} select * exclude (no_floor) from facts", "features")
def category_facts(s: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(c)
    return reports.category_facts(_features(s, d)).select("layer", "code", "known", "role", "records", "named", "malformed", *map(flat, ("geometry_types", "floors", "areas")))


@query(f"""{FACTS} select layer, sum(records)::bigint as features, count(*) as categories, coalesce(sum(records) filter (code = '(missing)'), 0)::bigint as missing_category, sum(no_floor)::bigint as missing_floor,
 coalesce(string_agg(code, ',' order by code) filter (not known), '') as unknown_codes from facts group by layer""", "features")
def category_totals(s: SparkSession, d: str) -> DataFrame:
    t = reports.category_totals(reports.category_facts(_features(s, d)))
    return t.withColumn("unknown_codes", F.array_join("unknown_codes", ","))


FLOORS = {-2.0: "B2", -1.0: "B1", 0.0: "0", 1.0: "1", 2.0: "2"}
# A network document: some nodes of another floor, some links with wrong floors, without approval or beside their nodes.
DOCUMENT = f"""with {ctes('nodes', 'edges')}, nn as (select *, cast(substr(id, 2) as bigint) as j from nodes),
ee as (select e.id, from_id, to_id, cast(split_part(e.id, '-', 1) as bigint) as k, a.id is null as no_a, b.id is null as no_b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as ab,
  sqrt((a.x+0.25-b.x)*(a.x+0.25-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as ab2 from edges e left join nodes a on from_id = a.id left join nodes b on to_id = b.id),
ok as (select * from ee where not no_a and not no_b)"""
REPEATED = "select 'error' as severity, 'duplicate-edges' as code, null::varchar as source_id, count(*) - count(distinct id) as n from ee having count(*) > count(distinct id)"


def _document(s: SparkSession, d: str, broken: bool) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    n = table(s, d, "nodes")
    j = F.substring("id", 2, 20).cast("long")
    level = F.coalesce(*[F.when(F.col("floor_id") == f, F.lit(o)) for o, f in FLOORS.items()])
    nodes = n.select(F.to_json(F.struct("id", "floor_id", F.when(j % 43 == 0, 9.0).otherwise(level).alias("ordinal"), "x", "y", "z")).alias("value"), j.alias("j"))
    at = lambda end: n.select(F.col("id").alias(f"{end}_id"), F.col("floor_id").alias(f"floor_{end}"), F.struct("x", "y", "z").alias(end))
    k = F.split_part("id", F.lit("-"), F.lit(1)).cast("long")
    e = table(s, d, "edges").join(at("from"), "from_id", "left").join(at("to"), "to_id", "left").withColumn("k", k)
    none = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    aside = F.when(F.col("k") % 11 == 0, 0.25).when(F.col("k") % 11 == 1, 0.0625).otherwise(0.0)
    a, b = F.coalesce("from", none), F.coalesce("to", none)
    line = F.array(F.struct((a.x + aside).alias("x"), a.y.alias("y"), a.z.alias("z")), b)
    floor = lambda c: F.coalesce(c, F.lit("0"))
    whole = F.struct("id", "from_id", "to_id", F.when(F.col("k") % 37 == 0, "X").otherwise(floor("floor_from")).alias("floor_from"), floor("floor_to").alias("floor_to"), (F.col("k") % 53 != 0).alias("validated"), F.when(F.col("k") % 3 == 0, F.reverse(line)).otherwise(line).alias("points"))
    links = e.select(F.to_json(whole).alias("value"), "k", (F.col("from").isNull() != F.col("to").isNull()).alias("one"))
    if broken:
        nodes = nodes.withColumn("value", F.when(F.col("j") % 97 == 0, F.substring("value", 1, 10)).otherwise(F.col("value")))
        links = links.withColumn("value", F.when(F.col("k") % 89 == 0, F.regexp_replace("value", '"validated":(true|false)', '"validated":"so"')).otherwise(F.col("value")))
    stated = {"boundary_links": links.agg(F.count(F.when(F.col("one"), 1))).first()[0], "components": 1, "isolated_nodes": 0}
    return nodes.select("value"), links.select("value"), stated


@query(f"""{DOCUMENT}, i as ({REPEATED} union all
select 'error', 'floor-assignment', null, count(*) from nn where j % 43 = 0 having count(*) > 0 union all
select 'error', 'invalid-reference', id, null from ee where no_a or no_b union all
select 'error', 'edge-floor-assignment', id, null from ok where k % 37 = 0 union all
select 'error', 'disabled-source-link', id, null from ok where k % 53 = 0 union all
select 'error', 'endpoint-misalignment', id, cast(floor(least(0.25, greatest(ab, ab2))*1000+0.5) as bigint) from ok where k % 11 = 0 and greatest(ab, ab2) > 0.1 union all
select 'warning', 'boundary-links', null, count(*) from ee where no_a <> no_b having count(*) > 0) select * from i""")
def document_issues(s: SparkSession, d: str) -> DataFrame:
    """Issues of a document that fits the schema."""
    nodes, links, stated = _document(s, d, False)
    return reports.document_issues(nodes, links, FLOORS, stated, "selection").drop("raw")


@query(f"""{DOCUMENT}, known as (select id from nn where j % 97 <> 0), i as (
{REPEATED} union all
select 'error', 'invalid-reference', null, count(*) from ee where from_id not in (from known) or to_id not in (from known) having count(*) > 0 union all
select 'error', 'schema-validation', 'malformed', 10 from nn where j % 97 = 0 union all
select 'error', 'schema-validation', 'malformed', null from ee where k % 89 = 0) select * from i""")
def broken_document_issues(s: SparkSession, d: str) -> DataFrame:
    """Issues of a document with records that don't fit: preflight counts and the records themselves (n: length of those cut off)."""
    nodes, links, stated = _document(s, d, True)
    i = reports.document_issues(nodes, links, FLOORS, stated)
    return i.withColumn("n", F.when(F.length("raw") == 10, F.lit(10).cast("long")).otherwise(F.col("n"))).drop("raw")


KEYS = {"$": ["schemaVersion", "coordinateSystem", "nodes", "statistics"], "$.coordinateSystem": ["units", "axes"], "$.coordinateSystem.axes": ["x", "y", "z"], "$.nodes[*]": ["id", "distance"], "$.statistics": ["nodeCount", "bounds"]}
HEADER = {"$.schemaVersion": 1, "$.coordinateSystem.units": "meters", "$.coordinateSystem.axes.x": "east", "$.coordinateSystem.axes.y": "vertical", "$.coordinateSystem.axes.z": "south"}


@query("""with d as (select l_orderkey as source_id, count(*) as c from lineitem group by all)
select source_id, 'missing-key' as code, '$' as level, 'schemaVersion' as key, 1 as n from d where source_id % 5 = 0 union all
select source_id, 'unsupported-key', '$', 'extra', 1 from d where source_id % 17 = 0 union all
select source_id, 'header-mismatch', '$.schemaVersion', null, 1 from d where source_id % 5 = 0 union all
select source_id, 'header-mismatch', '$.coordinateSystem.units', null, 1 from d where source_id % 6 = 0 union all
select source_id, 'missing-key', '$.coordinateSystem.axes', 'z', 1 from d where source_id % 9 = 0 union all
select source_id, 'header-mismatch', '$.coordinateSystem.axes.z', null, 1 from d where source_id % 9 = 0 union all
select source_id, 'unsupported-key', '$.nodes[*]', 'note', c from d where source_id % 13 = 0 union all
select source_id, 'count-mismatch', '$.statistics.nodeCount', null, 1 from d where source_id % 8 = 0 union all
select source_id, 'bounds-order', '$.statistics.bounds', 'X', 1 from d where source_id % 10 = 0""")
def document_headers(s: SparkSession, d: str) -> DataFrame:
    """A document for each order, some with keys too many or too few, other units, wrong counts or turned bounds."""
    k = F.col("source_id")
    some = lambda n, v: F.when(k % n == 0, F.lit(v))  # noqa: E731  fields that are null aren't written
    node = F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("distance"), some(13, "by hand").alias("note"))
    docs = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "source_id").groupBy("source_id").agg(F.collect_list(node).alias("nodes"))  # seven lines at most
    axes = F.struct(F.lit("east").alias("x"), F.lit("vertical").alias("y"), F.when(k % 9 != 0, "south").alias("z"))
    system = F.struct(F.coalesce(some(6, "feet"), F.lit("meters")).alias("units"), axes.alias("axes"))
    bounds = F.struct(F.coalesce(some(10, 5.0), F.lit(0.0)).alias("minX"), F.lit(1.0).alias("maxX"))
    statistics = F.struct((F.size("nodes") + F.coalesce(some(8, 1), F.lit(0))).alias("nodeCount"), bounds.alias("bounds"))
    value = F.struct(F.when(k % 5 != 0, 1).alias("schemaVersion"), some(17, "x").alias("extra"), system.alias("coordinateSystem"), "nodes", statistics.alias("statistics"))
    return reports.header_issues(docs.select("source_id", F.to_json(value).alias("value")), KEYS, HEADER, {"$.statistics.nodeCount": "$.nodes"}, {"$.statistics.bounds": ["X"]})
