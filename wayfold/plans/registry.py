"""Registered queries over the given tables, with the SQL that a second engine can run.

Distances and coordinates are compared as whole millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..functions.scalars import millimetres as mm
from ..operators import graph, places, quality, routing, spatial
from ..sources.derived import ctes, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, *needs: str):
    """Register a query under its function's name; needs: derived tables that its SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if needs:
                body = f"with {ctes(*needs)}{', ' + body[5:] if body.startswith('with ') else ' ' + body}"
            SQL[f.__name__] = body
        return f

    return add


MM = "cast(floor(({})*1000+0.5) as bigint)"


@query("""
select id, cast(floor(radians(x*1e-5)*6378137.0*cos(radians(35.6909e0))*1000+0.5) as bigint) as x_mm, cast(floor(y*1000+0.5) as bigint) as y_mm,
       cast(floor(-(radians(z*1e-5+35.6909e0-35.6909e0)*6378137.0)*1000+0.5) as bigint) as z_mm from nodes""", "nodes")
def local_coordinates(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nodes")
    p = scalars.lonlat_to_local(F.col("x") * 1e-5, F.col("z") * 1e-5 + 35.6909, 0.0, 35.6909, F.col("y"))
    return n.select("id", *[mm(p[c]).alias(f"{c}_mm") for c in "xyz"])


@query("""
with r as (select p_partkey as id, case p_size % 6 when 0 then 'b1' when 1 then ' -2 ' when 2 then '3OUT' when 3 then '4' when 4 then 'x' else 'B2.5' end as raw from part),
v as (select *, upper(trim(raw)) as v from r),
f as (select *, case when regexp_full_match(v, '-\\d+') then 'B' || cast(cast(substr(v, 2) as int) as varchar) when regexp_full_match(v, '\\d+OUT') then lower(v) else v end as floor_id from v)
select id, floor_id, case floor_id when 'B1' then -5.0e0 when 'B2' then -10.0e0 when '3out' then 15.0e0 when '4' then 20.0e0 when 'B2.5' then -12.5e0 else 0.0e0 end as elevation,
       regexp_replace(floor_id, 'out$', '') as visual_floor from f""".replace("\\\\", "\\"))
def floors(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 6
    raw = F.when(k == 0, "b1").when(k == 1, " -2 ").when(k == 2, "3OUT").when(k == 3, "4").when(k == 4, "x").otherwise("B2.5")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), scalars.normalize_floor(raw).alias("floor_id"), scalars.floor_elevation(raw).alias("elevation"), scalars.visual_floor(raw).alias("visual_floor"))


@query("""select p_partkey as id, case p_size % 5 when 1 then 'both' when 2 then 'forward' when 3 then 'reverse' end as direction,
case p_size % 8 when 4 then 'elevator' when 5 then 'escalator' when 6 then 'stairs' else 'corridor' end as movement,
case p_size % 4 when 1 then 'outside' when 2 then 'boundary' when 3 then 'inside' end as in_out from part""")
def decoded_codes(s: SparkSession, d: str) -> DataFrame:
    code = lambda n: (F.col("p_size") % n).cast("string")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), scalars.decode(code(5), scalars.DIRECTIONS).alias("direction"), scalars.decode(code(8), scalars.MOVEMENTS, "corridor").alias("movement"), scalars.decode(code(4), scalars.IN_OUT).alias("in_out"))


@query("""
with u as (select page_id, url, regexp_extract(url, '\\?([^#]*)', 1) as q from pages)
select page_id, nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') as page, nullif(regexp_extract(q, '(?:^|&)ref=([^&]*)', 1), '') as ref from u""".replace("\\\\", "\\"))
def url_parameters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", scalars.url_parameter(F.col("url"), "page").alias("page"), scalars.url_parameter(F.col("url"), "ref").alias("ref"))


@query("""select id, ceil(abs(x-z)/1.2e0 + case floor_id when 'B1' then 15 when '0' then 45 else 35 end)::bigint as seconds,
greatest(1, ceil(ceil(abs(x-z)/1.2e0 + case floor_id when 'B1' then 15 when '0' then 45 else 35 end)/60.0e0))::bigint as minutes from places""", "places")
def journey_estimates(s: SparkSession, d: str) -> DataFrame:
    moves = F.when(F.col("floor_id") == "B1", F.array(F.lit("stairs"))).when(F.col("floor_id") == "0", F.array(F.lit("elevator"), F.lit("ramp"))).otherwise(F.array(F.lit("stairs"), F.lit("escalator")))
    p = table(s, d, "places").select("id", scalars.journey_seconds(F.abs(F.col("x") - F.col("z")), moves).cast("long").alias("seconds"))
    return p.withColumn("minutes", scalars.journey_minutes(F.col("seconds")).cast("long"))


@query("""
with q as (select id, x, z, 3.0e0 + cast(substr(id, 10) as bigint) % 7 as w from places)
select id, cast(floor(3*w*w*1000+0.5) as bigint) as area_mm,
       cast(floor((x + w*5/6)*1000+0.6) as bigint) as x_mm, cast(floor((z + w*5/6)*1000+0.6) as bigint) as z_mm, cast(floor(w/2*1000+0.5) as bigint) as edge_mm, true as inside_low, false as inside_notch from q""", "places")
def polygons(s: SparkSession, d: str) -> DataFrame:
    """An L around each place: a square of 2w with its far quarter missing. Centroids often lie half way between two
    millimetres, so they are cut at another place than halves."""
    p = table(s, d, "places").withColumn("w", F.lit(3.0) + F.substring("id", 10, 20).cast("long") % 7)
    at = lambda i, j: F.struct((F.col("x") + F.col("w") * i).alias("x"), (F.col("z") + F.col("w") * j).alias("z"))
    ring = F.array(at(0, 0), at(2, 0), at(2, 1), at(1, 1), at(1, 2), at(0, 2), at(0, 0))
    p = p.withColumn("ring", ring)
    half = F.col("w") / 2
    c = geometry.ring_centroid(F.col("ring"))
    low = geometry.boundary_distance(F.col("x") + half, F.col("z") + half, F.col("ring"))
    return p.select("id", mm(geometry.ring_area(F.col("ring"))).alias("area_mm"), *[F.floor(c[k] * 1000 + 0.6).cast("long").alias(f"{k}_mm") for k in "xz"], mm(low).alias("edge_mm"), geometry.inside(F.col("x") + half, F.col("z") + half, F.col("ring")).alias("inside_low"), geometry.inside(F.col("x") + half * 3, F.col("z") + half * 3, F.col("ring")).alias("inside_notch"))


EDGE_CTE = """with g as (
  select e.*, a.floor_id as floor_from, b.floor_id as floor_to, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as geometry_m,
    list_filter([case when e.kind='stairs' then 'stairs' end, case when e.kind='escalator' then 'escalator' end, case when width='1' then 'width-under-1m' end,
      case when vtcl_slope in ('2','3') then 'slope-over-5-percent' end, case when lev_diff='2' then 'level-difference-over-2cm' end,
      case when e.kind='elevator' and elevator in ('2','4') then 'elevator-not-wheelchair-equipped' end], lambda v: v is not null) as reasons,
    list_filter([case when width='99' then 'width' end, case when vtcl_slope='99' then 'vertical-slope' end, case when lev_diff='99' then 'level-difference' end,
      case when e.kind='elevator' and elevator not in ('2','3','4','5') then 'wheelchair-elevator-equipment' end], lambda v: v is not null) as unknowns,
    case when 'outside' in (a.in_out, b.in_out) then 'outside' when 'boundary' in (a.in_out, b.in_out) then 'boundary' else 'inside' end as context
  from edges e join nodes a on e.from_id=a.id join nodes b on e.to_id=b.id
), r as (
  select *, case when source_m > 0 then source_m else geometry_m end as distance_m,
    case when len(reasons) > 0 then 'no' when len(unknowns) > 0 then 'unknown' else 'yes' end as accessibility from g
), pen as (select coalesce(sum(greatest(0, distance_m)), 0) + 1 as penalty from r
), arcs as (
  select id, from_id, to_id, kind, floor_from, floor_to, distance_m, accessibility from r where direction <> 'reverse'
  union all select id || ':reverse', to_id, from_id, kind, floor_to, floor_from, distance_m, accessibility from r where direction <> 'forward'
)"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.routing_edges(table(s, d, "edges"), table(s, d, "nodes"))


@query(EDGE_CTE + f" select id, {MM.format('distance_m')} as distance_mm, accessibility, array_to_string(reasons, ',') as reasons, array_to_string(unknowns, ',') as unknowns, context, floor_from, floor_to from r", "nodes", "edges")
def routing_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).select("id", mm(F.col("distance_m")).alias("distance_mm"), "accessibility", F.array_join("reasons", ",").alias("reasons"), F.array_join("unknowns", ",").alias("unknowns"), "context", "floor_from", "floor_to")


@query(EDGE_CTE + " select id, from_id, to_id, floor_from, floor_to from arcs", "nodes", "edges")
def arcs(s: SparkSession, d: str) -> DataFrame:
    return graph.arcs(_edges(s, d)).select("id", "from_id", "to_id", "floor_from", "floor_to")


@query(EDGE_CTE + """ select kind, direction, count(*) as edges, sum((floor_from<>floor_to)::bigint)::bigint as cross_floor, sum((floor_from<>floor_to and kind<>'corridor')::bigint)::bigint as vertical,
cast(floor(max(abs(distance_m-geometry_m))*1000+0.5) as bigint) as max_gap_mm from r group by kind, direction""", "nodes", "edges")
def network_statistics(s: SparkSession, d: str) -> DataFrame:
    return graph.statistics(_edges(s, d))


@query(EDGE_CTE + """, k as (select *, floor_from<>floor_to as cross_floor from r, pen where geometry_m > 0)
select cast(floor(max(penalty)+0.5) as bigint) as penalty_m, cast(floor(min(distance_m/geometry_m)*1e6+0.5) as bigint) as shortest,
 cast(floor(min(case when accessibility<>'no' then distance_m/geometry_m end)*1e6+0.5) as bigint) as accessible,
 cast(floor(min(case when kind<>'stairs' then distance_m/geometry_m end)*1e6+0.5) as bigint) as avoid_stairs,
 cast(floor(min((distance_m + case when cross_floor and kind<>'elevator' then penalty else 0 end)/geometry_m)*1e6+0.5) as bigint) as prefer_elevator,
 cast(floor(min((distance_m + case when cross_floor then penalty else 0 end)/geometry_m)*1e6+0.5) as bigint) as fewest_floor_changes from k""", "nodes", "edges")
def profile_scales(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    out = graph.scales(e).crossJoin(F.broadcast(graph.penalty(e)))  # two single rows
    return out.select(F.floor(F.col("penalty") + 0.5).cast("long").alias("penalty_m"), *[F.floor(F.col(p.replace("-", "_")) * 1e6 + 0.5).cast("long").alias(p.replace("-", "_")) for p in graph.PROFILES])


COMPONENTS = """with recursive u as (select from_id as a, to_id as b from edges union select to_id, from_id from edges),
c(id, root) using key (id) as (
  select a, min(a) from u group by a
  union
  select u.b, min(c.root) from c join u on c.id = u.a join recurring.c as k on k.id = u.b where c.root < k.root group by u.b
)"""


@query(f"with recursive {ctes('edges')}, " + COMPONENTS[len("with recursive ") :] + ", z as (select root, count(*) as size from c group by root) select row_number() over (order by size desc, root) as component_id, root, size from z")
def component_report(s: SparkSession, d: str) -> DataFrame:
    return graph.component_report(table(s, d, "edges"))


@query("select id, floor_id from nodes where id not in (select from_id from edges union select to_id from edges)", "nodes", "edges")
def isolated_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.isolated(table(s, d, "nodes"), table(s, d, "edges")).select("id", "floor_id")


@query("""
with n as (select * from nodes where cast(substr(id, 2) as bigint) % 7 <> 0),
j as (select e.id, a.id as a, b.id as b from edges e left join n a on e.from_id=a.id left join n b on e.to_id=b.id)
select id, case when a is null and b is null then 'both-ends-missing' when a is null then 'start-missing' else 'end-missing' end as reason, (a is null) <> (b is null) as boundary
from j where a is null or b is null""", "nodes", "edges")
def rejected_edges(s: SparkSession, d: str) -> DataFrame:
    """A network from which each seventh node is missing."""
    return graph.rejected(table(s, d, "edges"), table(s, d, "nodes").where(F.substring("id", 2, 20).cast("long") % 7 != 0))


NEAREST = """with pair as (
  select p.id, n.id as node_id, sqrt((p.x-n.x)*(p.x-n.x)+(p.z-n.z)*(p.z-n.z)) as d from places p join nodes n on p.floor_id=n.floor_id
), near as (select id, arg_min(node_id, (d, node_id)) as node_id, min(d) as d from pair group by id)"""


@query(NEAREST + f" select id, node_id, {MM.format('d')} as distance_mm, case when d <= 5 then 'high' when d <= 15 then 'medium' else 'low' end as confidence from near", "nodes", "places")
def nearest_nodes(s: SparkSession, d: str) -> DataFrame:
    p = spatial.nearest_node(table(s, d, "places").select("id", "floor_id", "x", "z"), table(s, d, "nodes"))
    return p.select("id", "node_id", mm(F.col("distance_m")).alias("distance_mm"), scalars.confidence(F.col("distance_m")).alias("confidence"))


@query(f"select a.id as a, b.id as b, {MM.format('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))')} as distance_mm from places a join places b on a.floor_id=b.floor_id and a.id < b.id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 9", "places")
def near_place_pairs(s: SparkSession, d: str) -> DataFrame:
    return spatial.near_pairs(table(s, d, "places"), 3.0).select("a", "b", mm(F.col("distance_m")).alias("distance_mm"))


@query("select floor_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from nodes group by floor_id", "nodes")
def floor_bounds(s: SparkSession, d: str) -> DataFrame:
    return spatial.bounds(table(s, d, "nodes"), "floor_id")


def _attached(s: SparkSession, d: str) -> DataFrame:
    p = spatial.nearest_node(table(s, d, "places").select("id", "floor_id", "x", "z"), table(s, d, "nodes"))
    return p.select("id", "node_id", (F.coalesce("distance_m", F.lit(1e9)) <= 15).alias("routable"))


@query(NEAREST + """ select r.request_id, r.profile,
 case when a.id is null or b.id is null then 'invalid-place' when a.d > 15 or b.d > 15 then 'invalid-place' when a.id = b.id then 'ok' end as status,
 case when a.id is null or b.id is null then 'not-found' when a.d > 15 or b.d > 15 then 'low-confidence-attachment' when a.id = b.id then 'already-there' end as reason
from requests r left join near a on r.start_id=a.id left join near b on r.destination_id=b.id""", "nodes", "places", "requests")
def request_status(s: SparkSession, d: str) -> DataFrame:
    return routing.classify(table(s, d, "requests"), _attached(s, d)).select("request_id", "profile", "status", "reason")


@query(f"with recursive {ctes('nodes', 'edges')}, " + EDGE_CTE[5:] + """, pa as (
  select 'shortest' as profile, from_id, to_id, distance_m as cost from arcs union all
  select 'accessible', from_id, to_id, distance_m from arcs where accessibility <> 'no' union all
  select 'avoid-stairs', from_id, to_id, distance_m from arcs where kind <> 'stairs' union all
  select 'prefer-elevator', from_id, to_id, distance_m + case when floor_from <> floor_to and kind <> 'elevator' then penalty else 0 end from arcs, pen union all
  select 'fewest-floor-changes', from_id, to_id, distance_m + case when floor_from <> floor_to then penalty else 0 end from arcs, pen
), best as (select profile, from_id, to_id, min(cost) as cost from pa group by all),
d(profile, source, node, cost) using key (profile, source, node) as (
  select distinct profile, from_id, from_id, 0.0::double from pa where from_id in ('S1', 'S2', 'S3')
  union
  select d.profile, d.source, a.to_id, min(d.cost + a.cost) from d join best a on d.profile = a.profile and d.node = a.from_id
  left join recurring.d as k on k.profile = d.profile and k.source = d.source and k.node = a.to_id
  where k.cost is null or d.cost + a.cost < k.cost group by all
) select profile, source, node, """ + MM.format("cost") + " as cost_mm from d")
def shortest_paths(s: SparkSession, d: str) -> DataFrame:
    """Costs from three stations to every node they reach, under all five profiles in one loop."""
    a = graph.profile_arcs(_edges(s, d))
    sources = a.where(F.col("from_id").isin("S1", "S2", "S3")).select("profile", F.col("from_id").alias("node_id"))
    return routing.shortest(a, sources).select("profile", "source", "node", mm(F.col("cost")).alias("cost_mm"))


@query("""select id, case when count(*) over (partition by floor_id, category) > 1 then row_number() over (partition by floor_id, category order by id) end as ordinal from places""", "places")
def place_ordinals(s: SparkSession, d: str) -> DataFrame:
    return places.ordinals(table(s, d, "places"), "floor_id", "category").select("id", F.col("ordinal").cast("long").alias("ordinal"))


@query("""select id, row_number() over (partition by category, floor_id, floor(x*10+0.5), floor(z*10+0.5) order by id) > 1 as duplicate from places""", "places")
def duplicate_markers(s: SparkSession, d: str) -> DataFrame:
    return places.flag_duplicates(table(s, d, "places")).select("id", "duplicate")


@query("""with m as (select *, case category when 'gate' then 0 when 'exit' then 1 when 'elevator' then 2 else 3 end as priority from places),
c as (select *, row_number() over (partition by floor_id, floor(x/17.0e0), floor(z/17.0e0) order by priority, id) as k from m)
select id, priority from c where k = 1 order by priority, id limit 80""", "places")
def decluttered_markers(s: SparkSession, d: str) -> DataFrame:
    c = F.col("category")
    rank = F.when(c == "gate", 0).when(c == "exit", 1).when(c == "elevator", 2).otherwise(3)
    return places.declutter(table(s, d, "places"), rank, 2.0).select("id", "priority")


@query("""with t as (select distinct p_partkey as id, lower(trim(p_name)) as term from part), q as (select distinct substr(lower(unnest(string_split(p_name, ' '))), 1, 4) as query from part
union select distinct substr(lower(p_name), 1, 2) from part)
select distinct query, id from q join t on contains(term, query)""")
def place_search(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    q = words.select(F.substring("word", 1, 4).alias("query")).union(p.select(F.substring(F.lower("p_name"), 1, 2)))
    return places.search(places.search_terms(p, "p_name"), q.distinct())


@query("""with v as (select 'event_type' as field, case when event_id % 10 = 0 then null else event_type end as value from events union all select 'user_id', cast(user_id as varchar) from events),
c as (select field, value, count(*) as n from v group by all), w as (select field, sum(n)::bigint as rows, coalesce(sum(n) filter (value is null), 0)::bigint as nulls, count(value) as distinct_values from c group by field),
b as (select *, row_number() over (partition by field order by n desc, value) as k from c where value is not null)
select w.field, rows, nulls, cast(floor(nulls*1000000/rows + 0.5) as bigint) as null_ppm, distinct_values, value, n from w left join b using (field) where k is null or k <= 12 or distinct_values <= 50""")
def field_profile(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("event_type"), "user_id")
    return quality.field_profile(e, ["event_type", "user_id"])


ISSUES = """with e as (select case when l_linenumber = 7 then 'dup' else concat(l_orderkey,'-',l_linenumber) end as id, l_quantity as q, l_returnflag as f, l_tax as t from lineitem)
select id as source_id, 'distance-negative' as code from e where not (q > 1) union all select id, 'direction-unknown' from e where f not in ('A','N') union all
select id, 'tax-missing' from e where nullif(t, 0) is null union all select id, 'duplicate-id' from e group by id having count(*) > 1"""


@query(ISSUES)
def network_issues(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, "dup").otherwise(F.concat("l_orderkey", F.lit("-"), "l_linenumber")).alias("id"), "l_quantity", "l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    rules = {"distance-negative": F.col("l_quantity") > 1, "direction-unknown": F.col("l_returnflag").isin("A", "N"), "tax-missing": F.col("tax").isNotNull()}
    return quality.issues(e, "id", rules).unionByName(quality.repeated(e, "id"))


@query("""with a as (select floor_id as key, count(*) as n from nodes group by 1), b as (select floor_id as key, count(*) as n from places group by 1 union all select '9', count(*) from region)
select coalesce(a.key, b.key) as key, a.n as declared, b.n as computed, case when a.n is null then 'extra' when b.n is null then 'missing' else 'wrong' end as problem from a full join b on a.key=b.key where a.n is distinct from b.n""", "nodes", "places")
def reconciled_counts(s: SparkSession, d: str) -> DataFrame:
    count = lambda t: table(s, d, t).groupBy(F.col("floor_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    extra = table(s, d, "region").agg(F.count(F.lit(1)).alias("n")).select(F.lit("9").alias("key"), "n")
    return quality.reconcile(count("nodes"), count("places").unionByName(extra), "key", "n")


@query("""with w as (select p_partkey as id from part), g as (select p_partkey as id from part where p_partkey % 3 = 0 union all select p_partkey + 1000000000 from part where p_partkey % 50 = 0)
select id, 'missing' as side from w where id not in (select id from g) union all select id, 'unknown' from g where id not in (select id from w)""")
def translation_coverage(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "part").select(F.col("p_partkey").alias("id"))
    g = w.where(F.col("id") % 3 == 0).unionByName(w.where(F.col("id") % 50 == 0).select((F.col("id") + 1000000000).alias("id")))
    return quality.uncovered(w, g, "id")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Ten requests from classification to paths: request_id, status, node_ids, total_distance."""
    asked = routing.classify(table(s, d, "requests").where(F.col("request_id") < 40), _attached(s, d)).orderBy("request_id").limit(10)
    asked = graph.durable(asked.withColumn("profile", F.lit("shortest")))
    open_ = asked.where("status is null")
    a = graph.profile_arcs(_edges(s, d)).where("profile = 'shortest'")
    state = routing.shortest(a, open_.select("profile", F.col("start_node").alias("node_id")))
    found = routing.reconstruct(open_.select("profile", F.col("start_node").alias("source"), F.col("destination_node").alias("node")), state)
    found = found.select("profile", F.col("source").alias("start_node"), F.col("node").alias("destination_node"), "node_ids", F.col("distance_m").alias("total_distance"))
    out = asked.join(found, ["profile", "start_node", "destination_node"], "left")
    status = F.coalesce("status", F.when(F.col("node_ids").isNull(), "unreachable").otherwise("ok"))
    return out.select("request_id", status.alias("status"), "node_ids", "total_distance")
