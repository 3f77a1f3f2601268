"""Queries about imported and merged networks, segments, bounds, file names, and whole route plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..functions.scalars import millimetres as mm
from ..operators import graph, guidance, maps, markers, network, quality, routing, segments, spatial
from ..sources import files
from ..sources.derived import table
from .guidance import STEPS, _steps
from .maps import MARKERS, _candidates
from .registry import EDGE_CTE, MM, _edges, query

LAT0 = 35.6909

# Links drawn by three points in degrees: the ends and a point beside the middle; each second one runs backwards.
LINKS = """links as (select e.id, e.from_id, e.to_id, e.source_m, length(e.id) % 2 = 1 as back, a.x as ax, a.z as az, b.x as bx, b.z as bz
  from edges e join nodes a on e.from_id=a.id join nodes b on e.to_id=b.id)"""


def _links(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nodes")
    at = lambda end, k: n.select(F.col("id").alias(f"{end}_id"), F.col("x").alias(f"{k}x"), F.col("z").alias(f"{k}z"))
    e = table(s, d, "edges").join(at("from", "a"), "from_id").join(at("to", "b"), "to_id")
    degrees = lambda x, z: F.struct((x * 1e-5).alias("x"), (F.lit(LAT0) - z * 1e-5).alias("z"))
    a, b = degrees(F.col("ax"), F.col("az")), degrees(F.col("bx"), F.col("bz"))
    middle = degrees((F.col("ax") + F.col("bx")) / 2 + 3, (F.col("az") + F.col("bz")) / 2)
    line = F.array(a, middle, b)
    return e.select("id", "from_id", "to_id", "source_m", F.when(F.length("id") % 2 == 1, F.reverse(line)).otherwise(line).alias("points"))


def _local_nodes(s: SparkSession, d: str, keep: str) -> DataFrame:
    """Nodes in the metres that their degrees give, without those that keep excludes."""
    p = scalars.lonlat_to_local(F.col("x") * 1e-5, F.lit(LAT0) - F.col("z") * 1e-5, 0.0, LAT0, F.col("y"))
    return table(s, d, "nodes").where(keep).withColumn("p", p).withColumns({"x": F.col("p.x"), "z": F.col("p.z")}).drop("p")


KX = f"(radians(1e-5)*6378137.0*cos(radians({LAT0}e0)))"
KZ = "(radians(1e-5)*6378137.0)"
R = "floor(({})*1000+0.5)/1000"  # local coordinates are whole millimetres
IMPORT = f"""with {LINKS}, here as (select id, y, floor_id from nodes where cast(substr(id, 2) as bigint) % 7 <> 0),
i as (select l.*, a.y as ay, b.y as by_, a.floor_id as floor_from, b.floor_id as floor_to,
 case when a.id is null and b.id is null then 'both-ends-missing' when a.id is null or b.id is null then 'boundary' end as problem from links l left join here a on l.from_id=a.id left join here b on l.to_id=b.id),
c as (select *, {R.format(f"ax*{KX}")} as xa, {R.format(f"((ax+bx)/2+3)*{KX}")} as xm, {R.format(f"bx*{KX}")} as xb, {R.format(f"az*{KZ}")} as za, {R.format(f"(az+bz)/2*{KZ}")} as zm, {R.format(f"bz*{KZ}")} as zb from i),
m as (select *, case when problem is null then sqrt(pow(xm-xa,2)+pow((by_-ay)/2,2)+pow(zm-za,2)) + sqrt(pow(xb-xm,2)+pow((by_-ay)/2,2)+pow(zb-zm,2)) end as geometry_m from c)"""


def _imported(s: SparkSession, d: str) -> DataFrame:
    return network.import_links(_links(s, d), _local_nodes(s, d, "cast(substr(id, 2) as bigint) % 7 <> 0"), 0.0, LAT0)


@query(IMPORT + f" select id, floor_from, floor_to, cast(floor(geometry_m*100+0.37) as bigint) as geometry_cm, cast(floor(abs(source_m-geometry_m)*100+0.37) as bigint) as difference_cm, case when problem is null then back and (ax<>bx or az<>bz) end as reversed, cast(floor((ay+by_)/2*1000+0.5) as bigint) as middle_mm, problem from m", "nodes", "edges")
def network_import(s: SparkSession, d: str) -> DataFrame:
    """Links localised, turned to their start, measured and compared; each seventh node is missing."""
    i = _imported(s, d)
    near = lambda c: F.floor(F.col(c) * 100 + 0.37).cast("long")
    ok = F.col("problem").isNull()
    return i.select("id", "floor_from", "floor_to", near("geometry_m").alias("geometry_cm"), near("difference_m").alias("difference_cm"), F.when(ok, F.col("reversed")).alias("reversed"), F.when(ok, mm(F.col("points")[1]["y"])).alias("middle_mm"), "problem")


@query(IMPORT + " select problem, count(*) as links, cast(floor(max(abs(source_m-geometry_m))*100+0.37) as bigint) as max_difference_cm from m group by problem", "nodes", "edges")
def network_import_summary(s: SparkSession, d: str) -> DataFrame:
    return network.import_summary(_imported(s, d)).select("problem", "links", F.floor(F.col("max_difference_m") * 100 + 0.37).cast("long").alias("max_difference_cm"))


@query(EDGE_CTE + f""", v as (select 'review:' || p.id as id, p.id as from_id, n.id as to_id, p.floor_id, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) as m
  from places p join nodes n on n.id = 'P' || substr(p.id, 10) where p.category in ('gate', 'exit') and p.floor_id = n.floor_id)
select id, id as source_id, from_id, to_id, direction, kind, {MM.format('distance_m')} as distance_mm, accessibility, array_to_string(unknowns, ',') as unknowns, floor_from, floor_to from r
union all select id, 'reviewed:' || id, from_id, to_id, 'both', 'corridor', {MM.format('m')}, 'unknown', 'reviewed-custom-link', floor_id, floor_id from v""", "nodes", "edges", "places")
def merged_network(s: SparkSession, d: str) -> DataFrame:
    """The network and reviewed links from gates and exits to the node of the same number."""
    p = table(s, d, "places").where("category in ('gate', 'exit')")
    links = p.select(F.concat(F.lit("review:"), "id").alias("id"), F.col("id").alias("from_id"), F.concat(F.lit("P"), F.substring("id", 10, 20)).alias("to_id"))
    _, e = network.merged(table(s, d, "nodes"), _edges(s, d), p.select("id", "floor_id", "x", "y", "z"), links)
    return e.select("id", "source_id", "from_id", "to_id", "direction", "kind", mm(F.col("distance_m")).alias("distance_mm"), "accessibility", F.array_join("unknowns", ",").alias("unknowns"), "floor_from", "floor_to")


# The corners of a feature's L, closed; facilities are points.
CORNERS = """q as (select id, layer, floor_id, x, y, z, w, unnest([0,1,2,3,4,5,6]) as k from features where layer <> 'Facility'),
c as (select id, layer, floor_id, k, x + w*(case k when 0 then 0 when 1 then 2 when 2 then 2 when 3 then 1 when 4 then 1 else 0 end) as cx, y as cy, z + w*(case k when 0 then 0 when 1 then 0 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 2 else 0 end) as cz from q)"""


def _features(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "features")
    at = lambda i, j: F.struct((F.col("x") + F.col("w") * i).alias("x"), F.col("y").alias("y"), (F.col("z") + F.col("w") * j).alias("z"))
    ring = F.array(at(0, 0), at(2, 0), at(2, 1), at(1, 1), at(1, 2), at(0, 2), at(0, 0))
    return f.withColumn("parts", F.when(F.col("layer") != "Facility", F.array(ring))).withColumn("source_floor", F.when(F.col("source_record") % 3 == 0, F.concat("floor_id", F.lit("OUT"))).otherwise(F.col("floor_id")))


def _ends(seg: DataFrame) -> list:
    return [mm(F.col(f"{p}.{c}")).alias(f"{p}{c}_mm") for p in "ab" for c in "xyz"]


SEGMENTS = CORNERS + """, s as (select c.id, c.layer, coalesce(c.floor_id, 'B1') as shown, c.k as seg, c.cx as ax, c.cy as ay, c.cz as az, e.cx as bx, e.cy as by_, e.cz as bz from c join c e on c.id=e.id and e.k=c.k+1)"""
AB = ", ".join(f"cast(floor({v}*1000+0.5) as bigint) as {n}_mm" for v, n in (("ax", "ax"), ("ay", "ay"), ("az", "az"), ("bx", "bx"), ("by_", "by"), ("bz", "bz")))
AB_STACKED = ", ".join(f"cast(floor({v}*1000+0.5) as bigint) as {n}_mm" for v, n in (("ax", "ax"), ("ay*6", "ay"), ("az", "az"), ("bx", "bx"), ("by_*6", "by"), ("bz", "bz")))


@query(f"with {SEGMENTS} select id, layer, seg::int as seg, {AB_STACKED} from s where layer in ('Space', 'Floor') and shown in ('B1', '0')", "features")
def feature_segments(s: SparkSession, d: str) -> DataFrame:
    seg = segments.feature_segments(_features(s, d), ["Space", "Floor"], ["B1", "0"], stacked=True)
    return seg.select("id", "layer", "seg", *_ends(seg))


@query(f"with {SEGMENTS} select s.id, s.seg::int as seg, {AB} from s join features f using (id) where f.source_record % 3 = 0 and f.floor_id is not null and shown in ('1', '2')", "features")
def outdoor_segments(s: SparkSession, d: str) -> DataFrame:
    seg = segments.feature_segments(segments.outdoor(_features(s, d)), ["Floor", "Space", "Fixture"], ["1", "2"])
    return seg.select("id", "seg", *_ends(seg))


@query(f"with {SEGMENTS} select s.id, s.seg::int as seg, {AB} from s join features f using (id) where f.layer='Space' and upper(trim(f.category)) between 'B010' and 'B019' and shown in ('B1', '0', '1')", "features")
def emphasised_segments(s: SparkSession, d: str) -> DataFrame:
    styles = s.createDataFrame([(f"B{k:03d}", "strong" if 10 <= k < 20 else "quiet") for k in range(1, 51)], "code string, emphasis string")
    seg = segments.feature_segments(segments.emphasised(_features(s, d), styles, "strong"), ["Space"], ["B1", "0", "1"])
    return seg.select("id", "seg", *_ends(seg))


NET = """with n as (select * from nodes where floor_id in ('B1', '0', '1')), s as (select e.id, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz,
 case when 'outside' in (a.in_out, b.in_out) then 'outside' when 'boundary' in (a.in_out, b.in_out) then 'boundary' else 'inside' end as context, e.kind from edges e join n a on e.from_id=a.id join n b on e.to_id=b.id)"""


@query(NET + f" select id, context, {AB} from s", "nodes", "edges")
def network_segments(s: SparkSession, d: str) -> DataFrame:
    seg = segments.network_segments(table(s, d, "edges"), table(s, d, "nodes"), ["B1", "0", "1"])
    return seg.select("id", "context", *_ends(seg))


@query(NET + f" select id, {AB_STACKED} from s where id in (select id from edges where kind = 'elevator')", "nodes", "edges")
def highlighted_segments(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "edges")
    seg = segments.highlighted(segments.network_segments(e, table(s, d, "nodes"), ["B1", "0", "1"], stacked=True), e.where("kind = 'elevator'"))
    return seg.select("id", *_ends(seg))


@query("with s as (select request_id, pos, x0 as ax, y0+0.4e0 as ay, z0 as az, x1 as bx, y1+0.4e0 as by_, z1 as bz from walks) select request_id, (row_number() over (partition by request_id order by pos) - 1)::int as seg, " + AB + " from s", "walks")
def route_segments(s: SparkSession, d: str) -> DataFrame:
    lines = guidance.route_lines(table(s, d, "walks")).select("request_id", F.array("points").alias("lines"))
    seg = segments.exploded(lines, "lines", "request_id", lift=0.4)
    return seg.select("request_id", "seg", *_ends(seg))


SIDES = [f"{side}_{c}" for side in ("min", "max") for c in "xyz"]
POINTS = CORNERS + ", p as (select id, floor_id, cx as x, cy as y, cz as z from c union all select id, floor_id, x, y, z from features where layer='Facility')"
BOX = ", ".join(f"{a}({c}) as {a}_{c}" for a in ("min", "max") for c in "xyz")


@query(f"""with {POINTS} select 'some' as floors, {BOX} from p where coalesce(floor_id, 'B1') in ('B1', '0') union all select 'none', {BOX} from nodes""", "features", "nodes")
def floor_set_bounds(s: SparkSession, d: str) -> DataFrame:
    """Bounds of two floors, and of a floor without features: the network's."""
    f, whole = _features(s, d), spatial.bounds(table(s, d, "nodes"))
    some, none = (segments.bounds_of_floors(f, floors, whole).withColumn("floors", F.lit(k)) for k, floors in (("some", ["B1", "0"]), ("none", ["9"])))
    return some.unionByName(none).select("floors", *SIDES)


ENDS = "w as (select request_id, part, x0 as x, y0 as y, z0 as z from i union all select request_id, part, x1, y1, z1 from i)"
PADDED = "min(x)-{0} as min_x, min(y) as min_y, min(z)-{0} as min_z, max(x)+{0} as max_x, max(y) as max_y, max(z)+{0} as max_z"


@query("with w as (select request_id, x0 as x, y0 as y, z0 as z from walks union all select request_id, x1, y1, z1 from walks) select request_id, " + PADDED.format("18.0e0") + " from w group by request_id", "walks")
def route_bounds(s: SparkSession, d: str) -> DataFrame:
    return segments.route_bounds(table(s, d, "walks")).select("request_id", *SIDES)


@query(STEPS + f", n as (select request_id, part, row_number() over (partition by request_id order by part) as step_no from s), {ENDS} select n.request_id, n.step_no, {PADDED.format('10.0e0')} from n join w using (request_id, part) group by all", "walks", "ends")
def step_bounds(s: SparkSession, d: str) -> DataFrame:
    b = segments.step_bounds(_steps(s, d), table(s, d, "walks"))
    return b.select("request_id", F.col("step_no").cast("long").alias("step_no"), *SIDES)


@query("select -(min(x)+max(x))/2 as x, 0.0e0 as y, -(min(z)+max(z))/2 as z from nodes", "nodes")
def scene_centre(s: SparkSession, d: str) -> DataFrame:
    return segments.centre(spatial.bounds(table(s, d, "nodes")))


@query("""select id, cast(floor((x + case layer when 'Fixture' then w when 'Floor' then w*0.28125e0 when 'Space' then w*5/6 else 0 end)*1000+0.6) as bigint) as x_mm,
cast(floor((z + case layer when 'Fixture' then 0 when 'Floor' then w*0.28125e0 when 'Space' then w*5/6 else 0 end)*1000+0.6) as bigint) as z_mm from features""", "features")
def representative_points(s: SparkSession, d: str) -> DataFrame:
    """Facilities are points, fixtures lines, spaces an L, floors a square with a square hole around its middle."""
    f = _features(s, d).repartition(64, "id")  # few bytes a polygon, but a grid of work
    at = lambda i, j: F.struct((F.col("x") + F.col("w") * i).alias("x"), F.col("y").alias("y"), (F.col("z") + F.col("w") * j).alias("z"))
    square = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b), at(a, a))
    kind = F.when(F.col("layer") == "Facility", "Point").when(F.col("layer") == "Fixture", "PolyLine").otherwise("Polygon")
    points = F.when(kind == "PolyLine", F.array(at(0, 0), at(2, 0))).otherwise(F.array(at(0, 0)))
    rings = F.when(F.col("layer") == "Floor", F.array(square(0.5, 1.5), square(0, 2))).otherwise(F.col("parts"))
    p = geometry.representative_point(kind, points, rings)
    return f.select("id", p.alias("p")).select("id", *[F.floor(F.col(f"p.{c}") * 1000 + 0.6).cast("long").alias(f"{c}_mm") for c in "xz"])


@query(MARKERS + " select 'facility-marker:' || q.id as id, p.id as place_id from q join p on p.id = 'facility:' || q.id and p.floor_id = q.floor_id where p.d <= 15", "nodes", "features")
def marker_places(s: SparkSession, d: str) -> DataFrame:
    c = _candidates(s, d)
    p = markers.promoted(c).select("id", F.substring("id", 10, 40).alias("source_id"), "floor_id", (F.col("distance_m") <= 15).alias("routable"))
    return markers.routable_places(c.select(F.concat(F.lit("facility-marker:"), "id").alias("id"), F.col("id").alias("source_id"), "floor_id"), p)


@query("""with v as (select layer || '.category' as field, category as value from features where layer in ('Space', 'Facility') union all select layer || '.name', name from features where layer in ('Space', 'Facility')),
c as (select field, value, count(*) as n from v group by all), w as (select field, sum(n)::bigint as rows, coalesce(sum(n) filter (value is null), 0)::bigint as nulls, count(value) as distinct_values from c group by field),
b as (select *, row_number() over (partition by field order by n desc, value) as k from c where value is not null)
select split_part(w.field, '.', 1) as layer, split_part(w.field, '.', 2) as field, rows, nulls, cast(floor(nulls*1000000/rows + 0.5) as bigint) as null_ppm, distinct_values, value, n from w left join b using (field) where k is null or k <= 12 or distinct_values <= 50""", "features")
def layer_profile(s: SparkSession, d: str) -> DataFrame:
    return quality.layer_profile(table(s, d, "features"), ["Space", "Facility"], ["category", "name"])


@query("select place_id as id, 'missing' as side from reviewed where substr(place_id, 7) not in (select source_id from openings where layer='Opening') group by place_id", "openings", "reviewed", )
def gate_provenance(s: SparkSession, d: str) -> DataFrame:
    """Reviewed gates whose opening the sources don't have."""
    gates = table(s, d, "reviewed").select(F.substring("place_id", 7, 40).alias("source_id"), "place_id")
    lost = gates.join(table(s, d, "openings").where("layer = 'Opening'").select("source_id"), "source_id", "left_anti")
    return lost.select(F.col("place_id").alias("id"), F.lit("missing").alias("side")).distinct()


@query("""with f as (select p_partkey as id, case p_size % 3 when 0 then '-1' when 1 then '2OUT' else 'b3' end as fl, case p_partkey % 2 when 0 then 'Space' else 'Opening' end as layer, p_brand from part)
select id, 'data/' || p_brand || '/' || p_brand || '_' || fl || '_' || layer || '.shp' as path, p_brand as facility, case fl when '-1' then 'B1' when '2OUT' then '2out' else 'B3' end as floor, layer from f""")
def path_parts(s: SparkSession, d: str) -> DataFrame:
    """Facility, floor and layer from the paths of a release, written in the manner of another system."""
    p = table(s, d, "part")
    floor = F.when(F.col("p_size") % 3 == 0, "-1").when(F.col("p_size") % 3 == 1, "2OUT").otherwise("b3")
    raw = F.concat(F.lit(".\\data\\"), "p_brand", F.lit("\\"), "p_brand", F.lit("_"), floor, F.lit("_"), F.when(F.col("p_partkey") % 2 == 0, "Space").otherwise("Opening"), F.lit(".shp"))
    p = p.select(F.col("p_partkey").alias("id"), files.portable_path(raw).alias("path"), files.path_parts(raw).alias("p"))
    return p.select("id", "path", "p.*")


@query("select p_partkey as id, 'brand=' || p_brand || ';name=' || p_name || ';size=' || p_size as properties from part")
def sorted_properties(s: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    each = F.transform(F.map_entries(scalars.sorted_properties(m)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(each, ";").alias("properties"))


@query("""with n as (select p_partkey as id, case p_partkey % 2 when 0 then p_name else upper(substr(p_name, 1, 1)) || substr(p_name, 2) end as name, p_partkey % 2 as big, p_name from part)
select id, row_number() over (order by p_name, big, id) as place from n""")
def display_order(s: SparkSession, d: str) -> DataFrame:
    """Names in the order people expect: letters before case, whatever their code points."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")))
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.collate(name, "UNICODE").alias("name"))
    return graph.ranked(p, [F.col("name"), F.col("id")]).select("id", F.col("nth").alias("place"))


@query("""with p as (select id, case when cast(substr(id, 10) as bigint) % 3 = 0 then 'unknown' else 'yes' end as a from places)
select r.request_id, concat_ws(',', case when a.a='unknown' then a.id end, case when b.a='unknown' then b.id end) as place_ids from requests r left join p a on r.start_id=a.id left join p b on r.destination_id=b.id
where r.profile='accessible' and r.start_id<>r.destination_id and (a.a='unknown' or b.a='unknown')""", "places", "requests")
def access_warnings(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "places").select("id", F.when(F.substring("id", 10, 20).cast("long") % 3 == 0, "unknown").otherwise("yes").alias("accessibility"))
    asked = table(s, d, "requests").withColumn("status", F.lit("ok"))  # trip_access_warnings asks for found ways alone
    return guidance.access_unverified(asked, p).select("request_id", F.array_join("place_ids", ",").alias("place_ids"))


def planned(s: SparkSession, d: str) -> DataFrame:
    near = spatial.nearest_node(table(s, d, "places").select("id", "floor_id", "x", "z"), table(s, d, "nodes"))
    p = graph.stored(near.select("id", "node_id", "distance_m", (F.coalesce("distance_m", F.lit(1e9)) <= 15).alias("routable")))
    edges = graph.stored(_edges(s, d))
    return routing.plans(table(s, d, "requests"), p, graph.stored(graph.profile_arcs(edges)), parts=graph.components(edges))


@query()
def route_plans(s: SparkSession, d: str) -> DataFrame:
    """Every request from its places to a way: status, nodes, edges and lengths (tests compare with Dijkstra's method)."""
    return planned(s, d)


def walked(s: SparkSession, d: str, plans: DataFrame) -> DataFrame:
    """The arcs of found ways in walking order, with the places of their ends."""
    n = table(s, d, "nodes")
    at = lambda end, i: n.select(F.col("id").alias(f"{end}_id"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
    a = graph.arcs(_edges(s, d)).select("id", "from_id", "to_id", "kind", "floor_from", "floor_to", "distance_m", "unknowns")
    w = network.resolved(plans.where("status = 'ok'").select("request_id", "node_ids", "edge_ids"), a)
    return w.join(at("from", 0), "from_id").join(at("to", 1), "to_id")


@query()
def route_paths(s: SparkSession, d: str) -> DataFrame:
    """The steps of every found way."""
    plans = graph.stored(planned(s, d).where("status = 'ok'"))
    f = table(s, d, "places")
    side = lambda k: f.select(F.col("id").alias(f"{k}_id"), F.col("floor_id").alias(f"{k}_floor"))
    ends = plans.where("status = 'ok'").join(side("start"), "start_id").join(side("destination"), "destination_id")
    ends = ends.select("request_id", "start_floor", "start_m", "destination_floor", "destination_m")
    return guidance.steps(walked(s, d, plans), ends)
