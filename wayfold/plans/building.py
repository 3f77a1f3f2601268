"""Queries about places and networks that layers give, their rules, and the texts that people read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories, scalars, texts
from ..functions.scalars import millimetres as mm
from ..operators import building, graph, guidance, places, quality, routing, rules
from ..sources.derived import ctes, table
from .guidance import STEPS, _steps
from .registry import COMPONENTS, EDGE_CTE, MM, NEAREST, _attached, _edges, query


def _quoted(v) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'"


KNOWN = "cat(layer, code, name_ja, name_en, role, grp, shape) as (values " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in categories.category_rows()) + """),
given as (select id, layer, case when layer='Fixture' then replace(category, 'B', 'C') else category end as category from features),
g as (select f.*, upper(trim(category)) as code from given f)"""


def _given(s: SparkSession, d: str) -> DataFrame:
    """Features whose fixtures have fixture codes."""
    return table(s, d, "features").select("id", "layer", F.when(F.col("layer") == "Fixture", F.regexp_replace("category", "B", "C")).otherwise(F.col("category")).alias("category"))


@query(f"with {KNOWN} select g.id, g.layer, g.code, coalesce(name_ja, '不明なカテゴリー') as name_ja, coalesce(name_en, 'Unknown category') as name_en, coalesce(role, 'unknown') as role, coalesce(grp, 'unknown') as visual, role is not null as known from g left join cat using (layer, code)", "features")
def resolved_categories(s: SparkSession, d: str) -> DataFrame:
    return building.resolved(_given(s, d)).select("id", "layer", "code", "name_ja", "name_en", "role", F.col("group").alias("visual"), "known")


@query(f"""with {KNOWN} select layer, case when layer='Space' then coalesce(grp, 'unknown') when code='C002' then 'bench' when code='C012' then 'locker' when code='C013' then 'vending-machine' when code='C014' then 'atm' when code='C101' then 'platform-gate' when code='C104' then 'ticket-gate'
 when grp='furniture' then case when shape='low-solid' then 'furniture-low' else 'furniture-solid' end when grp='barrier' then case shape when 'thin-barrier' then 'barrier-thin' when 'low-solid' then 'barrier-low' else 'barrier-solid' end
 when grp in ('column','wall','fixture') then grp else 'unknown' end as style, count(*) as n from g left join cat using (layer, code) where layer in ('Space','Fixture') group by all""", "features")
def drawing_styles(s: SparkSession, d: str) -> DataFrame:
    return building.drawn_as(_given(s, d))


@query("""with r as (select concat('o', l_orderkey, '-', l_partkey % 3) as base_id, l_linenumber as record from lineitem), f as (select base_id, min(record) as first from r group by 1),
n as (select base_id, record, case when record=first then base_id else concat(base_id, ':', record) end as id from r join f using (base_id))
select base_id, record::bigint as record, id, count(*) over (partition by id) > 1 as clash from n""")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey", F.lit("-"), F.col("l_partkey") % 3).alias("base_id"), F.col("l_linenumber").cast("long").alias("record"))
    return building.stable_ids(r, record="record")


PLACES = """lf as (select *, trim(name) as nm from openings where trim(name) <> '' and name <> '不明'),
lg as (select *, case when layer='Opening' then 'gate' when nm like '%トイレ%' then 'toilet' when regexp_matches(nm, '(?i)^(EV[_-]|エレベーター)') then 'elevator' when regexp_matches(nm, '(?i)^(ESC[_-]|エスカレーター)') then 'escalator' end as cat from lf),
lh as (select concat(cat, ':', source_id) as id, area, nm as name, cat as category, floor_id, x, y, z from lg where cat is not null),
lp as (select h.id, n.id as node_id, sqrt((h.x-n.x)*(h.x-n.x)+(h.z-n.z)*(h.z-n.z)) as d from lh h join nodes n on h.floor_id=n.floor_id),
ln as (select id, arg_min(node_id, (d, node_id)) as node_id, min(d) as d from lp group by id),
lr as (select h.*, r.id as given, r.floor_id as given_floor, coalesce(r.id, ln.node_id) as node_id, case when r.id is not null then sqrt((h.x-r.x)*(h.x-r.x)+(h.y-r.y)*(h.y-r.y)+(h.z-r.z)*(h.z-r.z)) else ln.d end as d
 from lh h left join ln on h.id=ln.id left join (select * from reviewed where role='gate') r on r.place_id=h.id),
pl as (select *, given is not null as reviewed, case when given is not null or d <= 5 then 'high' when d <= 15 then 'medium' else 'low' end as confidence, case when given is not null and given_floor <> floor_id then 'floor-mismatch' when node_id is null then 'no-node' end as problem from lr)"""
_PLACES = ("nodes", "openings", "reviewed")


def _places(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "reviewed").where("role = 'gate'")
    return building.named_places(table(s, d, "openings"), table(s, d, "nodes"), r, r.select("place_id", F.col("id").alias("node_id")))


@query(f"with {PLACES} select id, name, category, floor_id, node_id, {MM.format('d')} as distance_mm, confidence, reviewed, problem is null and confidence <> 'low' as routable, problem from pl", *_PLACES)
def named_places(s: SparkSession, d: str) -> DataFrame:
    return _places(s, d).select("id", "name", "category", "floor_id", "node_id", mm(F.col("distance_m")).alias("distance_mm"), "confidence", "reviewed", "routable", "problem")


@query(EDGE_CTE + """, e as (select id, from_id, to_id from r where kind='elevator' and floor_from<>floor_to order by id limit 1), q as (select e.id as source_id, min(n.id) as node_id from e left join nodes n on n.floor_id='0' and n.id in (e.from_id, e.to_id) group by 1)
select concat('connector:', source_id, ':0') as id, source_id, node_id, case when node_id is null then 'no-ground-end' end as problem from q""", "nodes", "edges")
def connector_place(s: SparkSession, d: str) -> DataFrame:
    return building.connector(_edges(s, d), table(s, d, "nodes")).select("id", "source_id", "node_id", "problem")


@query(f"with recursive {ctes('nodes', 'edges')}, " + COMPONENTS[len("with recursive ") :] + ", a as (select n.id, coalesce(root, n.id) as root from nodes n left join c using (id)), k as (select root, row_number() over (order by root) - 1 as component_id from (select distinct root from a)) select id, component_id from a join k using (root)")
def component_numbers(s: SparkSession, d: str) -> DataFrame:
    return graph.component_numbers(table(s, d, "nodes"), table(s, d, "edges"))


@query("""with n as (select id, x, y, z from nodes where cast(substr(id, 2) as bigint) % 7 <> 0),
j as (select e.id, source_m, floor_id, a.id as a, b.id as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as m from (select e.*, f.floor_id from edges e join nodes f on e.from_id=f.id) e left join n a on e.from_id=a.id left join n b on e.to_id=b.id),
k as (select *, case when source_m > 90 then 'malformed-geometry' when a is null and b is null then 'missing-both-nodes' when a is null then 'missing-start-node' when b is null then 'missing-end-node' end as reason from j)
select concat('station:', floor_id, ':', id) as id, reason, case when reason is null then """ + MM.format("m") + " end as distance_mm from k", "nodes", "edges")
def tactile_edges(s: SparkSession, d: str) -> DataFrame:
    """Guidance lines between the nodes of one area; lines with a far source distance have lost their geometry."""
    at = table(s, d, "nodes")
    points = at.where(F.substring("id", 2, 20).cast("long") % 7 != 0).select(F.col("id").alias("source_id"), F.lit("station").alias("area"), F.lit(None).cast("string").alias("source_floor"), "floor_id", F.col("facility_id").alias("name"), F.lit("5").alias("category"), "x", "y", "z")
    end = lambda e: at.select(F.col("id").alias(f"{e}_id"), F.struct("x", "y", "z").alias(e), F.col("floor_id").alias(f"{e}_floor"))
    line = F.when(F.col("source_m") > 90, F.array("from")).otherwise(F.array("from", "to"))
    lines = table(s, d, "edges").join(end("from"), "from_id").join(end("to"), "to_id")
    lines = lines.select(F.col("id").alias("source_id"), F.lit("station").alias("area"), F.col("from_floor").alias("source_floor"), F.col("from_floor").alias("floor_id"), F.col("from_id").alias("start"), F.col("to_id").alias("end"), line.alias("points"))
    # ids are qualified by area and floor of a line; the points' own floors aren't part of theirs here
    nodes = building.tactile_nodes(points)
    floors = lines.select("source_floor", F.explode(F.array("start", "end")).alias("id")).distinct()
    nodes = floors.join(nodes, "id").withColumn("id", building.qualified(F.col("id"), F.lit("station"), F.col("source_floor")))
    return building.tactile_edges(lines, nodes).select("id", "reason", mm(F.col("distance_m")).alias("distance_mm"))


@query("""with p as (select p.*, w from openings p join (select source_record, w from features) f using (source_record)),
f as (select case when source_record % 50 = 0 then 'twice' else source_id end as id, case when source_record % 31 = 0 then 'Roof' when source_record % 3 = 0 then 'Facility' else layer end as layer, case when source_record % 29 = 0 then 'Mesh' when source_record % 3 = 0 and source_record % 5 <> 0 then 'Point' when source_record % 2 = 0 then 'PolyLine' else 'Polygon' end as gtype,
 case when source_record % 37 = 0 then 1 when source_record % 3 = 0 and source_record % 5 <> 0 then 1 when source_record % 7 = 0 then 2 else 4 end as n, case when source_record % 11 = 0 then '' else area end as area, source_record from p)
select id as source_id, 'record-not-positive' as code from f where source_record < 1 union all select id, 'layer-unknown' from f where layer='Roof' union all select id, 'geometry-unknown' from f where gtype='Mesh'
union all select id, 'part-too-short' from f where n < case gtype when 'Polygon' then 3 when 'PolyLine' then 2 else 1 end union all select id, 'facility-not-a-point' from f where layer='Facility' and gtype<>'Point'
union all select id, 'facility-without-area' from f where layer='Facility' and area='' union all select id, 'duplicate-id' from f group by id having count(*) > 1""", "openings", "features")
def feature_issues(s: SparkSession, d: str) -> DataFrame:
    """Features with repeated ids, unknown layers and geometries, short parts and facilities that are no points."""
    k = F.col("source_record")
    o = table(s, d, "openings")
    point = (k % 3 == 0) & (k % 5 != 0)
    size = F.when(k % 37 == 0, 1).when(point, 1).when(k % 7 == 0, 2).otherwise(4)
    part = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct((F.col("x") + i).alias("x"), "y", "z"))
    f = o.select(
        F.when(k % 50 == 0, "twice").otherwise(F.col("source_id")).alias("id"),
        "source_record",
        F.when(k % 31 == 0, "Roof").when(k % 3 == 0, "Facility").otherwise(F.col("layer")).alias("layer"),
        F.when(k % 29 == 0, "Mesh").when(point, "Point").when(k % 2 == 0, "PolyLine").otherwise("Polygon").alias("gtype"),
        F.array(part).alias("parts"),
        F.lit("F001").alias("category"),
        F.when(k % 11 == 0, "").otherwise(F.col("area")).alias("area"),
        F.col("floor_id").alias("source_floor"),
    )
    return rules.feature_issues(f)


@query(f"""with {PLACES}, q as (select id, category, pl.floor_id, d + case when cast(substr(id, strpos(id, ':o') + 2) as bigint) % 8 = 0 then 1 else 0 end as m, d, confidence, reviewed, n.floor_id as nf from pl left join (select id as nid, floor_id from nodes where cast(substr(id, 2) as bigint) % 7 <> 0 union all select id, floor_id from reviewed) n on n.nid=pl.node_id)
select id as source_id, 'node-missing' as code from q where nf is null union all select id, 'floor-mismatch' from q where nf <> floor_id union all select id, 'low-but-routable' from q where confidence='low' and not reviewed
union all select id, 'distance-mismatch' from q where nf is not null and m > d""", *_PLACES)
def place_issues(s: SparkSession, d: str) -> DataFrame:
    """Places that all claim to be routable, some with another distance, on a network without each seventh node."""
    p = _places(s, d).withColumn("routable", F.lit(True))
    p = p.withColumn("distance_m", F.col("distance_m") + F.when(F.regexp_extract("id", ":o(.*)", 1).cast("long") % 8 == 0, 1.0).otherwise(0.0))
    cols = ["id", "floor_id", "x", "y", "z"]
    n = table(s, d, "nodes").where(F.substring("id", 2, 20).cast("long") % 7 != 0).select(*cols)
    return rules.place_issues(p, n.unionByName(table(s, d, "reviewed").select(*cols)))


@query("""with n as (select case when cast(substr(id, 2) as bigint) % 9 = 0 then 'P' || substr(id, 2) else id end as id, place_id, case when role='turn' then 'door' else role end as role, floor_id, x, y, z from reviewed),
o as (select id, floor_id, x, y, z from nodes), v as (select id, floor_id, x, y, z from n where id like 'R%' union all select * from o),
oe as (select from_id, min(id) as oid from edges group by all),
e as (select coalesce(case when cast(substr(n.id, 2) as bigint) % 7 = 2 then oid end, concat('review:', n.id)) as id, n.id as from_id, concat('P', substr(n.id, 2)) as to_id, cast(substr(n.id, 2) as bigint) as k from n left join oe on oe.from_id = concat('S', substr(n.id, 2))),
j as (select e.*, a.floor_id as af, b.floor_id as bf from e left join v a on e.from_id=a.id left join v b on e.to_id=b.id), a as (select case when cast(substr(id, 2) as bigint) % 5 = 0 then 'gate:x' else place_id end as place_id, id as node_id, role from n)
select id as source_id, 'node-id-taken' as code from n where id in (select id from o) union all select id, 'role-unknown' from n where role='door' union all select id, 'floor-unknown' from n where floor_id='2'
union all select id, 'end-missing' from j where af is null or bf is null union all select id, 'leaves-floor' from j where af<>bf union all select id, 'not-both-ways' from j where k % 4 = 1 union all select id, 'accessibility-claimed' from j where k % 3 = 0
union all select id, 'distance-not-positive' from j where k % 10 = 3 union all select id, 'distance-mismatch' from j where k % 10 = 3 and af is not null and bf is not null
union all select place_id, 'not-a-gate' from a where role<>'gate' union all select place_id, 'place-attached-twice' from a group by place_id having count(*) > 1
union all select id, 'edge-id-taken' from e where id not like 'review:%' union all select id, 'not-two-points' from j where k % 10 = 7
union all select id, 'ends-mismatch' from j where k % 10 in (5, 7) and af is not null and bf is not null""", "nodes", "edges", "reviewed")
def reviewed_network_issues(s: SparkSession, d: str) -> DataFrame:
    """A reviewed network with taken ids, unknown roles, one-way edges, claims, wrong distances and lines."""
    o = table(s, d, "nodes")
    k = F.substring("id", 2, 20).cast("long")
    n = table(s, d, "reviewed").withColumn("k", k).withColumn("id", F.when(F.col("k") % 9 == 0, F.concat(F.lit("P"), F.substring("id", 2, 20))).otherwise(F.col("id"))).withColumn("role", F.when(F.col("role") == "turn", "door").otherwise(F.col("role")))
    own = n.where("id like 'R%'")
    at = lambda end: own.select("id", "x", "y", "z").unionByName(o.select("id", "x", "y", "z")).select(F.col("id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in "xyz"])
    official_edges = table(s, d, "edges")
    known = official_edges.groupBy("from_id").agg(F.min("id").alias("oid"))
    e = n.withColumn("number", F.substring("id", 2, 20)).join(known.select(F.substring("from_id", 2, 20).alias("number"), "oid"), "number", "left")
    e = e.select(F.coalesce(F.when(F.col("k") % 7 == 2, F.col("oid")), F.concat(F.lit("review:"), "id")).alias("id"), F.col("id").alias("from_id"), F.concat(F.lit("P"), "number").alias("to_id"), "k")
    e = e.join(at("from"), "from_id", "left").join(at("to"), "to_id", "left")
    m = F.sqrt(sum(((F.col(f"from_{c}") - F.col(f"to_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    m = F.when(F.col("k") % 10 == 3, -1.0).otherwise(F.greatest(F.coalesce(m, F.lit(1.0)), F.lit(1e-6)))
    first = F.struct((F.col("from_x") + F.when(F.col("k") % 10 == 5, 1.0).otherwise(0.0)).alias("x"), F.col("from_y").alias("y"), F.col("from_z").alias("z"))
    line = F.array(first, F.struct(*[F.col(f"to_{c}").alias(c) for c in "xyz"]))
    line = F.when(F.col("k") % 10 == 7, F.slice(line, 1, 1)).otherwise(line)
    e = e.select("id", "from_id", "to_id", F.when(F.col("k") % 4 == 1, "forward").otherwise("both").alias("direction"), F.lit("gate").alias("kind"), F.when(F.col("k") % 3 == 0, "yes").otherwise("unknown").alias("accessibility"), m.alias("distance_m"), line.alias("points"))
    a = n.select(F.when(F.col("k") % 5 == 0, "gate:x").otherwise(F.col("place_id")).alias("place_id"), F.col("id").alias("node_id"))
    official = o.select("id", "floor_id", "x", "y", "z")
    found = rules.reviewed_node_issues(n, official, ["B2", "B1", "0", "1"]).unionByName(rules.attachment_issues(n, a))
    return found.unionByName(rules.reviewed_edge_issues(own, e, official, official_edges))  # a taken id stands for its official node


@query("with n as (select id, row_number() over (order by id) - 1 as at, count(*) over () as of_ from nodes), q as (select unnest(range(40)) as pair), p as (select unnest(['shortest','accessible','avoid-stairs','prefer-elevator','fewest-floor-changes']) as profile) select pair::bigint as pair, profile, a.id as start_id, b.id as goal_id from q, p, n a, n b where a.at = (pair*17) % a.of_ and b.at = (pair*43+29) % b.of_", "nodes")
def request_workload(s: SparkSession, d: str) -> DataFrame:
    w = building.workload(table(s, d, "nodes"), graph.PROFILES)
    return w.withColumn("pair", F.col("pair").cast("long"))


def _sql_floor(c: str, locale: str) -> str:
    if locale == "en":
        return f"case {c} when '0' then 'Ground' else {c} end"
    return f"case {c} when '0' then '地上階' when 'B1' then '地下1階' when 'B2' then '地下2階' else {c} || '階' end"


def _sql_decimal(m: str) -> str:
    return f"format('{{:.1f}}', case when {m} % 1 = 0.25 then {m} + 0.04 else {m} end)"


def _sql_instruction(locale: str) -> str:
    m = f"(case when distance_m < 10 then {_sql_decimal('distance_m')} else cast(cast(floor(distance_m+0.5) as bigint) as varchar) end || ' m')"
    moves = texts.MOVEMENT_NAMES[locale]
    move = "case movement " + " ".join(f"when '{k}' then '{v}'" for k, v in moves.items() if k) + f" else '{moves[None]}' end"

    def t(key: str) -> str:
        out = _quoted(texts.MESSAGES[locale][key])
        for name, v in {"movement": move, "fromFloor": _sql_floor("floor_from", locale), "toFloor": _sql_floor("floor_to", locale), "place": "spot", "distance": m, "floor": _sql_floor("floor_from", locale)}.items():
            out = f"replace({out}, '{{{name}}}', {v})"
        return out

    return "case kind " + " ".join(f"when '{k}' then {t(k)}" for k in ("access", "transition", "turn-left", "turn-right", "continue")) + f" else case when distance_m > 0 then {t('arrive-access')} else {t('arrive')} end end"


@query(STEPS + f""", n as (select request_id, row_number() over (partition by request_id order by part) as step_no, kind, distance_m, floor_from, floor_to, movement, concat(case kind when 'access' then 'Stop ' else 'Hall ' end, request_id % 100) as spot from s)
select request_id, step_no, {_sql_instruction('en')} as en, {_sql_instruction('ja')} as ja from n""", "walks", "ends")
def route_instructions(s: SparkSession, d: str) -> DataFrame:
    number = (F.col("request_id") % 100).cast("string")
    start, end = F.concat(F.lit("Stop "), number), F.concat(F.lit("Hall "), number)
    return _steps(s, d).select("request_id", F.col("step_no").cast("long").alias("step_no"), *[texts.instruction(x, start, end).alias(x) for x in ("en", "ja")])


def _sql_category(c: str, locale: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in texts.CATEGORY_NAMES[locale].items()) + " end"


@query(f"""with {PLACES}, t as (select *, regexp_matches(name, '^([A-Z][A-Z]+[A-Z0-9]*[_-]|[A-Z]+_[A-Z0-9_-]+$)') as odd, cast(substr(id, strpos(id, ':o') + 2) as bigint) % 4 = 0 as given_name from pl)
select id, case when given_name then 'Place ' || id when odd then {_sql_category('category', 'en')} || ' · ' || {_sql_floor('floor_id', 'en')} else name end as en, case when given_name then '場所 ' || id when odd then {_sql_category('category', 'ja')} || ' · ' || {_sql_floor('floor_id', 'ja')} else name end as ja,
 area || ' · ' || {_sql_decimal('d')} || ' m access' as access_en from t""", *_PLACES)
def place_texts(s: SparkSession, d: str) -> DataFrame:
    """Public names of places; each fourth has a translation."""
    p = _places(s, d)
    given = F.regexp_extract("id", ":o(.*)", 1).cast("long") % 4 == 0
    ja, en = F.when(given, F.concat(F.lit("場所 "), "id")), F.when(given, F.concat(F.lit("Place "), "id"))
    name = lambda x: texts.place_name(F.col("name"), F.lit("source"), F.col("category"), F.col("floor_id"), ja, en, x).alias(x)
    return p.select("id", name("en"), name("ja"), texts.place_access(F.col("area"), F.col("distance_m"), "en").alias("access_en"))


@query(STEPS + """, j as (select request_id, count(*) filter (kind='transition') as n, ceil(sum(distance_m)/1.2e0 + coalesce(sum(case movement when 'stairs' then 15 when 'escalator' then 20 when 'elevator' then 45 else 0 end) filter (kind='transition'), 0)) as sec from s group by request_id),
jk as (select *, case when sec=0 then 0 else greatest(1, ceil(sec/60.0e0)) end::bigint as minutes from j)
select request_id, case when minutes=0 then 'Already there' else 'About ' || minutes || ' min' end as en, case when minutes=0 then '到着済み' else '約' || minutes || '分' end as ja, case when n=1 then '1 floor change' else n || ' floor changes' end as changes_en from jk""", "walks", "ends")
def journey_texts(s: SparkSession, d: str) -> DataFrame:
    j = guidance.journeys(_steps(s, d))
    return j.select("request_id", *[texts.estimate(F.col("minutes"), x).alias(x) for x in ("en", "ja")], texts.floor_changes(F.col("floor_changes"), "en").alias("changes_en"))


@query("""select area as source_id, 'outside-slice' as code from features group by area having greatest(max(abs(x*9)), max(abs(z*9))) > 2000""", "features")
def slice_warnings(s: SparkSession, d: str) -> DataFrame:
    """Areas that reach beyond a station's slice when drawn nine times as large."""
    f = table(s, d, "features")
    return rules.slice_warnings(f.select("area", (F.col("x") * 9).alias("x"), (F.col("z") * 9).alias("z")), "area")


@query(f"with recursive {ctes('nodes', 'edges', 'stops')}, " + COMPONENTS[len("with recursive ") :] + ", a as (select n.id, coalesce(root, n.id) as root from nodes n left join c using (id)), k as (select root, row_number() over (order by root) - 1 as component_id from (select distinct root from a)) select component_id, count(*) as n from stops join a on a.id=stops.node_id join k using (root) group by component_id")
def place_component_counts(s: SparkSession, d: str) -> DataFrame:
    """How many places each part of the network has."""
    return places.component_counts(table(s, d, "stops"), table(s, d, "nodes"), table(s, d, "edges"))


@query("with t as (select distinct p_partkey as id, lower(trim(p_name)) as term from part where trim(p_name) <> '') select count(distinct id) as places, count(*) as terms, count(distinct term) as distinct_terms from t")
def search_index_statistics(s: SparkSession, d: str) -> DataFrame:
    return places.index_statistics(places.search_terms(table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "p_name"))


@query(f"with recursive {ctes('nodes', 'edges', 'places', 'requests')}, " + COMPONENTS[len("with recursive ") :] + ", " + NEAREST[5:] + """, p as (select near.id, near.d, coalesce(c.root, near.node_id) as part, case when category='atm' then 'no' else 'unknown' end as access from near join places using (id) left join c on c.id=near.node_id)
select r.request_id, r.profile, case when a.id is null or b.id is null or a.d > 15 or b.d > 15 then 'invalid-place' when profile='accessible' and 'no' in (a.access, b.access) then 'unreachable' when a.id=b.id then 'ok' when a.part<>b.part then 'outside-coverage' end as status,
 case when a.id is null or b.id is null then 'not-found' when a.d > 15 or b.d > 15 then 'low-confidence-attachment' when profile='accessible' and 'no' in (a.access, b.access) then 'no-accessible-path' when a.id=b.id then 'already-there' when a.part<>b.part then 'different-components-in-bounded-extraction' end as reason
from requests r left join p a on r.start_id=a.id left join p b on r.destination_id=b.id""")
def bounded_request_status(s: SparkSession, d: str) -> DataFrame:
    """Requests on a part of a network; the ways to cash machines aren't accessible."""
    part = graph.component_numbers(table(s, d, "nodes"), table(s, d, "edges")).withColumnRenamed("id", "node_id")
    access = table(s, d, "places").select("id", F.when(F.col("category") == "atm", "no").otherwise("unknown").alias("accessibility"))
    p = _attached(s, d).join(access, "id").join(part, "node_id", "left")
    return routing.classify(table(s, d, "requests"), p, bounded=True).select("request_id", "profile", "status", "reason")


@query("""with a as (select id, floor_id, kind from nodes), b as (select id, case when cast(substr(id, 2) as bigint) % 41 = 0 then 'moved' else floor_id end as floor_id, kind from nodes where cast(substr(id, 2) as bigint) % 43 <> 0)
select 'left' as side, * from (select * from a except all select * from b) union all select 'right', * from (select * from b except all select * from a)""", "nodes")
def rebuilt_nodes(s: SparkSession, d: str) -> DataFrame:
    """Two builds of the nodes; the second lost some and moved others."""
    a, k = table(s, d, "nodes").select("id", "floor_id", "kind"), F.substring("id", 2, 20).cast("long")
    b = a.where(k % 43 != 0).withColumn("floor_id", F.when(k % 41 == 0, "moved").otherwise(F.col("floor_id")))
    return quality.differences(a, b)


@query("select 'nodes' as dataset, count(*) as rows from nodes union all select 'edges', count(*) from edges union all select 'places', count(*) from places union all select 'features', count(*) from features", "nodes", "edges", "places", "features")
def release_sizes(s: SparkSession, d: str) -> DataFrame:
    return quality.dataset_sizes({t: table(s, d, t) for t in ("nodes", "edges", "places", "features")})
