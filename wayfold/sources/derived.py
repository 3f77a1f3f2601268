"""Network, place and request tables derived from the given relational tables, as SQL that two engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _floor(c: str) -> str:
    return f"case ({c}) % 5 when 0 then 'B2' when 1 then 'B1' when 2 then '0' when 3 then '1' else '2' end"


def _elev(c: str) -> str:
    return f"case ({c}) % 5 when 0 then -10.0e0 when 1 then -5.0e0 when 2 then 0.0e0 when 3 then 5.0e0 else 10.0e0 end"


TABLES = {
    "nodes": f"""
select concat('P',p_partkey) as id, (p_partkey % 50)*5.0e0 as x, {_elev("p_size")} as y, floor(p_partkey/50.0e0)*5.0e0 as z,
       {_floor("p_size")} as floor_id, p_brand as facility_id, case when p_type='PROMO' then 'gate' else 'normal' end as kind,
       case p_size % 3 when 0 then 'inside' when 1 then 'boundary' else 'outside' end as in_out from {{part}}
union all
select concat('S',s_suppkey), (s_suppkey % 50)*5.0e0+2.5e0, {_elev("s_nationkey")}, s_acctbal/20.0e0, {_floor("s_nationkey")}, n_name, 'normal', 'inside'
from {{supplier}} join {{nation}} on s_nationkey=n_nationkey""",
    "edges": """
select concat(l_orderkey,'-',l_linenumber) as id, concat('S',l_suppkey) as from_id, concat('P',l_partkey) as to_id,
       case when l_tax=0 then 0.0e0 else l_extendedprice/1000.0e0 end as source_m,
       case l_returnflag when 'A' then 'both' when 'N' then 'forward' else 'reverse' end as direction,
       case cast(round(l_discount*100) as int) % 4 when 0 then 'corridor' when 1 then 'stairs' when 2 then 'elevator' else 'escalator' end as kind,
       case cast(round(l_tax*100) as int) when 0 then '99' when 1 then '1' else '3' end as width,
       case cast(round(l_discount*100) as int) when 0 then '99' when 1 then '2' else '1' end as vtcl_slope,
       case l_quantity when 46 then '2' when 47 then '99' else '1' end as lev_diff,
       case cast(round(l_tax*100) as int) % 4 when 0 then '3' when 1 then '2' when 2 then '99' else '5' end as elevator
from {lineitem} where l_linenumber=1 and l_quantity>=46""",
    "places": f"""
select concat('customer:',c_custkey) as id, c_name as name,
       case c_mktsegment when 'AUTOMOBILE' then 'gate' when 'BUILDING' then 'exit' when 'FURNITURE' then 'toilet' when 'HOUSEHOLD' then 'atm' else 'elevator' end as category,
       {_floor("c_nationkey")} as floor_id, (c_custkey % 53)*4.7e0 as x, {_elev("c_nationkey")} as y, c_acctbal/20.0e0 as z from {{customer}}""",
    "requests": """
select o_orderkey as request_id, concat('customer:',o_custkey) as start_id,
       concat('customer:',(o_custkey*7+13) % (select count(*) from {customer})) as destination_id,
       case o_orderpriority when '1-URGENT' then 'shortest' when '2-HIGH' then 'accessible' when '3-MEDIUM' then 'avoid-stairs'
            when '4-NOT SPECIFIED' then 'prefer-elevator' else 'fewest-floor-changes' end as profile from {orders}""",
    # An order's lines as a walk from part to part, in line order; the floor changes after each third line.
    "walks": f"""
select request_id, pos, concat(request_id, '-', pos, case when s % 2 = 0 then ':reverse' else '' end) as id, concat('P', a) as from_id, concat('P', b) as to_id,
       case when f <> g then case s % 3 when 0 then 'stairs' when 1 then 'elevator' else 'escalator' end when s % 5 = 0 then 'ramp' else 'corridor' end as kind,
       {_floor("f")} as floor_from, {_floor("g")} as floor_to, q*1.25e0 as distance_m,
       case when t = 0 then 'width' when s % 4 = 0 then 'vertical-slope' end as unknown,
       (a % 50)*5.0e0 as x0, {_elev("f")} as y0, floor(a/50.0e0)*5.0e0 as z0, (b % 50)*5.0e0 as x1, {_elev("g")} as y1, floor(b/50.0e0)*5.0e0 as z1
from (select request_id, pos, a, s, q, t, request_id + case when pos >= 6 then 2 when pos >= 3 then 1 else 0 end as f,
             request_id + case when lead(pos) over (partition by request_id order by pos) >= 6 then 2 when lead(pos) over (partition by request_id order by pos) >= 3 then 1 else 0 end as g,
             lead(a) over (partition by request_id order by pos) as b
      from (select l_orderkey as request_id, l_linenumber as pos, min(l_partkey) as a, min(l_suppkey) as s, min(l_quantity) as q, min(l_tax) as t from {{lineitem}} group by l_orderkey, l_linenumber) as lines) as steps
where b is not null""",
    # Both ends of each order's walk: floors and the way between place and network.
    "ends": f"""
select o_orderkey as request_id, {_floor("o_orderkey")} as start_floor, (o_custkey % 4)*2.5e0 as start_m, {_floor("o_custkey")} as destination_floor, (o_custkey % 7)*1.5e0 as destination_m,
       case o_orderpriority when '2-HIGH' then 'accessible' else 'shortest' end as profile from {{orders}}""",
    # A place beside each node, up to 3.75 m away; some can't be reached, some aren't known to be accessible.
    "stops": """
select concat('stop:', id) as id, id as node_id, floor_id, (k % 4)*1.25e0 as distance_m, k % 29 <> 0 as routable,
       case when k % 31 = 0 then 'no' when k % 5 = 0 then 'unknown' else 'yes' end as accessibility, x + (k % 4)*0.75e0 as x, y, z + (k % 4)*1.0e0 as z
from (select *, cast(substr(id, 2) as bigint) as k from {nodes}) as numbered""",
    # Three arcs from each arc on, so that most trips have a way; some go to the first station instead, some to no place.
    "trips": """
select distinct concat(d.id, ':', d.from_id, ':', d.to_id) as request_id, concat('stop:', d.from_id) as start_id,
       case when o % 41 = 0 then 'stop:none' when o % 13 = 0 then 'stop:S1' else concat('stop:', coalesce(c.to_id, b.to_id, d.to_id)) end as destination_id,
       case o % 5 when 0 then 'shortest' when 1 then 'accessible' when 2 then 'avoid-stairs' when 3 then 'prefer-elevator' else 'fewest-floor-changes' end as profile
from (select *, cast(split_part(id, '-', 1) as bigint) as o from (select id, from_id, to_id from {edges} as e where direction <> 'reverse' union all select id, to_id, from_id from {edges} as f where direction <> 'forward') as arcs0) as d
left join (select from_id, min(to_id) as to_id from (select from_id, to_id from {edges} as e where direction <> 'reverse' union all select to_id, from_id from {edges} as f where direction <> 'forward') as arcs1 group by from_id) as b on d.to_id = b.from_id
left join (select from_id, min(to_id) as to_id from (select from_id, to_id from {edges} as e where direction <> 'reverse' union all select to_id, from_id from {edges} as f where direction <> 'forward') as arcs2 group by from_id) as c on b.to_id = c.from_id""",
    # One feature a part: points of facilities, and L-shaped polygons of 2w a side around the others.
    "features": f"""
select concat('f', p_partkey) as id, p_partkey as source_record, p_brand as area,
       case p_partkey % 4 when 0 then 'Space' when 1 then 'Fixture' when 2 then 'Floor' else 'Facility' end as layer,
       case when p_partkey % 61 = 0 then null else {_floor("p_size")} end as floor_id,
       case when p_partkey % 53 = 0 then '' when p_partkey % 4 = 3 then concat(' f', lpad(cast(p_size as string), 3, '0')) else concat('B', lpad(cast(p_size as string), 3, '0')) end as category,
       case p_partkey % 7 when 0 then '' when 1 then 'EV3' when 2 then '不明' when 3 then cast(p_partkey as string) when 4 then null else p_name end as name,
       (p_partkey % 97)*2.5e0 as x, {_elev("p_size")} as y, floor(p_partkey/97.0e0)*2.5e0 as z, 3.0e0 + p_partkey % 7 as w from {{part}}""",
    # Named openings and spaces, one a part.
    "openings": f"""
select concat('o', p_partkey) as source_id, p_partkey as source_record, p_brand as area, case when p_partkey % 2 = 0 then 'Opening' else 'Space' end as layer,
       case p_partkey % 9 when 0 then '' when 1 then '不明' when 2 then null when 3 then ' トイレ 北' when 4 then 'EV_1' when 5 then 'esc-2' when 6 then 'エレベーター前' when 7 then 'GATE_A-1' else p_name end as name,
       {_floor("p_size")} as floor_id, (p_partkey % 89)*3.1e0 as x, {_elev("p_size")} as y, floor(p_partkey/89.0e0)*3.1e0 + 0.7e0 as z from {{part}}""",
    # Reviewed nodes near every second part's opening, each fourth on the lowest floor.
    "reviewed": f"""
select concat('R', s_suppkey) as id, concat('gate:o', p_partkey) as place_id, case when s_suppkey % 6 = 0 then 'turn' else 'gate' end as role,
       case when s_suppkey % 4 = 0 then 'B2' else {_floor("p_size")} end as floor_id, (p_partkey % 89)*3.1e0 + 1.0e0 as x, {_elev("p_size")} as y, floor(p_partkey/89.0e0)*3.1e0 + s_suppkey % 5 as z
from {{supplier}} join {{part}} on p_partkey = s_suppkey*2""",
}
_INPUTS = {"nodes": ("part", "supplier", "nation"), "edges": ("lineitem",), "places": ("customer",), "requests": ("orders", "customer"), "stops": ("nodes",), "trips": ("edges",), "walks": ("lineitem",), "ends": ("orders",), "features": ("part",), "openings": ("part",), "reviewed": ("supplier", "part")}


def table(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A derived table, or a given one by its name. made: derived tables by name that needn't be derived again."""
    if name in made:
        return made[name]
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TABLES[name], **{t: table(spark, sf_dir, t, **made) for t in _INPUTS[name]})


def ctes(*names: str) -> str:
    """The derived tables as a WITH list for an engine that has the given tables as views."""
    plain = {t: t for ts in _INPUTS.values() for t in ts}
    return ",\n".join(f"{n} as ({TABLES[n].format(**plain)})" for n in names)
