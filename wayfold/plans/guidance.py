"""Queries about found routes, over the walks that the order lines make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import millimetres as mm
from ..functions import scalars
from ..operators import guidance
from ..sources.derived import table
from .registry import MM, query

STEPS = """with u as (select *, x1-x0 as ux0, z1-z0 as uz, floor_from<>floor_to as tr from walks),
v as (select *, case when ux0=0 and uz=0 then 1.0e0 else ux0 end as ux from u),
g as (select *, lag(kind) over w as pk, lag(floor_from) over w as pf, lag(floor_to) over w as pt, lag(ux) over w as px, lag(uz) over w as pz from v window w as (partition by request_id order by pos)),
t as (select *, coalesce(pf=pt and not tr, false) as flat, degrees(atan2(px*uz-pz*ux, px*ux+pz*uz)) as turn0 from g),
h as (select *, case when turn0=-180 then 180.0e0 else turn0 end as turn from t),
i as (select *, sum(case when flat and pt=floor_from and pk=kind and abs(turn)<=20 then 0 else 1 end) over (partition by request_id order by pos) as part from h),
k as (select request_id, part::bigint as part, arg_min(floor_from, pos) as floor_from, arg_max(floor_to, pos) as floor_to, arg_min(kind, pos) as movement, max(turn) filter (flat and part_first) as turn, sum(distance_m) as distance_m, string_agg(replace(id, ':reverse', ''), ',' order by pos) as edge_ids
  from (select *, row_number() over (partition by request_id, part order by pos) = 1 as part_first from i) group by request_id, part),
a as (select request_id, part, case when floor_from<>floor_to then 'transition' when turn>20 then 'turn-right' when turn<-20 then 'turn-left' else 'continue' end as kind, distance_m, floor_from, floor_to, movement, edge_ids from k
  union all select request_id, 0, 'access', start_m, start_floor, start_floor, null, '' from ends where start_m > 0
  union all select request_id, 1099511627776, 'arrive', destination_m, destination_floor, destination_floor, null, '' from ends),
s as (select * from a where request_id in (select request_id from ends))"""


def _steps(s: SparkSession, d: str) -> DataFrame:
    return guidance.steps(table(s, d, "walks"), table(s, d, "ends"))


@query(STEPS + f" select request_id, row_number() over (partition by request_id order by part) as step_no, kind, {MM.format('distance_m')} as distance_mm, floor_from, floor_to, movement, edge_ids from s", "walks", "ends")
def route_steps(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).select("request_id", F.col("step_no").cast("long").alias("step_no"), "kind", mm(F.col("distance_m")).alias("distance_mm"), "floor_from", "floor_to", "movement", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(STEPS + f""", j as (select request_id, sum(distance_m) as distance_m, count(*) filter (kind='transition') as floor_changes,
 coalesce(sum(case movement when 'stairs' then 15 when 'escalator' then 20 when 'elevator' then 45 else 0 end) filter (kind='transition'), 0) as extra from s group by request_id),
z as (select *, ceil(distance_m/1.2e0 + extra)::bigint as seconds from j)
select request_id, {MM.format('distance_m')} as distance_mm, floor_changes, seconds, case when seconds=0 then 0 else greatest(1, ceil(seconds/60.0e0)) end::bigint as minutes from z""", "walks", "ends")
def route_journeys(s: SparkSession, d: str) -> DataFrame:
    return guidance.journeys(_steps(s, d)).select("request_id", mm(F.col("distance_m")).alias("distance_mm"), "floor_changes", "seconds", "minutes")


@query("select w.request_id, string_agg(distinct w.unknown, ',' order by w.unknown) as fields from walks w join ends e on w.request_id=e.request_id where e.profile='accessible' and w.unknown is not null group by w.request_id", "walks", "ends")
def route_warnings(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "walks").withColumn("unknowns", F.array_compact(F.array("unknown")))
    return guidance.warnings(w, table(s, d, "ends")).select("request_id", F.array_join("fields", ",").alias("fields"))


@query("""with u as (select w.request_id, string_agg(distinct w.unknown, ', ' order by w.unknown) as t from walks w join ends e on w.request_id=e.request_id where e.profile='accessible' and w.unknown is not null group by w.request_id),
p as (select id, name, case when cast(substr(id, 10) as bigint) % 3 = 0 then 'unknown' else 'yes' end as a from places),
v as (select r.request_id, [x for x in [case when a.a='unknown' then a.name end, case when b.a='unknown' then b.name end] if x is not null] as n from requests r left join p a on r.start_id=a.id left join p b on r.destination_id=b.id
 where r.profile='accessible' and r.start_id<>r.destination_id and (a.a='unknown' or b.a='unknown'))
select request_id, 1 as warning_no, 'Accessibility data is incomplete for: ' || t || '. Unknown segments are allowed by policy.' as en, 'アクセシビリティ情報が不完全です：' || t || '。情報が不明な区間は現在の方針により利用可能として扱います。' as ja from u
union all select request_id, case when request_id in (select request_id from u) then 2 else 1 end, 'Wheelchair accessibility has not been verified for the direct place-to-network access at: ' || array_to_string(n, ', ') || '.',
 '次の場所から歩行者ネットワークまでの車いす対応状況は未確認です：' || array_to_string(n, '、') || '。' from v""", "walks", "ends", "places", "requests")
def route_warning_texts(s: SparkSession, d: str) -> DataFrame:
    """The warnings of all accessible routes in both languages."""
    w = table(s, d, "walks").withColumn("unknowns", F.array_compact(F.array("unknown")))
    p = table(s, d, "places").withColumn("accessibility", F.when(F.substring("id", 10, 20).cast("long") % 3 == 0, "unknown").otherwise("yes"))
    asked = table(s, d, "requests").withColumn("status", F.lit("ok"))
    return guidance.warning_texts(guidance.warnings(w, table(s, d, "ends")), guidance.access_unverified(asked, p), p.select("id", F.col("name").alias("en"), F.col("name").alias("ja")))


@query("""with f as (select distinct request_id, unnest([floor_from, floor_to]) as f from walks)
select request_id, string_agg(f, ',' order by case f when 'B2' then -2 when 'B1' then -1 else cast(f as int) end) as floors from f group by request_id""", "walks")
def route_floors(s: SparkSession, d: str) -> DataFrame:
    return guidance.route_floors(table(s, d, "walks")).select("request_id", F.array_join("floors", ",").alias("floors"))


@query("""with p as (select request_id, pos, case when row_number() over (partition by request_id order by pos) = 1 then concat(x0::bigint, ':', y0::bigint, ':', z0::bigint, ' ') else '' end || concat(x1::bigint, ':', y1::bigint, ':', z1::bigint) as t from walks)
select request_id, string_agg(t, ' ' order by pos) as line from p group by request_id""", "walks")
def route_lines(s: SparkSession, d: str) -> DataFrame:
    text = F.transform("points", lambda p: F.concat_ws(":", *[p[c].cast("long").cast("string") for c in "xyz"]))
    return guidance.route_lines(table(s, d, "walks")).select("request_id", F.array_join(text, " ").alias("line"))


SHOWN = ["B1", "0", "1"]
CUE = "cast(floor((x0+x1)*500+0.5) as bigint) as x_mm, cast(floor((y0+y1)*500+0.5) as bigint) as y_mm, cast(floor((z0+z1)*500+0.5) as bigint) as z_mm"
LENGTH = "sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0))"


@query(f"select request_id, pos, {CUE}, cast(floor((x1-x0)/{LENGTH}*1000+0.5) as bigint) as ux, cast(floor((z1-z0)/{LENGTH}*1000+0.5) as bigint) as uz from walks where floor_from=floor_to and floor_from in ('B1','0','1') and distance_m>=10 and {LENGTH}>0", "walks")
def direction_cues(s: SparkSession, d: str) -> DataFrame:
    c = guidance.direction_cues(table(s, d, "walks"), SHOWN)
    return c.select("request_id", "pos", *[mm(F.col(f"cue.{k}")).alias(f"{k}_mm") for k in "xyz"], *[mm(F.col(f"cue.{k}")).alias(k) for k in ("ux", "uz")])


@query(f"select request_id, pos, kind as movement, floor_from, floor_to, {CUE} from walks where floor_from<>floor_to and floor_from in ('B1','0','1') and floor_to in ('B1','0','1') and {LENGTH}>0", "walks")
def transition_markers(s: SparkSession, d: str) -> DataFrame:
    c = guidance.transition_markers(table(s, d, "walks"), SHOWN)
    return c.select("request_id", "pos", "movement", "floor_from", "floor_to", *[mm(F.col(f"cue.{k}")).alias(f"{k}_mm") for k in "xyz"])


@query("""with v as (select request_id, pos, y0=y1 and y0 in (-5, 0) as shown from walks), b as (select *, coalesce(lag(shown) over (partition by request_id order by pos), false) as before from v),
r as (select *, sum((shown and not before)::int) over (partition by request_id order by pos)::bigint as run from b)
select request_id, run, min(pos) as first_pos, count(*)+1 as points from r where shown group by request_id, run""", "walks")
def visible_runs(s: SparkSession, d: str) -> DataFrame:
    return guidance.visible_runs(table(s, d, "walks"), [-5.0, 0.0])


@query("""select request_id, 'from=' || replace(start_id, ':', '%3A') || '&to=' || replace(destination_id, ':', '%3A') || case when profile <> 'shortest' then '&profile=' || profile else '' end as url from requests""", "requests")
def request_urls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "requests").select("request_id", scalars.route_url(F.col("start_id"), F.col("destination_id"), F.col("profile")).alias("url"))


@query("""with l as (select e.id, e.direction, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz from edges e join nodes a on e.from_id=a.id join nodes b on e.to_id=b.id where e.direction<>'both'
 and a.floor_id in ('B1','0','1') and b.floor_id in ('B1','0','1')),
f as (select id, case when direction='reverse' then bx else ax end as x0, case when direction='reverse' then by_ else ay end as y0, case when direction='reverse' then bz else az end as z0,
 case when direction='reverse' then ax else bx end as x1, case when direction='reverse' then ay else by_ end as y1, case when direction='reverse' then az else bz end as z1 from l)""" + f" select id, cast(floor((x0+(x1-x0)*0.5e0)*100+0.25) as bigint) as x_cm, cast(floor((z0+(z1-z0)*0.5e0)*100+0.25) as bigint) as z_cm, cast(floor((x1-x0)/{LENGTH}*1000+0.5) as bigint) as ux from f where {LENGTH}>0", "nodes", "edges")
def network_arrows(s: SparkSession, d: str) -> DataFrame:
    """Arrows half way along one-way edges. Heights of stations have odd tenths, so places are cut at centimetres."""
    a = guidance.network_arrows(table(s, d, "edges"), table(s, d, "nodes"), SHOWN)
    cm = lambda k: F.floor(F.col(f"arrow.{k}") * 100 + 0.25).cast("long").alias(f"{k}_cm")
    return a.select("id", cm("x"), cm("z"), mm(F.col("arrow.ux")).alias("ux"))
