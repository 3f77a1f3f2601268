"""Queries about features, markers, names and whole networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories, scalars, texts
from ..functions.scalars import millimetres as mm
from ..operators import maps, markers, places, spatial, translations
from ..sources.derived import ctes, table
from .registry import COMPONENTS, EDGE_CTE, MM, _edges, query


def _values(d: dict) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(text(x) for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in d.items())


MARKERS = f"""with pol(code, priority) as (values {_values(categories.MARKER_PRIORITY)}), cat(code, category, ja, en) as (values {_values(categories.PLACE_CATEGORIES)}),
f as (select f.* exclude (category), p.code, p.priority, nullif(trim(name), '') as given from features f join pol p on upper(trim(f.category)) = p.code where layer = 'Facility'),
c as (select *, case when not regexp_matches(given, '^(不明|[Uu][Nn][Kk][Nn][Oo][Ww][Nn]|[Nn][Uu][Ll][Ll])$') and not regexp_matches(given, '^[0-9]+$') and not regexp_matches(given, '^[A-Za-z][A-Za-z]?[0-9]*$') then given end as source_name from f),
pair as (select c.id, n.id as node_id, sqrt((c.x-n.x)*(c.x-n.x)+(c.z-n.z)*(c.z-n.z)) as d from c join nodes n on c.floor_id=n.floor_id),
near as (select id, arg_min(node_id, (d, node_id)) as node_id, min(d) as d from pair group by id),
r as (select c.*, node_id, d, case when floor_id is null then 'missing-floor' when given is not null and source_name is null then 'unclear-source-label' when d is null or d > 15 then 'network-misalignment' end as reason0 from c left join near using (id)),
q as (select *, case when reason0 is null and row_number() over (partition by reason0 is null, code, floor_id, floor(x*10+0.5), floor(z*10+0.5) order by id) > 1 then 'duplicate' else reason0 end as reason from r),
m as (select q.*, count(*) over g as of_, row_number() over (g order by q.id) as nth, cat.category, cat.ja, cat.en from q join cat on q.code=cat.code where reason is null window g as (partition by area, floor_id, q.code)),
p as (select concat('facility:', id) as id, coalesce(source_name, ja || case when of_ > 1 then ' ' || nth else '' end) as name, case when source_name is null then 'generated-category' else 'source' end as name_kind, category, code, area, floor_id, node_id, d, ja, en from m)"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return markers.candidates(table(s, d, "features"), table(s, d, "nodes"))


@query(MARKERS + f" select id, code, source_name, priority, node_id, {MM.format('d')} as distance_mm, reason from q", "nodes", "features")
def marker_candidates(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("id", "code", "source_name", "priority", "node_id", mm(F.col("distance_m")).alias("distance_mm"), "reason")


@query(MARKERS + """ select code, count(*) as candidates, count(*) filter (reason is null) as public, 0::bigint as invalid_geometry, count(*) filter (reason='missing-floor') as missing_floor,
count(*) filter (reason='unclear-source-label') as unclear_source_label, count(*) filter (reason='network-misalignment') as network_misalignment, count(*) filter (reason='duplicate') as duplicate from q group by code""", "nodes", "features")
def marker_summary(s: SparkSession, d: str) -> DataFrame:
    return markers.summary(_candidates(s, d))


@query(MARKERS + " select code, count(*) as n from q where reason is null and code not in ('F011') group by code union all select 'gate', count(*) from places where category='gate'", "nodes", "features", "places")
def marker_options(s: SparkSession, d: str) -> DataFrame:
    return markers.filter_options(_candidates(s, d), ["F011"], table(s, d, "places").where("category = 'gate'"))


@query(MARKERS + " select id, name, name_kind, category, code, floor_id, node_id, case when d <= 5 then 'high' when d <= 15 then 'medium' else 'low' end as confidence from p", "nodes", "features")
def facility_places(s: SparkSession, d: str) -> DataFrame:
    return markers.promoted(_candidates(s, d)).select("id", "name", "name_kind", "category", "code", "floor_id", "node_id", "confidence")


EXPLICIT = MARKERS + """, e as (select id, name as ja, 'Reviewed ' || code as en, 'reviewed' as status, 'register' as source from p where cast(substr(id, 11) as bigint) % 3 = 0),
t as (select p.id, coalesce(e.ja, p.name) as ja, case when e.id is not null then e.en when name_kind='generated-category' then p.en || substr(p.name, length(p.ja)+1) end as en,
 case when e.id is not null then 'reviewed' when name_kind='generated-category' then 'specification' else 'pending' end as status,
 case when e.id is not null then 'register' when name_kind='generated-category' then 'category-table' else 'authoritative-japanese-fallback' end as source from p left join e using (id))"""


def _translated(s: SparkSession, d: str) -> DataFrame:
    """A third of the places, by their part's key, has a reviewed record."""
    p = markers.promoted(_candidates(s, d))
    given = p.where(F.substring("id", 11, 20).cast("long") % 3 == 0)
    given = given.select("id", F.col("name").alias("ja"), F.concat(F.lit("Reviewed "), "code").alias("en"), F.lit("reviewed").alias("status"), F.lit("register").alias("source"))
    return translations.translate(p, given)


PLAIN = ["id", "ja", "en", "status", "source"]


@query(EXPLICIT + " select id, ja, en, status, source from t", "nodes", "features")
def place_translations(s: SparkSession, d: str) -> DataFrame:
    return _translated(s, d).select(*PLAIN)


@query(EXPLICIT + " select p.id, case when e.id is null and name_kind='generated-category' then p.ja end as alias_ja, case when e.id is null and name_kind='generated-category' then p.en end as alias_en from p left join e using (id)", "nodes", "features")
def translation_aliases(s: SparkSession, d: str) -> DataFrame:
    return _translated(s, d).select("id", *[F.nullif(F.array_join(f"aliases_{x}", ","), F.lit("")).alias(f"alias_{x}") for x in ("ja", "en")])


@query(EXPLICIT + " select status, source, count(*) as n from t group by all", "nodes", "features")
def translation_counts(s: SparkSession, d: str) -> DataFrame:
    return translations.coverage(_translated(s, d))


@query(EXPLICIT + """, b as (select id, case when cast(substr(id, 11) as bigint) % 5 = 0 then null else en end as en, status from t)
select id as source_id, case when status='pending' then 'english-of-pending' else 'english-missing' end as code from b where (status='pending') = (en is not null)""", "nodes", "features")
def translation_issues(s: SparkSession, d: str) -> DataFrame:
    """Records that lost their English name."""
    t = _translated(s, d)
    return translations.broken(t.withColumn("en", F.when(F.substring("id", 11, 20).cast("long") % 5 != 0, F.col("en"))))


@query("""with b as (select distinct floor_id from features where layer in ('Floor','Space')),
p as (select * from features f where floor_id is not null and (layer in ('Floor','Space') or layer='Fixture' and floor_id not in (select floor_id from b)))
select floor_id, count(*)*12 as segments, sum(8*w+24)::bigint as metres from p group by floor_id""", "features")
def wall_segments(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "features").where("layer != 'Facility'")
    at = lambda i, j: F.struct((F.col("x") + F.col("w") * i).alias("x"), F.col("y").alias("y"), (F.col("z") + F.col("w") * j).alias("z"))
    f = f.select("id", "layer", "floor_id", F.array(at(0, 0), at(2, 0), at(2, 1), at(1, 1), at(1, 2), at(0, 2), at(0, 0)).alias("ring"))
    g = F.col("segment")
    size = F.sqrt(sum(((g.b[c] - g.a[c]) ** 2 for c in "xyz"), F.lit(0.0)))
    return maps.walls(f).groupBy("floor_id").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(size)).cast("long").alias("metres"))


@query("""with f as (select *, coalesce(nullif(upper(trim(category)), ''), '(missing)') as code, coalesce(floor_id, '(missing)') as floor from features),
n as (select layer, code, string_agg(floor || ':' || n, ',' order by floor) as floors from (select layer, code, floor, count(*) as n from f group by all) group by all),
x as (select layer, code, string_agg(id, ',' order by source_record) as examples from (select *, row_number() over (partition by layer, code order by source_record) as nth from f) where nth <= 5 group by all),
a as (select layer, code, count(*) as records, count(*) filter (trim(name) <> '') as named, count(*) filter (floor_id is null) as without_floor, min(x) as min_x, max(x) as max_x, min(z) as min_z, max(z) as max_z from f group by all)
select a.*, floors, examples from a join n using (layer, code) join x using (layer, code)""", "features")
def category_audit(s: SparkSession, d: str) -> DataFrame:
    a = maps.audit(table(s, d, "features"))
    floors = F.array_join(F.transform(F.map_entries("floors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return a.select("layer", "code", "records", "named", "without_floor", "min_x", "max_x", "min_z", "max_z", floors.alias("floors"), F.array_join("examples", ",").alias("examples"))


@query("""select 'layer' as section, layer as key, count(*) as n from features where floor_id in ('0','1') group by layer
union all select 'category', upper(trim(category)), count(*) from features where floor_id in ('0','1') group by 2""", "features")
def map_presence(s: SparkSession, d: str) -> DataFrame:
    return maps.presence(table(s, d, "features"), ["0", "1"], {"layer": F.col("layer"), "category": scalars.category_code(F.col("category"))})


@query("select layer, count(*) as n from features group by layer", "features")
def layer_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "features").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with n as (select id, floor_id, x, y, z from nodes union all select id, floor_id, x, y, z from places where category='gate'),
e as (select concat('review:', id) as id, id as from_id, concat('P', substr(id, 10)) as to_id from places where category in ('gate', 'exit')),
j as (select e.*, a.floor_id as floor_id, b.floor_id as other, a.id as a, b.id as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as m from e left join n a on e.from_id=a.id left join n b on e.to_id=b.id)
select id, floor_id, {MM.format('m')} as distance_mm, case when a is null then 'start-missing' when b is null then 'end-missing' when floor_id <> other then 'floor-mismatch' end as problem from j""", "nodes", "places")
def overlay_edges(s: SparkSession, d: str) -> DataFrame:
    """Reviewed links from gates to the node of the same number; exits aren't nodes."""
    p = table(s, d, "places")
    cols = ["id", "floor_id", "x", "y", "z"]
    n = table(s, d, "nodes").select(*cols).unionByName(p.where("category = 'gate'").select(*cols))
    e = p.where("category in ('gate', 'exit')").select(F.concat(F.lit("review:"), "id").alias("id"), F.col("id").alias("from_id"), F.concat(F.lit("P"), F.substring("id", 10, 20)).alias("to_id"))
    return maps.overlay_edges(n, e).select("id", "floor_id", mm(F.col("distance_m")).alias("distance_mm"), "problem")


@query("""with n as (select * from nodes where floor_id in ('B1','0','1') and x between 20 and 180 and z between -20 and 400)
select a.floor_id as floor_from, b.floor_id as floor_to, e.kind, count(*) as n from edges e join n a on e.from_id=a.id join n b on e.to_id=b.id where a.floor_id<>b.floor_id group by all""", "nodes", "edges")
def vertical_profile(s: SparkSession, d: str) -> DataFrame:
    e = maps.induced(table(s, d, "nodes"), table(s, d, "edges"), ["B1", "0", "1"], 20.0, -20.0, 180.0, 400.0)
    return e.groupBy("floor_from", "floor_to", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select * from nodes where cast(substr(id, 2) as bigint) % 7 <> 0), e as (select *, case when kind='stairs' then 'ladder' else kind end as k, case when source_m > 90 then -1.0e0 else source_m end as m from edges),
j as (select e.id, direction, k, m, a.id as a, b.id as b from e left join n a on e.from_id=a.id left join n b on e.to_id=b.id)
select id as source_id, 'error' as severity, 'kind-unknown' as code from j where k='ladder' union all select id, 'error', 'distance-negative' from j where m < 0
union all select id, 'error', 'both-ends-missing' from j where a is null and b is null union all select id, 'warning', 'boundary-link' from j where (a is null) <> (b is null)""", "nodes", "edges")
def edge_rule_issues(s: SparkSession, d: str) -> DataFrame:
    """A network without each seventh node, with one unknown kind and some negative distances."""
    n = table(s, d, "nodes").where(F.substring("id", 2, 20).cast("long") % 7 != 0)
    e = table(s, d, "edges").withColumn("kind", F.when(F.col("kind") == "stairs", "ladder").otherwise(F.col("kind")))
    return maps.rule_issues(n, e.withColumn("source_m", F.when(F.col("source_m") > 90, -1.0).otherwise(F.col("source_m"))))


@query(f"with recursive {ctes('nodes', 'edges')}, " + COMPONENTS[len("with recursive ") :] + ", " + EDGE_CTE[5:] + """, t as (select from_id as id from edges union select to_id from edges)
select 'nodes' as metric, count(*)::bigint as value from nodes union all select 'floors', count(distinct floor_id) from nodes union all select 'facilities', count(distinct facility_id) from nodes
union all select 'duplicate_nodes', count(*) - count(distinct id) from nodes union all select 'edges', count(*) from edges union all select 'one_way_edges', count(*) from edges where direction<>'both'
union all select 'invalid_references', (select count(*) from edges) - count(*) from r
union all select 'access_' || v, (select count(*) from r where accessibility = v) from (values ('yes'), ('no'), ('unknown')) as q(v)
union all select 'vertical_' || v, (select count(*) from r where floor_from<>floor_to and r.kind = v) from (values ('stairs'), ('escalator'), ('elevator')) as q(v)
union all select 'linked_components', count(distinct root) from c union all select 'single_nodes', count(*) from nodes where id not in (select id from t) union all select 'isolated_nodes', count(*) from nodes where id not in (select id from t)
union all select 'near_pairs', count(*) from nodes a join nodes b on a.floor_id=b.floor_id and a.id<b.id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.0025""")
def network_validation(s: SparkSession, d: str) -> DataFrame:
    return maps.validation_summary(table(s, d, "nodes"), table(s, d, "edges"), _edges(s, d))


@query(f"""with pair as (select n.id, p.id as place_id, sqrt((p.x-n.x)*(p.x-n.x)+(p.z-n.z)*(p.z-n.z)) as d from nodes n join places p on abs(p.x-n.x) <= 15 and abs(p.z-n.z) <= 15)
select id, arg_min(place_id, (d, place_id)) as place_id, {MM.format('min(d)')} as distance_mm from pair where d <= 15 group by id""", "nodes", "places")
def nearest_places(s: SparkSession, d: str) -> DataFrame:
    p = spatial.nearest_within(table(s, d, "nodes"), table(s, d, "places"))
    return p.select("id", "place_id", mm(F.col("distance_m")).alias("distance_mm"))


@query("select p_name as name, min(p_partkey) as id from part group by p_name")
def first_named(s: SparkSession, d: str) -> DataFrame:
    return places.first_by_name(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name")))


@query(MARKERS + " select floor_id, area, category, count(*) as n, min(name) as first_name from p group by all", "nodes", "features")
def place_groups(s: SparkSession, d: str) -> DataFrame:
    return places.groups(markers.promoted(_candidates(s, d)))


@query(MARKERS + " select count(*) as places, count(distinct name) as unique_names, count(*) filter (d <= 5) as high, count(*) filter (d > 5 and d <= 15) as medium, count(*) filter (d > 15) as low from p", "nodes", "features")
def place_statistics(s: SparkSession, d: str) -> DataFrame:
    return places.statistics(markers.promoted(_candidates(s, d)))


AREAS = EXPLICIT + """, ar as (select distinct area as id from p where area not like '%3'), pr as (select *, d <= 5 as routable from p)"""


def _areas(s: SparkSession, d: str) -> DataFrame:
    """Records of the areas, but for those whose name ends in 3; an area is called by its number too."""
    a = markers.promoted(_candidates(s, d)).select(F.col("area").alias("id")).distinct().where("id not like '%3'")
    number = F.array(F.concat(F.lit("No "), F.substring_index("id", "#", -1)))
    return a.select("id", F.col("id").alias("ja"), F.concat(F.lit("Area "), "id").alias("en"), F.lit("reviewed").alias("status"), F.lit("register").alias("source"), F.array().cast("array<string>").alias("aliases_ja"), number.alias("aliases_en"))


def _public(s: SparkSession, d: str) -> DataFrame:
    """Places; those with high confidence are routable."""
    return markers.promoted(_candidates(s, d)).withColumns({"layer": F.lit("Facility"), "routable": F.col("confidence") == "high"})


INDEXED = AREAS + f""", cn(category, cen, cja) as (values {_values({k: (v, texts.CATEGORY_NAMES['ja'][k]) for k, v in texts.CATEGORY_NAMES['en'].items()})}),
ix as (select pr.id, unnest([pr.name, t.ja, t.en, cen, cja, pr.area, ar.id, 'Area ' || ar.id, 'No ' || string_split(ar.id, '#')[-1],
 case when t.source='category-table' then pr.ja end, case when t.source='category-table' then pr.en end]) as raw from pr join t using (id) join cn using (category) left join ar on ar.id=pr.area where routable),
tm as (select id, trim(regexp_replace(lower(translate(raw, '（）／', '()/')), '\\s+', ' ', 'g')) as term from ix where raw <> '')"""


def _index(s: SparkSession, d: str) -> DataFrame:
    return places.term_index(_public(s, d), _translated(s, d), _areas(s, d))


@query(INDEXED + " select id, term, count(*) as n from tm group by all", "nodes", "features")
def place_terms(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(INDEXED + """, asked as (select distinct left(term, 5) as query from tm union select distinct right(term, 2) from tm) select distinct query, id from asked join tm on contains(term, query)""", "nodes", "features")
def bilingual_search(s: SparkSession, d: str) -> DataFrame:
    """Places found by the first five and the last two letters of all terms."""
    t = _index(s, d)
    q = t.select(F.left("term", F.lit(5)).alias("query")).union(t.select(F.right("term", F.lit(2)))).distinct()
    return places.search(t, q)


@query(AREAS + """, h as (select pr.*, t.en as ten, ar.id as known from pr left join t using (id) left join ar on ar.id=pr.area where routable)
select 'routable-places' as section, count(*) as covered, count(ten) as english, count(*) as total from h having count(*) > 0 union all select 'facility-markers', count(*), count(ten), count(*) from h having count(*) > 0
union all select 'permanent-labels', count(*), count(ten), count(*) from h where category='gate' having count(*) > 0 union all select 'public-areas', count(distinct known), count(distinct known), count(distinct area) from h having count(*) > 0""", "nodes", "features")
def translation_report(s: SparkSession, d: str) -> DataFrame:
    return translations.coverage_report(_public(s, d), _translated(s, d), _areas(s, d))


RELEASE = AREAS + """, rt as (select t.* from t join pr using (id) where routable), k as (
select 'records' as section, 'places' as key, count(*) as n from rt union all select 'records', 'areas', count(*) from ar
union all select 'status', v, (select count(*) from rt where status=v) + case v when 'reviewed' then (select count(*) from ar) else 0 end from (values ('specification'), ('reviewed'), ('pending')) as q(v)
union all select 'source', source, count(*) from (select source from rt union all select 'register' from ar) group by source)"""


def _released(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    routable = _public(s, d).where("routable").select("id")
    return _translated(s, d).join(routable, "id", "left_semi"), _areas(s, d)


@query(RELEASE + " select * from k", "nodes", "features")
def translation_release(s: SparkSession, d: str) -> DataFrame:
    """The counts that a release of the translations of routable places and their areas states."""
    return translations.release_statistics(*_released(s, d))


@query(RELEASE + """ select 'records.areas' as key, null::bigint as declared, n as computed, 'extra' as problem from k where section='records' and key='areas'
union all select 'status.reviewed', n + 1, n, 'wrong' from k where section='status' and key='reviewed' union all select 'source.elsewhere', 1, null, 'missing'""", "nodes", "features")
def translation_release_issues(s: SparkSession, d: str) -> DataFrame:
    """A release that leaves one count out, is wrong in another and names a source that no record has."""
    t, a = _released(s, d)
    k = translations.release_statistics(t, a)
    stated = k.where("not (section = 'records' and key = 'areas')").withColumn("n", F.col("n") + (F.col("key") == "reviewed").cast("long"))
    other = s.range(1).select(F.lit("source").alias("section"), F.lit("elsewhere").alias("key"), F.lit(1).cast("long").alias("n"))
    return translations.release_issues(stated.unionByName(other), t, a)


@query(f"""with pol(code, category, ja, en) as (values {_values(categories.PLACE_CATEGORIES)}), f as (select coalesce(upper(trim(category)), '') as code from features where layer='Facility'),
g as (select code, count(*) as features, code in ({', '.join(repr(r[1]) for r in categories.CATEGORIES if r[0] == 'Facility')}) and code not in ({', '.join(map(repr, categories.NO_DESTINATIONS))}) as destination from f group by code)
select g.*, case when destination then pol.category end as category, case when destination and pol.category is null then 'outside-current-named-place-taxonomy' end as excluded from g left join pol using (code)""", "features")
def place_promotions(s: SparkSession, d: str) -> DataFrame:
    """What becomes of the facilities of each code: a place, none for a stated reason, or no destination."""
    return markers.promotions(table(s, d, "features"))


@query(EXPLICIT + " select id from t where status='pending'", "nodes", "features")
def pending_translations(s: SparkSession, d: str) -> DataFrame:
    return translations.pending(_translated(s, d))


@query(EXPLICIT + """, bad as (select case when k % 11 = 0 then 'lost:' || id else id end as id, case when k % 7 = 0 then ja || '?' else ja end as ja, case when k % 13 = 0 then ' ' else en end as en, status, k % 5 = 0 as twice from (select *, cast(substr(id, 11) as bigint) as k from t))
select id as source_id, 'id-unknown' as code from bad where id like 'lost:%' union all select id, 'japanese-not-authoritative' from bad where id not like 'lost:%' and ja like '%?' union all select id, 'english-blank' from bad where en=' '
union all select id, 'english-of-pending' from bad where status='pending' and en is not null union all select id, 'alias-twice' from bad where twice union all select id, 'record-missing' from p where id not in (select id from bad)""", "nodes", "features")
def translation_record_issues(s: SparkSession, d: str) -> DataFrame:
    """Records with strange ids and texts and aliases that repeat, against the places' names."""
    k = F.substring("id", 11, 20).cast("long")
    t = _translated(s, d).withColumn("k", k)
    r = t.withColumns({
        "id": F.when(F.col("k") % 11 == 0, F.concat(F.lit("lost:"), "id")).otherwise(F.col("id")),
        "ja": F.when(F.col("k") % 7 == 0, F.concat("ja", F.lit("?"))).otherwise(F.col("ja")),
        "en": F.when(F.col("k") % 13 == 0, " ").otherwise(F.col("en")),
        "aliases_ja": F.when(F.col("k") % 5 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("aliases_ja")),
    })
    return translations.record_issues(r, markers.promoted(_candidates(s, d)))


def _sql_groups(locale: str) -> str:
    name = "coalesce(t.en, t.ja)" if locale == "en" else "t.ja"
    area = "coalesce('Area ' || ar.id, p.area)" if locale == "en" else "p.area"
    floor = "case p.floor_id when 'B2' then -10 when 'B1' then -5 when '0' then 0 when '1' then 5 else 10 end"
    kind = "cen" if locale == "en" else "cja"
    return f"""select dense_rank() over (order by {floor}, {area} collate ja, {kind} collate {locale}, p.floor_id, p.area, p.category) as group_no, p.floor_id, p.area as area_id, {area} as area, p.category,
 row_number() over (partition by p.floor_id, p.area, p.category order by {name} collate {locale}, p.id) as nth, p.id, {name} as name from p join t using (id) join cn using (category) left join ar on ar.id=p.area"""


@query(INDEXED + ", both_ as (select 'en' as locale, * from (" + _sql_groups("en") + ") union all select 'ja', * from (" + _sql_groups("ja") + ")) select * from both_", "nodes", "features")
def ordered_place_groups(s: SparkSession, d: str) -> DataFrame:
    """Members of the groups in both languages' order."""
    one = lambda x: places.ordered_groups(_public(s, d), _translated(s, d), _areas(s, d), x).select(F.lit(x).alias("locale"), "*")
    return one("en").unionByName(one("ja"))
