"""Places: ordinal names, markers, search terms and queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, texts
from .graph import component_numbers, ranked


def ordinals(places: DataFrame, *group: str) -> DataFrame:
    """places with ordinal: the number in its group by id, null in groups of one."""
    d = ranked(places, [F.col("id")], group)
    return d.select(*places.columns, F.when(F.col("of") > 1, F.col("nth")).alias("ordinal"))


def flag_duplicates(markers: DataFrame) -> DataFrame:
    """duplicate: a marker of the same category, floor and place (to a tenth of a metre) comes before it in the reading order
    of ids; rows that share the first id are none."""
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5)
    m = markers.withColumns({"__x": tenth("x"), "__z": tenth("z")})
    key = ["category", "floor_id", "__x", "__z"]
    first = m.groupBy(*key).agg(F.min(F.struct(*scalars.in_reading_order("id"))).alias("__f")).select(F.col("__f.id").alias("__first"), *[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return m.join(first, same).select(*markers.columns, (F.col("id") != F.col("__first")).alias("duplicate"))


def declutter(markers: DataFrame, priority: Column, zoom: float, limit: int = 80) -> DataFrame:
    """The best marker of each screen cell of a floor, then the first ``limit`` by priority and reading order of ids."""
    cell = 34 / max(zoom, 0.1)
    m = markers.withColumn("priority", priority)
    w = Window.partitionBy("floor_id", F.floor(F.col("x") / cell), F.floor(F.col("z") / cell)).orderBy("priority", *scalars.in_reading_order("id"))
    return m.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place").orderBy("priority", *scalars.in_reading_order("id")).limit(limit)


def search_terms(places: DataFrame, *columns: str) -> DataFrame:
    """id, term: the distinct normalised texts a place is found by."""
    return places.select("id", F.explode(F.array_compact(F.array(*columns))).alias("raw")).select("id", scalars.search_text(F.col("raw")).alias("term")).where("term != ''").distinct()


def _grams(c: str, n: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(F.col(c), i, F.lit(n)))


def term_index(places: DataFrame, translated: DataFrame, areas: DataFrame) -> DataFrame:
    """id, term: each normalised text by which a routable place is found: its name, its category and its area in both
    languages, and the aliases of all three (a text that two of them share stays twice). places: id, name, category,
    area, routable; translated, areas: id, ja, en, aliases_ja, aliases_en (one row an id)."""
    also = ["aliases_ja", "aliases_en"]
    a = areas.select(F.col("id").alias("area"), F.array("ja", "en").alias("area_texts"), *[F.col(c).alias(f"area_{c}") for c in also])
    p = places.where("routable").join(translated.select("id", "ja", "en", *also), "id", "left").join(a, "area", "left")
    kinds = [texts.category_name(F.col("category"), x) for x in ("en", "ja")]
    more = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (*also, "area_texts", *[f"area_{c}" for c in also])]
    found = F.concat(F.array("name", "ja", "en", *kinds, "area"), *more)
    raw = p.select("id", F.explode(F.array_compact(found)).alias("raw")).where("raw != ''")
    return raw.select("id", scalars.search_text(F.col("raw")).alias("term"))


def search(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id: places with a term that contains the query. An index of three-letter parts of the different terms finds
    the candidates by the query's rarest part, so that a common beginning brings no crowd together; queries under three
    letters look at the parts of their own length. Terms that many places share are searched once."""
    known = terms.select("term").distinct()
    parts = known.select("term", F.explode(F.array_distinct(_grams("term"))).alias("part"))
    q = queries.select("query").distinct()
    asked = q.where(F.length("query") >= 3).select("query", F.explode(F.array_distinct(_grams("query"))).alias("part"))
    often = parts.join(asked.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a query with a part that no term has finds nothing
    rarest = F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part")
    long_ = parts.join(asked.join(often, "part", "left").groupBy("query").agg(rarest), "part")
    tails = known.select("term", F.explode(F.array_distinct(F.concat(_grams("term", 1), _grams("term", 2)))).alias("part"))
    short = tails.join(q.where(F.length("query").between(1, 2)).withColumn("part", F.col("query")), "part")
    hits = long_.select("query", "term").unionByName(short.select("query", "term")).where(F.contains("term", "query"))
    return terms.join(hits, "term").select("query", "id").distinct()


def first_by_name(places: DataFrame, name: str = "name", order: str = "ordinal") -> DataFrame:
    """name, id: the first place of each display name."""
    return places.groupBy(F.col(name).alias("name")).agg(F.min_by("id", F.struct(order, "id")).alias("id"))


def groups(places: DataFrame) -> DataFrame:
    """floor_id, area, category, n, first_name, ordered by floor height, area and category."""
    g = places.groupBy("floor_id", "area", "category").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    return g.orderBy(scalars.floor_elevation(F.col("floor_id")), "area", "category")


def ordered_groups(places: DataFrame, translated: DataFrame, areas: DataFrame, locale: str) -> DataFrame:
    """group_no, floor_id, area_id, area, category, nth, id, name: the places of each floor, area and category in the
    order in which a reader of the locale looks for them: groups by floor height, area's and category's name, members by
    name, then id. The members of a group are rows, so a group may have any size. places: id, name, name_kind,
    category, area, floor_id; translated, areas: id, ja, en (one row an id)."""
    t = translated.select("id", F.col("ja").alias("__ja"), F.col("en").alias("__en"))
    a = areas.select(F.col("id").alias("area_id"), F.col("ja").alias("__aja"), F.col("en").alias("__aen"))
    p = places.withColumnRenamed("area", "area_id").join(t, "id", "left").join(a, "area_id", "left")
    shown = texts.place_name(F.col("name"), F.col("name_kind"), F.col("category"), F.col("floor_id"), F.col("__ja"), F.col("__en"), locale)
    p = p.select("id", "floor_id", "area_id", texts.translated(F.col("__aja"), F.col("__aen"), F.col("area_id"), locale).alias("area"), "category", shown.alias("name"))
    key = ["floor_id", "area_id", "category"]
    order = [scalars.floor_elevation(F.col("floor_id")), F.collate("area", "ja"), F.collate(texts.category_name(F.col("category"), locale), locale), *key]
    g = ranked(p.select(*key, "area").distinct(), order).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("nth").alias("group_no"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return ranked(p, [F.collate("name", locale), F.col("id")], tuple(key)).join(g, same).select("group_no", *key[:2], "area", "category", "nth", "id", "name")


def statistics(places: DataFrame) -> DataFrame:
    """One row: places, unique_names, and the count of each confidence."""
    level = [F.count(F.when(F.col("confidence") == c, 1)).alias(c) for c in ("high", "medium", "low")]
    return places.agg(F.count(F.lit(1)).alias("places"), F.count_distinct("name").alias("unique_names"), *level)


def component_counts(places: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id, n: places by the part of the network that their node_id belongs to."""
    part = component_numbers(nodes, edges).withColumnRenamed("id", "node_id")
    return places.select("node_id").join(part, "node_id").groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))


def index_statistics(terms: DataFrame) -> DataFrame:
    """One row: places, terms, distinct_terms of a search index."""
    return terms.agg(F.count_distinct("id").alias("places"), F.count(F.lit(1)).alias("terms"), F.count_distinct("term").alias("distinct_terms"))
