"""Names of places and areas in two languages: explicit records, names that the category tables give, what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, texts
from . import quality

STATUSES = ["specification", "reviewed", "pending"]
ALIASES = ["aliases_ja", "aliases_en"]
# Codes of spaces whose category names them.
LAVATORIES = ["B007", "B008", "B010", "B011"]


def _no_aliases() -> Column:
    return F.array().cast("array<string>")


def _with_aliases(records: DataFrame) -> DataFrame:
    return records if set(ALIASES) <= set(records.columns) else records.withColumns({a: _no_aliases() for a in ALIASES})


def translate(places: DataFrame, explicit: DataFrame) -> DataFrame:
    """id, ja, en, status, source, aliases_ja, aliases_en of each place: its explicit record, else the category's name
    (of a lavatory space, or with the number that a facility's generated name ends in), else pending with its own name
    only. A name that the category table gives has the table's names as aliases. places: id, name, name_kind, code and
    perhaps layer (else all are facilities); explicit: id, ja, en, status, source and perhaps both aliases (one row an
    id; null aliases are none)."""
    given = _with_aliases(explicit).select("id", "ja", "en", "status", "source", *ALIASES)
    p = places.join(given, "id", "left")
    layer = F.col("layer") if "layer" in places.columns else F.lit("Facility")
    space = {r[1]: r for r in categories.category_rows() if r[0] == "Space" and r[1] in LAVATORIES}
    space_ja, space_en = (categories.looked_up(F.col("code"), {c: r[i] for c, r in space.items()}) for i in (2, 3))
    lavatory = F.coalesce((layer == "Space") & space_ja.isNotNull(), F.lit(False))
    ja, en = categories.name_ja(F.col("code")), categories.name_en(F.col("code"))
    fits = F.coalesce((layer == "Facility") & (F.col("name_kind") == "generated-category") & F.col("name").startswith(ja), F.lit(False))
    numbered = F.concat(en, F.substring(F.col("name"), F.length(ja) + 1, F.length("name")))
    made = F.when(lavatory, space_en).when(fits, numbered)
    known, none = F.col("status").isNotNull(), _no_aliases()
    also_ja = F.when(lavatory & (F.col("name") != space_ja), F.array(space_ja)).when(fits & ~lavatory, F.array(ja))
    also_en = F.when(fits & ~lavatory, F.array(en))
    return p.select(
        "id",
        F.coalesce("ja", "name").alias("ja"),
        F.when(known, F.col("en")).otherwise(made).alias("en"),
        F.coalesce("status", F.when(made.isNotNull(), STATUSES[0]).otherwise(STATUSES[2])).alias("status"),
        F.coalesce("source", F.when(made.isNotNull(), "category-table").otherwise("authoritative-japanese-fallback")).alias("source"),
        F.coalesce(F.when(known, F.col(ALIASES[0])).otherwise(also_ja), none).alias(ALIASES[0]),
        F.coalesce(F.when(known, F.col(ALIASES[1])).otherwise(also_en), none).alias(ALIASES[1]),
    )


def coverage(translated: DataFrame) -> DataFrame:
    """status, source, n."""
    return translated.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))


def pending(translated: DataFrame) -> DataFrame:
    """id of each record that has no reviewed English text yet."""
    return translated.where(F.col("status") == STATUSES[2]).select("id")


def coverage_report(places: DataFrame, translated: DataFrame, areas: DataFrame) -> DataFrame:
    """section (routable-places, facility-markers, permanent-labels, public-areas), covered, english, total: of the
    routable places and their areas, those with a record, and those with English text. places: id, layer, category, area,
    routable; translated, areas: id, en (one row an id)."""
    have = lambda t, key: t.select(F.col("id").alias(key), F.lit(True).alias("found"), F.col("en").isNotNull().alias("in_en"))
    p = places.where("routable")
    kinds = [F.lit("routable-places"), F.when(F.col("layer") == "Facility", "facility-markers"), F.when(F.col("category") == "gate", "permanent-labels")]
    of_places = p.join(have(translated, "id"), "id", "left").select(F.explode(F.array_compact(F.array(*kinds))).alias("section"), "found", "in_en")
    of_areas = p.select("area").distinct().join(have(areas, "area"), "area", "left").select(F.lit("public-areas").alias("section"), "found", "in_en")
    count = lambda c: F.count(F.when(F.col(c), 1))
    return of_places.unionByName(of_areas).groupBy("section").agg(count("found").alias("covered"), count("in_en").alias("english"), F.count(F.lit(1)).alias("total"))


def release_statistics(places: DataFrame, areas: DataFrame) -> DataFrame:
    """section, key, n: the counts that a release of both tables of records states: records of places and areas, and of
    both together by status (each of them, also with 0) and by source."""
    both = places.select(F.lit("places").alias("side"), "status", "source").unionByName(areas.select(F.lit("areas").alias("side"), "status", "source"))
    pair = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    counts = both.select(F.explode(F.array(pair("records", F.col("side")), pair("status", F.col("status")), pair("source", F.col("source")))).alias("p"))
    counts = counts.groupBy("p.section", "p.key").agg(F.count(F.lit(1)).alias("n"))
    must = [pair("records", F.lit(x)) for x in ("places", "areas")] + [pair("status", F.lit(x)) for x in STATUSES]
    none = places.sparkSession.range(1).select(F.explode(F.array(*must)).alias("p")).select("p.section", "p.key", F.lit(0).cast("long").alias("n"))
    return counts.unionByName(none).groupBy("section", "key").agg(F.sum("n").alias("n"))


def release_issues(declared: DataFrame, places: DataFrame, areas: DataFrame) -> DataFrame:
    """key (section.key), declared, computed, problem of the stated counts (section, key, n) that the records don't bear
    out: wrong, missing (no such records), extra (records that no count states)."""
    named = lambda df: df.select(F.concat_ws(".", "section", "key").alias("key"), "n")
    return quality.reconcile(named(declared), named(release_statistics(places, areas)), "key", "n")


def broken(translated: DataFrame) -> DataFrame:
    """source_id, code: English missing though not pending, or present though pending; ids that repeat."""
    t = F.col("status") == STATUSES[2]
    rules = [F.when(~t & F.col("en").isNull(), "english-missing"), F.when(t & F.col("en").isNotNull(), "english-of-pending"), F.when(~F.col("status").isin(STATUSES), "status-unknown")]
    found = translated.select(F.col("id").alias("source_id"), F.explode(F.array_compact(F.array(*rules))).alias("code"))
    return found.unionByName(quality.repeated(translated, "id"))


def record_issues(records: DataFrame, wanted: DataFrame, areas: bool = False) -> DataFrame:
    """source_id, code: what the records of places (or areas) break against the names they must follow. Beside the rules
    of ``broken``: ids that aren't wanted or have no record; Japanese text that isn't the wanted name (a reviewed area
    may drop its number and set its parts apart); texts and sources of blanks; aliases of blanks or given twice.
    records: as ``translate`` gives them; wanted: id, name (one row an id)."""
    r = records.join(wanted.select("id", F.col("name").alias("wanted")), "id", "left")
    known = F.col("wanted").isNotNull()
    same = F.col("ja") == F.col("wanted")
    if areas:
        same |= (F.col("status") == "reviewed") & (F.col("ja") == texts.clean_area(F.col("wanted")))
    filled = lambda a: F.coalesce(F.forall(a, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(True))
    once = lambda a: F.coalesce(F.size(F.array_distinct(a)) == F.size(a), F.lit(True))
    rules = {
        "id-unknown": known,
        "japanese-missing": F.trim("ja") != "",
        "japanese-not-authoritative": ~known | same,
        "english-blank": F.col("en").isNull() | (F.trim("en") != ""),
        "source-missing": F.trim("source") != "",
        "alias-blank": filled(ALIASES[0]) & filled(ALIASES[1]),
        "alias-twice": once(F.col(ALIASES[0])) & once(F.col(ALIASES[1])),
    }
    left_out = wanted.join(records.select("id"), "id", "left_anti").select(F.col("id").alias("source_id"), F.lit("record-missing").alias("code"))
    return quality.issues(r, "id", rules).unionByName(broken(records)).unionByName(left_out)
