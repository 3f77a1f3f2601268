"""Reports on data as it comes: categories by geometry, floor and area; network documents that may be broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .building import resolved
from .graph import stored

TOLERANCE_M = 0.1  # between the end of a link's line and its node
NODE = "id string, floor_id string, ordinal double, x double, y double, z double"
LINK = "id string, from_id string, to_id string, floor_from string, floor_to string, validated boolean, points array<struct<x: double, y: double, z: double>>"
_ISSUE = ["severity", "code", "source_id", "n", "raw"]


def category_facts(features: DataFrame) -> DataFrame:
    """layer, code, known, role, records, named, malformed, and maps of counts: geometry_types (Null where there is none),
    floors, areas ((missing) where there is none); a missing category is ``(missing)``.

    features: layer, category, name, geometry_type, floor_id, area. One scan counts by all five keys, and grouping sets fold
    those counts, so that a hot category meets in few rows. The maps have an entry a type, floor and area.
    """
    code = scalars.category_code(F.col("category"))
    f = features.select("layer", F.when(F.coalesce(code, F.lit("")) == "", "(missing)").otherwise(code).alias("code"), F.coalesce("geometry_type", F.lit("Null")).alias("geometry_types"), F.coalesce("floor_id", F.lit("(missing)")).alias("floors"), F.coalesce("area", F.lit("(missing)")).alias("areas"), (F.trim("name") != "").alias("has_name"))
    kinds = ["geometry_types", "floors", "areas"]
    fine = f.groupBy("layer", "code", *kinds).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_name"), 1)).alias("named"))
    sets = fine.groupingSets([["layer", "code", k] for k in kinds], "layer", "code", *kinds).agg(F.sum("n").alias("n"), F.sum("named").alias("named"))
    entries = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("key"), "n"))))).alias(k)
    shape = F.col("geometry_types")  # each record is in one row of each set
    total = lambda v, when: F.coalesce(F.sum(F.when(when, F.col(v))), F.lit(0))
    d = sets.groupBy("layer", "code").agg(total("n", shape.isNotNull()).alias("records"), total("named", shape.isNotNull()).alias("named"), total("n", shape == "Null").alias("malformed"), *map(entries, kinds))
    looked = resolved(d.select("layer", F.col("code").alias("category"))).select("layer", F.col("category").alias("code"), "known", "role")
    return d.join(looked, ["layer", "code"])


def category_totals(facts: DataFrame) -> DataFrame:
    """layer, features, categories, missing_category, missing_floor, unknown_codes (sorted) of category_facts."""
    missing = F.col("code") == "(missing)"
    no_floor = F.coalesce(F.try_element_at("floors", F.lit("(missing)")), F.lit(0))
    return facts.groupBy("layer").agg(F.sum("records").alias("features"), F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum(F.when(missing, F.col("records"))), F.lit(0)).alias("missing_category"), F.sum(no_floor).alias("missing_floor"), F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("code")))).alias("unknown_codes"))


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """value and the fields of JSON records (value string), with problem: malformed (no JSON, or a field of another type),
    missing-<field>, no-line (fewer than two points), or null. Nothing is dropped."""
    d = raw.select("value", F.from_json("value", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"}).alias("r")).select("value", "r.*")
    fields = [c for c in d.columns if c not in ("value", "__broken")]
    problem = F.coalesce(F.when(F.col("__broken").isNotNull() | F.col("value").isNull(), "malformed"), *[F.when(F.col(c).isNull(), f"missing-{c}") for c in fields])
    if "points" in fields:
        problem = F.coalesce(problem, F.when(F.size("points") < 2, "no-line"))
    return d.withColumn("problem", problem).drop("__broken")


def _issue(d: DataFrame, severity: str, code: str, n: Column | None = None, source: Column | None = None, raw: Column | None = None) -> DataFrame:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    return d.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (text if source is None else source).alias("source_id"), (number if n is None else n.cast("long")).alias("n"), (text if raw is None else raw).alias("raw"))


def _repeated(d: DataFrame, code: str) -> DataFrame:
    extra = d.agg((F.count("id") - F.count_distinct("id")).alias("n")).where("n > 0")
    return _issue(extra, "error", code, F.col("n"))


def document_issues(raw_nodes: DataFrame, raw_links: DataFrame, floors: dict[float, str], stated: dict[str, int], coverage: str = "full-source") -> DataFrame:
    """severity, code, source_id, n, raw of a network document given as JSON records (value): no error, no more than warnings.

    If a record doesn't fit the schema (NODE, LINK), that is a schema-validation error with the record itself (raw) and its
    problem as source, and beside it there are only preflight counts over what can be read: duplicate-nodes,
    duplicate-edges, invalid-reference. Otherwise: those two counts, floor-assignment (a count of nodes whose floor isn't that
    of their ordinal in ``floors``), and by link invalid-reference, edge-floor-assignment, disabled-source-link and
    endpoint-misalignment (n in millimetres; ends in either orientation). stated: boundary_links, components and isolated_nodes
    of the document's header; boundary links are an error in a full source and a warning elsewhere, the others warnings.
    Of nodes that share an id the smallest row counts. An empty document has no issues but those stated.
    """
    nodes, links = stored(parsed(raw_nodes, NODE)), stored(parsed(raw_links, LINK))
    found = [_repeated(nodes, "duplicate-nodes"), _repeated(links, "duplicate-edges")]
    broken = nodes.select("value", "problem").unionByName(links.select("value", "problem")).where("problem is not null")
    if broken.limit(1).count():
        known = nodes.where("id is not null").select("id").distinct().withColumn("here", F.lit(True))
        end = lambda c: known.withColumnsRenamed({"id": c, "here": f"{c}_here"})
        lost = links.join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left").where("from_id_here is null or to_id_here is null")
        found.append(_issue(lost.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "error", "invalid-reference", F.col("n")))
        found.append(_issue(broken, "error", "schema-validation", source=F.col("problem"), raw=F.col("value")))
        return reduce(DataFrame.unionByName, found)
    fits = F.coalesce(*[F.when(F.col("ordinal") == o, F.col("floor_id") == f) for o, f in floors.items()], F.lit(False))
    found.append(_issue(nodes.agg(F.count(F.when(~fits, 1)).alias("n")).where("n > 0"), "error", "floor-assignment", F.col("n")))
    at = nodes.groupBy("id").agg(F.min(F.struct("floor_id", "x", "y", "z")).alias("at"))
    d = links.join(at.withColumnsRenamed({"id": "from_id", "at": "a"}), "from_id", "left").join(at.withColumnsRenamed({"id": "to_id", "at": "b"}), "to_id", "left")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    off = lambda p, q: F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0)))
    a, b = F.col("a"), F.col("b")
    offset = F.least(F.greatest(off(a, first), off(b, last)), F.greatest(off(a, last), off(b, first)))
    lost = a.isNull() | b.isNull()
    rule = lambda when, code, n=None: F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(None) if n is None else n).cast("long").alias("n")))
    rules = F.array_compact(F.array(
        rule(lost, "invalid-reference"),
        rule(~lost & ((F.col("floor_from") != a.floor_id) | (F.col("floor_to") != b.floor_id)), "edge-floor-assignment"),
        rule(~lost & ~F.col("validated"), "disabled-source-link"),
        rule(~lost & (offset > TOLERANCE_M), "endpoint-misalignment", scalars.millimetres(offset)),
    ))
    each = d.select("id", F.explode(rules).alias("i"))
    found.append(each.select(F.lit("error").alias("severity"), "i.code", F.col("id").alias("source_id"), "i.n", F.lit(None).cast("string").alias("raw")))
    heads = [("boundary_links", 0, "boundary-links", "error" if coverage == "full-source" else "warning"), ("components", 1, "disconnected-components", "warning"), ("isolated_nodes", 0, "isolated-nodes", "warning")]
    rows = [(severity, code, None, stated[k], None) for k, most, code, severity in heads if stated.get(k, 0) > most]
    found.append(d.sparkSession.createDataFrame(rows, "severity string, code string, source_id string, n long, raw string"))
    return reduce(DataFrame.unionByName, [f.select(*_ISSUE) for f in found])


def header_issues(raw: DataFrame, keys: dict[str, list[str]], expected: dict[str, str | float], counts: dict[str, str], bounds: dict[str, list[str]]) -> DataFrame:
    """source_id, code, level, key, n: where whole JSON documents (source_id, value) differ from what they have to be.

    keys: the exact keys of the objects at a path (``$``, ``$.axes``, or each element of an array: ``$.nodes[*]``), told by
    missing-key, unsupported-key (n: elements) and not-an-object; expected: values at paths (header-mismatch); counts: paths of
    numbers that an array at another path must have as length (count-mismatch); bounds: axes of objects with
    min<axis> and max<axis>, in order (bounds-order, also where one is no number). Text that is no JSON, or has a key twice
    in an object, is malformed and nothing else; a null document as well.
    """
    d = raw.withColumn("v", F.try_parse_json("value"))
    at = lambda path, kind="variant": F.try_variant_get("v", path, kind)
    is_text = lambda path: F.schema_of_variant(at(path)) == "STRING"
    own = lambda e, path: F.map_keys(F.try_variant_get(e, path, "map<string, variant>"))  # noqa: E731  null: no object
    issue = lambda code, level, key=None, n=1: F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), (F.lit(None).cast("string") if key is None else key).alias("key"), F.lit(n).cast("long").alias("n"))
    named = lambda code, level: lambda k: issue(code, level, k)
    found = []
    for i, (level, names) in enumerate(keys.items()):
        each = F.transform(at(level[:-3], "array<variant>"), lambda e: own(e, "$")) if level.endswith("[*]") else F.array(own("v", level))
        each = F.coalesce(each, F.array(F.lit(None).cast("array<string>")))
        d = d.withColumn(f"__keys{i}", each)  # columns of their own: computed once, not wherever they are named
        objects, others = F.filter(F.col(f"__keys{i}"), lambda e: e.isNotNull()), F.size(F.filter(F.col(f"__keys{i}"), lambda e: e.isNull()))
        required = F.array(*map(F.lit, names))
        sides = [("missing-key", F.transform(objects, lambda e: F.array_except(required, e))), ("unsupported-key", F.transform(objects, lambda e: F.array_except(e, required)))]
        for code, lists in sides:
            found.append(F.transform(F.flatten(lists), named(code, level)))
        found.append(F.when(others > 0, F.array(F.struct(F.lit("not-an-object").alias("code"), F.lit(level).alias("level"), F.lit(None).cast("string").alias("key"), others.cast("long").alias("n")))))
    for path, value in expected.items():
        same = is_text(path) & (at(path, "string") == value) if isinstance(value, str) else ~is_text(path) & (at(path, "double") == value)
        found.append(F.when(~F.coalesce(same, F.lit(False)), F.array(issue("header-mismatch", path))))
    for path, array in counts.items():
        same = (at(path, "long") == F.size(at(array, "array<variant>"))) & ~is_text(path)
        found.append(F.when(~F.coalesce(same, F.lit(False)), F.array(issue("count-mismatch", path))))
    for path, axes in bounds.items():
        for axis in axes:
            in_order = at(f"{path}.min{axis}", "double") <= at(f"{path}.max{axis}", "double")
            found.append(F.when(~F.coalesce(in_order, F.lit(False)), F.array(issue("bounds-order", path, F.lit(axis)))))
    none = F.array().cast("array<struct<code: string, level: string, key: string, n: long>>")
    every = F.when(F.col("v").isNull(), F.array(issue("malformed", "$"))).otherwise(F.flatten(F.array(*[F.coalesce(f, none) for f in found])))
    each = d.select("source_id", F.explode(every).alias("i")).select("source_id", "i.*")
    return each.groupBy("source_id", "code", "level", "key").agg(F.sum("n").alias("n"))
