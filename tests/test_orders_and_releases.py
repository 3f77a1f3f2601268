"""Ties in reading order, far nodes against brute force, profiles of large fields, releases, promotions, warnings."""

import math
import random

from pyspark.sql import functions as F

from wayfold.functions import categories
from wayfold.operators import graph, guidance, markers, places, quality, rules, spatial, translations

READ = ["a", "a-b", "a:reverse", "ab", "B"]  # the order in which readers look for these; bytes put B first
EDGE = "id string, from_id string, to_id string, direction string, kind string"


def test_ties_follow_the_reading_order(spark):
    n = spark.createDataFrame([(i, "0", 1.0, 0.0) for i in ["B", "ab", "a:reverse", "a-b"]], "id string, floor_id string, x double, z double")
    p = spark.createDataFrame([("near", "0", 1.0, 0.0), ("far", "0", 90000.0, 0.0)], "id string, floor_id string, x double, z double")
    assert {r.id: r.node_id for r in spatial.nearest_node(p, n).collect()} == {"near": "a-b", "far": "a-b"}
    assert spatial.nearest_within(p.where("id = 'near'"), n).first().place_id == "a-b"
    m = n.withColumn("category", F.lit("F001"))
    assert {r.id for r in places.flag_duplicates(m).collect() if not r.duplicate} == {"a-b"}
    spread = spark.createDataFrame([(i, "0", 100.0 * k, 0.0) for k, i in enumerate(READ[::-1])], n.schema)
    assert [r.id for r in places.declutter(spread, F.lit(1), 1.0).collect()] == READ
    e = spark.createDataFrame([("1", "B", "ab"), ("2", "a:reverse", "a-b")], "id string, from_id string, to_id string")
    assert [(r.component_id, r.root) for r in graph.component_report(e).orderBy("component_id").collect()] == [(1, "a-b"), (2, "ab")]
    nodes = spark.createDataFrame([(i,) for i in READ], "id string")
    assert {r.id: r.component_id for r in graph.component_numbers(nodes, e).collect()} == {"a": 0, "a-b": 1, "a:reverse": 1, "ab": 2, "B": 2}


def test_nearest_node_far_away_is_that_of_all_nodes(spark):
    r = random.Random(3)
    nodes = [(f"n{i}", str(i % 3), r.uniform(-400, 400), r.uniform(-400, 400)) for i in range(900)]
    asks = [(f"p{i}", str(i % 4), r.choice([-1, 1]) * 10 ** r.uniform(1, 6.5), r.choice([-1, 1]) * 10 ** r.uniform(1, 6.5)) for i in range(120)]
    asks += [("null", "0", None, 1.0), ("nan", "0", float("nan"), 1.0), ("infinite", "0", float("inf"), 1.0)]
    schema = "id string, floor_id string, x double, z double"
    got = {x.id: (x.node_id, x.distance_m) for x in spatial.nearest_node(spark.createDataFrame(asks, schema), spark.createDataFrame(nodes, schema)).collect()}
    assert len(got) == len(asks)
    for i, floor, x, z in asks:
        want = min(((math.sqrt((x - a) ** 2 + (z - b) ** 2), k) for k, f, a, b in nodes if f == floor), default=(None, None)) if x is not None and math.isfinite(x) else (None, None)
        assert got[i][0] == want[1] and (want[0] is None or abs(got[i][1] - want[0]) < 1e-6), i


def test_profile_ranks_large_fields_alone(spark):
    pairs = spark.createDataFrame([("big", str(i % 60)) for i in range(200)] + [("small", str(i % 20)) for i in range(40)] + [("none", None)], "field string, value string")
    out = quality.profile(pairs)
    rows = out.collect()
    assert sum(r.field == "big" for r in rows) == 12 and sum(r.field == "small" for r in rows) == 20
    assert [(r.nulls, r.value) for r in rows if r.field == "none"] == [(1, None)]
    assert sorted(r.value for r in rows if r.field == "big") == sorted(sorted(map(str, range(20)))[:12])
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_promotions(spark):
    f = spark.createDataFrame([("Facility", " f001"), ("Facility", "F003"), ("Facility", "F016"), ("Facility", "F777"), ("Facility", None), ("Space", "F001")], "layer string, category string")
    got = {r.code: (r.features, r.destination, r.category, r.excluded) for r in markers.promotions(f).collect()}
    assert got["F001"] == (1, True, "toilet", None) and got["F003"] == (1, True, None, categories.NOT_A_PLACE)
    assert got["F016"] == (1, False, None, None) and got["F777"] == (1, False, None, None) and len(got) == 5


def test_release_counts(spark):
    row = "status string, source string"
    t = spark.createDataFrame([("reviewed", "a"), ("pending", "b"), ("pending", "b")], row)
    areas = spark.createDataFrame([("reviewed", "c")], row)
    stated = translations.release_statistics(t, areas)
    got = {(r.section, r.key): r.n for r in stated.collect()}
    assert got == {("records", "places"): 3, ("records", "areas"): 1, ("status", "specification"): 0, ("status", "reviewed"): 2, ("status", "pending"): 2, ("source", "a"): 1, ("source", "b"): 2, ("source", "c"): 1}
    assert translations.release_issues(stated, t, areas).count() == 0
    bad = stated.where("key != 'a'").withColumn("n", F.when(F.col("key") == "b", 5).otherwise(F.col("n"))).union(spark.createDataFrame([("source", "d", 0)], "section string, key string, n long"))
    assert {(r.key, r.declared, r.computed, r.problem) for r in translations.release_issues(bad, t, areas).collect()} == {("source.a", None, 1, "extra"), ("source.b", 5, 2, "wrong"), ("source.d", 0, None, "missing")}
    assert {r.n for r in translations.release_statistics(t.limit(0), areas.limit(0)).collect()} == {0}


def test_warning_texts(spark):
    fields = spark.createDataFrame([(1, ["vertical-slope", "width"]), (2, ["width"])], "request_id int, fields array<string>")
    access = spark.createDataFrame([(1, ["p", "q"]), (3, ["q"])], "request_id int, place_ids array<string>")
    names = spark.createDataFrame([("p", "Gate", "改札")], "id string, en string, ja string")
    got = {(r.request_id, r.warning_no): (r.en, r.ja) for r in guidance.warning_texts(fields, access, names).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1)}
    assert got[1, 1][0] == "Accessibility data is incomplete for: vertical-slope, width. Unknown segments are allowed by policy."
    assert got[1, 2][0].endswith("access at: Gate, q.") and got[1, 2][1].endswith("改札、q。")


def test_slice_warnings(spark):
    p = spark.createDataFrame([("a", 1.0, -2000.1), ("a", 0.0, 0.0), ("b", 2000.0, 0.0), ("c", None, None)], "area string, x double, z double")
    assert [(r.source_id, r.code) for r in rules.slice_warnings(p, "area").collect()] == [("a", "outside-slice")]
