"""Places, guidance networks, ids, numbers in hot groups, texts and rules on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import categories, texts
from wayfold.operators import building, graph, quality, routing, rules
from wayfold.sources import datasets

NODE = "id string, floor_id string, x double, y double, z double"
LAYER = "source_id string, area string, layer string, name string, floor_id string, x double, y double, z double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ranked_hot_and_null_groups(spark):
    d = spark.range(3000).select((F.col("id") * 7 % 3000).alias("n"), F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    want, groups = {}, {}
    for r in sorted(d.collect(), key=lambda r: r.n):
        groups.setdefault(r.g, []).append(r.n)
    for g, ns in groups.items():
        want |= {n: (i + 1, len(ns)) for i, n in enumerate(ns)}
    got = graph.ranked(d, [F.col("n")], ("g",)).collect()
    assert {r.n: (r.nth, r.of) for r in got} == want and len(got) == 3000
    whole = graph.ranked(d, [F.desc("n")]).collect()
    assert {r.n: r.nth for r in whole} == {n: 3000 - n for n in range(3000)} and whole[0].of == 3000
    assert graph.ranked(d.limit(0), [F.col("n")], ("g",)).count() == 0


def test_component_numbers(spark):
    n = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2), ("d", 3)], "id string, place int")
    e = spark.createDataFrame([("a", "d")], "from_id string, to_id string")
    assert {r.id: r.component_id for r in graph.component_numbers(n, e, "place").collect()} == {"b": 0, "c": 1, "a": 2, "d": 2}


def test_named_places(spark):
    rows = [
        ("1", "A", "Opening", " North ", "0", 0.0, 0.0, 0.0), ("2", "A", "Opening", "South", "1", 0.0, 5.0, 0.0), ("3", "A", "Space", "EV_2", "0", 30.0, 0.0, 0.0),
        ("4", "A", "Space", "Shop", "0", 0.0, 0.0, 0.0), ("5", "A", "Opening", "不明", "0", 0.0, 0.0, 0.0), ("6", "A", "Opening", None, "0", 0.0, 0.0, 0.0),
        ("7", "A", "Opening", "Lost", "0", None, None, None), ("8", "A", "Opening", "Deep", "B9", 0.0, 0.0, 0.0), (None, "A", "Opening", "No id", "0", 0.0, 0.0, 0.0),
    ]
    nodes = spark.createDataFrame([("n2", "0", 3.0, 0.0, 4.0), ("n1", "0", -3.0, 0.0, 4.0), ("n3", "1", 1.0, 5.0, 0.0)], NODE)
    own = spark.createDataFrame([("r1", "0", 0.0, 5.0, 0.0), ("r2", "B1", 0.0, 0.0, 0.0)], NODE)
    given = spark.createDataFrame([("gate:2", "r2"), ("gate:1", "r1")], "place_id string, node_id string")
    got = {r.id: r for r in building.named_places(spark.createDataFrame(rows, LAYER), nodes, own, given).collect()}
    assert set(got) == {"gate:1", "gate:2", "elevator:3", "gate:8"}
    assert got["gate:1"].name == "North" and got["gate:1"].node_id == "r1" and got["gate:1"].distance_m == 5.0 and got["gate:1"].reviewed and got["gate:1"].routable
    assert got["gate:2"].problem == "floor-mismatch" and got["gate:8"].problem == "no-node" and not got["gate:8"].routable
    assert got["elevator:3"].node_id == "n2" and got["elevator:3"].confidence == "low" and not got["elevator:3"].routable
    plain = {r.id: r for r in building.named_places(spark.createDataFrame(rows, LAYER), nodes, own.limit(0), given).collect()}
    assert plain["gate:1"].node_id == "n1" and plain["gate:1"].confidence == "high" and not plain["gate:1"].reviewed
    assert building.named_places(spark.createDataFrame([], LAYER), nodes, own, given).count() == 0


def test_connector(spark):
    e = spark.createDataFrame([("e2", "a", "b", "elevator", "0", "1"), ("e1", "b", "c", "elevator", "1", "2"), ("e0", "a", "a", "corridor", "0", "0")], "id string, from_id string, to_id string, kind string, floor_from string, floor_to string")
    n = spark.createDataFrame([("a", "0", 1.0, 0.0, 1.0), ("b", "1", 1.0, 5.0, 1.0), ("c", "2", 1.0, 9.0, 1.0)], NODE)
    got = building.connector(e, n).first()
    assert got.source_id == "e1" and got.problem == "no-ground-end"
    got = building.connector(e, n, "e2").first()
    assert got.id == "connector:e2:0" and got.node_id == "a" and got.problem is None
    assert building.connector(e.limit(0), n).count() == 0


def test_tactile(spark):
    p = spark.createDataFrame([("1", "A", "B1", "B1", " ", "5", 0.0, 0.0, 0.0), ("2", "A", "B1", "B1", "x", "1", 3.0, 0.0, 4.0)], "source_id string, area string, source_floor string, floor_id string, name string, category string, x double, y double, z double")
    n = building.tactile_nodes(p)
    assert {(r.id, r.name, r.kind) for r in n.collect()} == {("A:B1:1", None, "gate"), ("A:B1:2", "x", "normal")}
    a, b = (0.0, 0.0, 0.0), (3.0, 0.0, 4.0)
    lines = [("10", "1", "2", [a, b]), ("11", None, "9", [a]), ("12", "1", None, [a, b]), ("13", "8", "2", [a, b]), ("14", "8", "9", [a, b]), ("15", "1", "2", None)]
    d = spark.createDataFrame([(i, "A", "B1", "B1", s, e, g) for i, s, e, g in lines], "source_id string, area string, source_floor string, floor_id string, start string, end string, points array<struct<x: double, y: double, z: double>>")
    got = {r.source_id: r for r in building.tactile_edges(d, n).collect()}
    assert {k: r.reason for k, r in got.items()} == {"10": None, "11": "malformed-geometry", "12": "missing-end-node", "13": "missing-start-node", "14": "missing-both-nodes", "15": "malformed-geometry"}
    assert got["10"].id == "A:B1:10" and got["10"].distance_m == 5.0


def test_stable_ids(spark):
    d = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("a", 2)], "base_id string, source_record int")
    assert sorted((r.id, r.clash) for r in building.stable_ids(d).collect()) == [("a", False), ("a:2", True), ("a:2", True), ("b", False)]


def test_categories(spark):
    rows = categories.category_rows()
    assert len({r[:2] for r in rows}) == len(rows) and all(len(r) == 7 for r in rows)
    d = spark.createDataFrame([(1, "Space", " b007 "), (2, "Fixture", "B007"), (3, "Space", None)], "id int, layer string, category string")
    got = {r.id: (r.code, r.name_en, r.known) for r in building.resolved(d).collect()}
    assert got == {1: ("B007", "Lavatory (Male)", True), 2: ("B007", "Unknown category", False), 3: ("", "Unknown category", False)}


def test_texts(spark):
    t = lambda c: one(spark, c)
    assert t(texts.floor_name(F.lit("B2"), "ja")) == "地下2階" and t(texts.floor_name(F.lit("B2.5"), "ja")) == "B2.5" and t(texts.floor_name(F.lit("0"), "en")) == "Ground"
    assert t(texts.floor_long_name(F.lit("B1"), "en")) == "Floor B1" and t(texts.floor_long_name(F.lit("0"), "en")) == "Ground floor"
    assert [t(texts.distance(F.lit(x))) for x in (0.25, 0.15, 9.96, 10.5, 1234.0)] == ["0.3 m", "0.1 m", "10.0 m", "11 m", "1234 m"]
    assert t(texts.clean_area(F.lit("12.East_West"))) == "East・West"
    args = [F.lit("source"), F.lit("gate"), F.lit("0"), F.lit(None).cast("string")]
    assert t(texts.place_name(F.lit("EV_1"), *args, F.lit(None).cast("string"), "en")) == "Gate · Ground" and t(texts.place_name(F.lit("North"), *args, F.lit("N"), "ja")) == "North"
    assert t(texts.unverified_access(F.array(F.lit("a"), F.lit("b")), "ja")).endswith("a、b。") and "x, y" in t(texts.unknown_fields(F.array(F.lit("x"), F.lit("y")), "en"))
    assert t(texts.warning_count(F.lit(0), "en")) == "No route warnings." and t(texts.estimate(F.lit(3), "ja")) == "約3分" and t(texts.profile_name(F.lit("shortest"), "ja")) == "最短"
    assert set(texts.MESSAGES["en"]) == set(texts.MESSAGES["ja"])


def test_place_rules(spark):
    n = spark.createDataFrame([("n", "0", 3.0, 9.0, 4.0)], NODE)
    p = spark.createDataFrame([("a", "A", "gate", "0", 0.0, 0.0, 0.0, "n", 5.0, "high", False, True), ("b", "", "den", "1", 0.0, 9.0, 0.0, "n", 5.0, "low", False, True), ("c", "C", "exit", "0", 0.0, 0.0, 0.0, None, -1.0, "high", True, True)], "id string, name string, category string, floor_id string, x double, y double, z double, node_id string, distance_m double, confidence string, reviewed boolean, routable boolean")
    got = {(r.source_id, r.code) for r in rules.place_issues(p, n).collect()}
    assert got == {("b", "name-missing"), ("b", "category-unknown"), ("b", "floor-mismatch"), ("b", "low-but-routable"), ("c", "node-missing"), ("c", "distance-negative")}


def test_request_outcomes(spark):
    places = [("a", True, "1", "yes", 0), ("b", True, "2", "no", 0), ("c", True, "3", "yes", 1), ("d", False, "4", "yes", 0), ("e", True, "5", "yes", 0)]
    p = spark.createDataFrame(places, "id string, routable boolean, node_id string, accessibility string, component_id int")
    ways = [("a", "b", "accessible"), ("b", "b", "accessible"), ("a", "b", "shortest"), ("a", "c", "shortest"), ("a", "d", "shortest"), ("a", "x", "shortest"), ("a", "a", "accessible"), ("a", "e", "avoid-stairs"), ("a", "e", "shortest")]
    r = spark.createDataFrame([(i, *w) for i, w in enumerate(ways)], "request_id int, start_id string, destination_id string, profile string")
    got = {x.request_id: (x.status, x.reason) for x in routing.classify(r, p, bounded=True).collect()}
    assert got[0] == got[1] == ("unreachable", "no-accessible-path") and got[2] == (None, None) and got[6] == ("ok", "already-there")
    assert got[3] == ("outside-coverage", "different-components-in-bounded-extraction") and got[4] == ("invalid-place", "low-confidence-attachment") and got[5] == ("invalid-place", "not-found")
    found = spark.createDataFrame([("shortest", "1", "2", 7.5)], "profile string, start_node string, destination_node string, distance_m double")
    end = {x.request_id: (x.status, x.reason, x.distance_m) for x in routing.outcomes(routing.classify(r, p), found).collect()}
    assert end[2] == ("ok", None, 7.5) and end[6] == ("ok", "already-there", 0.0) and end[7] == ("unreachable", "no-stair-free-path", None) and end[8] == ("unreachable", "no-directed-path", None)
    assert end[3] == ("unreachable", "no-directed-path", None) and end[5][0] == "invalid-place"


def test_datasets(spark, tmp_path):
    d = spark.createDataFrame([(f"{i:03}", i * 37 % 100, None if i % 9 else "x") for i in range(100)][::-1], "id string, n int, name string")
    datasets.write_dataset(d, f"{tmp_path}/a")
    lines = [json.loads(x) for f in sorted((tmp_path / "a").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == sorted(x["id"] for x in lines) and lines[0]["schemaVersion"] == 1 and "name" not in lines[1]
    back = datasets.read_dataset(spark, f"{tmp_path}/a", "id string, n int, name string")
    assert quality.same_rows(d, back) and quality.differences(d, back.where("n != 5")).count() == 1
    (tmp_path / "old.json").write_text('{"id": "a", "schemaVersion": 2}')
    with pytest.raises(Exception, match="unsupported schemaVersion"):
        datasets.read_dataset(spark, f"{tmp_path}/old.json", "id string").collect()
    (tmp_path / "doc.json").write_text(json.dumps({"places": [{"id": "a"}, {"id": "b"}]}, indent=1))
    assert datasets.read_document(spark, f"{tmp_path}/doc.json", "places array<struct<id: string>>", "places").count() == 2
