"""Hand-made graphs, places, geometry and binary files."""

import heapq
import random
import struct

from pyspark.sql import Row
from pyspark.sql import functions as F

from wayfold.functions import geometry, scalars
from wayfold.operators import graph, places, quality, routing, spatial
from wayfold.sources import shapes

EDGE = "id string, from_id string, to_id string, direction string, kind string, distance_m double, geometry_m double, accessibility string, floor_from string, floor_to string"


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, d, k, float(m), float(m), acc, x, y) for i, a, b, d, k, m, acc, x, y in rows], EDGE)


def profile_graph(spark):
    return edges(spark, [
        ("short-stairs", "s", "stairs", "both", "stairs", 1, "no", "B1", "0"), ("stairs-goal", "stairs", "g", "both", "corridor", 1, "yes", "0", "0"),
        ("accessible-lift", "s", "lift", "both", "elevator", 4, "yes", "B1", "0"), ("lift-goal", "lift", "g", "both", "corridor", 4, "unknown", "0", "0"),
    ])


def test_profiles(spark):
    a = graph.profile_arcs(profile_graph(spark))
    asked = spark.createDataFrame([(p, "s", "g") for p in graph.PROFILES], "profile string, source string, node string")
    state = routing.shortest(a, asked.select("profile", F.col("source").alias("node_id")))
    got = {r.profile: r.edge_ids for r in routing.reconstruct(asked, state).collect()}
    lift = ["accessible-lift", "lift-goal"]
    assert got["shortest"] == ["short-stairs", "stairs-goal"]
    assert got["accessible"] == got["avoid-stairs"] == got["prefer-elevator"] == lift


def test_arcs_and_unreachable(spark):
    e = edges(spark, [("ab", "a", "b", "both", "corridor", 1, "unknown", "B1", "B1"), ("bc", "b", "c", "forward", "corridor", 1, "yes", "B1", "B1"), ("ad", "a", "d", "both", "elevator", 4, "yes", "B1", "1")])
    assert sorted(r.id for r in graph.arcs(e).collect()) == ["ab", "ab:reverse", "ad", "ad:reverse", "bc"]
    a = graph.profile_arcs(e).where("profile = 'shortest'")
    asked = spark.createDataFrame([("shortest", "a", "c"), ("shortest", "c", "a"), ("shortest", "d", "b"), ("shortest", "a", "a")], "profile string, source string, node string")
    state = routing.shortest(a, asked.select("profile", F.col("source").alias("node_id")))
    got = {(r.source, r.node): r for r in routing.reconstruct(asked, state).collect()}
    assert got["a", "c"].node_ids == ["a", "b", "c"] and got["c", "a"].node_ids is None
    assert got["d", "b"].node_ids == ["d", "a", "b"] and got["d", "b"].distance_m == 5
    assert got["a", "a"].node_ids == ["a"] and got["a", "a"].edge_ids == []


def test_random_graph_against_dijkstra(spark):
    r = random.Random(4)
    rows = [(f"e{i}", f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.choice(["both", "forward", "reverse"]), r.choice(["corridor", "stairs", "elevator"]), r.randrange(1, 50), r.choice(["yes", "no", "unknown"]), r.choice("01"), r.choice("01")) for i in range(70)]
    arcs = graph.profile_arcs(edges(spark, rows))
    near = {}
    for a in arcs.collect():
        near.setdefault((a.profile, a.from_id), []).append((a.to_id, a.cost))
    sources = spark.createDataFrame([(p, f"n{i}") for p in graph.PROFILES for i in (0, 1)], "profile string, node_id string")
    got = {(x.profile, x.source, x.node): x.cost for x in routing.shortest(arcs, sources).collect()}
    want = {}
    for p in graph.PROFILES:
        for s in ("n0", "n1"):
            heap, seen = [(0.0, s)], {}
            while heap:
                c, n = heapq.heappop(heap)
                if n not in seen:
                    seen[n] = c
                    for m, k in near.get((p, n), []):
                        heapq.heappush(heap, (c + k, m))
            want |= {(p, s, n): c for n, c in seen.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_components(spark):
    e = spark.createDataFrame([("ab", "a", "b"), ("cd", "d", "c"), *[(f"l{i}", f"x{i:03}", f"x{i + 1:03}") for i in range(40)]], "id string, from_id string, to_id string")
    got = [(r.component_id, r.root, r.size) for r in graph.component_report(e).orderBy("component_id").collect()]
    assert got == [(1, "x000", 41), (2, "a", 2), (3, "c", 2)]


def test_nearest_node_falls_back_and_breaks_ties(spark):
    p = spark.createDataFrame([("p", "0", 0.0, 0.0), ("far", "0", 5000.0, 0.0), ("none", "9", 0.0, 0.0)], "id string, floor_id string, x double, z double")
    n = spark.createDataFrame([("b", "0", 1.0, 0.0), ("a", "0", -1.0, 0.0)], "id string, floor_id string, x double, z double")
    got = {r.id: (r.node_id, r.distance_m) for r in spatial.nearest_node(p, n).collect()}
    assert got == {"p": ("a", 1.0), "far": ("b", 4999.0), "none": (None, None)}


def test_scalars(spark):
    d = spark.createDataFrame([Row(f=f) for f in ["-1", "b1", "2out", " 3 ", "x"]])
    assert [r[0] for r in d.select(scalars.normalize_floor(F.col("f"))).collect()] == ["B1", "B1", "2out", "3", "X"]
    assert [r[0] for r in d.select(scalars.floor_elevation(F.col("f"))).collect()] == [-5.0, -5.0, 10.0, 15.0, 0.0]
    t = spark.createDataFrame([Row(t=t) for t in ["  CENTRAL   East ", "ＡＢＣ", None]])
    assert [r[0] for r in t.select(scalars.search_text(F.col("t"))).collect()] == ["central east", "abc", None]
    n = spark.createDataFrame([Row(t=t) for t in ["不明", "A1", "12", " East gate ", ""]])
    assert [r[0] for r in n.select(scalars.clear_label(F.col("t"))).collect()] == [None, None, None, "East gate", None]
    j = spark.range(1).select(scalars.journey_seconds(F.lit(72.0), F.array().cast("array<string>")), scalars.journey_seconds(F.lit(120.0), F.array(F.lit("elevator"))), scalars.signed_turn(F.lit(170.0), F.lit(-170.0)), scalars.signed_turn(F.lit(0.0), F.lit(180.0))).first()
    assert list(j) == [60, 145, 20.0, 180.0]
    f = spark.createDataFrame([(-1.0,), (-2.5,), (3.0,)], "o double").select(scalars.floor_of_ordinal(F.col("o"))).collect()
    assert [r[0] for r in f] == ["B1", "B2.5", "3"]


def test_geometry(spark):
    pt = lambda x, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z"))
    line = F.array(pt(0, 0), pt(4, 0), pt(10, 0))
    m = spark.range(1).select(geometry.midpoint(line)).first()[0]
    assert (m.x, m.z) == (5.0, 0.0)
    one = spark.range(1).select(geometry.midpoint(F.array(pt(3, 4)))).first()[0]
    assert (one.x, one.z) == (3.0, 4.0)


def test_search_and_rules(spark):
    p = spark.createDataFrame([("1", "East Gate"), ("2", "Toilet A"), ("3", None)], "id string, name string")
    q = spark.createDataFrame([("gate",), ("t",), ("zz",), ("et a",)], "query string")
    got = {(r.query, r.id) for r in places.search(places.search_terms(p, "name"), q).collect()}
    assert got == {("gate", "1"), ("t", "1"), ("t", "2"), ("et a", "2")}
    i = quality.issues(p, "id", {"named": F.col("name").isNotNull(), "short": F.length("name") < 9})
    assert sorted((r.source_id, r.code) for r in i.collect()) == [("1", "short"), ("3", "named"), ("3", "short")]
    assert quality.same_rows(p, p) and not quality.same_rows(p, p.limit(1))


def test_search_brute_force(spark):
    words = ["gate", "gates", "ga", "g", "", "agate west", "west gate", "改札", "北改札口", "gategate"]
    terms = [(f"p{i}", words[(i * 7 + j) % len(words)]) for i in range(40) for j in range(3)]
    asked = ["gate", "gat", "te w", "ate", "g", "ga", "改", "札口", "改札口", "gatx", "zzz", "", "gates"]
    t = spark.createDataFrame(terms, "id string, term string")
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    want = {(x, i) for x in asked if x for i, w in terms if x in w}
    assert sorted(map(tuple, places.search(t, q).collect())) == sorted(want)
    assert places.search(t.limit(0), q).count() == 0 and places.search(t, q.limit(0)).count() == 0


def test_shapes(spark, tmp_path):
    body = struct.pack("<idd", 1, 139.7, 35.69)
    line = struct.pack("<i4d2i1i4d", 3, 0, 0, 2, 2, 1, 2, 0, 0, 0, 2, 2)
    recs = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate([body, line, struct.pack("<i", 0)]))
    (tmp_path / "a.shp").write_bytes(bytes(100) + recs)
    field = b"id\0\0\0\0\0\0\0\0\0C" + bytes(4) + bytes([4, 0]) + bytes(14)
    rows = b" ab  " + b"     " + b" x   "
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 3, 65, 5) + bytes(20) + field + b"\r" + rows)
    got = {r.record: r for r in shapes.features(spark, str(tmp_path)).collect()}
    assert got[1].gtype == "Point" and got[1].parts[0][0].x == 139.7 and got[1].attributes == {"id": "ab"}
    assert [(p.x, p.y) for p in got[2].parts[0]] == [(0, 0), (2, 2)] and got[2].attributes == {"id": None}
    assert got[3].problem == "malformed"
    r = shapes.inspect(spark, str(tmp_path)).first()
    assert r.missing == ["shx", "prj"] and r.feasible
    assert shapes.checksums(spark, str(tmp_path)).count() == 2
