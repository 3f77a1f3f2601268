"""Whole plans against Dijkstra's method, imports, authored files and file headers."""

import heapq
import json
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import graph, network, routing
from wayfold.plans import network as queries
from wayfold.plans.registry import _edges
from wayfold.sources import files, shapes

DATA = "/root/testdata/sf0.01"  # the smallest size at which ways are found


def dijkstra(near, source):
    cost, todo = {source: 0.0}, [(0.0, source)]
    while todo:
        c, n = heapq.heappop(todo)
        if c == cost[n]:
            for to, more in near.get(n, ()):
                if c + more < cost.get(to, float("inf")):
                    cost[to] = c + more
                    heapq.heappush(todo, (c + more, to))
    return cost


def chain(spark, n):
    rows = [("shortest", f"n{i}", f"n{i + 1}", f"e{i}:reverse" if i % 2 else f"e{i}", 1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "profile string, from_id string, to_id string, id string, cost double, distance_m double")


def test_long_ways_are_whole_or_an_error(spark):
    arcs = chain(spark, 30)
    asked = spark.createDataFrame([("shortest", "n0", "n29"), ("shortest", "n0", "n0"), ("shortest", "n0", "n7"), ("shortest", "n0", "nowhere")], "profile string, source string, node string")
    sources = asked.select("profile", F.col("source").alias("node_id"))
    state = routing.shortest(arcs, sources)
    got = {r.node: r for r in routing.reconstruct(asked, state).collect()}
    assert got["n29"].node_ids == [f"n{i}" for i in range(30)] and got["n29"].edge_ids == [f"e{i}" for i in range(29)]
    assert got["n0"].node_ids == ["n0"] and got["n0"].edge_ids == [] and got["n7"].distance_m == 7
    assert got["nowhere"].node_ids is None
    with pytest.raises(RuntimeError):
        routing.shortest(arcs, sources, max_rounds=5)
    with pytest.raises(RuntimeError):
        routing.reconstruct(asked, state, max_doublings=3)
    pruned = routing.shortest(arcs, sources, goals=asked.where("node = 'n7'"))
    assert pruned.agg(F.max("cost")).first()[0] == 7


def test_plans_against_dijkstra(spark):
    plans = queries.planned(spark, DATA).collect()
    arcs, near = graph.profile_arcs(_edges(spark, DATA)).collect(), {}
    by_arc = {}
    for a in arcs:
        near.setdefault(a.profile, {}).setdefault(a.from_id, []).append((a.to_id, a.cost))
        key = (a.profile, a.id.removesuffix(":reverse"), a.from_id, a.to_id)
        by_arc[key] = min(by_arc.get(key, float("inf")), a.cost)
    p = {r.id: r for r in queries.spatial.nearest_node(queries.table(spark, DATA, "places").select("id", "floor_id", "x", "z"), queries.table(spark, DATA, "nodes")).collect()}
    asked = {r.request_id: r for r in queries.table(spark, DATA, "requests").collect()}
    assert len(plans) == len(asked)
    trees, walked = {}, 0
    for r in plans:
        ask = asked[r.request_id]
        a, b = p.get(ask.start_id), p.get(ask.destination_id)
        if any(x is None or x.node_id is None or x.distance_m > 15 for x in (a, b)):
            assert r.status == "invalid-place"
        elif ask.start_id == ask.destination_id:
            assert (r.status, r.reason, r.node_ids, r.total_m) == ("ok", "already-there", [a.node_id], 0)
        else:
            key = (ask.profile, a.node_id)
            if key not in trees:
                trees[key] = dijkstra(near.get(ask.profile, {}), a.node_id)
            want = trees[key].get(b.node_id)
            assert (r.status == "ok") == (want is not None)
            if want is not None:
                assert r.node_ids[0] == a.node_id and r.node_ids[-1] == b.node_id and len(r.edge_ids) == len(r.node_ids) - 1
                assert abs(sum(by_arc[ask.profile, e, x, y] for e, x, y in zip(r.edge_ids, r.node_ids, r.node_ids[1:])) - want) < 1e-6
                assert abs(r.total_m - r.network_m - r.access_m) < 0.002
                walked += 1
    assert walked


def test_regressions_and_resolution(spark):
    arcs = chain(spark, 4)
    found = spark.createDataFrame([(1, ["n0", "n1", "n2"], ["e0", "e1"])], "request_id int, node_ids array<string>, edge_ids array<string>")
    assert [(r.pos, r.id) for r in network.resolved(found, arcs).orderBy("pos").collect()] == [(0, "e0"), (1, "e1:reverse")]
    lost = spark.createDataFrame([(1, ["n0", "n2"], ["e0"])], found.schema)
    with pytest.raises(Exception, match="no arc e0"):
        network.resolved(lost, arcs).collect()
    schema = "request_id int, status string, total_m double, edge_ids array<string>"
    plan = spark.createDataFrame([(1, "ok", 5.0, ["a"]), (2, "ok", 5.0, ["a"]), (3, "unreachable", None, None)], schema)
    golden = spark.createDataFrame([(1, "ok", 5.0, ["a"]), (2, "ok", 6.0, ["a"]), (3, "ok", 1.0, ["b"]), (4, "ok", 1.0, [])], schema)
    assert {r.request_id: r.problem for r in routing.regressions(plan, golden).collect()} == {2: "distance", 3: "status", 4: "missing"}


def test_legs(spark):
    place = "id string, x double, y double, z double"
    places = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 9.0, 0.0, 1.0)], place)
    nodes = spark.createDataFrame([("s", 0.0, 0.0, 0.0), ("g", 9.0, 0.0, 0.0)], place)
    plan = spark.createDataFrame([(1, "ok", None, "a", "b", ["s", "g"])], "request_id int, status string, reason string, start_id string, destination_id string, node_ids array<string>")
    walk = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0)], "request_id int, pos int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    r = routing.legs(plan, walk, places, nodes).first()
    flat = lambda line: [(p.x, p.z) for p in line]
    assert (flat(r.start_access), flat(r.network), flat(r.destination_access)) == ([(0, 1), (0, 0)], [(0, 0), (9, 0)], [(9, 0), (9, 1)])


def test_polygon_with_a_hole(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    d = spark.createDataFrame([([ring(0.0, 4.0), ring(1.0, 3.0)],)], "rings array<array<struct<x: double, z: double>>>")
    at = lambda x, z: geometry.inside_rings(F.lit(x), F.lit(z), F.col("rings"))
    assert d.select(at(0.5, 0.5), at(2.0, 2.0), at(5.0, 2.0)).first()[:] == (True, False, False)
    p = d.select(geometry.representative_point(F.lit("Polygon"), F.col("rings")[0], F.col("rings")).alias("p")).first().p
    assert min(p.x, p.z) < 1


def test_file_names_and_authored_documents(spark, tmp_path):
    names = spark.createDataFrame([("a\\B_-2_Space.shp",), ("./x/hall_3out_Floor.shp",), ("notes.txt",)], "p string")
    got = [tuple(r.p) for r in names.select(files.path_parts(F.col("p")).alias("p")).collect()]
    assert got == [("B", "B2", "Space"), ("hall", "3out", "Floor"), (None, None, None)]
    assert names.select(files.same_lines(F.lit("a\r\nb\rc"))).first()[0] == "a\nb\nc"
    (tmp_path / "d.json").write_text(json.dumps({"schemaVersion": 1, "nodes": [{"id": "n"}]}))
    schema = "schemaVersion int, nodes array<struct<id: string>>"
    assert files.read_authored(spark, str(tmp_path / "d.json"), schema, "nodes", {"schemaVersion": 1}).first().id == "n"
    with pytest.raises(ValueError):
        files.read_authored(spark, str(tmp_path / "d.json"), schema, "nodes", {"schemaVersion": 2})


def test_file_headers(spark, tmp_path):
    head = struct.pack(">i", 9994) + b"\0" * 28 + struct.pack("<i4d", 5, 1.0, 2.0, 3.0, 4.0) + b"\0" * 32
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    (tmp_path / "g_0_Floor.shp").write_bytes(head)
    (tmp_path / "g_0_Floor.dbf").write_bytes(struct.pack("<4xIHH20x", 3, 65, 11) + field + b"\r")
    (tmp_path / "g_0_Floor.cpg").write_text("UTF-8\n")
    (tmp_path / "g_0_Floor.prj").write_text("GEOGCS[]")
    (tmp_path / "h.shp").write_bytes(b"bad")
    got = {r.base.rsplit("/", 1)[1]: r for r in shapes.inspect(spark, str(tmp_path)).collect()}
    g = got["g_0_Floor"]
    assert (g.geometry_type, g.bounds, g.rows, g.encoding, g.crs, g.missing, g.feasible) == ("Polygon", [1, 2, 3, 4], 3, "UTF-8", "GEOGCS[]", ["shx"], True)
    assert [(f.name, f.type, f.width) for f in g.fields] == [("name", "C", 10)] and g.warnings == ["dbf: truncated"]
    assert got["h"].warnings == ["shp: no header"] and not got["h"].feasible
    found = {r.path.rsplit("/", 1)[1]: (r.facility, r.floor, r.layer) for r in files.discover(spark, str(tmp_path)).collect()}
    assert found == {"g_0_Floor.shp": ("g", "0", "Floor"), "h.shp": (None, None, None)}


def test_deviations_and_connectors(spark):
    schema = "request_id int, edge_ids array<string>"
    plan = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x", "c"]), (3, ["a"]), (4, ["a", "b"]), (5, []), (6, None)], schema)
    golden = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["a", "b"]), (4, ["a"]), (5, []), (6, None), (7, ["z"])], schema)
    got = {r.request_id: (r.position, r.expected, r.found) for r in routing.deviations(plan, golden).collect()}
    assert got == {2: (1, "b", "x"), 3: (1, "b", None), 4: (1, None, "b"), 7: (0, "z", None)}
    walk = spark.createDataFrame([(1, 2, "stairs", "0", "1"), (1, 0, "elevator", "B1", "0"), (1, 1, "corridor", "0", "0"), (2, 0, "corridor", "0", "0")], "request_id int, pos int, kind string, floor_from string, floor_to string")
    assert [(r.request_id, [tuple(c) for c in r.connectors]) for r in routing.connectors(walk).collect()] == [(1, [("elevator", "B1", "0"), ("stairs", "0", "1")])]
