"""Map files as a data source, the network import from files, and request streams that restart."""

import struct
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from wayfold.functions import scalars  # noqa: E402
from wayfold.operators import graph  # noqa: E402
from wayfold.sources import mapfiles  # noqa: E402


def shp(shapes) -> bytes:
    """Records of points, lines (lists of parts) or None (a null shape)."""
    out = bytes(100)
    for n, s in enumerate(shapes, 1):
        if s is None:
            body = struct.pack("<i", 0)
        elif isinstance(s, tuple):
            body = struct.pack("<idd", 1, *s)
        else:
            points, starts = [p for part in s for p in part], [sum(map(len, s[:i])) for i in range(len(s))]
            body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(s), len(points)) + struct.pack(f"<{len(s)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        out += struct.pack(">ii", n, len(body) // 2) + body
    return out


def dbf(fields, rows) -> bytes:
    """fields: (name, type, width); rows: texts."""
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, 0]) + bytes(14) for n, k, w in fields)
    body = b"".join(b" " + b"".join(v.encode().ljust(w) for v, (_, _, w) in zip(r, fields)) for r in rows)
    return struct.pack("<BBBBIHH", 3, 0, 0, 0, len(rows), 33 + len(head), 1 + sum(w for _, _, w in fields)) + bytes(20) + head + b"\r" + body


NODES = [("node_id", "C", 4), ("ordinal", "N", 4), ("in_out", "C", 1)]
LINKS = [("link_id", "C", 4), ("start_id", "C", 4), ("end_id", "C", 4), ("distance", "N", 8), ("direction", "C", 1), ("route_type", "C", 1)]


def network_files(folder, links, shapes):
    (folder / "x_node.shp").write_bytes(shp([(139.7, 35.69), (139.7001, 35.69), (139.7, 35.69), (139.7, 35.69), None]))
    (folder / "x_node.dbf").write_bytes(dbf(NODES, [("a", "0", "3"), ("b", "0", "2"), ("c", "-1", "1"), ("odd", "", "9"), ("e", "1", "1")]))
    (folder / "x_link.shp").write_bytes(shp(shapes))
    (folder / "x_link.dbf").write_bytes(dbf(LINKS, links))


def test_codes():
    assert [scalars.IN_OUT[c] for c in "123"] == ["outside", "boundary", "inside"]
    assert [scalars.DIRECTIONS[c] for c in "123"] == ["both", "forward", "reverse"]
    assert [scalars.MOVEMENTS[c] for c in "456"] == ["elevator", "escalator", "stairs"]


def test_typed_attributes_and_pruning(spark, tmp_path):
    fields = [("n", "N", 6), ("f", "F", 6), ("l", "L", 1), ("t", "C", 6)]
    rows = [("12", "-1.5", "Y", "駅"), ("", "", "", ""), ("***", "1e2", "N", "a\0b"), ("1", "2", "t", "x")]
    for name in ("st_B1_Space", "st_-1_Wall", "st_2out_Space", "plain"):
        (tmp_path / f"{name}.shp").write_bytes(shp([(1.0, 2.0), None, [[(0, 0), (1, 1)], [(2, 2), (3, 3)]], (5.0, 5.0), (9.0, 9.0)]))
        (tmp_path / f"{name}.dbf").write_bytes(dbf(fields, rows))
    (tmp_path / "st_3_Bare.shp").write_bytes(shp([(1.0, 1.0)]))
    (tmp_path / "st_4_Lost.dbf").write_bytes(dbf(fields, rows))
    d = mapfiles.read(spark, str(tmp_path))
    got = {r.record: r for r in d.where("layer = 'Wall'").collect()}
    value = lambda r, f: None if r.attributes[f] is None else tuple(r.attributes[f])
    assert (got[1].facility, got[1].floor, got[1].parts[0][0].y) == ("st", "B1", 2.0)
    assert [value(got[1], f) for f in "nflt"] == [("number", 12.0, None, None), ("number", -1.5, None, None), ("boolean", None, True, None), ("text", None, None, "駅")]
    assert all(value(got[2], f) is None for f in "nflt") and got[2].problem == "malformed"
    assert [value(got[3], f) for f in "nflt"] == [("number", None, None, "***"), ("number", 100.0, None, None), ("boolean", None, False, None), ("text", None, None, "ab")]
    assert [len(p) for p in got[3].parts] == [2, 2] and value(got[4], "l")[2] and (got[5].problem, got[5].attributes) == ("skipped", None)
    assert {r.problem for r in d.where("layer = 'Bare'").collect()} == {"skipped"} and not d.where("layer = 'Lost'").count()
    pruned = mapfiles.read(spark, str(tmp_path), floor=["B1", "2out"], layer=["Space"])
    assert pruned.rdd.getNumPartitions() == 2 and d.rdd.getNumPartitions() == 5
    assert {r.file.rsplit("/", 1)[1] for r in pruned.collect()} == {"st_B1_Space", "st_2out_Space"}
    with pytest.raises(ValueError):
        mapfiles.read(spark, str(tmp_path), level=["1"])
    assert mapfiles.read(spark, str(tmp_path), facility=["nowhere"]).count() == 0 and d.where("layer is null").count() == 5
    for raw in (" b1 ", "-2", "-02", "2OUT", "3", "B2.5"):
        assert mapfiles.floor_name(raw) == spark.range(1).select(scalars.normalize_floor(scalars.F.lit(raw))).first()[0]


def test_network_from_files(spark, tmp_path):
    links = [("l1", "a", "b", "9.05", "1", "1"), ("l2", "c", "a", "5", "2", "6"), ("l3", "a", "zz", "1", "9", "1"), ("l4", "y", "zz", "1", "1", "1"), ("l5", "", "a", "1", "1", "1")]
    line = [[(139.7001, 35.69), (139.7, 35.69)]]
    network_files(tmp_path, links, [line, [[(139.7, 35.69), (139.7, 35.69)]], line, line, line])
    nodes, edges = mapfiles.import_network(spark, str(tmp_path), 139.7, 35.69)
    assert {r.id: (r.floor_id, r.in_out, r.y) for r in nodes.collect()} == {"a": ("0", "inside", 0.0), "b": ("0", "boundary", 0.0), "c": ("B1", "outside", -5.0)}
    got = {r.id: r for r in edges.collect()}
    assert {i: r.problem for i, r in got.items()} == {"l1": None, "l2": None, "l3": "boundary", "l4": "both-ends-missing"}
    assert got["l1"].reversed and (got["l1"].direction, got["l1"].kind, got["l1"].source_record) == ("both", "corridor", 1)
    assert got["l1"].points[0].x == 0 and abs(got["l1"].geometry_m - got["l1"].points[-1].x) < 1e-9 and got["l1"].difference_m < 0.05
    assert (got["l2"].direction, got["l2"].kind, got["l2"].floor_from, got["l2"].geometry_m) == ("forward", "stairs", "B1", 5.0)
    report = {(r.measure, r.key): r.n for r in mapfiles.network_report(nodes, edges).collect()}
    assert report.pop(("difference", "max_mm")) < 50
    assert report == {("nodes", "0"): 2, ("nodes", "B1"): 1, ("links", "selected"): 2, ("links", "boundary"): 1, ("links", "both-ends-missing"): 1, ("kind", "corridor"): 1, ("kind", "stairs"): 1, ("direction", "both"): 1, ("direction", "forward"): 1, ("change", "same-floor"): 1, ("change", "cross-floor"): 1}


@pytest.mark.parametrize("link,shape,message", [(("l1", "a", "b", "9", "7", "1"), [[(139.7, 35.69), (139.7, 35.7)]], "direction 7 in record 1"), (("l1", "a", "b", "", "1", "1"), [[(139.7, 35.69), (139.7, 35.7)]], "link record 1 lacks"), (("l1", "a", "b", "9", "1", "1"), None, "link record 1 lacks")])
def test_wrong_links_stop_the_import(spark, tmp_path, link, shape, message):
    network_files(tmp_path, [link], [shape])
    with pytest.raises(Exception, match=message):
        mapfiles.import_network(spark, str(tmp_path), 139.7, 35.69)[1].collect()


def test_request_stream_restarts(spark, tmp_path):
    from test_operators import profile_graph

    from wayfold.streaming import requests

    at = {"s": "B1", "stairs": "0", "lift": "0", "g": "0"}
    nodes = spark.createDataFrame([(i, float(n), -5.0 if f == "B1" else 0.0, 0.0) for n, (i, f) in enumerate(at.items())], "id string, x double, y double, z double")
    places = spark.createDataFrame([("customer:1", True, "s", 2.0, "B1"), ("customer:2", True, "g", 1.0, "0")], "id string, routable boolean, node_id string, distance_m double, floor_id string")
    edges = profile_graph(spark)
    edges = edges.withColumn("unknowns", scalars.F.array().cast("array<string>"))
    arcs, profiles = graph.arcs(edges), graph.profile_arcs(edges)
    plan = lambda asked: requests.whole_plans(asked, places, nodes, arcs, profiles)
    schema = "event_id long, ts timestamp, user_id long, props string"
    submitted = [[(1, None, 1, '{"k": 2}'), (2, None, 1, '{"k": 1}'), (1, None, 1, '{"k": 2}')], [(3, None, 1, '{"k": 9}'), (1, None, 1, '{"k": 2}')], [(4, None, 2, '{"k": 1}'), (3, None, 1, '{"k": 9}')]]
    rows = {}
    for batch in submitted:  # each start goes on from the checkpoint
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = requests.requests_from_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        requests.plan_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
        rows = {r.request_id: r for r in got}
        assert len(rows) == len(got)  # one plan a request
    assert {i: (r.status, r.total_m) for i, r in rows.items()} == {1: ("ok", 5.0), 2: ("ok", 0.0), 3: ("invalid-place", None), 4: ("ok", 5.0)}
    assert [s.kind for s in rows[1].steps] == ["access", "transition", "continue", "arrive"] and rows[1].edge_ids == ["short-stairs", "stairs-goal"]
    whole = requests.requests_from_events(spark.read.schema(schema).parquet(str(tmp_path / "in"))).dropDuplicates(["request_id"])
    assert {r.request_id: r for r in plan(whole).collect()} == rows  # equal to the batch's
