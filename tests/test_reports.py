"""Category facts and reports on network documents, case by case."""

import json

from wayfold.operators import reports

POINT = [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 3.0, "y": 0.0, "z": 4.0}]
FLOORS = {0.0: "0", -1.0: "B1"}


def raw(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string")


def node(i, p, floor="0", ordinal=0.0):
    return {"id": i, "floor_id": floor, "ordinal": ordinal, **p}


def link(i, a="a", b="b", points=POINT, **more):
    return {"id": i, "from_id": a, "to_id": b, "floor_from": "0", "floor_to": "0", "validated": True, "points": points, **more}


def found(d):
    return sorted((r.severity, r.code, r.source_id or "", -1 if r.n is None else r.n) for r in d.collect())


def test_whole_document(spark):
    nodes = raw(spark, [node("a", POINT[0]), node("b", POINT[1]), node("c", POINT[1], "B1", 0.0), node("d", POINT[0], "0", 7.5)])
    far = [{"x": 0.0, "y": 0.125, "z": 0.0}, POINT[1]]
    near = [{"x": 0.0, "y": 0.0625, "z": 0.0}, POINT[1]]
    links = raw(spark, [link("fine"), link("turned", points=POINT[::-1]), link("far", points=far), link("near", points=near[::-1]), link("lost", b="zz"), link("floor", b="c"), link("off", validated=False), link("fine")])
    stated = {"boundary_links": 2, "components": 3, "isolated_nodes": 1}
    got = found(reports.document_issues(nodes, links, FLOORS, stated, "selection"))
    assert got == sorted([
        ("error", "duplicate-edges", "", 1), ("error", "floor-assignment", "", 2), ("error", "endpoint-misalignment", "far", 125), ("error", "invalid-reference", "lost", -1),
        ("error", "edge-floor-assignment", "floor", -1), ("error", "disabled-source-link", "off", -1),
        ("warning", "boundary-links", "", 2), ("warning", "disconnected-components", "", 3), ("warning", "isolated-nodes", "", 1),
    ])
    full = found(reports.document_issues(nodes.limit(2), raw(spark, [link("fine")]), FLOORS, {"boundary_links": 1, "components": 1}))
    assert full == [("error", "boundary-links", "", 1)]
    assert found(reports.document_issues(raw(spark, []), raw(spark, []), FLOORS, {})) == []


def test_broken_documents_keep_their_records(spark):
    nodes = raw(spark, [node("a", POINT[0]), node("a", POINT[0]), '{"id": "b", "floor', None, {"id": "e"}])
    links = raw(spark, [link("l1", b="a"), link("l1"), link("one", b="a", points=POINT[:1]), link("typed", b="a", validated="so"), "[]"])
    d = reports.document_issues(nodes, links, FLOORS, {"boundary_links": 5})
    got = found(d)
    assert ("error", "duplicate-nodes", "", 1) in got and ("error", "duplicate-edges", "", 1) in got and ("error", "invalid-reference", "", 2) in got
    broken = sorted((r.source_id, r.raw or "") for r in d.where("code = 'schema-validation'").collect())
    assert [b[0] for b in broken] == ["malformed"] * 4 + ["missing-floor_id", "no-line"]
    assert '{"id": "b", "floor' in [b[1] for b in broken] and len(got) == 3 + len(broken)  # nothing else is said of a broken document


def test_category_facts_on_odd_rows(spark):
    rows = [("Space", " b001 ", "x", "Polygon", "0", "A"), ("Space", "B001", " ", None, None, None), ("Space", None, None, "Point", "0", "A"), ("Space", " ", "y", "Point", None, "A"), ("Facility", "Z9", None, "Point", "1", "B")]
    d = reports.category_facts(spark.createDataFrame(rows, "layer string, category string, name string, geometry_type string, floor_id string, area string"))
    got = {(r.layer, r.code): r for r in d.collect()}
    a, m, z = got["Space", "B001"], got["Space", "(missing)"], got["Facility", "Z9"]
    assert (a.known, a.role, a.records, a.named, a.malformed) == (True, "room", 2, 1, 1)
    assert (a.geometry_types, a.floors, a.areas) == ({"Null": 1, "Polygon": 1}, {"(missing)": 1, "0": 1}, {"(missing)": 1, "A": 1})
    assert (m.known, m.records, m.named, m.geometry_types) == (False, 2, 1, {"Point": 2}) and not z.known
    t = {r.layer: r for r in reports.category_totals(d).collect()}
    assert (t["Space"].features, t["Space"].categories, t["Space"].missing_category, t["Space"].missing_floor, t["Space"].unknown_codes) == (4, 2, 2, 2, ["(missing)"])
    assert t["Facility"].unknown_codes == ["Z9"] and not reports.category_facts(spark.createDataFrame([], "layer string, category string, name string, geometry_type string, floor_id string, area string")).count()


def test_headers(spark):
    keys, expected = {"$": ["version", "axes", "rows"], "$.axes": ["x"], "$.rows[*]": ["id"]}, {"$.version": 1, "$.axes.x": "east"}
    good = {"version": 1, "axes": {"x": "east"}, "rows": [{"id": 1}, {"id": 2}]}
    texts = [json.dumps(good), "{", None, json.dumps(good | {"version": "1", "axes": '{"x": "east"}'}), json.dumps(good | {"rows": [{"id": 1, "b": 0}, 7, {"b": 0}]}), '{"version": 1, "version": 1}', json.dumps({"version": 1.0, "axes": {"x": "west"}, "rows": [], "min": 0}), "[]"]
    d = spark.createDataFrame(list(enumerate(texts)), "source_id int, value string")
    got = {}
    for r in reports.header_issues(d, keys, expected, {}, {}).collect():
        got.setdefault(r.source_id, set()).add((r.code, r.level, r.key, r.n))
    malformed = {("malformed", "$", None, 1)}
    assert 0 not in got and got[1] == got[2] == got[5] == malformed
    assert got[3] == {("header-mismatch", "$.version", None, 1), ("not-an-object", "$.axes", None, 1), ("header-mismatch", "$.axes.x", None, 1)}
    assert got[4] == {("unsupported-key", "$.rows[*]", "b", 2), ("missing-key", "$.rows[*]", "id", 1), ("not-an-object", "$.rows[*]", None, 1)}
    assert got[6] == {("unsupported-key", "$", "min", 1), ("header-mismatch", "$.axes.x", None, 1)}
    assert ("not-an-object", "$", None, 1) in got[7]
    rows = [json.dumps({"n": n, "rows": [1, 2], "b": {"minX": a, "maxX": b}}) for n, a, b in ((2, 0, 1), (3, 2, 1), ("2", 0, None))]
    d = spark.createDataFrame(list(enumerate(rows)), "source_id int, value string")
    got = {(r.source_id, r.code) for r in reports.header_issues(d, {}, {}, {"$.n": "$.rows"}, {"$.b": ["X"]}).collect()}
    assert got == {(1, "count-mismatch"), (1, "bounds-order"), (2, "count-mismatch"), (2, "bounds-order")}
