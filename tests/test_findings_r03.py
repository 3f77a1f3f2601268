"""Small cases of the findings of round 3."""

import heapq
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import graph, guidance, reports, routing, spatial

ARCS = "profile string, from_id string, to_id string, id string, cost double, distance_m double"


def least(arcs, source):
    cost, todo = {source: 0.0}, [(0.0, source)]
    while todo:
        c, n = heapq.heappop(todo)
        if c == cost[n]:
            for _, a, b, _, more, _ in arcs:
                if a == n and c + more < cost.get(b, math.inf):
                    cost[b] = c + more
                    heapq.heappush(todo, (cost[b], b))
    return cost


def test_corridors_hold_every_cheapest_way_and_little_else(spark):
    r = random.Random(3)
    rows = [("shortest", f"n{r.randrange(150)}", f"n{r.randrange(150)}", f"e{i}", float(r.randrange(1, 4)), 1.0) for i in range(400)]  # many ties
    pairs = {(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(12)} | {("n1", "n1"), ("n2", "nowhere")}
    arcs = spark.createDataFrame(rows, ARCS)
    asked = spark.createDataFrame([("shortest", a, b) for a, b in pairs], "profile string, source string, node string")
    kept = {(x.source, x.from_id, x.to_id) for x in routing.corridors(arcs, asked).collect()}
    want = set()
    for s, t in pairs:
        out, back = least(rows, s), least([(p, b, a, i, c, d) for p, a, b, i, c, d in rows], t)
        if t in out:
            want |= {(s, a, b) for _, a, b, _, c, _ in rows if a != b and out.get(a, math.inf) + c + back.get(b, math.inf) == out[t]}
    assert kept == want  # costs are whole, so nothing is within the tolerance besides the ties
    near = arcs.join(routing.corridors(arcs, asked), ["profile", "from_id", "to_id"])
    sources = asked.select("profile", F.col("source").alias("node_id"))
    ways = lambda a: {x.source + x.node: (x.node_ids, x.edge_ids, x.cost) for x in routing.reconstruct(asked, routing.shortest(a, sources)).collect()}
    assert ways(near) == ways(arcs)


def test_unknowns_of_all_edges_with_an_id(spark):
    edges = spark.createDataFrame([("1-1", ["width"]), ("1-1", []), ("2-1", [])], "id string, unknowns array<string>")
    walk = spark.createDataFrame([("q", "1-1:reverse", []), ("r", "2-1", [])], "request_id string, id string, unknowns array<string>")
    asked = spark.createDataFrame([("q", "accessible"), ("r", "accessible")], "request_id string, profile string")
    assert [tuple(x) for x in guidance.warnings(guidance.unknowns_by_id(walk, edges), asked).collect()] == [("q", ["width"])]


def test_penalty_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(5)
    metres = [r.uniform(0, 500) for _ in range(20_000)] + [-3.0]
    rows = spark.createDataFrame([(m,) for m in metres], "distance_m double")
    want = math.fsum(max(0.0, m) for m in metres) + 1
    for d in (rows.coalesce(1), rows.repartition(7), rows.orderBy("distance_m")):
        assert graph.penalty(d).first()[0] == want
    assert graph.penalty(rows.limit(0)).first()[0] == 1


def test_inner_points_in_numpy():
    ring = lambda *p: (np.array([float(x) for x, _ in p]), np.array([float(z) for _, z in p]))
    square, hole = ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)), ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))
    assert geometry.inner_point([square]) == (4, 4)
    x, z = geometry.inner_point([hole, square])  # the middle is a hole: farthest from both lines, smaller x first
    assert 0 < x < 2 and 0 < z < 2
    assert geometry.inner_point([ring((0, 0), (4, 0), (0, 0))]) is None


def grid(spark, wide, high):
    """Unit arcs both ways between neighbours: many equal ways."""
    name = lambda x, y: f"n{x:03d}-{y:03d}"
    steps = [(name(x, y), name(x + dx, y + dy)) for x in range(wide) for y in range(high) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)) if 0 <= x + dx < wide and 0 <= y + dy < high]
    return spark.createDataFrame([("shortest", a, b, f"{a}>{b}", 1.0, 1.0) for a, b in steps], "profile string, from_id string, to_id string, id string, cost double, distance_m double"), name


def test_long_ways_take_few_rounds(spark):
    """F3-F10: a way of 60 arcs, which took a round for each arc or two from either end."""
    arcs, name = grid(spark, 61, 1)
    pairs = spark.createDataFrame([("shortest", name(0, 0), name(60, 0))], "profile string, source string, node string")
    assert routing.corridors(arcs, pairs, max_rounds=15).count() == 60


def test_ties_of_contracted_networks(spark):
    """F3-F10: equal ways stay in the corridors, so that ways are those of a search of the whole network."""
    arcs, name = grid(spark, 3, 3)
    goals = spark.createDataFrame([("shortest", name(0, 0), name(2, 2)), ("shortest", name(0, 0), name(2, 0)), ("shortest", name(2, 0), name(0, 2)), ("shortest", name(1, 1), "nowhere")], "profile string, source string, node string")
    whole = routing.shortest(arcs, goals.select("profile", goals.source.alias("node_id")))
    rows = lambda d: sorted(map(str, d.select("source", "node", "node_ids", "edge_ids", "cost", "distance_m").collect()))
    assert rows(routing.ways_of(arcs, goals)) == rows(routing.reconstruct(goals, whole))


def test_header_texts_with_quotes(spark):
    """values are read from the document as they are, not as JSON texts (quotes in an expected text never matched)."""
    d = spark.createDataFrame([(1, '{"u": "a\\"b", "n": {"k": 1}}'), (2, '{"u": 5, "n": [1]}')], "source_id int, value string")
    got = sorted((r.source_id, r.code, r.level, r.key) for r in reports.header_issues(d, {"$.n": ["k"]}, {"$.u": 'a"b'}, {}, {}).collect())
    assert got == [(2, "header-mismatch", "$.u", None), (2, "not-an-object", "$.n", None)]


def test_cues_are_computed_once(spark):
    """F16, F23: a line's cue is one expression, however many of its fields are read."""
    w = spark.range(2).selectExpr("id as request_id", "1 as pos", "'0' as floor_from", "'0' as floor_to", "12.0D as distance_m", *[f"cast(id * {i} as double) as {c}{i}" for c in "xyz" for i in (0, 1)])
    c = guidance.direction_cues(w, ["0"]).select("request_id", *[F.col(f"cue.{k}") for k in ("x", "y", "z", "ux", "uz")])
    assert c._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1
    assert [r.request_id for r in c.collect()] == [1]


def test_components_take_few_rounds(spark, monkeypatch):
    """F5-F9, F20, F21: a chain of 600 edges is contracted in one task; in several tasks its labels still meet."""
    r = random.Random(7)
    rows = [(f"c{i}", f"c{i + 1}") for i in range(600)] + [("x", "x"), ("y", None), (None, None), ("b", "a")]
    r.shuffle(rows)
    edges = spark.createDataFrame(rows, "from_id string, to_id string")
    want = {f"c{i}": "c0" for i in range(601)} | {"x": "x", "y": "y", "a": "a", "b": "a"}
    assert dict(graph.components(edges, max_rounds=0).collect()) == want
    monkeypatch.setattr(graph, "EDGE_BLOCK", 200)
    assert dict(graph.components(edges).collect()) == want


def test_nearest_places_of_dense_floors(spark):
    """points meet few of the places around them, and still find the nearest one."""
    r = random.Random(11)
    spots = [(f"p{i}", r.uniform(-20, 20), r.choice([0.0, 4.7, r.uniform(-20, 20)])) for i in range(1500)]
    spots += [("q2", 100.0, 100.0), ("q1", 100.0, 100.0), ("far", 115.0, 130.0), ("nan", math.nan, 0.0), ("none", None, 0.0), ("inf", math.inf, 0.0)]
    asks = [(f"n{i}", r.uniform(-40, 40), r.uniform(-40, 40)) for i in range(300)] + [("at", 100.0, 100.0), ("edge", 115.0, 115.0), ("bad", math.nan, 1.0), ("lost", None, 1.0)]
    points, places = (spark.createDataFrame(d, "id string, x double, z double") for d in (asks, spots))
    gap = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) if None not in a + b else math.inf
    want = {a[0]: min((gap(a, b), b[0]) for b in spots if gap(a, b) == gap(a, b)) if a[1] == a[1] else (math.inf, "") for a in asks}
    want = {k: (v, d) for k, (d, v) in want.items() if d <= 15}
    assert want["at"] == ("q1", 0.0) and want["edge"] == ("far", 15.0)
    assert {x.id: (x.place_id, x.distance_m) for x in spatial.nearest_within(points, places).collect()} == want
    assert spatial._candidates(points, places, 15.0).count() < 2 * len(asks)
