"""Small cases of the findings of round 4."""

import math
import os
import random

from pyspark.sql import functions as F

from wayfold.operators import graph, routing, spatial

ARCS = "profile string, from_id string, to_id string, id string, cost double, distance_m double"


def chain(spark, n):
    steps = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)] + [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(n)]
    return spark.createDataFrame([("shortest", a, b, f"{a}>{b}", 1.0, 1.0) for a, b in steps], ARCS)


def test_search_leaves_no_tables_behind(spark):
    """each round's tables stayed in the shared folder, now only the result's does."""
    arcs = chain(spark, 12)
    goals = spark.createDataFrame([("shortest", "n000", "n012"), ("shortest", "n003", "n001"), ("shortest", "n004", "nowhere")], "profile string, source string, node string")
    folder = graph.shared_folder(spark).removeprefix("file:")
    was = set(os.listdir(folder))
    ways = routing.ways_of(arcs, goals)
    left = {x for x in set(os.listdir(folder)) - was if x.startswith("table-")}
    assert len(left) == 1 and ways.stored_at.endswith(left.pop())
    found = {(x.source, x.node): (x.node_ids, x.cost) for x in ways.collect()}
    assert found == {("n000", "n012"): ([f"n{i:03d}" for i in range(13)], 12.0), ("n003", "n001"): (["n003", "n002", "n001"], 2.0), ("n004", "nowhere"): (None, None)}


def test_balls_without_open_pairs_are_set_aside(spark, monkeypatch):
    """F4-F12: one long way made each round go through the rows of all balls; a network that doesn't thin out keeps it in the core."""
    monkeypatch.setattr(routing, "contracted", lambda arcs, f=routing.contracted: f(arcs, max_levels=0))
    arcs = chain(spark, 40)
    goals = [("n000", "n040")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(2, 38)]
    pairs = spark.createDataFrame([("shortest", a, b) for a, b in goals], "profile string, source string, node string")
    sizes, kept = [], routing.stored

    def counted(df):
        out = kept(df)
        if {"root", "node", "open", "new"} <= set(out.columns):
            sizes.append(out.select("side", "root").distinct().count())
        return out

    monkeypatch.setattr(routing, "stored", counted)
    got = {(x.source, x.from_id, x.to_id) for x in routing.corridors(arcs, pairs).collect()}
    assert got == {(a, f"n{i:03d}", f"n{i + 1:03d}") for a, b in goals for i in range(int(a[1:]), int(b[1:]))}
    assert sizes[0] == 74 and sizes[-1] == 2


def test_least_of_cost_and_flags(spark):
    """F4-F12: the minimum by plain numbers is that of (cost, new, open), null costs first."""
    r = random.Random(8)
    rows = [(r.randrange(60), r.choice([None, 0.0, 1.5, 2.0, float("inf")]), r.random() < 0.5, r.random() < 0.5) for _ in range(300)]
    d = spark.createDataFrame(rows, "k int, cost double, new boolean, open boolean")
    aggs, best = routing._least(("new", "open"))
    got = {tuple(x) for x in d.groupBy("k").agg(*aggs).select("k", *best).collect()}
    old = d.groupBy("k").agg(F.min(F.struct("cost", "new", "open")).alias("b")).select("k", "b.*")
    assert got == {tuple(x) for x in old.collect()}


def test_parts_of_components_are_contracted(spark, monkeypatch):
    """F4-F12: parts that several tasks hold are contracted in their turn, without rounds of labels."""
    r = random.Random(9)
    rows = [(f"s{c}-{r.randrange(6)}", f"p{c}-{r.randrange(40)}") for c in range(12) for _ in range(60)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string")
    want = dict(graph.components(edges).collect())
    monkeypatch.setattr(graph, "EDGE_BLOCK", 250)
    assert dict(graph.components(edges, max_rounds=0).collect()) == want


def test_nearest_nodes_of_dense_floors(spark):
    """places met all nodes within 8 m, however many, and each of those that share a spot."""
    r = random.Random(12)
    spots = [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(900)]
    nodes = [(f"n{i}-{j}", r.choice("01"), x, z) for i, (x, z) in enumerate(spots) for j in range(2)] + [("far", "0", 90.0, 0.0), ("farther", "1", 9e3, 0.0), ("none", "0", None, 0.0)]
    places = [(f"p{i}", r.choice("012"), r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(200)] + [("at", "0", 90.0, 0.0), ("lost", "0", None, 0.0)]
    frames = [spark.createDataFrame(d, "id string, floor_id string, x double, z double") for d in (places, nodes)]
    gap = lambda a, b: math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
    want = {a[0]: min(((gap(a, b), b[0]) for b in nodes if a[1] == b[1] and None not in a + b), default=(None, None)) for a in places}
    got = {x.id: (x.distance_m, x.node_id) for x in spatial.nearest_node(*frames).collect()}
    assert got == want
    n = frames[1].where("x is not null").selectExpr("floor_id", "id as node_id", "x as nx", "z as nz")
    assert spatial._finer(n, 8.0) == 1 and spatial._finer(n.where("node_id like 'far%'"), 8.0) == 0 and spatial._finer(n.limit(0), 8.0) == 0
