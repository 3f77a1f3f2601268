"""Route guidance, envelopes and interior points on hand-made rows."""

from pyspark.sql import functions as F

from wayfold.functions import geometry, scalars
from wayfold.operators import guidance, maps, places, spatial, translations

WALK = "request_id long, pos int, id string, kind string, floor_from string, floor_to string, distance_m double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
ENDS = "request_id long, start_floor string, start_m double, destination_floor string, destination_m double"


def test_steps(spark):
    rows = [
        (1, 1, "a", "corridor", "0", "0", 5.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0),
        (1, 2, "b:reverse", "corridor", "0", "0", 5.0, 5.0, 0.0, 0.0, 10.0, 0.0, 1.0),
        (1, 3, "c", "corridor", "0", "0", 4.0, 10.0, 0.0, 1.0, 10.0, 0.0, 5.0),
        (1, 4, "d", "stairs", "0", "B1", 6.0, 10.0, 0.0, 5.0, 12.0, -5.0, 5.0),
        (1, 5, "e", "corridor", "B1", "B1", 3.0, 12.0, -5.0, 5.0, 12.0, -5.0, 0.0),
    ]
    ends = spark.createDataFrame([(1, "0", 2.0, "B1", 0.0), (2, "0", 0.0, "0", 0.0)], ENDS)
    got = guidance.steps(spark.createDataFrame(rows, WALK), ends)
    mine = [(r.kind, r.distance_m, r.movement, r.edge_ids) for r in got.where("request_id = 1").orderBy("step_no").collect()]
    assert mine == [("access", 2.0, None, []), ("continue", 10.0, "corridor", ["a", "b"]), ("turn-right", 4.0, "corridor", ["c"]), ("transition", 6.0, "stairs", ["d"]), ("continue", 3.0, "corridor", ["e"]), ("arrive", 0.0, None, [])]
    assert [r.kind for r in got.where("request_id = 2").collect()] == ["arrive"]
    j = {r.request_id: (r.seconds, r.floor_changes, r.minutes) for r in guidance.journeys(got).collect()}
    assert j == {1: (36, 1, 1), 2: (0, 0, 0)}
    assert guidance.steps(spark.createDataFrame([], WALK), ends).count() == 3


def _ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(float(z)).alias("z")) for x, z in points])


def test_interior_point(spark):
    square = _ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    u = _ring((0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10), (0, 0))
    flat = _ring((0, 0), (2, 0), (4, 0), (0, 0))
    a, b, c = spark.range(1).select(*[geometry.interior_point(r).alias(n) for n, r in zip("abc", (square, u, flat))]).first()
    assert (a.x, a.z) == (2.0, 2.0)

    def clear(x, z):  # distance to the walls of the U, or None outside of it
        sides = [((0, 0), (10, 0)), ((10, 0), (10, 10)), ((10, 10), (9, 10)), ((9, 10), (9, 1)), ((9, 1), (1, 1)), ((1, 1), (1, 10)), ((1, 10), (0, 10)), ((0, 10), (0, 0))]
        within = 0 < x < 10 and 0 < z < 10 and not (1 < x < 9 and z > 1)
        gap = lambda p, q: ((x - min(max(x, min(p[0], q[0])), max(p[0], q[0]))) ** 2 + (z - min(max(z, min(p[1], q[1])), max(p[1], q[1]))) ** 2) ** 0.5
        return min(gap(*s) for s in sides) if within else None

    grid = [((i + 0.5) * 10 / 32, (k + 0.5) * 10 / 32) for i in range(32) for k in range(32)]
    assert (b.x, b.z) == min((p for p in grid if clear(*p) is not None), key=lambda p: (-clear(*p), p))
    assert (c.x, c.z) == (4.0, 0.0)


def test_envelope_arrow_and_nearest(spark):
    open_, short = _ring((0, 0), (1, 0), (0, 1)), _ring((0, 0), (1, 0))
    n = spark.range(1).select(F.size(geometry.envelope(open_, 4.0)), geometry.envelope(short, 4.0), geometry.arrow(_ring((1, 1), (1, 1))), geometry.arrow(_ring((0, 0), (0, 0), (4, 0)))).first()
    assert n[0] == 6 and n[1] is None and n[2] is None and (n[3].x, n[3].ux) == (2.0, 1.0)
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 90.0, 0.0)], "id string, x double, z double")
    q = spark.createDataFrame([(1, 14.0, 0.0), (2, 40.0, 0.0)], "id int, x double, z double")
    assert [tuple(r) for r in spatial.nearest_within(q, p).collect()] == [(1, "a", 14.0)]


def test_names_and_links(spark):
    p = spark.createDataFrame([("1", "階段 2", "generated-category", "F011"), ("2", "East", "source", "F012"), ("3", "北口", "source", "F108")], "id string, name string, name_kind string, code string")
    e = spark.createDataFrame([("3", "北口", "North Exit", "reviewed", "register")], "id string, ja string, en string, status string, source string")
    t = translations.translate(p, e)
    assert {r.id: (r.en, r.status) for r in t.collect()} == {"1": ("Stairs 2", "specification"), "2": (None, "pending"), "3": ("North Exit", "reviewed")}
    assert translations.broken(t).count() == 0 and translations.broken(t.union(t)).count() == 3
    n = spark.createDataFrame([("a", "0", 0.0, 0.0, 0.0), ("b", "0", 3.0, 0.0, 4.0), ("c", None, 1.0, 0.0, 0.0)], "id string, floor_id string, x double, y double, z double")
    l = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "z", "a")], "id string, from_id string, to_id string")
    assert {r.id: (r.distance_m, r.problem) for r in maps.overlay_edges(n, l).collect()} == {"1": (5.0, None), "2": (1.0, "floor-mismatch"), "3": (None, "start-missing")}
    s = spark.createDataFrame([("エレベーター1",), ("女子トイレ",), ("ESC-2",), ("shop",)], "n string")
    assert [r[0] for r in s.select(scalars.space_category(F.col("n"))).collect()] == ["elevator", "toilet", "escalator", None]


PLACE = "id string, name string, name_kind string, code string, layer string, category string, area string, floor_id string, routable boolean"
RECORD = "id string, ja string, en string, status string, source string, aliases_ja array<string>, aliases_en array<string>"


def test_translations_search_and_groups(spark):
    rows = [
        ("1", "階段 2", "generated-category", "F011", "Facility", "stairs", "1.East_A", "0", True), ("2", "トイレ（男性）", "source", "B007", "Space", "toilet", "1.East_A", "0", True),
        ("3", "b gate", "source", None, "Opening", "gate", "2.West", "B1", True), ("4", "A gate", "source", None, "Opening", "gate", "2.West", "B1", True),
        ("5", "階段", "source", "F011", "Facility", "stairs", None, "0", False), ("6", "EV_9", "source", "F999", "Space", "gate", "2.West", "B1", True),
    ]
    p = spark.createDataFrame(rows, PLACE)
    e = spark.createDataFrame([("3", "b gate", "B Gate", "reviewed", "register", ["ビー"], None)], RECORD)
    a = spark.createDataFrame([("1.East_A", "East・A", "East A", "reviewed", "register", ["東"], [])], RECORD)
    t = translations.translate(p, e)
    got = {r.id: (r.en, r.status, r.aliases_ja, r.aliases_en) for r in t.collect()}
    assert got["1"] == ("Stairs 2", "specification", ["階段"], ["Stairs"]) and got["2"][:2] == ("Lavatory (Male)", "specification") and got["2"][3] == []
    assert got["3"] == ("B Gate", "reviewed", ["ビー"], []) and got["4"] == (None, "pending", [], []) and got["6"][1] == "pending"
    assert {r.id for r in translations.pending(t).collect()} == {"4", "5", "6"}
    report = {r.section: (r.covered, r.english, r.total) for r in translations.coverage_report(p, t, a).collect()}
    assert report == {"routable-places": (5, 3, 5), "facility-markers": (1, 1, 1), "permanent-labels": (3, 1, 3), "public-areas": (1, 1, 2)}
    assert translations.record_issues(t, p).count() == 0 and translations.record_issues(t.limit(0), p.limit(0)).count() == 0
    own = p.select(F.col("area").alias("id"), F.col("area").alias("name")).where("id is not null").distinct()
    assert [tuple(r) for r in translations.record_issues(a, own, areas=True).collect()] == [("2.West", "record-missing")]
    assert {r.code for r in translations.record_issues(a, own).collect()} == {"record-missing", "japanese-not-authoritative"}
    odd = spark.createDataFrame([("x", " ", "X", "pending", " ", ["a", "a"], [" "])], RECORD)
    assert {r.code for r in translations.record_issues(odd, p.limit(0)).collect()} == {"id-unknown", "japanese-missing", "source-missing", "alias-blank", "alias-twice", "english-of-pending"}
    terms = places.term_index(p, t, a)
    n = {}
    for r in terms.collect():
        n.setdefault(r.id, []).append(r.term)
    assert "5" not in n and sorted(n["1"]) == sorted(["階段 2", "階段 2", "stairs 2", "stairs", "階段", "1.east_a", "階段", "stairs", "east・a", "east a", "東"])
    q = spark.createDataFrame([("東",), ("ビー",), ("stairs",), ("改札",), ("west",)], "query string")
    hits = {(r.query, r.id) for r in places.search(terms, q).collect()}
    assert hits == {("東", "1"), ("東", "2"), ("ビー", "3"), ("stairs", "1"), ("改札", "3"), ("改札", "4"), ("改札", "6"), ("west", "3"), ("west", "4"), ("west", "6")}
    g = sorted((r.group_no, r.nth, r.id, r.name) for r in places.ordered_groups(p, t, a, "en").collect())
    assert [(x[0], x[2]) for x in g if x[0] == 1] == [(1, "4"), (1, "3"), (1, "6")] and {x[2] for x in g} == {r[0] for r in rows}
    assert places.ordered_groups(p.limit(0), t, a, "ja").count() == 0
