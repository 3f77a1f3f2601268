"""What a found route tells its walker: steps, warnings, floors, lines, cues. All routes of a batch at once.

walk: one row an arc in walking order: request_id, pos, id, kind, floor_from, floor_to, distance_m, x0 y0 z0, x1 y1 z1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars, texts

STRAIGHT_DEGREES = 20


def by_pos():
    return Window.partitionBy("request_id").orderBy("pos")


def changes() -> Column:
    return F.col("floor_from") != F.col("floor_to")


def line() -> Column:
    return F.array(*[F.struct(*[F.col(f"{c}{i}").alias(c) for c in "xyz"]) for i in (0, 1)])


def steps(walk: DataFrame, ends: DataFrame) -> DataFrame:
    """request_id, step_no (from 1), kind, distance_m, floor_from, floor_to, movement, edge_ids.

    Successive arcs of one floor and kind that hardly turn make one step; a floor change is a step of its own. The turn
    into a step counts from the arc before it, unless one of both changes floors. ends has start_floor, start_m,
    destination_floor and destination_m of each request; the way to the network is a step if it has a length, the arrival
    always. Walks without ends give no steps.
    """
    lag = lambda c: F.lag(c).over(by_pos())
    d = walk.withColumn("ux", F.col("x1") - F.col("x0")).withColumn("uz", F.col("z1") - F.col("z0")).withColumn("changes", changes())
    d = d.withColumn("flat", (lag("floor_from") == lag("floor_to")) & ~F.col("changes")).withColumn("turn", scalars.turn_between(lag("ux"), lag("uz"), F.col("ux"), F.col("uz")))
    goes_on = F.col("flat") & (lag("floor_to") == F.col("floor_from")) & (lag("kind") == F.col("kind")) & (F.abs("turn") <= STRAIGHT_DEGREES)
    d = d.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("begins").over(by_pos()))
    first = lambda c: F.min_by(c, "pos")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("id", ":reverse$", "").alias("id")))), lambda s: s["id"])
    g = d.groupBy("request_id", "part").agg(first("floor_from").alias("floor_from"), F.max_by("floor_to", "pos").alias("floor_to"), first("kind").alias("movement"), first(F.when(F.col("flat"), F.col("turn"))).alias("turn"), F.sum("distance_m").alias("distance_m"), ids.alias("edge_ids"))
    kind = F.when(changes(), "transition").when(F.col("turn") > STRAIGHT_DEGREES, "turn-right").when(F.col("turn") < -STRAIGHT_DEGREES, "turn-left").otherwise("continue")
    g = g.join(ends.select("request_id"), "request_id", "left_semi").select("request_id", F.col("part").cast("long").alias("part"), kind.alias("kind"), "distance_m", "floor_from", "floor_to", "movement", "edge_ids")
    none = F.lit(None).cast("string")

    def end(kind: str, side: str, part: int) -> Column:
        return F.struct(F.lit(part).cast("long").alias("part"), F.lit(kind).alias("kind"), F.col(f"{side}_m").alias("distance_m"), F.col(f"{side}_floor").alias("floor_from"), F.col(f"{side}_floor").alias("floor_to"), none.alias("movement"), F.array().cast("array<string>").alias("edge_ids"))

    both = F.array_compact(F.array(F.when(F.col("start_m") > 0, end("access", "start", 0)), end("arrive", "destination", 1 << 40)))
    out = g.unionByName(ends.select("request_id", F.explode(both).alias("e")).select("request_id", "e.*"))
    out = out.withColumn("step_no", F.row_number().over(Window.partitionBy("request_id").orderBy("part")))
    return out.select("request_id", "step_no", "kind", "distance_m", "floor_from", "floor_to", "movement", "edge_ids")


def journeys(found: DataFrame) -> DataFrame:
    """request_id, distance_m, floor_changes, seconds, minutes of each request's steps."""
    change = F.col("kind") == "transition"
    g = found.groupBy("request_id").agg(F.sum("distance_m").alias("distance_m"), F.count(F.when(change, 1)).alias("floor_changes"), F.collect_list(F.when(change, F.col("movement"))).alias("movements"))
    g = g.withColumn("seconds", scalars.journey_seconds(F.col("distance_m"), F.col("movements")).cast("long")).drop("movements")
    return g.withColumn("minutes", scalars.journey_minutes(F.col("seconds")).cast("long"))


def warnings(walk: DataFrame, requests: DataFrame, unknowns: str = "unknowns") -> DataFrame:
    """request_id, fields: what isn't known of the arcs of accessible routes, sorted; routes without any give no row."""
    asked = requests.where(F.col("profile") == "accessible").select("request_id")
    fields = walk.join(asked, "request_id", "left_semi").select("request_id", F.explode(unknowns).alias("field"))
    return fields.groupBy("request_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def unknowns_by_id(walk: DataFrame, edges: DataFrame) -> DataFrame:
    """walk with unknowns of all edges that carry its arcs' ids: an id that several edges share is unsure in what any of them
    is. edges: id, unknowns."""
    every = edges.select(F.col("id").alias("__edge"), F.explode("unknowns").alias("field")).groupBy("__edge").agg(F.array_sort(F.collect_set("field")).alias("unknowns"))
    d = walk.drop("unknowns").withColumn("__edge", F.regexp_replace("id", ":reverse$", "")).join(every, "__edge", "left")
    return d.withColumn("unknowns", F.coalesce("unknowns", F.array().cast("array<string>"))).drop("__edge")


def access_unverified(planned: DataFrame, places: DataFrame) -> DataFrame:
    """request_id, place_ids (start first): ends of found accessible routes whose way to the network isn't known to be
    accessible; none where both ends are one place. planned: as routing.plans gives it, places: id, accessibility."""
    unsure = places.where(F.col("accessibility") == "unknown").select("id")
    ends = F.posexplode(F.array("start_id", "destination_id")).alias("side", "id")
    found = planned.where("profile = 'accessible' and status = 'ok' and start_id != destination_id")
    d = found.select("request_id", ends).join(unsure, "id", "left_semi")
    return d.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "id"))), lambda s: s["id"]).alias("place_ids"))


def warning_texts(fields: DataFrame, access: DataFrame, names: DataFrame) -> DataFrame:
    """request_id, warning_no (from 1), en, ja: what ``warnings`` and then ``access_unverified`` found, as texts. names:
    id, en, ja of places (one row an id); a place without a row is called by its id."""
    cols = ["request_id", "kind", "en", "ja"]
    unknown = fields.select("request_id", F.lit(1).alias("kind"), *[texts.unknown_fields(F.col("fields"), x).alias(x) for x in ("en", "ja")])
    a = access.select("request_id", F.posexplode("place_ids").alias("pos", "id")).join(names.select("id", "en", "ja"), "id", "left")
    called = [F.coalesce(x, "id").alias(x) for x in ("en", "ja")]
    a = a.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", *called))).alias("called"))  # two ends at most
    unsure = a.select("request_id", F.lit(2).alias("kind"), *[texts.unverified_access(F.col(f"called.{x}"), x).alias(x) for x in ("en", "ja")])
    first = unknown.select("request_id", F.lit(True).alias("__both"))
    both = unsure.join(first, "request_id", "left").withColumn("kind", F.when(F.col("__both"), 2).otherwise(1))
    return unknown.select(*cols).unionByName(both.select(*cols)).withColumnRenamed("kind", "warning_no")


def route_floors(walk: DataFrame) -> DataFrame:
    """request_id, floors: those a route touches, from the lowest."""
    f = walk.select("request_id", F.explode(F.array("floor_from", "floor_to")).alias("floor"))
    ranked = F.array_sort(F.collect_set(F.struct(scalars.floor_elevation(F.col("floor")).alias("at"), "floor")))
    return f.groupBy("request_id").agg(F.transform(ranked, lambda s: s["floor"]).alias("floors"))


def route_lines(walk: DataFrame) -> DataFrame:
    """request_id, points: each route's line, with the joints once; of its arcs' own lines (points) where walk has them."""
    own = F.col("points") if "points" in walk.columns else line()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("line")))), lambda s: s["line"])
    return walk.groupBy("request_id").agg(geometry.joined(lines).alias("points"))


def _cue(points: Column) -> Column:
    """The rows of lines with a length, with their cue; exploded, so that it is computed once, not once for each field."""
    return F.explode(F.array_compact(F.array(geometry.arrow(points)))).alias("cue")


def direction_cues(walk: DataFrame, floors: list[str], shortest_m: float = 10.0) -> DataFrame:
    """request_id, pos, cue (place and direction half way) of arcs within a shown floor that are long enough."""
    d = walk.where(~changes() & F.col("floor_from").isin(floors) & (F.col("distance_m") >= shortest_m))
    return d.select("request_id", "pos", _cue(line()))


def _own_line(walk: DataFrame) -> Column:
    return F.col("points") if "points" in walk.columns else line()


def transition_markers(walk: DataFrame, floors: list[str]) -> DataFrame:
    """request_id, pos, movement, floor_from, floor_to, cue of floor changes between shown floors."""
    d = walk.where(changes() & F.col("floor_from").isin(floors) & F.col("floor_to").isin(floors))
    return d.select("request_id", "pos", F.col("kind").alias("movement"), "floor_from", "floor_to", _cue(_own_line(walk)))


def transition_lines(walk: DataFrame, floors: list[str]) -> DataFrame:
    """request_id, pos, points: the lines of floor changes between shown floors, whole."""
    d = walk.where(changes() & F.col("floor_from").isin(floors) & F.col("floor_to").isin(floors))
    return d.select("request_id", "pos", _own_line(walk).alias("points"))


def shown_between(elevations: list[float]) -> Column:
    on = lambda y: F.exists(F.array(*[F.lit(float(e)) for e in elevations]), lambda e: F.abs(y - e) < 0.01)
    return on(F.col("a.y")) & on(F.col("b.y"))


def visible_lines(legs: DataFrame, elevations: list[float], factor: float = 1.0) -> DataFrame:
    """request_id, leg, run (from 1), points: the unbroken parts of each leg's line that lie on the shown floors. legs:
    request_id, leg, points; a segment is shown if both its ends are at a shown elevation, and heights are drawn times
    ``factor``. One leg is one line; its parts are told apart in it, rows of a leg don't meet."""
    n = F.size("points")
    pairs = F.when(n > 1, F.arrays_zip(F.slice("points", 1, n - 1).alias("a"), F.slice("points", 2, n - 1).alias("b")))
    d = legs.select("request_id", "leg", F.posexplode(pairs).alias("pos", "s")).select("request_id", "leg", "pos", "s.a", "s.b")
    w = Window.partitionBy("request_id", "leg").orderBy("pos")
    d = d.withColumn("shown", shown_between(elevations)).withColumn("before", F.coalesce(F.lag("shown").over(w), F.lit(False)))
    d = d.withColumn("run", F.sum(F.when(F.col("shown") & ~F.col("before"), 1).otherwise(0)).over(w)).where("shown")
    segments = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    g = d.groupBy("request_id", "leg", "run").agg(segments.alias("s"))
    drawn = lambda p: F.struct(p.x.alias("x"), (p.y * factor).alias("y"), p.z.alias("z"))
    first, rest = F.array(drawn(F.col("s")[0]["a"])), F.transform("s", lambda x: drawn(x["b"]))
    return g.select("request_id", "leg", "run", F.concat(first, rest).alias("points"))


def visible_runs(walk: DataFrame, elevations: list[float]) -> DataFrame:
    """request_id, run (from 1), first_pos, points: unbroken parts of a route that lie on the shown floors."""
    shown = F.exists(F.array(*[F.lit(float(e)) for e in elevations]), lambda e: (F.abs(F.col("y0") - e) < 0.01) & (F.abs(F.col("y1") - e) < 0.01))
    d = walk.withColumn("shown", shown).withColumn("before", F.coalesce(F.lag("shown").over(by_pos()), F.lit(False)))
    d = d.withColumn("run", F.sum(F.when(F.col("shown") & ~F.col("before"), 1).otherwise(0)).over(by_pos())).where("shown")
    return d.groupBy("request_id", "run").agg(F.min("pos").alias("first_pos"), (F.count(F.lit(1)) + 1).alias("points"))


def network_arrows(edges: DataFrame, nodes: DataFrame, floors: list[str]) -> DataFrame:
    """id, arrow (place and direction half way, in the sense of travel) of one-way edges between shown floors."""
    at = lambda end: nodes.where(F.col("floor_id").isin(floors)).select(F.col("id").alias(f"{end}_id"), F.struct("x", "y", "z").alias(end))
    d = edges.where("direction != 'both'").join(at("from"), "from_id").join(at("to"), "to_id")
    points = F.array("from", "to")
    points = F.when(F.col("direction") == "reverse", F.reverse(points)).otherwise(points)
    return d.select("id", _cue(points).alias("arrow"))
