"""Batch routing: request classification, shortest paths of all requests in one loop, path reconstruction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dropped, own_tables, stored
from .guidance import route_lines


#: Why nothing was found, by profile.
UNREACHABLE = {"accessible": "no-accessible-path", "avoid-stairs": "no-stair-free-path"}


def classify(requests: DataFrame, places: DataFrame, bounded: bool = False) -> DataFrame:
    """request_id, status, reason (null status: to be searched), with both nodes. places: id, routable, node_id, and
    perhaps accessibility (of the way to the network) and component_id; bounded: the network is a part of a larger one,
    so that ends in different components are outside its coverage."""
    more = [c for c in ("accessibility", "component_id") if c in places.columns]
    side = lambda s: places.select(F.col("id").alias(f"{s}_id"), F.col("routable").alias(f"{s}_ok"), F.col("node_id").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in more])
    d = requests.join(side("start"), "start_id", "left").join(side("destination"), "destination_id", "left")
    rules = [
        (F.col("start_ok").isNull(), "invalid-place", "not-found"),
        (F.col("destination_ok").isNull(), "invalid-place", "not-found"),
        (~F.col("start_ok") | ~F.col("destination_ok"), "invalid-place", "low-confidence-attachment"),
    ]
    if "accessibility" in more:
        rules.append(((F.col("profile") == "accessible") & ((F.col("start_accessibility") == "no") | (F.col("destination_accessibility") == "no")), "unreachable", UNREACHABLE["accessible"]))
    rules.append((F.col("start_id") == F.col("destination_id"), "ok", "already-there"))
    if bounded and "component_id" in more:
        rules.append((F.col("start_component_id") != F.col("destination_component_id"), "outside-coverage", "different-components-in-bounded-extraction"))
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, s, r in reversed(rules):
        status, reason = F.when(when, s).otherwise(status), F.when(when, r).otherwise(reason)
    return d.withColumn("status", status).withColumn("reason", reason).drop(*[f"{s}_{c}" for s in ("start", "destination") for c in more])


def outcomes(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked (as classify gives it) with the costs that were found (profile, start_node, destination_node, distance_m):
    status and reason are final, distance_m is null where no way was found and 0 where there is none to go."""
    keys = ["profile", "start_node", "destination_node"]
    d = asked.join(found.select(*keys, "distance_m"), keys, "left")
    lost = F.col("status").isNull() & F.col("distance_m").isNull()
    why = F.lit("no-directed-path")
    for profile, text in UNREACHABLE.items():
        why = F.when(F.col("profile") == profile, text).otherwise(why)
    metres = F.when(F.col("status").isNull(), F.col("distance_m")).when(F.col("status") == "ok", F.lit(0.0))
    return d.withColumns({"reason": F.when(lost, why).otherwise(F.col("reason")), "status": F.when(lost, "unreachable").otherwise(F.coalesce("status", F.lit("ok"))), "distance_m": metres})


def located(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arcs with the place of their far end (x, y, z), and for each profile the least cost of a straight metre (rate): no way
    between two places costs less than the metres between them at that rate. nodes: id, x, y, z."""
    at = lambda end, names: nodes.select(F.col("id").alias(end), *[F.col(c).alias(n) for c, n in zip("xyz", names)])
    d = arcs.join(at("from_id", ("ax", "ay", "az")), "from_id").join(at("to_id", "xyz"), "to_id")
    straight = F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2 + (F.col("z") - F.col("az")) ** 2)
    d = stored(d.withColumn("straight", straight))
    rates = d.where("straight > 0").groupBy("profile").agg(F.greatest(F.lit(0.0), F.min(F.col("cost") / F.col("straight"))).alias("rate"))
    return d.drop("straight", "ax", "ay", "az"), rates


def boxes(goals: DataFrame, nodes: DataFrame, rates: DataFrame) -> DataFrame:
    """profile, source, rate and the box (x0 to z1) that holds the goals of a search."""
    at = nodes.select(F.col("id").alias("node"), "x", "y", "z")
    sides = [f(c).alias(f"{c}{i}") for i, f in ((0, F.min), (1, F.max)) for c in "xyz"]
    box = goals.join(at, "node").groupBy("profile", "source").agg(*sides)
    return box.join(F.broadcast(rates), "profile", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))  # a row a profile


def shortest(arcs: DataFrame, sources: DataFrame, max_rounds: int = 5000, goals: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """profile, source, node, cost, distance_m, pred, arc: least costs from each (profile, source) to the nodes reached.
    Arcs with a source are those of its search alone.

    Each round relaxes the arcs of the rows that improved last and folds them in with one minimum by key; ties go to the
    first predecessor and arc in reading order. arcs: profile, from_id, to_id, id, cost, distance_m. With goals
    (profile, source, node) a search goes no further than its dearest goal, once it has reached all of them: rows beyond
    are left out. With nodes (id, x, y, z) as well, a step is left out as soon as its cost and the least cost of the
    straight metres from there to the goals' box exceed the dearest goal. A search that isn't done after ``max_rounds``
    (arcs of a way) is an error, never a partial result.
    """
    keys = ["profile", "source", "node"]
    box = None
    if goals is not None:
        goals = stored(goals.select(*keys).distinct())
        if nodes is not None:
            arcs, rates = located(arcs, nodes)
            box = stored(boxes(goals, nodes, rates))
    by = ["profile", "source", "from_id"] if "source" in arcs.columns else ["profile", "from_id"]
    a = stored(arcs.withColumnRenamed("id", "arc").repartition(*by))
    start = sources.select("profile", F.col("node_id").alias("source"), F.col("node_id").alias("node")).distinct()
    none = F.lit(None).cast("string")
    state = stored(start.select("*", F.lit(0.0).alias("cost"), F.lit(0.0).alias("distance_m"), none.alias("pred"), none.alias("arc"), F.lit(True).alias("new")))
    for _ in range(max_rounds):
        front = state.where("new")
        if goals is not None:  # what the dearest goal of a search costs so far
            far = goals.join(state.select(*keys, "cost"), keys, "left").groupBy("profile", "source").agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("dearest"))
            if box is not None:
                far = far.join(box, ["profile", "source"], "left")
            front = front.join(far, ["profile", "source"]).where("cost < dearest")
        front = front.withColumnsRenamed({"node": "from_id", "cost": "so_far", "distance_m": "walked"}).drop("pred", "arc", "new")
        step = front.join(a, by).withColumn("total", F.col("so_far") + F.col("cost"))
        if box is not None:
            off = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1")) for c in "xyz"]
            ahead = F.sqrt(off[0] ** 2 + off[1] ** 2 + off[2] ** 2) * F.col("rate")
            step = step.where(F.col("total") + F.coalesce(ahead, F.lit(0.0)) * (1 - 1e-9) <= F.col("dearest"))
        step = step.select("profile", "source", F.col("to_id").alias("node"), F.col("total").alias("cost"), (F.col("walked") + F.col("distance_m")).alias("distance_m"), F.col("from_id").alias("pred"), "arc", F.lit(True).alias("new"))
        both = state.withColumn("new", F.lit(False)).unionByName(step)
        best = F.min(F.struct("cost", "new", F.collate("pred", "UNICODE").alias("p"), "pred", F.collate("arc", "UNICODE").alias("a"), "arc", "distance_m")).alias("b")  # at equal cost the known row stays
        state = stored(both.groupBy(*keys).agg(best).select(*keys, "b.cost", "b.distance_m", "b.pred", "b.arc", "b.new"))
        if not state.where("new").limit(1).count():
            return state.drop("new")
    raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")


@own_tables
def contracted(arcs: DataFrame, more: int = 2, max_levels: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A network whose cheapest ways have few arcs: (ways, core, made).

    Level by level the nodes go that come before all their neighbours by the arcs which they would add; a node's ways in and
    out are joined to arcs past it, so that all costs stay. None goes that adds over ``more`` arcs, so that the arcs stay in
    proportion; it ends with the nodes or once a level takes under one in 50 of them. ways: side (f along arcs, b
    against them), profile, node, next, c and low (next isn't in the core): the arcs of a node when it went, and those
    of the core. core: profile, node. made: profile, a, b, via, gap: every arc ever between two nodes (null via: a given one)
    with what it costs over the cheapest.
    """
    none = F.lit(None).cast("string")
    now = stored(arcs.where("from_id != to_id").groupBy("profile", F.col("from_id").alias("a"), F.col("to_id").alias("b")).agg(F.min("cost").alias("c")))
    made, gone = [now.select("profile", "a", "b", none.alias("via"), "c")], []
    for _ in range(max_levels):
        one = F.lit(1).cast("long")
        ends = now.select("profile", F.col("a").alias("node"), F.col("b").alias("near"), one.alias("o"), (one - 1).alias("i")).unionByName(now.select("profile", F.col("b").alias("node"), F.col("a").alias("near"), (one - 1).alias("o"), one.alias("i")))
        count = ends.groupBy("profile", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        adds = F.col("o") * F.col("i") - F.col("o") - F.col("i")
        # one number orders nodes by what they add, then by hash; of equal ones none goes
        order = F.greatest(F.lit(-(1 << 19)), F.least(adds, F.lit((1 << 19) - 1))) * F.lit(1 << 43) + F.xxhash64("node").bitwiseAND(F.lit((1 << 43) - 1))
        place = count.select("profile", "node", adds.alias("adds"), order.alias("k"))
        first = ends.join(place.select("profile", F.col("node").alias("near"), F.col("k").alias("near_k")), ["profile", "near"]).groupBy("profile", "node").agg(F.min("near_k").alias("near_k"))
        goes = stored(place.join(first, ["profile", "node"]).select("profile", "node", ((F.col("adds") <= more) & (F.col("k") < F.col("near_k"))).alias("goes")))
        n = goes.agg(F.count_if("goes").alias("go"), F.count(F.lit(1)).alias("all")).first()
        if 50 * n["go"] <= n["all"]:
            break
        of = lambda end, flag: goes.where("goes").select("profile", F.col("node").alias(end), F.lit(True).alias(flag))
        split = stored(now.join(of("a", "f"), ["profile", "a"], "left").join(of("b", "t"), ["profile", "b"], "left"))
        out, into, rest = split.where("f"), split.where("t"), split.where("f is null and t is null")
        gone += [out.select(F.lit("f").alias("side"), "profile", F.col("a").alias("node"), F.col("b").alias("next"), "c"), into.select(F.lit("b").alias("side"), "profile", F.col("b").alias("node"), F.col("a").alias("next"), "c")]
        past = into.select("profile", "a", F.col("b").alias("via"), F.col("c").alias("c_in")).join(out.select("profile", F.col("a").alias("via"), "b", F.col("c").alias("c_out")), ["profile", "via"]).where("a != b")
        past = stored(past.select("profile", "a", "b", "via", (F.col("c_in") + F.col("c_out")).alias("c")))
        made.append(past)
        now = rest.select("profile", "a", "b", "c").unionByName(past.drop("via")).groupBy("profile", "a", "b").agg(F.min("c").alias("c"))
    now = stored(now)
    core = stored(now.select("profile", F.col("a").alias("node")).unionByName(now.select("profile", F.col("b").alias("node"))).distinct())
    ways = reduce(DataFrame.unionByName, [*gone, *(now.select(F.lit(s).alias("side"), "profile", F.col(a).alias("node"), F.col(b).alias("next"), "c") for s, a, b in (("f", "a", "b"), ("b", "b", "a")))])
    high = core.select("profile", F.col("node").alias("next"), F.lit(False).alias("low"))
    ways = stored(ways.join(high, ["profile", "next"], "left").select("side", "profile", "node", "next", "c", F.coalesce("low", F.lit(True)).alias("low")))
    made = reduce(DataFrame.unionByName, made)
    least = made.groupBy("profile", "a", "b").agg(F.min("c").alias("least"))
    return ways, core, stored(made.join(least, ["profile", "a", "b"]).select("profile", "a", "b", "via", (F.col("c") - F.col("least")).alias("gap")))


#: Ways whose costs agree so far are kept for the exact search; sums of ten thousand arcs round less.
TIE = 1e-11


def _least(flags: tuple[str, ...]):
    """The columns of a minimum by key of (cost, flags), as aggregates of plain numbers (those need no sorting), and how they are
    read: a null cost is the least."""
    low = F.lit(float("-inf"))
    state = sum((F.col(f).cast("int") * 2**i for i, f in enumerate(reversed(flags))), F.lit(0))
    aggs = [F.min(F.when(state == n, F.coalesce("cost", low))).alias(f"__{n}") for n in range(2 ** len(flags))]
    cost = F.least(*[F.col(f"__{n}") for n in range(2 ** len(flags))])
    which = F.coalesce(*[F.when(F.col(f"__{n}") == cost, n) for n in range(2 ** len(flags))])
    return aggs, [F.nullif(cost, low).alias("cost"), *[(F.shiftright(which, i).bitwiseAND(F.lit(1)) == 1).alias(f) for i, f in reversed([*enumerate(reversed(flags))])]]


@own_tables
def corridors(arcs: DataFrame, pairs: DataFrame, max_rounds: int = 5000) -> DataFrame:
    """profile, source, from_id, to_id: arcs that hold every cheapest way of the pairs (profile, source, node), ties too.

    Searches from both ends of the contracted network: a ball around each source and, against the arcs, around each goal,
    shared by its pairs. A cheapest way climbs from its source, may cross the core and comes down to its goal; so balls only
    climb, and below the core (low rows) all of a ball's ways are followed. An open row is one whose ways aren't
    followed since it last improved. A meeting that isn't found yet costs as much as the least open low row of either ball, or
    as the least open rows of both balls together; a pair's cheapest way is known once it costs less. In the core
    pairs let the ball grow that has fewer rows for each of its open pairs, or both while small. Then the ways are followed
    back from where balls meet, as far as costs agree within TIE, and arcs past nodes are replaced by what they were made of.
    Balls that no open pair asks for are set aside.
    """
    ball, small, inf = ["side", "profile", "root"], 64, F.lit(float("inf"))
    ways, core, made = contracted(arcs)
    pairs = stored(pairs.select("profile", F.col("source").alias("f"), F.col("node").alias("b")).distinct())
    roots = pairs.select("profile", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("root")) for s in "fb"])).alias("r")).select("r.side", "profile", "r.root").distinct()
    roots = roots.join(core.select("profile", F.col("node").alias("root"), F.lit(False).alias("low")), ["profile", "root"], "left")
    rows = stored(roots.select(*ball, F.col("root").alias("node"), F.coalesce("low", F.lit(True)).alias("low"), F.lit(0.0).alias("cost"), F.lit(True).alias("open"), F.lit(True).alias("new")))
    left, done, aside = pairs.withColumn("met", inf), [], []
    of = lambda d, side, *more: d.where(F.col("side") == side).select("profile", F.col("root").alias(side), *more)
    for _ in range(max_rounds):
        at = lambda side, which: of(rows.where(which), side, "node", F.col("cost").alias(f"{side}_cost"))
        meet = lambda side, other, which: left.join(at(side, "new"), ["profile", side]).join(at(other, which), ["profile", other, "node"]).select("profile", "f", "b", (F.col("f_cost") + F.col("b_cost")).alias("met"))
        left = left.unionByName(meet("f", "b", "true")).unionByName(meet("b", "f", "not new")).groupBy("profile", "f", "b").agg(F.min("met").alias("met"))
        opened = F.when(F.col("open"), F.col("cost"))
        within = F.when(~F.col("low"), opened)
        balls = stored(rows.groupBy(*ball).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(opened), inf).alias("whole"), F.coalesce(F.min(F.when(F.col("low"), opened)), inf).alias("under"), F.when(F.count(within) <= small, inf).otherwise(F.percentile_approx(within, 0.5)).alias("cut")))
        for side in "fb":
            left = left.join(of(balls, side, *[F.col(c).alias(f"{side}_{c}") for c in ("n", "whole", "under")]), ["profile", side])
        wide = F.least(F.col("f_whole") + F.col("b_whole"), "f_under", "b_under")
        left = stored(left.withColumn("known", (wide == inf) | (F.col("met") * (1 + TIE) < wide)))
        done.append(left.where("known").select("profile", "f", "b", "met"))
        left = left.where("not known")
        if not left.limit(1).count():
            break
        for side in "fb":
            left = left.join(left.groupBy("profile", side).agg(F.count(F.lit(1)).alias(f"{side}_pairs")), ["profile", side])
        load = {side: F.col(f"{side}_n") / F.col(f"{side}_pairs") for side in "fb"}
        wants = lambda side, other: F.when((load[side] <= load[other]) | (load[side] <= small) | (F.col(f"{side}_under") < inf), F.struct(F.lit(side).alias("side"), F.col(side).alias("root"), (F.col("met") * (1 + 2 * TIE) - F.col(f"{other}_whole")).alias("most")))
        grow = left.select("profile", F.explode(F.array_compact(F.array(wants("f", "b"), wants("b", "f")))).alias("w")).groupBy("w.side", "profile", "w.root").agg(F.max("w.most").alias("most"))
        grow = grow.join(balls.select(*ball, "cut"), ball)
        within = F.col("low") | ((F.col("cost") <= F.col("cut")) & (F.col("cost") <= F.col("most")))
        asked = stored(left.select("profile", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("root")) for s in "fb"])).alias("r")).select("r.side", "profile", "r.root").distinct())
        n = balls.join(asked.withColumn("on", F.lit(True)), ball, "left").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("on"), F.col("n"))).alias("on")).first()
        if 2 * n["on"] < n["all"]:
            aside.append(stored(rows.join(asked, ball, "left_anti")))
            was, rows = rows, stored(rows.join(asked, ball, "left_semi"))
            dropped(was)
        was = [rows, balls, asked]
        rows = rows.withColumn("new", F.lit(False)).join(grow, ball, "left").withColumn("go", F.coalesce(F.col("open") & F.col("most").isNotNull() & within, F.lit(False)))
        now, all_ = rows.where("go"), [rows.withColumn("open", F.col("open") & ~F.col("go"))]
        for _ in range(3):  # three arcs a round; what they reach is folded in once
            step = now.join(ways.withColumnRenamed("low", "next_low"), ["side", "profile", "node"]).select(*ball, F.col("next").alias("node"), F.col("next_low").alias("low"), "most", "cut", (F.col("cost") + F.col("c")).alias("cost"))
            step = step.groupBy(*ball, "node").agg(F.min("cost").alias("cost"), *[F.first(c).alias(c) for c in ("low", "most", "cut")])
            if len(all_) < 3:  # read twice
                step = stored(step)
                was.append(step)
            now = step.withColumns({"go": within, "open": ~within if len(all_) < 3 else F.lit(True), "new": F.lit(True)})
            all_.append(now)
            now = now.where("go")
        aggs, best = _least(("new", "open"))  # at equal cost the known row stays
        rows = reduce(lambda x, y: x.unionByName(y), [d.select(*ball, "node", "low", "cost", "open", "new") for d in all_]).groupBy(*ball, "node").agg(F.first("low").alias("low"), *aggs)
        rows = stored(rows.select(*ball, "node", "low", *best))
        left = left.select("profile", "f", "b", "met")
        dropped(*was)
    else:
        raise RuntimeError(f"searches did not meet in {max_rounds} rounds")
    aside.append(rows)
    known = stored(reduce(DataFrame.unionByName, done).where(F.col("met") < inf))
    # what lies beyond the dearest way of a ball is on none
    dearest = reduce(DataFrame.unionByName, [known.groupBy("profile", F.col(s).alias("root")).agg(F.max("met").alias("dearest")).withColumn("side", F.lit(s)) for s in "fb"])
    rows = stored(reduce(DataFrame.unionByName, aside).join(dearest, ball).where(F.col("cost") <= F.col("dearest") * (1 + 4 * TIE)).select(*ball, "node", "cost"))
    dropped(*aside)
    meeting = known.join(of(rows, "f", "node", F.col("cost").alias("f_cost")), ["profile", "f"]).join(of(rows, "b", "node", F.col("cost").alias("b_cost")), ["profile", "b", "node"])
    meeting = meeting.where(F.col("f_cost") + F.col("b_cost") <= F.col("met") * (1 + TIE))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("root"), F.col(f"{s}_cost").alias("cost")) for s in "fb"]))
    seen = ["side", "profile", "root", "f", "node"]  # a goal's ball is followed once for each source
    meeting = meeting.drop("met").join(known.groupBy("profile", "f").agg(F.max("met").alias("met")), ["profile", "f"])
    first = stored(meeting.select("profile", "f", "met", "node", each.alias("e")).groupBy("e.side", "profile", "e.root", "f", "node").agg(F.max("met").alias("met"), F.min("e.cost").alias("cost")))
    back = ways.select("side", "profile", F.col("node").alias("prior"), F.col("next").alias("node"), "c")
    prior = rows.select(*ball, F.col("node").alias("prior"), F.col("cost").alias("before"))
    tight = lambda d: d.join(back, ["side", "profile", "node"]).join(prior, [*ball, "prior"]).where(F.col("before") + F.col("c") <= F.col("cost") + F.col("met") * TIE)
    trace, now, on = [first], first, []
    for _ in range(max_rounds):
        on.append(stored(tight(now)))
        more = on[-1].groupBy("side", "profile", "root", "f", F.col("prior").alias("node")).agg(F.max("met").alias("met"), F.min("before").alias("cost"))
        now = stored(more.join(reduce(DataFrame.unionByName, [t.select(*seen) for t in trace]), seen, "left_anti"))
        if not now.limit(1).count():
            break
        trace.append(now)
    else:
        raise RuntimeError("a corridor has no end")
    forth = F.col("side") == "f"
    on = reduce(DataFrame.unionByName, on).select("profile", "f", "met", F.when(forth, F.col("prior")).otherwise(F.col("node")).alias("a"), F.when(forth, F.col("node")).otherwise(F.col("prior")).alias("b"))
    same, given = ["profile", "f", "a", "b"], []
    todo = stored(on.groupBy(*same).agg(F.max("met").alias("met")))
    parts = F.when(F.col("via").isNull(), F.array(F.struct("a", "b", F.lit(True).alias("given")))).otherwise(F.array(F.struct("a", F.col("via").alias("b"), F.lit(False).alias("given")), F.struct(F.col("via").alias("a"), "b", F.lit(False).alias("given"))))
    for _ in range(max_rounds):
        split = stored(todo.join(made, ["profile", "a", "b"]).where(F.col("gap") <= F.col("met") * TIE).select("profile", "f", "met", F.explode(parts).alias("p")).select("profile", "f", "met", "p.*"))
        given.append(split.where("given").select("profile", F.col("f").alias("source"), F.col("a").alias("from_id"), F.col("b").alias("to_id")))
        todo = split.where("not given").groupBy(*same).agg(F.max("met").alias("met"))
        if not split.where("not given").limit(1).count():
            return stored(reduce(DataFrame.unionByName, given).distinct())
    raise RuntimeError("an arc has no end")


def trees(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """near (arcs with a source, as corridors leave them) in two: the arcs of sources whose corridor has one way to each node
    (so that nothing is left to search), and those of the others. Of arcs with the same ends the cheapest count, and those that
    cost so much the same that a sum may not tell them apart."""
    ends = ["profile", "source", "from_id", "to_id"]
    least = near.groupBy(*ends).agg(F.min("cost").alias("least"))
    near = near.join(least, ends).where(F.col("cost") <= F.col("least") * (1 + 1e-9) + 1e-6).drop("least")
    into = near.groupBy("profile", "source", "to_id").agg(F.count(F.lit(1)).alias("n"))
    tied = stored(into.where("n > 1 or to_id = source").select("profile", "source").distinct())
    return near.join(tied, ["profile", "source"], "left_anti"), near.join(tied, ["profile", "source"], "left_semi")


def tree_state(near: DataFrame, sources: DataFrame) -> DataFrame:
    """What shortest gives for arcs that are trees (see trees), with the cost and length of the last arc of each way only."""
    none = F.lit(None).cast("string")
    start = sources.select("profile", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("distance_m"), none.alias("pred"), none.alias("arc"))
    return start.unionByName(near.select("profile", "source", F.col("to_id").alias("node"), "cost", "distance_m", F.col("from_id").alias("pred"), F.col("id").alias("arc")))


def reconstruct(asked: DataFrame, state: DataFrame, max_doublings: int = 40, last_arcs: bool = False) -> DataFrame:
    """asked (profile, source, node) with node_ids, edge_ids, cost, distance_m; rows that nothing reaches have nulls.
    last_arcs: costs and lengths of state are those of the last arc, and are added up from the source on.

    Pointers to predecessors double their reach from round to round, and so does what of each way is known, so that a
    way of n arcs takes log2(n) joins. A way that doesn't end at its source is an error.
    """
    keys = ["profile", "source", "node"]
    asked = asked.select(*keys).distinct()
    base = F.regexp_replace("arc", ":reverse$", "")
    jump = stored(state.select("profile", "source", F.col("node").alias("at"), F.col("pred").alias("up"), F.lit(1).alias("steps")))
    walk = stored(asked.join(state.select(*keys), keys).select(*keys, F.col("node").alias("at"), F.lit(0).alias("back")))
    for _ in range(max_doublings):
        ahead = walk.join(jump.where("up is not null"), ["profile", "source", "at"]).select(*keys, F.col("up").alias("at"), (F.col("back") + F.col("steps")).alias("back"))
        walk = stored(walk.unionByName(ahead))
        above = jump.select("profile", "source", F.col("at").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        jump = stored(jump.where("up is not null").join(above, ["profile", "source", "up"]).select("profile", "source", "at", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps")).where("up is not null"))
        if not jump.limit(1).count():
            break
    else:
        raise RuntimeError("a way has no end")
    on = walk.join(state.select("profile", "source", F.col("node").alias("at"), base.alias("edge"), "cost", "distance_m"), ["profile", "source", "at"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), "at", "edge", "cost", "distance_m")))
    paths = on.groupBy(*keys).agg(order.alias("s"))
    total = lambda c: (F.aggregate("s", F.lit(0.0), lambda t, x: t + x[c]) if last_arcs else F.element_at("s", -1)[c]).alias(c)
    paths = paths.select(*keys, F.transform("s", lambda x: x["at"]).alias("node_ids"), F.filter(F.transform("s", lambda x: x["edge"]), lambda e: e.isNotNull()).alias("edge_ids"), total("cost"), total("distance_m"))
    return asked.join(paths, keys, "left")


@own_tables
def ways_of(arcs: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (profile, source, node) with node_ids, edge_ids, cost, distance_m of their ways, nulls where there is none. Only
    sources whose corridors hold ties are searched again; elsewhere the corridor is the way."""
    alone, tied = (stored(d) for d in trees(stored(arcs.join(corridors(arcs, goals), ["profile", "from_id", "to_id"]))))
    both = ["profile", "source"]
    again = stored(tied.select(*both).distinct())
    single = goals.join(again, both, "left_anti")
    out = stored(reconstruct(single, tree_state(alone, single.select(*both).distinct()), last_arcs=True))
    if not again.limit(1).count():
        return out
    state = shortest(tied, again.select("profile", F.col("source").alias("node_id")))
    return stored(out.unionByName(reconstruct(goals.join(again, both, "left_semi"), state)))


def plans(requests: DataFrame, places: DataFrame, arcs: DataFrame, bounded: bool = False, parts: DataFrame | None = None) -> DataFrame:
    """One row a request: request_id, profile, status, reason, both places, node_ids, edge_ids, network_m, start_m,
    destination_m, access_m, total_m.

    places: id, routable, node_id, distance_m (of the way to the network), and what classify takes besides. Searches from
    both ends (``corridors``), one a (profile, node), however many requests share it, leave few arcs to each exact search;
    parts (id, root: the network's weak components) spare the search for goals in other parts. start_m and destination_m are the
    ways to the network, access_m both, total_m with the network's part, to the millimetre; 0 where there is nowhere to go.
    """
    asked = stored(classify(requests, places, bounded))
    goals = asked.where("status is null").select("profile", F.col("start_node").alias("source"), F.col("destination_node").alias("node")).distinct()
    if parts is not None:
        of = lambda end: parts.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        goals = goals.join(of("source"), "source", "left").join(of("node"), "node", "left")
        goals = goals.where(F.col("source_root").eqNullSafe(F.col("node_root")) | (F.col("source") == F.col("node"))).select("profile", "source", "node")
    goals = stored(goals)
    found = ways_of(arcs, goals).select("profile", F.col("source").alias("start_node"), F.col("node").alias("destination_node"), "node_ids", "edge_ids", "distance_m")
    out = outcomes(asked, found).join(found.drop("distance_m"), ["profile", "start_node", "destination_node"], "left")
    way = lambda side: places.select(F.col("id").alias(f"{side}_id"), F.col("distance_m").alias(f"{side}_m"))
    out = out.join(way("start"), "start_id", "left").join(way("destination"), "destination_id", "left")
    there = F.coalesce(F.col("reason") == "already-there", F.lit(False))
    mm = lambda c: F.floor(c * 1000 + 0.5) / 1000
    leg = lambda c: F.when(there, 0.0).when(F.col("status") == "ok", c)
    out = out.withColumns({"access_m": leg(mm(F.col("start_m") + F.col("destination_m"))), "total_m": leg(mm(F.col("distance_m") + F.col("start_m") + F.col("destination_m"))), "start_m": leg(F.col("start_m")), "destination_m": leg(F.col("destination_m"))})
    out = out.withColumn("node_ids", F.when(there, F.array("start_node")).otherwise(F.col("node_ids"))).withColumn("edge_ids", F.when(there, F.array().cast("array<string>")).otherwise(F.col("edge_ids")))
    return out.select("request_id", "profile", "status", "reason", "start_id", "destination_id", "node_ids", "edge_ids", F.col("distance_m").alias("network_m"), "start_m", "destination_m", "access_m", "total_m")


def legs(planned: DataFrame, walk: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """request_id, start_access, network, destination_access: the three lines of found routes. walk: request_id, pos and
    the ends of its arcs (x0 to z1) or their lines (see network.drawn); places and nodes have x, y, z. A way that has no
    arc has no network line."""
    at = lambda t, side: t.select(F.col("id").alias(side), F.struct("x", "y", "z").alias(f"{side}_at"))
    ok = planned.where("status = 'ok' and reason is null")
    ends = ok.select("request_id", "start_id", "destination_id", F.element_at("node_ids", 1).alias("first"), F.element_at("node_ids", -1).alias("last"))
    for t, side in ((places, "start_id"), (places, "destination_id"), (nodes, "first"), (nodes, "last")):
        ends = ends.join(at(t, side), side)
    lines = ends.join(route_lines(walk).withColumnRenamed("points", "network"), "request_id", "left")
    return lines.select("request_id", F.array("start_id_at", "first_at").alias("start_access"), "network", F.array("last_at", "destination_id_at").alias("destination_access"))


def regressions(planned: DataFrame, golden: DataFrame, tolerance_m: float = 0.001) -> DataFrame:
    """request_id, problem (missing, status, distance, path) of the golden routes (request_id, status, total_m, edge_ids)
    that plans don't reproduce."""
    g = golden.select("request_id", F.col("status").alias("g_status"), F.col("total_m").alias("g_total"), F.col("edge_ids").alias("g_edges"))
    d = g.join(planned.withColumn("there", F.lit(True)), "request_id", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("status").eqNullSafe(F.col("g_status")), "status").when(F.abs(F.col("total_m") - F.col("g_total")) > tolerance_m, "distance").when(~F.col("edge_ids").eqNullSafe(F.col("g_edges")), "path")
    return d.select("request_id", problem.alias("problem")).where("problem is not null")


def deviations(planned: DataFrame, golden: DataFrame) -> DataFrame:
    """request_id, position (from 0), expected, found: the first edge in which a plan leaves its golden way (both with
    request_id, edge_ids). No expected edge: the plan goes on behind the golden end; no found one: it stops before, or there is
    no plan. Ways without a list are empty; equal ways give no row."""
    empty = F.array().cast("array<string>")
    g = golden.select("request_id", F.coalesce("edge_ids", empty).alias("want"))
    d = g.join(planned.select("request_id", F.col("edge_ids").alias("got")), "request_id", "left").withColumn("got", F.coalesce("got", empty))
    most = F.greatest(F.size("want"), F.size("got"))
    differs = F.filter(F.sequence(F.lit(0), most - 1), lambda i: ~F.get("want", i).eqNullSafe(F.get("got", i)))
    d = d.withColumn("position", F.when(most > 0, F.array_min(differs))).where("position is not null")
    return d.select("request_id", "position", F.get("want", F.col("position")).alias("expected"), F.get("got", F.col("position")).alias("found"))


def connectors(walk: DataFrame) -> DataFrame:
    """request_id, connectors: kind, floor_from and floor_to of the arcs that change floors, in walking order. Ways on one
    floor give no row. walk: request_id, pos, kind, floor_from, floor_to."""
    change = walk.where("floor_from != floor_to")
    return change.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "floor_from", "floor_to"))), lambda s: s.dropFields("pos")).alias("connectors"))
