"""Routing graphs: edges with accessibility, arcs, statistics, components, rejects."""

from __future__ import annotations

import contextvars
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_reading_order

PROFILES = ["shortest", "accessible", "avoid-stairs", "prefer-elevator", "fewest-floor-changes"]


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names. Only a local session gets a folder of its own where none is
    named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-loop-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage by a table in the shared checkpoint folder. Unlike a checkpoint, which keeps the estimated size
    of its plan (a product for each join, which a loop of joins squares round by round), a table has its true size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _MADE.get() is not None:
        _MADE.get().append(out)
    return out


#: The tables that the running function with tables of its own has stored.
_MADE = contextvars.ContextVar("made", default=None)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and have Spark's cleaner delete the shuffle files of what they were
    made of (it learns of them when the driver's heap is collected)."""
    if not tables:
        return
    spark = tables[0].sparkSession
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def own_tables(f):
    """A function all of whose results are stored tables; the others that it stores go when it ends."""

    @functools.wraps(f)
    def run(*args, **named):
        outer, made = _MADE.get(), []
        token = _MADE.set(made)
        try:
            out = f(*args, **named)
        finally:
            _MADE.reset(token)
        given = out if isinstance(out, tuple) else (out,)
        if outer is not None:
            outer.extend(given)
        dropped(*(t for t in made if not any(t is g for g in given)))
        return out

    return run


def with_endpoints(edges: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """edges with the floors, places and contexts of both ends (a_*, b_*)."""
    cols = ["id", "x", "y", "z", "floor_id", "in_out"]
    a = nodes.select(*[F.col(c).alias("from_id" if c == "id" else f"a_{c}") for c in cols])
    b = nodes.select(*[F.col(c).alias("to_id" if c == "id" else f"b_{c}") for c in cols])
    return edges.join(a, "from_id", how).join(b, "to_id", how)


def reasons() -> Column:
    k, w, s, d, e = (F.col(c) for c in ("kind", "width", "vtcl_slope", "lev_diff", "elevator"))
    found = [
        F.when(k == "stairs", "stairs"),
        F.when(k == "escalator", "escalator"),
        F.when(w == "1", "width-under-1m"),
        F.when(s.isin("2", "3"), "slope-over-5-percent"),
        F.when(d == "2", "level-difference-over-2cm"),
        F.when((k == "elevator") & e.isin("2", "4"), "elevator-not-wheelchair-equipped"),
    ]
    return F.array_compact(F.array(*found))


def unknowns() -> Column:
    k, w, s, d, e = (F.col(c) for c in ("kind", "width", "vtcl_slope", "lev_diff", "elevator"))
    found = [
        F.when(w == "99", "width"),
        F.when(s == "99", "vertical-slope"),
        F.when(d == "99", "level-difference"),
        F.when((k == "elevator") & ~e.isin("2", "3", "4", "5"), "wheelchair-elevator-equipment"),
    ]
    return F.array_compact(F.array(*found))


def routing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ready for routing: geometry distance where the source says 0, accessibility with reasons and unknowns."""
    d = with_endpoints(edges, nodes)
    line = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 + (F.col("a_z") - F.col("b_z")) ** 2)
    d = d.withColumn("geometry_m", line).withColumn("distance_m", F.when(F.col("source_m") > 0, F.col("source_m")).otherwise(F.col("geometry_m")))
    d = d.withColumn("reasons", reasons()).withColumn("unknowns", unknowns())
    access = F.when(F.size("reasons") > 0, "no").when(F.size("unknowns") > 0, "unknown").otherwise("yes")
    context = F.when((F.col("a_in_out") == "outside") | (F.col("b_in_out") == "outside"), "outside").when((F.col("a_in_out") == "boundary") | (F.col("b_in_out") == "boundary"), "boundary").otherwise("inside")
    return d.select("id", "from_id", "to_id", "direction", "kind", "distance_m", "geometry_m", access.alias("accessibility"), "reasons", "unknowns", F.col("a_floor_id").alias("floor_from"), F.col("b_floor_id").alias("floor_to"), context.alias("context"))


def arcs(edges: DataFrame) -> DataFrame:
    """One row a direction of travel; reversed arcs are named id:reverse."""
    cols = [c for c in edges.columns if c not in ("id", "from_id", "to_id", "direction", "floor_from", "floor_to")]
    one = lambda i, a, b, x, y: F.struct(i.alias("id"), F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.col(x).alias("floor_from"), F.col(y).alias("floor_to"))
    both = F.array_compact(F.array(
        F.when(F.col("direction") != "reverse", one(F.col("id"), "from_id", "to_id", "floor_from", "floor_to")),
        F.when(F.col("direction") != "forward", one(F.concat("id", F.lit(":reverse")), "to_id", "from_id", "floor_to", "floor_from")),
    ))
    return edges.select(F.explode(both).alias("arc"), *cols).select("arc.*", *cols)


#: Edges that a task contracts in memory.
EDGE_BLOCK = 500_000


def _contract():
    """A task's function that travels with its code, so that workers needn't have this module."""

    def run(batches):
        """Edges of a task as (a, b): b is the smallest node that they tie a to, which has a row with itself."""
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        ends = pa.chunked_array([x.column(c).cast(pa.large_string()) for c in ("a", "b") for x in parts])
        node = pc.unique(ends)
        node = node.take(pc.sort_indices(node))  # by bytes
        at = pc.index_in(ends, node).to_numpy().astype(np.int64)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while (new != new[new]).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([node.cast(pa.string()), node.take(pa.array(label)).cast(pa.string())], names=["a", "b"])

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, root (smallest id) of each node with an edge. Tasks contract EDGE_BLOCK edges each; where several had to, nodes that
    several of them hold tie their parts together, which are contracted in their turn while they get fewer. Else
    labels take their neighbours' minimum, then their label's label, so that rounds grow with the logarithm of a
    component's width."""
    both = edges.select(F.coalesce("from_id", "to_id").alias("a"), F.coalesce("to_id", "from_id").alias("b"))
    both = stored(both.where("a is not null"))
    n = both.count()
    tasks = max(1, -(-n // EDGE_BLOCK))
    both = stored(both.repartition(tasks).mapInArrow(_contract(), "a string, b string"))
    if tasks == 1:
        return both.select(F.col("a").alias("id"), F.col("b").alias("root"))
    low = stored(both.groupBy("a").agg(F.min("b").alias("low")))
    ties = stored(both.join(low, "a").where("b != low").select(F.col("low").alias("from_id"), F.col("b").alias("to_id")).distinct())
    if 2 * ties.count() <= n:
        top = components(ties, max_rounds).select(F.col("id").alias("low"), "root")
        return low.join(top, "low", "left").select(F.col("a").alias("id"), F.coalesce("root", "low").alias("root"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, "a").select("a", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("a").alias("next"), F.col("root").alias("far"))
        now = stored(step.join(jump, "next").select("a", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")))
        label = now.select("a", "root")
        if not now.where("moved").limit(1).count():
            return label.withColumnRenamed("a", "id")
    raise RuntimeError("components did not settle")


def ranked(df: DataFrame, order: list, group: tuple[str, ...] = ()) -> DataFrame:
    """df with nth (from 1, by order, in its group) and of (its group's rows).

    Rows are dealt by ranges of group and order, so that a group of any size, or one group of all rows, takes many
    tasks; each range counts from what the ranges before it hold. Rows equal in order are numbered in any order.
    """
    d = durable(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    d = d.withColumn("__nth", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)))
    n = d.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))  # a row for each group and range
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], before.alias("__before"), F.sum("__n").over(whole).alias("of"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = d.join(n, same)
    return out.select(*df.columns, (F.col("__nth") + F.col("__before")).cast("long").alias("nth"), F.col("of").cast("long").alias("of"))


def component_report(edges: DataFrame) -> DataFrame:
    """component_id (from 1, largest first, then by root), root (the first id in reading order), size."""
    first = F.min(F.struct(*in_reading_order("id"))).alias("first")
    sizes = components(edges).groupBy("root").agg(F.count(F.lit(1)).alias("size"), first).select("size", F.col("first.id").alias("root"))
    return ranked(sizes, [F.desc("size"), *in_reading_order("root")]).select(F.col("nth").alias("component_id"), "root", "size")


def component_numbers(nodes: DataFrame, edges: DataFrame, order: str = "id") -> DataFrame:
    """id, component_id (from 0) of all nodes; components are numbered in the order of their first node (texts in reading
    order), a node without edges is one of its own."""
    d = nodes.select("id", F.col(order).alias("place")).join(components(edges), "id", "left").withColumn("root", F.coalesce("root", "id"))
    keys = in_reading_order("place") if dict(d.dtypes)["place"].startswith("string") else [F.col("place")]
    first = d.groupBy("root").agg(F.min(F.struct(*keys, "id")).alias("first")).select("root", "first.place", "first.id")
    numbers = ranked(first, [*keys, F.col("id")]).select("root", (F.col("nth") - 1).alias("component_id"))
    return d.join(numbers, "root").select("id", "component_id")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incident edge, valid or not."""
    used = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id")))
    return nodes.join(used, "id", "left_anti")


def rejected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with missing ends: id and reason (both, start or end); exactly one missing end makes a boundary link."""
    d = with_endpoints(edges, nodes, "left")
    no_a, no_b = F.col("a_floor_id").isNull(), F.col("b_floor_id").isNull()
    reason = F.when(no_a & no_b, "both-ends-missing").when(no_a, "start-missing").when(no_b, "end-missing")
    return d.select("id", reason.alias("reason"), (no_a != no_b).alias("boundary")).where("reason is not null")


def statistics(edges: DataFrame) -> DataFrame:
    """kind, direction, edges, cross_floor, vertical connectors, largest difference of source and geometry (mm)."""
    cross = F.col("floor_from") != F.col("floor_to")
    gap = F.max(F.abs(F.col("distance_m") - F.col("geometry_m")))
    return edges.groupBy("kind", "direction").agg(F.count(F.lit(1)).alias("edges"), F.sum(cross.cast("long")).alias("cross_floor"), F.sum((cross & (F.col("kind") != "corridor")).cast("long")).alias("vertical"), F.floor(gap * 1000 + 0.5).cast("long").alias("max_gap_mm"))


def eligible(profile: str) -> Column:
    return {"accessible": F.col("accessibility") != "no", "avoid-stairs": F.col("kind") != "stairs"}.get(profile, F.lit(True))


def cost(profile: str, penalty: Column) -> Column:
    cross = F.col("floor_from") != F.col("floor_to")
    if profile == "fewest-floor-changes":
        return F.col("distance_m") + F.when(cross, penalty).otherwise(0.0)
    if profile == "prefer-elevator":
        return F.col("distance_m") + F.when(cross & (F.col("kind") != "elevator"), penalty).otherwise(0.0)
    return F.col("distance_m")


def penalty(edges: DataFrame) -> DataFrame:
    """One row: more than any route's length, so that one floor change outweighs distance. The sum doesn't depend on the
    order of rows: whole metres and 2^-36 parts add exactly, only what is below them is rounded."""
    d = edges.select(F.greatest(F.lit(0.0), "distance_m").alias("m")).withColumn("whole", F.floor(F.col("m")).cast("double"))
    part = F.nanvl(F.col("m") - F.col("whole"), F.lit(0.0)) * 2.0**36
    d = d.select("whole", F.floor(part).alias("part"), (part - F.floor(part)).alias("rest"))
    total = F.sum("whole") + (F.sum("part") + F.sum("rest") + F.lit(2.0**36)) / 2.0**36
    return d.agg(F.coalesce(total, F.lit(1.0)).alias("penalty"))


def scales(edges: DataFrame) -> DataFrame:
    """One row with, for each profile, the least cost of a straight metre over its edges (0 without any)."""
    d = edges.crossJoin(F.broadcast(penalty(edges))).where("geometry_m > 0")  # one row
    least = [F.coalesce(F.min(F.when(eligible(p), cost(p, F.col("penalty")) / F.col("geometry_m"))), F.lit(0.0)).alias(p.replace("-", "_")) for p in PROFILES]
    return d.agg(*least)


def profile_arcs(edges: DataFrame) -> DataFrame:
    """profile, from_id, to_id, id, cost, distance_m for all profiles."""
    d = arcs(edges).crossJoin(F.broadcast(penalty(edges)))  # one row
    rows = [F.when(eligible(p), F.struct(F.lit(p).alias("profile"), cost(p, F.col("penalty")).alias("cost"))) for p in PROFILES]
    return d.select("from_id", "to_id", "id", "distance_m", F.explode(F.array_compact(F.array(*rows))).alias("p")).select("p.profile", "from_id", "to_id", "id", "p.cost", "distance_m")
