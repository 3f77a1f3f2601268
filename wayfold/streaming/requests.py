"""Submitted route requests as a stream: told apart, classified as they arrive, planned whole in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import guidance, network, routing

PLAN = ["request_id", "profile", "status", "reason", "start_id", "destination_id", "node_ids", "edge_ids", "network_m", "start_m", "destination_m", "access_m", "total_m", "steps"]


def requests_from_events(events: DataFrame) -> DataFrame:
    """A request for each event: start from its user, destination from its properties."""
    k = F.get_json_object("props", "$.k")
    return events.select(F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("start_id"), F.concat(F.lit("customer:"), k).alias("destination_id"), F.lit("shortest").alias("profile"))


def classify_stream(requests: DataFrame, places: DataFrame) -> DataFrame:
    """The stream-static join of each request with both of its places."""
    return routing.classify(requests, places)


def submitted_once(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """requests (request_id, ts, ...) without repeated submissions of an id within the delay. A request without a time
    counts as of its micro-batch; one that comes later than the delay allows is dropped with its state gone."""
    timed = requests.withColumn("ts", F.coalesce("ts", F.current_timestamp()))  # a micro-batch logs its time, so reruns agree
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def whole_plans(requests: DataFrame, places: DataFrame, nodes: DataFrame, arcs: DataFrame, profiles: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """routing.plans with steps: an array of struct(step_no, kind, distance_m, floor_from, floor_to, movement, edge_ids),
    null where nothing was found. places: as routing.plans takes them, with floor_id; nodes: id, x, y, z; arcs: the
    network's, with kind and floors; profiles: arcs by profile (graph.profile_arcs)."""
    plan = routing.stored(routing.plans(requests, places, profiles, parts=parts))
    found = plan.where("status = 'ok'")
    at = lambda end, i: nodes.select(F.col("id").alias(f"{end}_id"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
    walk = network.resolved(found.select("request_id", "node_ids", "edge_ids"), arcs.select("id", "from_id", "to_id", "kind", "floor_from", "floor_to", "distance_m"))
    walk = walk.join(at("from", 0), "from_id").join(at("to", 1), "to_id")
    side = lambda s: places.select(F.col("id").alias(f"{s}_id"), F.col("floor_id").alias(f"{s}_floor"))
    ends = found.join(side("start"), "start_id").join(side("destination"), "destination_id")
    steps = guidance.steps(walk, ends.select("request_id", "start_floor", "start_m", "destination_floor", "destination_m"))
    step = F.struct("step_no", "kind", "distance_m", "floor_from", "floor_to", "movement", "edge_ids")
    steps = steps.groupBy("request_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # the steps of one way
    return plan.join(steps, "request_id", "left").select(*PLAN)


def plan_stream(requests: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Write plan(requests) of each micro-batch as Parquet below path, in a folder of its batch id.

    Submissions are told apart by request_id (submitted_once); a micro-batch that runs again after a failure overwrites its
    own folder, so that each request has one plan however often the stream restarts from its checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = batch.persist()
        if asked.limit(1).count():  # batches that only move the watermark write nothing
            plan(asked).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        asked.unpersist()

    return submitted_once(requests, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
