"""Journeys: a vehicle's events in order, each pair checked against the camera topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.scalars import seconds_between


def segments(events: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Consecutive events of each vehicle by (occurred_at, id): elapsed_seconds, edge_id, feasible (null without an edge).

    With a limit, the first `limit` events of a vehicle count and `truncated` says whether there were more.
    """
    order = Window.partitionBy("vehicle_id").orderBy("occurred_at", "id")
    seen = events.where("vehicle_id IS NOT NULL").select("vehicle_id", "id", "camera_id", "occurred_at")
    if limit is not None:
        seen = seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit + 1)
        seen = seen.withColumn("truncated", F.max("_n").over(Window.partitionBy("vehicle_id")) > limit).where(F.col("_n") <= limit)
    else:
        seen = seen.withColumn("truncated", F.lit(False))
    pairs = seen.select("vehicle_id", "truncated", F.lag("id").over(order).alias("from_event"), F.col("id").alias("to_event"), F.lag("camera_id").over(order).alias("from_camera_id"), F.col("camera_id").alias("to_camera_id"), F.lag("occurred_at").over(order).alias("_from"), F.col("occurred_at").alias("_to")).where("from_event IS NOT NULL")
    e = edges.where("enabled").select("from_camera_id", "to_camera_id", F.col("id").alias("edge_id"), "minimum_travel_seconds", "maximum_travel_seconds")
    joined = pairs.withColumn("elapsed_seconds", seconds_between(F.col("_from"), F.col("_to"))).join(e, ["from_camera_id", "to_camera_id"], "left")
    return joined.select("vehicle_id", "from_event", "to_event", "from_camera_id", "to_camera_id", "elapsed_seconds", "edge_id", F.col("elapsed_seconds").between(F.col("minimum_travel_seconds"), F.col("maximum_travel_seconds")).alias("feasible"), "truncated")


def summarize(events: DataFrame, found: DataFrame) -> DataFrame:
    """Per vehicle: observations, cameras, duration and the segments that are infeasible or have no edge."""
    seen = events.where("vehicle_id IS NOT NULL").groupBy("vehicle_id").agg(F.count("*").alias("observations"), F.countDistinct("camera_id").alias("cameras"), F.greatest(F.lit(0.0), seconds_between(F.min("occurred_at"), F.max("occurred_at"))).alias("duration_seconds"))
    doubts = found.groupBy("vehicle_id").agg(F.count_if(~F.col("feasible")).alias("infeasible"), F.count_if(F.col("feasible").isNull()).alias("unknown_topology"))
    return seen.join(doubts, "vehicle_id", "left").fillna(0, ["infeasible", "unknown_topology"])
