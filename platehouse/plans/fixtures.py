"""Vehicle tables derived from the driver's tables. Each column's expression is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Clean plates have province, a letter and five digits; readings confuse characters, add marks or are noise.
_COMPACT = "concat(lpad(CAST(11 + user_id % 88 AS STRING), 2, '0'), substr('ABCDEFGHKLMNPSTUVXYZ', CAST(1 + user_id % 20 AS INT), 1), lpad(CAST((user_id * 37 + 10205) % 100000 AS STRING), 5, '0'))"
_DIRECTION = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'ENTER' WHEN 1 THEN 'EXIT' ELSE 'UNKNOWN' END"
_READ = f"CASE WHEN event_id % 11 = 0 THEN 'HELLO' WHEN event_id % 7 = 0 THEN translate({_COMPACT}, '0158', 'OISB') WHEN event_id % 5 = 0 THEN concat(substr({_COMPACT}, 1, 3), '-', substr({_COMPACT}, 4, 3), '.', substr({_COMPACT}, 7, 2)) WHEN event_id % 13 = 0 THEN substr({_COMPACT}, 4, 5) ELSE {_COMPACT} END"
EVENTS = {
    "event_id": "event_id", "id": "concat('evt_', lpad(CAST(event_id AS STRING), 8, '0'))", "camera_id": "concat('cam-', CAST(event_id % 8 AS STRING))", "track_id": "concat('t-', CAST(event_id % 997 AS STRING))",
    "vehicle_id": "CASE WHEN user_id % 50 <> 7 THEN concat('veh-', CAST(user_id AS STRING)) END", "direction": _DIRECTION,
    "event_type": "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'VEHICLE_ENTER' WHEN 1 THEN 'VEHICLE_EXIT' ELSE 'VEHICLE_DETECTED' END",
    "status": "CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'click' THEN 'NEEDS_REVIEW' WHEN 'view' THEN 'LOW_CONFIDENCE' WHEN 'signup' THEN 'UNREADABLE' ELSE 'NO_PLATE' END",
    "raw": _READ, "plate": f"CASE WHEN event_type NOT IN ('signup', 'error') THEN {_COMPACT} END",
    "plate_final": f"CASE WHEN event_id % 20 = 0 AND event_type NOT IN ('signup', 'error') THEN concat(substr({_COMPACT}, 1, 7), '9') END",
    "plate_confidence": "CASE WHEN event_type NOT IN ('signup', 'error') THEN least(value / 600.0, 1.0) END", "reviewed": "event_id % 10 = 0", "corrected": "event_id % 20 = 0",
    "model_name": "CASE WHEN event_id % 17 <> 0 THEN 'reader' END", "model_version": "CASE WHEN event_id % 17 <> 0 THEN concat('v', CAST(event_id % 3 AS STRING)) END",
    "vehicle_type": "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'motorcycle' ELSE 'unknown' END",
    "vehicle_confidence": "0.5 + (event_id % 50) / 100.0", "color": "CASE WHEN event_id % 6 <> 0 THEN substr('redblugrn', CAST(1 + 3 * (event_id % 3) AS INT), 3) END",
    "occurred_at": "ts", "value": "value", "user_id": "user_id", "zone": "concat('ZONE_', CAST(event_id % 4 AS STRING))",
    "observed_at": "ts", "embedding_id": "event_id % 500",
}
#: The same as a DuckDB query.
VE = "ve AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVENTS.items()) + " FROM events)"

#: Eight cameras in a ring, both ways; one edge is off.
EDGES = [(f"e{i}{'ab'[way]}", f"cam-{i}", f"cam-{(i + 1 - 2 * way) % 8}", 60.0, 1800.0 + 600 * way, 7200.0, not (i == 3 and way == 1)) for i in range(8) for way in (0, 1)]
EDGE_COLUMNS = "id, from_camera_id, to_camera_id, minimum_travel_seconds, typical_travel_seconds, maximum_travel_seconds, enabled"
EDGE_VALUES = "edges(" + EDGE_COLUMNS + ") AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE), CAST({e} AS DOUBLE), CAST({f} AS DOUBLE), {str(g).lower()})" for a, b, c, d, e, f, g in EDGES) + ")"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vehicle_events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in EVENTS.items()])


def edges(spark: SparkSession) -> DataFrame:
    """topology_edges."""
    return spark.createDataFrame(EDGES, "id string, from_camera_id string, to_camera_id string, minimum_travel_seconds double, typical_travel_seconds double, maximum_travel_seconds double, enabled boolean")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Watchlist entries for one in five vehicles' plates, with open, past and current intervals.
WATCHLIST = {
    "id": "concat('w-', CAST(u AS STRING))", "plate": _COMPACT.replace("user_id", "u"), "list_type": "CASE CAST(u % 3 AS INT) WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'VIP' ELSE 'ALLOW' END", "enabled": "u % 4 <> 3",
    "valid_from": "CASE WHEN u % 2 = 0 THEN low END", "valid_until": "CASE WHEN u % 5 <> 0 THEN high END",
}
WL = "wl AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in WATCHLIST.items()) + " FROM (SELECT user_id AS u, min(ts) AS low, max(CASE WHEN event_id % 2 = 0 THEN ts END) AS high FROM events WHERE user_id % 5 = 0 GROUP BY user_id))"


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    spans = table(spark, sf_dir, "events").where("user_id % 5 = 0").groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("low"), F.max(F.when(F.col("event_id") % 2 == 0, F.col("ts"))).alias("high"))
    return spans.selectExpr(*[f"{e} AS {n}" for n, e in WATCHLIST.items()])


#: Boxes from order lines: truths by line, predictions shifted from them.
TRUTHS = {"id": "((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 1000 + l_suppkey % 10 * 100 + CAST(l_quantity AS BIGINT)", "image_id": "l_orderkey", "category_id": "CAST(l_linenumber % 2 AS BIGINT)", "x": "CAST(l_partkey % 40 AS DOUBLE)", "y": "CAST(l_suppkey % 10 AS DOUBLE)", "w": "10.0 + l_quantity", "h": "8.0 + l_linenumber"}
PREDICTED = {"id": "((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 1000 + l_suppkey % 10 * 100 + CAST(l_quantity AS BIGINT)", "image_id": "l_orderkey", "category_id": "CAST(l_linenumber % 2 AS BIGINT)", "x": "CAST(l_partkey % 40 AS DOUBLE) + 40 * l_discount", "y": "CAST(l_suppkey % 10 AS DOUBLE) + l_tax", "w": "10.0 + l_quantity", "h": "8.0 + l_linenumber", "score": "round(l_extendedprice / 110000.0, 6)"}


def boxes(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """truths or predictions with bbox [x, y, w, h]."""
    rest = [c for c in columns if c not in "xywh"]
    lines = table(spark, sf_dir, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" if n in "xywh" or n == "score" else f"{e} AS {n}" for n, e in columns.items()])
    return lines.selectExpr(*rest, "array(x, y, w, h) AS bbox")
