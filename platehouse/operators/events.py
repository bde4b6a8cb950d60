"""Event queries: conjunctive filters, keyset pages, timelines, first-write-wins storage and console views."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions import plates
from platehouse.functions.scratch import new_path, staged


def matching(equal: dict[str, object], at: str = "occurred_at", start=None, end=None, half_open: bool = False) -> Column:
    """All given conditions together; a value of None sets none. Times are inclusive, or half-open at the end."""
    terms = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    if start is not None:
        terms.append(F.col(at) >= F.lit(start))
    if end is not None:
        terms.append(F.col(at) < F.lit(end) if half_open else F.col(at) <= F.lit(end))
    return reduce(Column.__and__, terms, F.lit(True))


def effective_plate() -> Column:
    """The reviewed plate if there is one, else the normalized reading."""
    return F.coalesce("plate_final", "plate")


def encode_cursor(at: str, key: str) -> str:
    """An opaque page cursor."""
    return base64.urlsafe_b64encode(json.dumps({"occurredAt": at, "id": key}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return found["occurredAt"], found["id"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid cursor") from error


def encode_bound(after: str, bound: dict[str, object]) -> str:
    """A cursor after a key that holds for one set of filters."""
    return base64.urlsafe_b64encode(json.dumps({"after": after, "bound": bound}, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_bound(cursor: str, bound: dict[str, object]) -> str:
    """The key of a cursor; ValueError if it is none or was made with other filters."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        after, made_with = found["after"], found["bound"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid cursor") from error
    if made_with != bound or not isinstance(after, str):
        raise ValueError("the cursor belongs to other filters")
    return after


def in_camera_window(prints: DataFrame, camera_id: str, start, end, limit: int) -> DataFrame:
    """A camera's newest observations from start to end, both included."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = prints.where(matching({"camera_id": camera_id}, at="observed_at", start=start, end=end))
    return rows.orderBy(F.desc("observed_at"), F.desc("id")).limit(limit)


def first_occurrences(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key once with the place (order columns) where it first stands; sorting by that keeps the rows' order."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).select(key, "_first.*")


def page(events: DataFrame, limit: int, after: tuple[object, str] | None = None, at: str = "occurred_at", key: str = "id", ascending: bool = False) -> DataFrame:
    """One page by (at, key), newest first: rows strictly after the cursor, and one more to tell whether another follows."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    if after is not None:
        moment, last = F.lit(after[0]).cast(dict(events.dtypes)[at]), F.lit(after[1])
        beyond = (F.col(at) > moment) | ((F.col(at) == moment) & (F.col(key) > last)) if ascending else (F.col(at) < moment) | ((F.col(at) == moment) & (F.col(key) < last))
        events = events.where(beyond)
    order = [F.col(at).asc(), F.col(key).asc()] if ascending else [F.col(at).desc(), F.col(key).desc()]
    return events.orderBy(*order).limit(limit + 1)


def latest(events: DataFrame, by: str, at: str = "occurred_at", key: str = "id") -> DataFrame:
    """The newest row of each group, found without sorting groups."""
    rest = [c for c in events.columns if c != by]
    return events.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(at, key)).alias("_row")).select(by, "_row.*")


def last_n(events: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group in an order."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, semantic: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that are new by key and by semantic key: the first of each in `order` is kept.

    A row that another row shadows by one key does not shadow others by its second key, so the rule is applied again
    until no row changes: a round for each link of a chain of shadows, each a pair of windows over the rows still open.
    Rounds are staged in the shared folder and what is kept is read from there, so plans do not grow.
    """
    spark = incoming.sparkSession
    rows = staged(incoming.join(stored.select(key), key, "left_anti").join(stored.select(*semantic), semantic, "left_anti").select(*incoming.columns), "open")
    kept = new_path(spark, "kept")
    rows.limit(0).write.parquet(kept)
    while not rows.isEmpty():
        first = rows.withColumn("_a", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy(*semantic).orderBy(*order)))
        sure = staged(first.where("_a = 1 AND _b = 1").drop("_a", "_b"), "sure")
        sure.write.mode("append").parquet(kept)
        rows = staged(rows.join(sure.select(key), key, "left_anti").join(sure.select(*semantic), semantic, "left_anti").select(*incoming.columns), "open")
    return spark.read.schema(incoming.schema).parquet(kept)


def hourly_activity(events: DataFrame, now: str, hours: int = 7, at: str = "occurred_at") -> DataFrame:
    """Entries, exits and total of each of the last hours, with zeros where nothing happened, and a bar width."""
    top = F.date_trunc("hour", F.lit(now).cast("timestamp_ntz"))
    calendar = events.sparkSession.range(hours).select((top - F.make_dt_interval(hours=(hours - 1 - F.col("id")).cast("int"))).cast("timestamp_ntz").alias("hour"))
    seen = events.where((F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))) & (F.col(at) < top + F.make_dt_interval(hours=F.lit(1))))
    counts = seen.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.col("direction") == "ENTER").alias("entries"), F.count_if(F.col("direction") == "EXIT").alias("exits"), F.count("*").alias("total"))
    filled = calendar.join(counts, "hour", "left").fillna(0, ["entries", "exits", "total"])
    most = F.greatest(F.lit(1), F.max("total").over(Window.partitionBy()))
    return filled.withColumn("width", F.greatest(F.lit(3.0), F.lit(100.0) * F.col("total") / most))


def dashboard(events: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Totals; with health, cameras on and off line (a camera without a report is neither)."""
    out = events.agg(F.count("*").alias("total"), F.count_if(F.col("direction") == "ENTER").alias("entries"), F.count_if(F.col("direction") == "EXIT").alias("exits"), F.count_if(effective_plate().isNull()).alias("no_plate"))
    if health is not None:
        out = out.crossJoin(health.agg(F.count_if(F.col("status") == "ONLINE").alias("online"), F.count_if(F.col("status") != "ONLINE").alias("offline"), F.sum("dropped_frames").alias("dropped_frames"), F.sum("reconnects").alias("reconnects")))  # one row each
    return out


def most_common(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group that is not null; of equals the least."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def plate_history(events: DataFrame) -> DataFrame:
    """One row for each effective plate: counts, cameras, directions, span, usual type and colour, mean confidence."""
    seen = events.withColumn("plate_key", effective_plate()).where("plate_key IS NOT NULL")
    out = seen.groupBy("plate_key").agg(
        F.count("*").alias("observations"), F.countDistinct("camera_id").alias("cameras"), F.count_if(F.col("direction") == "ENTER").alias("entries"), F.count_if(F.col("direction") == "EXIT").alias("exits"),
        F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("latest"), F.avg("plate_confidence").alias("mean_confidence"), F.countDistinct("vehicle_id").alias("vehicles"), F.count_if(F.col("vehicle_id").isNull()).alias("unresolved"),
    )
    for value in ("vehicle_type", "color"):
        out = out.join(most_common(seen, ["plate_key"], value), "plate_key", "left")
    return out


def merge_realtime(current: DataFrame, incoming: DataFrame, keep: int = 200) -> DataFrame:
    """Both by id, incoming first, the newest `keep` of them."""
    both = incoming.withColumn("_old", F.lit(0)).unionByName(current.withColumn("_old", F.lit(1)))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_old", F.desc("occurred_at")))).where("_n = 1")
    return first.drop("_n", "_old").orderBy(F.desc("occurred_at"), F.desc("id")).limit(keep)


def plate_contains(text: str) -> Column:
    """The console's filter: part of a plate, without hyphens, dots and spaces."""
    bare = F.regexp_replace(F.upper(effective_plate()), "[-. ]", "")
    return bare.contains("".join(c for c in text.upper() if c not in "-. "))


def window_of(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """An aligned page by offset, with has_previous and has_next."""
    start = offset // size * size
    some = rows.orderBy(*order).offset(start).limit(size + 1)
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most size + 1 rows
    return numbered.withColumn("has_previous", F.lit(start > 0)).withColumn("has_next", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def canonical(text: str, spark) -> str | None:
    """A query's plate in the form that events hold."""
    return spark.range(1).select(plates.normalize(F.lit(text), allow_partial=True)["normalized"]).first()[0]
