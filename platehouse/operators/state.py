"""Keyed state: claims of actions and exports, camera health, live status, compare-and-set commands, audit redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.redaction import redact  # noqa: F401 (an operator of the audit log)
from platehouse.operators.lifecycles import compare_and_set  # noqa: F401 (a lifecycle, folded over ranges)


def claim_actions(wanted: DataFrame, executions: DataFrame, stale_before: Column, most_attempts: int) -> DataFrame:
    """Executions that may run now: new ones, failed ones and running ones gone stale, while attempts are left.

    wanted: id, at. executions: id, status, attempts, updated_at. Returns id, attempts (this one counted), reclaimed.
    """
    e = executions.select("id", "status", "attempts", "updated_at")
    joined = wanted.select("id", "at").join(e, "id", "left")
    again = (F.col("attempts") < most_attempts) & ((F.col("status") == "FAILED") | ((F.col("status") == "RUNNING") & (F.col("updated_at") < stale_before)))
    return joined.where(F.col("status").isNull() | again).select("id", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), F.col("status").isNotNull().alias("reclaimed"))


def claim_export(samples: DataFrame, export_id: str, limit: int, stale_before: Column) -> DataFrame:
    """Up to `limit` samples for an export: first those that it holds already, then free or stale ones, oldest first.

    samples: id, status, created_at, export_id, attempts, claimed_at. Returns id and attempts; held ones keep theirs.
    """
    held = (F.col("status") == "EXPORTING") & (F.col("export_id") == export_id)
    free = F.col("status").isin("READY", "EXPORT_FAILED") | ((F.col("status") == "EXPORTING") & (F.col("claimed_at") < stale_before))
    rank = F.when(F.coalesce(held, F.lit(False)), 0).otherwise(1)
    some = samples.where(F.coalesce(held, F.lit(False)) | F.coalesce(free, F.lit(False))).withColumn("_rank", rank).orderBy("_rank", "created_at", "id").limit(limit)
    return some.select("id", (F.coalesce("attempts", F.lit(0)) + F.col("_rank")).alias("attempts"))


def latest_health(reports: DataFrame) -> DataFrame:
    """The newest report of each camera."""
    rest = [c for c in reports.columns if c != "camera_id"]
    newest = F.struct("updated_at", *[c for c in rest if c != "updated_at"])  # of one time the greatest values
    return reports.groupBy("camera_id").agg(F.max_by(F.struct(*rest), newest).alias("_h")).select("camera_id", "_h.*")


def live_status(cameras: DataFrame, frames: DataFrame, now: Column, stale_after: float, source_down: bool = False) -> DataFrame:
    """(camera_id, status): DISABLED, LIVE, STALE, or without frames WAITING (OFFLINE if the source is down)."""
    last = frames.groupBy("camera_id").agg(F.max("received_at").alias("_last"))
    age = F.timestamp_diff("MICROSECOND", F.col("_last"), now) / 1e6
    status = F.when(~F.col("enabled"), "DISABLED").when(F.col("_last").isNull(), "OFFLINE" if source_down else "WAITING").when(age > stale_after, "STALE").otherwise("LIVE")
    return cameras.join(last, "camera_id", "left").select("camera_id", status.alias("status"))


def recent_ids(rows: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Rows without repeats of a key (first by time) among the newest `most` distinct keys."""
    first = rows.groupBy(key).agg(F.min(at).alias(at))
    return first.orderBy(F.desc(at), F.desc(key)).limit(most)


def failure_causes(reports: DataFrame, causes: dict[str, Column]) -> DataFrame:
    """Reports with the names of the causes that hold, in order."""
    return reports.withColumn("causes", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in causes.items()])))


def audit_page(log: DataFrame, filters: dict[str, object], start, end, limit: int) -> DataFrame:
    """The newest entries of an audit log that match, both ends of the time included, and one more."""
    from platehouse.operators.events import matching, page

    return page(log.where(matching(filters, start=start, end=end)), limit)


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
