"""Retention: what may go at a time, past pins of samples that still need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in these states pin their event and media; an event has these media.
PINNING = ("READY", "EXPORTING", "EXPORT_FAILED")
MEDIA = ("snapshot_key", "vehicle_crop_key", "plate_crop_key", "clip_key")


def expired_events(events: DataFrame, samples: DataFrame, now: str, days: int, limit: int, over_fetch: int | None = 4) -> DataFrame:
    """The oldest events before the cut-off (exclusive) that no sample pins and that have no media left, at most `limit`.

    With over_fetch, only the oldest over_fetch * limit rows are looked at before pins are taken away; None looks at all.
    """
    cut = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    old = events.where(F.col("occurred_at") < cut).where(" AND ".join(f"{m} IS NULL" for m in MEDIA))
    if over_fetch is not None:
        old = old.orderBy("occurred_at", "id").limit(over_fetch * limit)
    pins = samples.where(F.col("status").isin(*PINNING)).select(F.col("source_event_id").alias("id"))
    return old.join(pins, "id", "left_anti").orderBy("occurred_at", "id").limit(limit)


def expired_media(events: DataFrame, samples: DataFrame, now: str, days: dict[str, int]) -> DataFrame:
    """(id, kind, key) of media past their kind's age that no sample pins."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key"), F.lit(d).alias("days")) for k, d in days.items()])
    rows = events.select("id", "occurred_at", F.inline(pairs)).where("key IS NOT NULL").where(F.col("occurred_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.col("days")))
    pins = samples.where(F.col("status").isin(*PINNING)).select(F.col("image_key").alias("key"))
    return rows.join(pins, "key", "left_anti").select("id", "kind", "key")
