"""First writes on keyed state: streaming deduplication by id and then by track and type, in order within a micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platehouse.sources import files

#: What an event is unique by, beside its id.
SEMANTIC = ("camera_id", "track_id", "event_type")
ORDER = ("occurred_at", "id")
REJECTED, STORED, DUE = "REJECTED", "STORED", "DUE"


def _first(rows: DataFrame, keys: list[str], keep: str | None) -> DataFrame:
    """The first row of each key, of all that ever came (or within the watermark). Rows are dealt by the key, so the state
    operator takes them as they are, sorted; so of one micro-batch the first in ORDER wins, however it was read."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *ORDER, F.xxhash64(*rows.columns))
    return dealt.dropDuplicatesWithinWatermark(keys) if keep else dealt.dropDuplicates(keys)


def outcomes(messages: DataFrame, later_steps: bool = True, keep: str | None = None) -> DataFrame:
    """What a stream of messages (value) comes to: rows of an `outcome` with value and reason, or with an event's columns.

    REJECTED: a message that is no event. STORED: an event whose id nobody showed before, and whose track and type no such
    event had. DUE: an event whose id nobody showed before, for which later steps run, stored or not (`later_steps`). An
    id that comes again, on whatever track, is a duplicate and claims nothing. Earlier events are known by the state store
    alone, so a batch costs as much as its own rows. State is kept for good, or for as long as `keep` (as "7 days") of the
    events' own time. Counters of what was read are observed under the name "worker".
    """
    rejected = files.decode_envelope(messages).where("reject_reason IS NOT NULL").select(F.lit(REJECTED).alias("outcome"), "value", F.col("reject_reason").alias("reason"))
    decoded = files.decode_envelope(messages).observe("worker", F.count("*").alias("messages"), F.count("reject_reason").alias("rejected"))
    events = files.flatten_events(decoded.where("reject_reason IS NULL").select("event.*"))
    if keep:
        events = events.withWatermark("occurred_at", keep)
    new = _first(events, ["id"], keep)
    claim = F.struct(F.lit(STORED).alias("outcome"), *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in SEMANTIC])
    step = F.struct(F.lit(DUE).alias("outcome"), F.col("id").alias("_camera_id"), F.lit("").alias("_track_id"), F.lit("").alias("_event_type"))
    claims = new.select("*", F.inline(F.array(claim, step) if later_steps else F.array(claim)))
    kept = _first(claims, ["outcome", *[f"_{c}" for c in SEMANTIC]], keep).drop(*[f"_{c}" for c in SEMANTIC])
    return kept.unionByName(rejected, allowMissingColumns=True)


def attempted(rows: DataFrame, attempt: Column) -> DataFrame:
    """rows (camera_id, occurred_at, id, reclaimed) with a `reason` and whether they `passed`.

    attempt gives a reason where a row's later steps fail. A camera's group, its reclaimed rows and its new ones each,
    stops at its first failure: that row and all behind it wait. The first failure is a minimum, so no group is walked.
    """
    place = F.struct(*ORDER)
    tried = rows.withColumn("reason", attempt)
    stops = tried.where("reason IS NOT NULL").groupBy("camera_id", "reclaimed").agg(F.min(place).alias("_stop"))
    return tried.join(stops, ["camera_id", "reclaimed"], "left").withColumn("passed", F.col("_stop").isNull() | (place < F.col("_stop"))).drop("_stop")
