"""Vehicle identities from fingerprints: rebuilt in one aggregation, merged one by one, merged and split by review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.scratch import staged

MOST_PLATES = 16
#: Fingerprints that a review moves or rebuilds at most.
MOST_REVIEWED = 1000


def rebuild(prints: DataFrame) -> DataFrame:
    """Identities (vehicle_id, ...) that their fingerprints make up.

    A plate's signal has its best confidence and its span; the best 16 by (confidence, last seen, text) are kept and the
    first is primary. Type is that of the highest summed confidence, colour the most frequent; of equals the greater name.
    """
    by_plate = prints.where("plate IS NOT NULL AND plate_confidence IS NOT NULL").groupBy("vehicle_id", "plate").agg(F.max("plate_confidence").alias("confidence"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    signal = F.struct("confidence", "last_seen", F.col("plate").alias("text"), "first_seen")
    best = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("confidence"), F.desc("last_seen"), F.desc("plate")))
    by_plate = by_plate.withColumn("_n", best).where(F.col("_n") <= MOST_PLATES)
    by_plate = by_plate.groupBy("vehicle_id").agg(F.sort_array(F.collect_list(signal), asc=False).alias("plates"))
    types = prints.groupBy("vehicle_id", "vehicle_type").agg(F.sum("vehicle_confidence").alias("_s")).groupBy("vehicle_id").agg(F.max_by("vehicle_type", F.struct("_s", "vehicle_type")).alias("vehicle_type"))
    colors = prints.where("color IS NOT NULL").groupBy("vehicle_id", "color").agg(F.count("*").alias("_n")).groupBy("vehicle_id").agg(F.max_by("color", F.struct("_n", "color")).alias("color"))
    span = prints.groupBy("vehicle_id").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("observation_count"))
    out = span.join(types, "vehicle_id", "left").join(colors, "vehicle_id", "left").join(by_plate, "vehicle_id", "left")
    return out.withColumn("primary_plate", F.get("plates", F.lit(0))["text"])


def merge_in_order(prints: DataFrame) -> DataFrame:
    """Identities as they grow print by print: the first plate, type and colour stay, aliases are the first 16 plates.

    Unlike rebuild, what came first wins; min_by over (time, id) gives that without keeping an order of rows. revision is
    the number of prints.
    """
    order = F.struct("observed_at", "id")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order))
    aliases = prints.where("plate IS NOT NULL").groupBy("vehicle_id", "plate").agg(F.min(order).alias("_first"))
    aliases = aliases.withColumn("_n", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("_first", "plate"))).where(F.col("_n") <= MOST_PLATES)
    aliases = aliases.groupBy("vehicle_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "plate"))), lambda x: x["plate"]).alias("aliases"))
    out = prints.groupBy("vehicle_id").agg(first("plate").alias("primary_plate"), F.min_by("vehicle_type", order).alias("vehicle_type"), first("color").alias("color"), F.count("*").alias("revision"))
    return out.join(aliases, "vehicle_id", "left")


def reassign(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows with vehicle_id mapped by reviews (review_id, from_vehicle_id, to_vehicle_id, source_event_id).

    A review without source_event_id merges a whole vehicle, one with it splits off an event's rows. Of several reviews
    for a row the split counts, then the greatest review_id; mapping again changes nothing.
    """
    merges = reviews.where("source_event_id IS NULL").groupBy(F.col("from_vehicle_id").alias("vehicle_id")).agg(F.max_by("to_vehicle_id", "review_id").alias("_merged"))
    splits = reviews.where("source_event_id IS NOT NULL").groupBy("source_event_id").agg(F.max_by("to_vehicle_id", "review_id").alias("_split"))
    out = rows.join(merges, "vehicle_id", "left").join(splits, "source_event_id", "left")
    return out.withColumn("vehicle_id", F.coalesce("_split", "_merged", "vehicle_id")).select(*rows.columns)


def by_plate(identities: DataFrame, plate: str) -> DataFrame:
    """Identities that have a plate among their signals."""
    return identities.where(F.exists("plates", lambda p: p["text"] == plate))


def having_plates(identities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Identities that have one of the wanted plates among their signals."""
    pairs = identities.select("vehicle_id", F.explode("plates.text").alias("plate")).join(wanted, "plate", "left_semi")
    return identities.join(pairs, "vehicle_id", "left_semi")


def with_latest(identities: DataFrame, events: DataFrame) -> DataFrame:
    """Identities with latest_event and the columns of their newest event; null where none is kept."""
    from platehouse.operators.events import latest

    newest = latest(events.select("vehicle_id", "id", "occurred_at", "camera_id"), "vehicle_id").withColumnRenamed("id", "latest_event")
    return identities.join(newest, "vehicle_id", "left")


def apply_merges(identities: DataFrame, prints: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, prints, identities) after merges (review_id, source, target, source_revision, target_revision).

    identities: vehicle_id, status, revision. A merge is APPLIED if both are ACTIVE, at the expected revisions and have
    fingerprints, MOST_REVIEWED at most. NOT_FOUND, NOT_ACTIVE, REVISION, NO_EVIDENCE, TOO_LARGE say why not; of merges
    that touch one identity the least review_id comes first and the others are at a REVISION that is past. An applied
    merge moves the source's prints, rebuilds the target from all of them at its next revision and marks the source MERGED.
    """
    sizes = prints.groupBy("vehicle_id").agg(F.count("*").alias("n"))
    one = identities.select("vehicle_id", "status", "revision").join(sizes, "vehicle_id", "left")
    side = lambda name: one.select(F.col("vehicle_id").alias(name), F.struct("status", "revision", F.coalesce("n", F.lit(0)).alias("n")).alias(f"_{name}"))
    met = reviews.join(side("source"), "source", "left").join(side("target"), "target", "left")
    a, b = F.col("_source"), F.col("_target")
    why = (
        F.when(a.isNull() | b.isNull() | (F.col("source") == F.col("target")), "NOT_FOUND").when((a["status"] != "ACTIVE") | (b["status"] != "ACTIVE"), "NOT_ACTIVE")
        .when((a["revision"] != F.col("source_revision")) | (b["revision"] != F.col("target_revision")), "REVISION").when((a["n"] == 0) | (b["n"] == 0), "NO_EVIDENCE").when((a["n"] > MOST_REVIEWED) | (b["n"] > MOST_REVIEWED), "TOO_LARGE")
    )
    judged = met.withColumn("_why", why)
    good = judged.where("_why IS NULL").select("review_id", F.explode(F.array("source", "target")).alias("vehicle_id"))
    first = good.groupBy("vehicle_id").agg(F.min("review_id").alias("_first"))
    late = good.join(first, "vehicle_id").where("review_id <> _first").select("review_id").distinct().withColumn("_late", F.lit("REVISION"))
    outcomes = judged.join(late, "review_id", "left").select("review_id", "source", "target", F.coalesce("_why", "_late", F.lit("APPLIED")).alias("outcome"))
    outcomes = staged(outcomes, "merges")
    applied = outcomes.where("outcome = 'APPLIED'")
    moved = prints.join(applied.select(F.col("source").alias("vehicle_id"), F.col("target").alias("_to")), "vehicle_id", "left").withColumn("vehicle_id", F.coalesce("_to", "vehicle_id")).select(*prints.columns)
    rebuilt = rebuild(moved.join(applied.select(F.col("target").alias("vehicle_id")), "vehicle_id", "left_semi"))
    state = identities.select("vehicle_id", "status", "revision").join(applied.select(F.explode(F.array(F.struct(F.col("source").alias("vehicle_id"), F.lit("MERGED").alias("_now")), F.struct(F.col("target").alias("vehicle_id"), F.lit("ACTIVE").alias("_now")))).alias("_x")).select("_x.*"), "vehicle_id", "left")
    state = state.select("vehicle_id", F.coalesce("_now", "status").alias("status"), (F.col("revision") + F.col("_now").isNotNull().cast("int")).alias("revision"))
    return outcomes, moved, state.join(rebuilt, "vehicle_id", "left")
