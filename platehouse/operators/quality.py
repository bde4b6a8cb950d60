"""Model quality: metrics over events in total, by model and by day in one scan, and reviewers' feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.scalars import ratio, utc_day

STATUSES = {"confirmed": "CONFIRMED", "needs_review": "NEEDS_REVIEW", "no_plate": "NO_PLATE", "unreadable": "UNREADABLE"}


def counters() -> list[Column]:
    """Counts and the mean confidence; events have plate, status, reviewed, corrected, plate_confidence."""
    return [
        F.count("*").alias("events"), F.count_if(F.col("plate").isNotNull()).alias("readable"),
        *[F.count_if(F.col("status") == value).alias(name) for name, value in STATUSES.items()],
        F.count_if("reviewed").alias("reviewed"), F.count_if("corrected").alias("corrected"), F.avg("plate_confidence").alias("average_confidence"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Success, unknown-plate and correction rates; 0 where there is nothing to divide by."""
    return (
        counts.withColumn("success_rate", ratio(F.col("readable"), F.col("events")))
        .withColumn("unknown_rate", ratio(F.col("no_plate") + F.col("unreadable"), F.col("events")))
        .withColumn("correction_rate", ratio(F.col("corrected"), F.col("reviewed")))
    )


def facets(events: DataFrame, start, end, most_models: int = 20) -> DataFrame:
    """Rows for the total, each OCR model and each UTC day of [start, end): facet, model_name, model_version, day, metrics.

    One scan by grouping sets. Models come by count (high first), name and version, at most most_models; days in order;
    `place` numbers them.
    """
    seen = events.where((F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end))).withColumn("day", utc_day(F.col("occurred_at")))
    model, day = [F.col("model_name"), F.col("model_version")], [F.col("day")]
    sets = seen.groupingSets([[], model, day], *model, *day).agg(F.grouping_id().alias("_g"), *counters())
    named = sets.withColumn("facet", F.when(F.col("_g") == 7, "total").when(F.col("_g") == 1, "model").otherwise("day"))
    order = Window.partitionBy("facet").orderBy(F.when(F.col("facet") == "model", -F.col("events")), "model_name", "model_version", "day")
    ranked = named.withColumn("place", F.row_number().over(order)).where((F.col("facet") != "model") | ((F.col("place") <= most_models) & F.col("model_name").isNotNull()))
    return with_rates(ranked.drop("_g"))


def feedback(samples: DataFrame) -> DataFrame:
    """Dataset samples by status and by reason, in one row."""
    status = {"ready": "READY", "exporting": "EXPORTING", "exported": "EXPORTED", "export_failed": "EXPORT_FAILED"}
    reason = {"corrections": "HUMAN_CORRECTION", "confirmations": "HUMAN_CONFIRMATION"}
    return samples.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == v).alias(k) for k, v in status.items()], *[F.count_if(F.col("reason") == v).alias(k) for k, v in reason.items()])


#: What partial states are kept by, and their counters, all of which add up.
STATE_KEYS = ("day", "camera_id", "model_name", "model_version")
STATE_COUNTS = ("events", "readable", *STATUSES, "reviewed", "corrected", "confidence_count")


def partials(events: DataFrame) -> DataFrame:
    """Mergeable counters of events by UTC day, camera and OCR model: sums and numbers instead of means and rates.

    Confidences add up as decimals of nine digits, so that a merged state doesn't depend on how it was split.
    """
    counted = counters()[:-1] + [F.count("plate_confidence").alias("confidence_count"), F.coalesce(F.sum(F.col("plate_confidence").cast("decimal(20,9)")), F.lit(0)).cast("decimal(38,9)").alias("confidence_sum")]
    return events.withColumn("day", utc_day(F.col("occurred_at"))).groupBy(*STATE_KEYS).agg(*counted)


def add_increment(events: DataFrame, path: str, number: int) -> None:
    """Store the partial states of an increment; one that is stored again takes the place of its first attempt."""
    partials(events).write.mode("overwrite").parquet(f"{path}/increment={number}")


def merged(states: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """Metrics of stored states by any of their keys. With `most`, truncated says that more events than that are counted
    in all, which a scan that stops there would not have seen."""
    sums = states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in STATE_COUNTS], F.sum("confidence_sum").alias("confidence_sum"))
    out = with_rates(sums.withColumn("average_confidence", (F.col("confidence_sum") / F.when(F.col("confidence_count") > 0, F.col("confidence_count"))).cast("double")))
    if most is not None:
        total = states.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("_all"))
        out = out.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("_all") > most).drop("_all")  # one row
    return out.drop("confidence_sum", "confidence_count")


def read_states(spark, path: str) -> DataFrame:
    """All stored increments, one below the other."""
    return spark.read.parquet(path).drop("increment")
