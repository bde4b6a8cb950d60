"""The event worker: decode, set rejects aside, store first writes, then run rules on what is new.

`start` runs it as a stream on keyed state; `process_batch` loads one batch against a store, without state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from platehouse.functions.scratch import staged
from platehouse.operators import policy
from platehouse.operators.events import insert_if_absent
from platehouse.sources import files
from platehouse.streaming import firstwrites
from platehouse.streaming.starting import SORTED, settings

REASON_CHARACTERS = 2000


_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"} | SORTED
SEMANTIC = list(firstwrites.SEMANTIC)


def process_batch(batch: DataFrame, number: int, store: str, rejects: str, alerts: str | None = None, rules: tuple[policy.Rule, ...] = (), watchlist: DataFrame | None = None, identities: str | None = None) -> None:
    """One micro-batch. Each output goes to a folder of the batch's number, so that a batch that runs again overwrites itself.

    Events are first writes by (occurred_at, id): one whose id, or camera, track and type, an earlier one has is a
    duplicate and not stored. Duplicates pass through identities and rules all the same, as their first run may have
    been cut short; what these steps write has ids of its own, so a second time adds nothing. Counters of the batch are
    observed under the name "worker".
    """
    spark = batch.sparkSession
    counters = [F.count("*").alias("messages"), F.count("reject_reason").alias("rejected")]
    decoded = files.decode_envelope(batch).observe("worker", *counters).persist()
    try:
        decoded.where("reject_reason IS NOT NULL").select("value", F.substring("reject_reason", 1, REASON_CHARACTERS).alias("reason"), F.current_timestamp().alias("failed_at")).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        good = files.flatten_events(decoded.where("reject_reason IS NULL").select("event.*"))
        stored = _earlier(spark, store, number, good.schema)
        fresh = insert_if_absent(stored, good, "id", SEMANTIC, ["occurred_at", "id", F.xxhash64(*good.columns)])
        fresh.repartition("camera_id").sortWithinPartitions("camera_id", "occurred_at").write.mode("overwrite").parquet(f"{store}/batch={number}")
        seen = _of_store(spark, good, store, number)
        if identities:
            prints = seen.where("vehicle_id IS NOT NULL").withColumn("observed_at", F.col("occurred_at"))
            held = _earlier(spark, identities, number, prints.schema).select("id")
            prints.join(held, "id", "left_anti").write.mode("overwrite").parquet(f"{identities}/batch={number}")
        if alerts and rules:
            listed = policy.watchlist_matches(seen, watchlist) if watchlist is not None else seen.withColumn("list_types", F.array().cast("array<string>"))
            found = policy.apply_rules(listed, list(rules)).select("id", "rule_id", "action", "execution_id")
            held = _earlier(spark, alerts, number, found.schema).select("execution_id")
            found.join(held, "execution_id", "left_anti").write.mode("overwrite").parquet(f"{alerts}/batch={number}")
    finally:
        decoded.unpersist()


def _of_store(spark, good: DataFrame, store: str, number: int) -> DataFrame:
    """A batch's events, each id once: as stored, or where only another id of its track and type is stored, the first."""
    known = spark.read.schema(StructType([*good.schema.fields, StructField("batch", LongType())])).parquet(store).where(F.col("batch") <= number).select(*good.columns)
    known = known.join(good.select("id").distinct(), "id", "left_semi")
    others = good.join(known.select("id"), "id", "left_anti").select(*good.columns)
    first = Window.partitionBy("id").orderBy("occurred_at", F.xxhash64(*good.columns))
    return known.unionByName(others.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))


def _earlier(spark, store: str, number: int, schema) -> DataFrame:
    """Rows of earlier batches; none before the first."""
    try:
        found = spark.read.parquet(store)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    return found.where(F.col("batch") < number).select(*schema.names)


def write_outcomes(batch: DataFrame, number: int, store: str, rejects: str, alerts: str | None = None, rules: tuple[policy.Rule, ...] = (), watchlist: DataFrame | None = None, identities: str | None = None, attempt: Column | None = None, waiting: str | None = None, idle_seconds: float = 60.0) -> None:
    """Write one micro-batch of outcomes (see firstwrites), each output to a folder of the batch's number, so that a batch
    that runs again overwrites itself. Nothing is read of what earlier batches wrote, but for the rows that wait.

    Identities and rules run once for every id. With an `attempt`, a row for which it names a reason, and what follows it
    in its camera's group, goes to the folder `waiting`; rows that have waited for idle_seconds are tried again before new
    ones, each batch passing on those that still wait. Other cameras are not held up.
    """
    seen = batch.persist()
    try:
        is_ = lambda outcome: seen.where(F.col("outcome") == outcome)
        event = [c for c in seen.columns if c not in ("outcome", "value", "reason")]
        is_(firstwrites.REJECTED).select("value", F.substring("reason", 1, REASON_CHARACTERS).alias("reason"), F.current_timestamp().alias("failed_at")).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        is_(firstwrites.STORED).select(*event).write.mode("overwrite").parquet(f"{store}/batch={number}")
        due = is_(firstwrites.DUE).select(*event)
        if attempt is not None:
            due = _passed(due, number, attempt, waiting, idle_seconds)
        if identities:
            due.where("vehicle_id IS NOT NULL").withColumn("observed_at", F.col("occurred_at")).write.mode("overwrite").parquet(f"{identities}/batch={number}")
        if alerts and rules:
            listed = policy.watchlist_matches(due, watchlist) if watchlist is not None else due.withColumn("list_types", F.array().cast("array<string>"))
            policy.apply_rules(listed, list(rules)).select("id", "rule_id", "action", "execution_id").write.mode("overwrite").parquet(f"{alerts}/batch={number}")
    finally:
        seen.unpersist()


def _passed(due: DataFrame, number: int, attempt: Column, waiting: str, idle_seconds: float) -> DataFrame:
    """Rows that pass, after writing those that wait (with since and reason) for the next batch."""
    spark = due.sparkSession
    rows = due.select("*", F.lit(False).alias("reclaimed"))
    still = None
    if number:
        held = spark.read.schema(StructType([*due.schema.fields, StructField("since", TimestampType()), StructField("reason", StringType())])).parquet(f"{waiting}/batch={number - 1}")
        idle = F.col("since") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(idle_seconds))
        rows = rows.unionByName(held.where(idle).select(*due.columns, F.lit(True).alias("reclaimed")))
        still = held.where(~idle)
    tried = staged(firstwrites.attempted(rows, attempt), "tried")
    wait = tried.where(~F.col("passed")).select(*due.columns, F.current_timestamp().alias("since"), "reason")
    (wait.unionByName(still) if still is not None else wait).write.mode("overwrite").parquet(f"{waiting}/batch={number}")
    return tried.where("passed").select(*due.columns)


def start(messages: DataFrame, store: str, rejects: str, checkpoint: str, keep: str | None = None, every: str | None = None, **options) -> StreamingQuery:
    """Run the worker over a stream of messages (value) until what is there has been read, or without end at intervals of
    `every`; see firstwrites.outcomes and write_outcomes.

    State is kept in RocksDB. The session's settings are put back.
    """
    later = any(options.get(k) for k in ("alerts", "identities")) or options.get("attempt") is not None
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with settings(messages.sparkSession, _SETTINGS):
        found = firstwrites.outcomes(messages, later, keep)
        return found.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda batch, number: write_outcomes(batch, number, store, rejects, **options)).start()
