"""Training datasets: splits that keep groups whole, content dedup, leakage and reconciliation checks, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions import plates
from platehouse.functions.folding import Machine, fold
from platehouse.functions.ids import hash_split

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def split_by_group(samples: DataFrame, group: str, seed: str, ratios: dict[str, float] = RATIOS, explicit: str | None = None) -> DataFrame:
    """Samples with `split`: all rows of a group get the same one, from a hash of the group; an explicit split wins."""
    return samples.withColumn("split", hash_split(F.col(group).cast("string"), seed, ratios, F.col(explicit) if explicit else None))


def leaking_groups(samples: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split; there should be none."""
    return samples.groupBy(group).agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def missing_splits(samples: DataFrame, required: list[str]) -> DataFrame:
    """Required splits that have no sample."""
    wanted = samples.sparkSession.createDataFrame([(s,) for s in required], "split string")
    return wanted.join(samples.select("split").distinct(), "split", "left_anti")


def dedup_content(samples: DataFrame, content: Column, key: str, group: str) -> DataFrame:
    """One sample for each content: that of the least key. Copies from several groups get the group dedup:<digest> and no split.

    Only digests are shuffled with the rows' keys; contents stay where they are.
    """
    hashed = samples.withColumn("sha256", F.sha2(content, 256))
    facts = hashed.groupBy("sha256").agg(F.min(key).alias(key), F.count("*").alias("copies"), F.min(group).alias("_low"), F.max(group).alias("_high"))
    merged = F.col("_low") < F.col("_high")
    kept = facts.withColumn("group_key", F.when(merged, F.concat(F.lit("dedup:"), "sha256")).otherwise(F.col("_low").cast("string"))).withColumn("conflict", F.coalesce(merged, F.lit(False)))
    return kept.select(key, "sha256", "copies", "group_key", "conflict")


def duplicates(samples: DataFrame, content: Column, key: str) -> DataFrame:
    """Digests that several rows have: how many, and the least key."""
    return samples.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min(key).alias("kept")).where("copies > 1")


def dedup_boxes(annotations: DataFrame, order: str) -> DataFrame:
    """Annotations without repeats of class and box (to six digits) in one sample; the first stays."""
    box = [F.bround(F.col("bbox")[i], 6) for i in range(4)]
    return annotations.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id", "class_name", *box).orderBy(order))).where("_n = 1").drop("_n")


def counts(samples: DataFrame, *by: str) -> DataFrame:
    """Samples of each combination, as manifests list them."""
    return samples.groupBy(*by).agg(F.count("*").alias("samples"))


def unknown_classes(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations whose class no category has; building a dataset needs that there are none."""
    return annotations.join(categories.select(F.col("name").alias("class_name")), "class_name", "left_anti")


def enrich(samples: DataFrame, events: DataFrame, media: DataFrame) -> DataFrame:
    """Samples with the key of their event's image, or an error code for each row that can't be exported."""
    e = events.select(F.col("id").alias("source_event_id"), F.lit(True).alias("_event"), "image_key")
    m = media.select("image_key", F.lit(True).alias("_media"), "sha256")
    joined = samples.join(e, "source_event_id", "left").join(m, "image_key", "left")
    code = F.when(F.col("_event").isNull(), "SOURCE_EVENT_MISSING").when(F.col("image_key").isNull(), "MEDIA_KEY_MISSING").when(F.col("_media").isNull(), "MEDIA_MISSING")
    return joined.withColumn("error_code", code).drop("_event", "_media")


def reconcile(wanted: DataFrame, running: DataFrame) -> DataFrame:
    """(id, action) for wanted (id, revision) against running (id, revision, alive): START, STOP, RESTART or KEEP."""
    w, r = wanted.select("id", F.col("revision").alias("_w")), running.select("id", F.col("revision").alias("_r"), "alive")
    action = F.when(F.col("_w").isNull(), "STOP").when(F.col("_r").isNull(), "START").when((F.col("_w") != F.col("_r")) | ~F.col("alive"), "RESTART").otherwise("KEEP")
    return w.join(r, "id", "full_outer").select("id", action.alias("action"))


def apply_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events with the review of highest revision: final plate, status, schema version and reason; applying twice is the same."""
    last = reviews.groupBy("event_id").agg(F.max_by(F.struct("plate", "revision"), "revision").alias("_r"))
    joined = events.join(last.withColumnRenamed("event_id", "id"), "id", "left")
    seen = F.col("_r").isNotNull()
    return joined.select(
        *[c for c in events.columns if c not in ("plate_final", "status", "schema_version")],
        F.when(seen, F.col("_r.plate")).alias("plate_final"), F.when(seen, "CONFIRMED").otherwise(F.col("status")).alias("status"),
        F.when(seen, F.greatest(F.lit(2), "schema_version")).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(seen, F.when(F.col("_r.plate").eqNullSafe(F.col("plate")), "HUMAN_CONFIRMATION").otherwise("HUMAN_CORRECTION")).alias("reason"), F.col("_r.revision").alias("review_revision"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several corpora, columns by name, missing ones null."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def take_per_class(boxes: DataFrame, each: int, order: str) -> DataFrame:
    """The first `each` boxes of every class in input order."""
    return boxes.withColumn("_n", F.row_number().over(Window.partitionBy("class_name").orderBy(order))).where(F.col("_n") <= each).drop("_n")


def catalog_order(versions: DataFrame) -> DataFrame:
    """Dataset versions (source_id, created_at) with their place, the newest first; there are few of them."""
    return versions.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("source_id")))).select("source_id", "place")


def review_commands(events: DataFrame, commands: DataFrame) -> DataFrame:
    """Every review command (event_id, seq, text, expected_revision) with what it came to, in order of seq.

    events: id, plate, review_revision, plate_final. outcome is INVALID_PLATE where the text is no plate in full form,
    NO_EVENT or NO_PLATE where there is nothing to review, CHANGED where expected_revision is the event's revision then,
    UNCHANGED for a retry (the revision is one further and the plate the same), else CONFLICT. revision and plate_final
    are those after it.
    """
    read = plates.add_normalized(commands.select("event_id", "seq", "text", "expected_revision"), "text", "_p")
    now = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_event"), F.col("plate").isNotNull().alias("_plate"), F.coalesce("review_revision", F.lit(0)).cast("int").alias("_revision"), F.col("plate_final").alias("_final"))
    rows = read.join(now, "event_id", "left").select("event_id", "seq", "expected_revision", F.when(F.col("_p.valid"), F.col("_p.normalized")).alias("normalized"), F.coalesce("_event", F.lit(False)).alias("known"), F.coalesce("_plate", F.lit(False)).alias("read"), "_revision", "_final")

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        key, seq, expected, text, known, seen, revision, final = row
        if state[0] is not None:
            revision, final = state
        outcome = "CONFLICT"
        if text is None:
            outcome = "INVALID_PLATE"
        elif not known:
            outcome = "NO_EVENT"
        elif not seen:
            outcome = "NO_PLATE"
        elif expected == revision:
            outcome, revision, final = "CHANGED", revision + 1, text
        elif expected + 1 == revision and final == text:
            outcome = "UNCHANGED"
        return (revision, final) if known else state, (key, seq, outcome, revision if known else None, final if known else None)

    return fold(rows, ["event_id"], ["seq"], Machine((None, None), step, "event_id string, seq long, outcome string, revision int, plate_final string"))
