"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.llm.shared import WORD, in_order, offsets, partitions, staged


def words(text: str = "text") -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, most_epochs: float, total: Column) -> DataFrame:
    """Add target to sources (source_size, weight): weight's share of total, clamped at most_epochs * source_size.

    What the clamp leaves over goes to the other sources by weight, again and again until none is above. That ends where
    one level of water stands in all that are not full: in order of cap / weight, a source is full if the level that the
    sources from it on would share lies above its own brim. One row for each source, so the window is small.
    """
    cap = F.col("source_size") * F.lit(float(most_epochs))
    order = Window.orderBy("_brim", "_cap", "weight")
    s = sources.select("*", cap.alias("_cap"), (cap / F.col("weight")).alias("_brim"), total.cast("double").alias("_total"))
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open")).withColumn("_at", F.row_number().over(order))
    s = s.withColumn("_water", F.min_by(F.when(F.col("_level") <= F.col("_brim"), F.col("_level")), F.when(F.col("_level") <= F.col("_brim"), F.col("_at"))).over(Window.partitionBy()))
    return s.withColumn("target", F.least("_cap", F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap")))).drop("_cap", "_brim", "_total", "_full", "_open", "_level", "_at", "_water")


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Words that the mix takes of each document: doc_id, source, size, source_size, target, taken, epochs, part_words.

    Sources in code-point order, null last as one source of its own, weigh `weights` in turn; their targets share all
    words. A source of target t and size s gives every document floor(t / s) times whole; the rest of t is taken from its
    documents in the order of a seeded hash of doc_id until it is used up, so that the last of them gives its first
    part_words words only. taken = epochs * size + part_words is at most most_epochs times the size, and a source's sum
    is its target, rounded. Null texts and texts without words have size 0 and give none. Rows of one doc_id are told
    apart by their text's hash; rows alike in both may swap parts. Runs agree: nothing depends on the partitions.
    """
    base = staged(docs.select("doc_id", "source", words().alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"), F.xxhash64("text").alias("_tie")), "mix")
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_rank", F.row_number().over(by_code_point) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double"))
    sources = water_fill(sources, most_epochs, F.sum("source_size").over(Window.partitionBy()))
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = staged(sources.select("source", "source_size", "weight", "target", whole.alias("epochs"), (F.round("target").cast("long") - whole * F.col("source_size")).alias("_rest")), "targets")
    ordered = in_order(base, ["source", "_key", "_tie", "size"], "mixed")
    ahead = offsets(ordered, ["source"], "size")
    earlier = Window.partitionBy("source", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.withColumn("_in", F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("d")
    joined = inside.join(ahead.alias("o"), F.expr("d.source <=> o.source AND d.part = o.part")).join(sources.alias("s"), F.expr("d.source <=> s.source"))
    part = F.greatest(F.lit(0), F.least(F.col("d.size"), F.col("s._rest") - F.col("o.before") - F.col("d._in")))
    return joined.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", (F.col("s.epochs") * F.col("d.size") + part).alias("taken"), "s.epochs", part.alias("part_words"), "s.weight", F.col("d._tie").alias("text_hash"))


#: Repetitions of one document that a task makes at once.
CHUNK = 10_000


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each as often as the plan says, in the columns of docs.

    A fractional repetition of a document is its first part_words words, joined by spaces; n_chars, where docs has it,
    is then counted anew. Rows alike in doc_id and text are one document that is taken as often as all of them;
    where other columns differ, the row of least hash stands for all. One that is taken more than CHUNK times is dealt over
    tasks in chunks of as many before its rows are made.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    taken = plan(docs, **options).groupBy(*key, F.col("text_hash").alias("_hash")).agg(F.sum("epochs").alias("_epochs"), F.sum("part_words").alias("_part"), F.max("size").alias("_size"))
    whole_row = docs.select(*key, F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_doc"))
    one = whole_row.groupBy("_id", "_null", "_hash").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc")).join(taken, ["_id", "_null", "_hash"])
    size = F.greatest("_size", F.lit(1))
    part = F.col("_part") % size
    one = one.select("_doc", "_id", "_hash", (F.col("_epochs") + F.floor(F.col("_part") / size)).alias("_times"), F.when(part > 0, part).alias("_rest"))
    few = one.where(F.col("_times") <= CHUNK)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / CHUNK)), lambda i: F.struct(i.alias("number"), F.least(F.lit(CHUNK), F.col("_times") - i * CHUNK).alias("times"), F.when(i == 0, F.col("_rest")).alias("rest")))
    many = one.where(F.col("_times") > CHUNK).select("_doc", "_id", "_hash", F.explode(chunks).alias("_c")).repartition(partitions(docs.sparkSession), "_id", "_hash", "_c.number")
    both = few.select("_doc", "_times", "_rest").unionByName(many.select("_doc", F.col("_c.times").alias("_times"), F.col("_c.rest").alias("_rest")))
    whole, none = F.array_repeat(F.lit(None).cast("long"), F.col("_times").cast("int")), F.array().cast("array<long>")
    rows = both.select("_doc", F.explode(F.concat(whole, F.when(F.col("_rest").isNotNull(), F.array("_rest")).otherwise(none))).alias("_words"))
    field = {c: F.col("_doc").getField(c) for c in docs.columns}
    first = F.array_join(F.slice(F.regexp_extract_all(field["text"], F.lit(WORD), F.lit(0)), 1, F.coalesce("_words", F.lit(1)).cast("int")), " ")
    changed = {"text": F.when(F.col("_words").isNull(), field["text"]).otherwise(first)}
    if "n_chars" in field:
        changed["n_chars"] = F.when(F.col("_words").isNull(), field["n_chars"]).otherwise(F.length(first).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*[changed.get(c, field[c]).alias(c) for c in docs.columns])
