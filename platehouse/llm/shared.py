"""Helpers shared by the operators: staged tables, ordered numbering and connected components."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platehouse.functions.batches import small_batches
from platehouse.functions.scratch import staged

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents below a folder, which any Hadoop file system may hold; batches of it are kept small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which its operator sets to suit the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that are broadcast at most, and rows that a key has at least to be one of them.
HOT_KEYS, HOT_ROWS = 100_000, 100


def joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the facts of their keys. facts has one row for each key, and in _n how many rows have it.

    Keys of more than a hundred-thousandth of all rows (and HOT_ROWS) number HOT_KEYS at most, so their facts are
    broadcast and their rows stay where they are. All others are shuffled, none of which is large.
    """
    facts = staged(facts, "facts")
    most = max(HOT_ROWS, (facts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col("_n") > most).drop("_n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col("_n") <= most).drop("_n"), keys)
    return rows.join(hot, keys).unionByName(rest)


def hot_ends(pairs: DataFrame, ends: list[str], name: str) -> DataFrame:
    """(name, _parts) of the ends that very many pairs have, and into how many parts their pairs are dealt; HOT_KEYS rows at most."""
    counts = staged(pairs.select(F.explode(F.array(*ends)).alias(name)).groupBy(name).agg(F.count("*").alias("_n")), "ends")
    most = max(HOT_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
    return counts.where(F.col("_n") > most).select(name, F.ceil(F.col("_n") / most).alias("_parts"))


def spread_join(pairs: DataFrame, ends: list[str], end: str, facts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """pairs joined with the facts (unique name) of one end. Pairs of a hot end are dealt by hash over its parts, each of
    which gets a copy of its facts: no more copies in all than there are hot keys at most."""
    few = F.broadcast(hot)
    left = pairs.withColumn(name, F.col(end)).join(few, name, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*ends), F.col("_parts")), F.lit(0)))
    right = facts.join(few, name, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [name, "_part"]).drop(name, "_part")


def quantiles(df: DataFrame, column: str, n: int) -> tuple[list[int], int]:
    """The values that begin each n-th of a column, least first, from Spark's own sketch, a frequent value several times;
    and how many such parts the rows without a value would fill."""
    row = df.agg(F.min(column), F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(n)]), 20 * n), F.count("*"), F.count(column)).first()
    return [] if row[0] is None else sorted([row[0], *row[1][1:]]), -(-n * (row[2] - row[3]) // max(row[2], 1))


def number_below(value: Column, numbers: list[int], or_equal: bool) -> Column:
    """How many of the sorted numbers are below a value, or equal to it: first among every k-th, then among k of them."""
    if not numbers:
        return F.lit(0)
    k = isqrt(len(numbers))
    rows = [numbers[i : i + k] for i in range(0, len(numbers), k)]
    passed = lambda x: x <= value if or_equal else x < value
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<long>")
    whole = F.size(F.filter(longs([r[0] for r in rows]), passed))
    last = F.element_at(F.array(*[longs(r) for r in rows]), F.greatest(whole, F.lit(1)))
    return F.when(whole == 0, 0).otherwise((whole - 1) * k + F.size(F.filter(last, passed)))


def in_order(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """df staged in ascending order of keys, with `part` (range partition) and `pos` (place within it).

    Rows of one key may fall into several partitions only if later keys tell them apart, so callers add
    a tie-breaker. The table is written before anything counts its partitions: a range exchange that is
    computed twice may cut elsewhere.
    """
    ids = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ids = ids.withColumn("_n", F.monotonically_increasing_id())
    return staged(ids.select(*df.columns, F.shiftright("_n", 33).alias("part"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("pos")), label)


def offsets(ordered: DataFrame, within: list[str], amount: str) -> DataFrame:
    """For each (within..., part): the sum of `amount` in earlier parts, as `before`, and the first pos, as `first`.

    There are at most parts + groups such rows, so the window over them is small.
    """
    sums = ordered.groupBy(*within, "part").agg(F.sum(amount).alias("_sum"), F.min("pos").alias("first"))
    ahead = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*within, "part", "first", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).cast("long").alias("before"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node reachable.

    Each round hooks every node to the smallest neighbour of its star and then joins the stars (large and
    small star operations), so a chain of n nodes needs about log n rounds. Only nodes with a link take part;
    each round is staged. Null ends are left out.
    """
    edges = staged(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = state(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(near, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        after = staged(small.where("a <> b").distinct(), "edges")
        before, now = now, state(after)
        if now == before:
            break
        edges = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())
