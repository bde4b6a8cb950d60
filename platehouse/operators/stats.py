"""Benchmark statistics: latency summaries, fairness, histograms and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platehouse.functions.scalars import ratio
from platehouse.functions.scratch import staged


#: Ranks are looked for among values that a sketch of this accuracy can't tell from them: a few in so many of a group.
SKETCH = 1_000


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str], nearest: bool = False) -> DataFrame:
    """Exact percentiles of each group, however large: a column for each of shares, linear between ranks or `nearest` rank.

    A sketch brackets every rank between two values. A second scan counts what lies below each bracket and, value by
    value, what lies inside; only those few values are put in order. No task holds a group's distinct values. Nulls don't
    count; a group of nulls alone has null percentiles. The keys of groups come to no driver.
    """
    names, margin = list(shares), 2.0 / SKETCH
    ends = [min(1.0, max(0.0, shares[n] + d)) for n in names for d in (-margin, margin)]
    keyed = rows.select(F.struct(F.lit(0).alias("_0"), *by).alias("_by"), F.col(value).alias("_v"))
    sketch = staged(keyed.groupBy("_by").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), SKETCH).alias("_q"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sketch")

    def ranks(share: float) -> tuple[Column, Column]:
        """The ranks, from 1, of the values that a percentile lies between."""
        if nearest:
            one = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_n")))
            return one, one
        at = F.lit(share) * (F.col("_n") - 1)
        return F.floor(at) + 1, F.ceil(at) + 1

    brackets = []
    for i, n in enumerate(names):
        few = F.col("_n") <= 2 * SKETCH  # then the margin may be less than a rank, and all values are few
        low = F.when(few | F.lit(ends[2 * i] == 0.0), F.col("_low")).otherwise(F.col("_q")[2 * i])
        high = F.when(few | F.lit(ends[2 * i + 1] == 1.0), F.col("_high")).otherwise(F.col("_q")[2 * i + 1])
        first, last = ranks(shares[n])
        brackets.append(F.struct(F.lit(n).alias("name"), low.alias("low"), high.alias("high"), first.alias("first"), last.alias("last")))
    wanted = sketch.where("_n > 0").select("_by", F.explode(F.array(*brackets)).alias("_b"))
    # Every value counts once for each bracket: as below it, or as itself within; what lies above counts for none.
    met = keyed.where("_v IS NOT NULL").join(sketch.where("_n > 0").select("_by", F.array(*brackets).alias("_bs")), "_by")
    each = met.select("_by", "_v", F.explode(F.filter("_bs", lambda b: F.col("_v") <= b["high"])).alias("_b"))
    counts = each.groupBy("_by", F.col("_b.name").alias("name"), F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_by", "name").orderBy(F.col("_v").asc_nulls_first())
    placed = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c") + 1)
    placed = placed.join(wanted.select("_by", F.col("_b.name").alias("name"), F.col("_b.first").alias("_first"), F.col("_b.last").alias("_last")), ["_by", "name"])
    holds = lambda rank: F.max(F.when(F.col(rank).between(F.col("_from"), F.col("_to")), F.col("_v")))
    ends_ = placed.groupBy("_by", "name").agg(holds("_first").alias("_a"), holds("_last").alias("_b"))
    at = ends_.join(sketch.select("_by", "_n"), "_by")
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, shares[n])]), F.col("name"))
    weight = share * (F.col("_n") - 1) - F.floor(share * (F.col("_n") - 1))
    exact = F.col("_a") if nearest else F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - weight) * F.col("_a") + weight * F.col("_b"))
    wide = at.groupBy("_by").agg(*[F.max(F.when(F.col("name") == n, exact)).alias(n) for n in names])
    return sketch.select("_by").join(wide, "_by", "left").select(*[F.col("_by")[c].alias(c) for c in by], *names)


def latency_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, p50, p95, p99 (linear between ranks) and max, to three digits."""
    by = by or []
    out = rows.groupBy(*by).agg(F.count(value).alias("count"), F.bround(F.avg(value), 3).alias("mean"), F.bround(F.max(value), 3).alias("max"))
    p = percentiles(rows, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by).withColumns({n: F.bround(n, 3) for n in ("p50", "p95", "p99")})
    if not by:
        return out.crossJoin(p).select("count", "mean", "p50", "p95", "p99", "max") if not rows.isEmpty() else out.select("count", "mean", *[F.lit(None).cast("double").alias(n) for n in ("p50", "p95", "p99")], "max")  # one row each
    keys = {c: f"_key_{c}" for c in by}
    both = out.join(p.withColumnsRenamed(keys), [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return both.select(*by, "count", "mean", "p50", "p95", "p99", "max")


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """The value whose rank is ceil(share * n), for each group."""
    return percentiles(rows, value, {value: share}, by, nearest=True)


def jain(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Fairness (sum x)^2 / (n sum x^2): 1 if all are equal, 0 if all are zero."""
    total, squares = F.sum(value), F.sum(F.col(value) * F.col(value))
    return rows.groupBy(*(by or [])).agg(ratio(total * total, F.count(value) * squares).alias("fairness"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at or below each bound, and of all (+Inf)."""
    buckets = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.lit(float(b)).alias("_b")) for b in bounds], F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("_b")))
    cells = rows.where(F.col(value).isNotNull()).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count("*").alias("_all"))
    counts = F.array(*[F.col(f"_{i}") for i in range(len(bounds))], F.col("_all"))
    return cells.select(F.inline(F.zip_with(buckets, counts, lambda b, n: F.struct(b["le"].alias("le"), n.alias("count")))))


def regressions(current: DataFrame, baseline: DataFrame, most_slower: float, least_throughput: float) -> DataFrame:
    """(name, failures) of benchmark rows (name, p95_ms, throughput) that are slower or do less than a baseline allows."""
    both = current.alias("c").join(baseline.alias("b"), "name", "left")
    slower = F.coalesce(F.try_divide(F.col("c.p95_ms") - F.col("b.p95_ms"), F.col("b.p95_ms")), F.lit(0.0)) > most_slower
    less = F.coalesce(F.try_divide(F.col("c.throughput"), F.col("b.throughput")), F.lit(1.0)) < least_throughput
    return both.select("name", F.array_compact(F.array(F.when(F.col("b.p95_ms").isNull(), "missing_baseline"), F.when(slower, "p95_regression"), F.when(less, "throughput_ratio"))).alias("failures"))


def verify_gates(reports: DataFrame, most_dropped: float = 0.10, most_p95: float = 250.0, required: tuple[str, ...] = ("detector-runtime-benchmark", "edge-capacity-benchmark")) -> DataFrame:
    """(file, failure) of benchmark reports that a release must not have; file is null for what all reports lack.

    reports: file, kind, model_sha256, latency_count, p95_ms, drop_ratio, gate_passed, accuracy_representative; missing
    values are null. Runtime reports count as representative only if nothing else is wrong with them.
    """
    edge = F.col("kind") == "edge-capacity-benchmark"
    fails = {
        "invalid_model_hash": ~F.coalesce(F.col("model_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "missing_latency_samples": ~F.coalesce((F.col("latency_count") > 0) & (F.col("latency_count") == F.floor("latency_count")), F.lit(False)),
        "invalid_p95_latency": ~F.coalesce(F.col("p95_ms") >= 0, F.lit(False)),
        "missing_drop_ratio": edge & F.col("drop_ratio").isNull(),
        "invalid_drop_ratio": edge & ~F.col("drop_ratio").between(0, 1),
        "drop_ratio_exceeds_limit": edge & F.col("drop_ratio").between(0, 1) & (F.col("drop_ratio") > most_dropped),
        "p95_latency_exceeds_limit": edge & (F.col("p95_ms") > most_p95),
        "gate_failed": ~F.coalesce(F.col("gate_passed"), F.lit(False)),
    }
    found = reports.withColumn("_f", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in fails.items()])))
    good = (F.col("kind") == required[0]) & F.coalesce("accuracy_representative", F.lit(False)) & (F.size("_f") == 0)
    lacks = [F.when(F.count_if(F.col("kind") == k) == 0, f"missing_kind:{k}") for k in sorted(required)] + [F.when(F.count_if(good) == 0, "missing_accuracy_representative_detector_gate")]
    whole = found.agg(F.array_compact(F.array(*lacks)).alias("_f")).select(F.lit(None).cast("string").alias("file"), F.explode("_f").alias("failure"))
    return found.select("file", F.explode("_f").alias("failure")).union(whole)
