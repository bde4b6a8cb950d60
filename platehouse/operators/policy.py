"""Watchlists and rules: validity-interval joins, and declarative conditions compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule may ask, and how.
FIELDS = ("camera_id", "zone", "event_type", "direction", "status", "plate", "vehicle_type", "color", "watchlist")
OPERATORS = ("EQ", "NEQ", "IN", "NOT_IN", "CONTAINS", "EXISTS")
ACTIONS = ("CREATE_ALERT", "WEBHOOK", "NOTIFY", "TAG_EVENT")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    priority: int
    conditions: tuple[Condition, ...]
    actions: tuple[str, ...] = ("CREATE_ALERT",)
    enabled: bool = True
    revision: int = field(default=1)


def validate(rule: Rule) -> None:
    """Raise ValueError for a rule that asks or does what is not known."""
    if not rule.conditions or not rule.actions:
        raise ValueError("a rule needs conditions and actions")
    for c in rule.conditions:
        if c.field not in FIELDS or c.operator not in OPERATORS:
            raise ValueError(f"unknown condition {c.field} {c.operator}")
        if c.operator in ("IN", "NOT_IN") and not isinstance(c.value, list | tuple):
            raise ValueError(f"{c.operator} takes a list")
        if c.operator == "EXISTS" and not isinstance(c.value, bool):
            raise ValueError("EXISTS takes true or false")
        if (c.field == "watchlist") != (c.operator == "CONTAINS") and c.operator != "EXISTS":
            raise ValueError("CONTAINS is for watchlists")
    if unknown := set(rule.actions) - set(ACTIONS):
        raise ValueError(f"unknown actions {sorted(unknown)}")


def compile_condition(c: Condition) -> Column:
    """Two-valued logic: null equals null, and null is in no list that lacks it."""
    col = F.col("list_types" if c.field == "watchlist" else c.field)
    if c.operator in ("EQ", "NEQ"):
        same = col.eqNullSafe(F.lit(c.value))
        return same if c.operator == "EQ" else ~same
    if c.operator in ("IN", "NOT_IN"):
        some = [v for v in c.value if v is not None]
        within = F.coalesce(col.isin(*some), F.lit(False)) if some else F.lit(False)
        if None in c.value:
            within = within | col.isNull()
        return within if c.operator == "IN" else ~within
    if c.operator == "CONTAINS":
        return F.coalesce(F.array_contains(col, c.value), F.lit(False))
    present = F.size(col) > 0 if c.field == "watchlist" else col.isNotNull()
    return present if c.value else ~present


def watchlist_matches(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Events with list_types and entry_ids of the entries in force for their plate at their time, in (type, id) order.

    An entry holds from valid_from to valid_until, both included; null is open. Grouping by event id keeps every event.
    """
    entry = watchlist.where("enabled").select(F.col("plate").alias("_plate"), "list_type", F.col("id").alias("entry_id"), "valid_from", "valid_until")
    at = F.col("occurred_at")
    held = (F.col("plate") == F.col("_plate")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (at <= F.col("valid_until")))
    hits = events.select("id", "plate", "occurred_at").join(entry, held).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("list_type", "entry_id"))).alias("entries"))
    empty = F.array().cast("array<string>")
    return events.join(hits, "id", "left").select(*events.columns, F.coalesce(F.col("entries.list_type"), empty).alias("list_types"), F.coalesce(F.col("entries.entry_id"), empty).alias("entry_ids"))


def apply_rules(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each event, matching rule and action: rules by priority (high first), name, id. One scan, no join."""
    for rule in rules:
        validate(rule)
    ranked = sorted((r for r in rules if r.enabled), key=lambda r: (-r.priority, r.name, r.id))
    if not ranked:
        kind = "struct<rule_id:string,rule_rank:int,actions:array<string>>"
        return events.where(F.lit(False)).select("*", F.inline(F.array(F.lit(None).cast(kind)))).select(*events.columns, "rule_id", "rule_rank", F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("execution_id"))
    found = [F.when(reduce(Column.__and__, [compile_condition(c) for c in r.conditions]), F.struct(F.lit(r.id).alias("rule_id"), F.lit(n).alias("rule_rank"), F.array(*[F.lit(a) for a in r.actions]).alias("actions"))) for n, r in enumerate(ranked)]
    matched = events.select("*", F.inline(F.array_compact(F.array(*found))))
    fanned = matched.select(*events.columns, "rule_id", "rule_rank", F.explode("actions").alias("action"))
    source = F.concat_ws("|", "id", "rule_id", "action")
    return fanned.withColumn("execution_id", F.concat(F.lit("act_"), F.substring(F.sha2(source, 256), 1, 40)))


def lifecycle(now: Column) -> Column:
    """DISABLED, SCHEDULED, EXPIRED or ACTIVE for watchlist entries."""
    return F.when(~F.col("enabled"), "DISABLED").when(F.col("valid_from") > now, "SCHEDULED").when(F.col("valid_until") < now, "EXPIRED").otherwise("ACTIVE")


def search_watchlist(watchlist: DataFrame, text: str) -> DataFrame:
    """Entries whose plate (without separators) or id contains the text, whatever its case."""
    bare = "".join(c for c in text.upper() if c not in "-. ")
    return watchlist.where(F.regexp_replace(F.upper("plate"), "[-. ]", "").contains(bare) | F.upper("id").contains(text.upper()))


def list_watchlist(watchlist: DataFrame, list_type: str | None, enabled: bool | None, limit: int) -> DataFrame:
    """Entries by type and state, the last changed first."""
    rows = watchlist.where(F.lit(list_type is None) | (F.col("list_type") == F.lit(list_type))).where(F.lit(enabled is None) | (F.col("enabled") == F.lit(enabled)))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def counts_by_type(watchlist: DataFrame) -> DataFrame:
    """Entries of each type, as the console shows beside its search."""
    return watchlist.groupBy("list_type").agg(F.count("*").alias("entries"))


def fold_alert(commands: DataFrame) -> DataFrame:
    """Alert state after its commands in order: OPEN, then ACKNOWLEDGED, then RESOLVED, which is final.

    Commands (alert_id, at, command) that do not fit the state change nothing. The state depends on the first RESOLVE and
    on whether an ACKNOWLEDGE came before it, so a plain aggregate folds them.
    """
    ack, done = F.min(F.when(F.col("command") == "ACKNOWLEDGE", F.col("at"))), F.min(F.when(F.col("command") == "RESOLVE", F.col("at")))
    out = commands.groupBy("alert_id").agg(ack.alias("_ack"), done.alias("resolved_at"))
    acknowledged = F.when(F.col("resolved_at").isNull() | (F.col("_ack") <= F.col("resolved_at")), F.col("_ack"))
    return out.select("alert_id", F.when(F.col("resolved_at").isNotNull(), "RESOLVED").when(F.col("_ack").isNotNull(), "ACKNOWLEDGED").otherwise("OPEN").alias("state"), acknowledged.alias("acknowledged_at"), "resolved_at")
