"""Lifecycles of records under commands: compare-and-set, actions, exports and leases on media, folded over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.functions.folding import Machine, fold

#: What a command came to, and the record's state after it.
ACTION_SCHEMA = "id string, at long, command string, accepted boolean, status string, attempts int"
EXPORT_SCHEMA = "id string, at long, command string, export_id string, accepted boolean, status string, holder string, attempts int, manifest string"
LEASE_SCHEMA = "id string, at long, command string, lease_id string, accepted boolean, state string, holder string"


def compare_and_set(commands: DataFrame) -> DataFrame:
    """(id, revision, accepted) after commands (id, at, expected) that each write only if expected is the revision then.

    A record starts at revision 1 and each accepted command adds one; of one time the lower expectation comes first.
    """
    step = lambda s, row: ((s[0] + (row[2] == s[0]),), None)
    machine = Machine((1,), step, "id string, revision int, accepted int", lambda key, s: (key[0], s[0], s[0] - 1))
    return fold(commands.select("id", "at", "expected"), ["id"], ["at", "expected"], machine)


def _micros(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


def action_history(commands: DataFrame, stale_seconds: float, most_attempts: int) -> DataFrame:
    """Every command on an action's execution (id, at, seq, command) with what it came to; times are microseconds.

    CLAIM is accepted for a new execution, one that failed, or one that has been running since before at - stale_seconds,
    while attempts are left; it counts an attempt. SUCCEED ends it for good. FAIL lets it be claimed again, ABANDON uses up
    all attempts, and RELEASE fails it but gives its attempt back. All but CLAIM need an execution to be there.
    """
    stale = int(stale_seconds * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        status, attempts, since = state
        key, at, _, command = row
        if command == "CLAIM":
            taken = status == "SUCCEEDED" or (status is not None and attempts >= most_attempts) or (status == "RUNNING" and since >= at - stale)
            accepted, after = not taken, ("RUNNING", attempts + 1, at)
        else:
            accepted = status is not None and command in ("SUCCEED", "FAIL", "ABANDON", "RELEASE")
            left = {"ABANDON": most_attempts, "RELEASE": max(0, attempts - 1)}.get(command, attempts)
            after = ("SUCCEEDED" if command == "SUCCEED" else "FAILED", left, at)
        state = after if accepted else state
        return state, (key, at, command, accepted, state[0], state[1])

    return fold(_micros(commands.select("id", "at", "seq", "command")), ["id"], ["at", "seq"], Machine((None, 0, 0), step, ACTION_SCHEMA))


def export_history(commands: DataFrame, stale_seconds: float) -> DataFrame:
    """Every command on a sample's export (id, at, seq, command, export_id, manifest) with what it came to.

    A sample begins READY. CLAIM takes one that is READY, EXPORT_FAILED or has been EXPORTING since before at -
    stale_seconds; an export that holds it already goes on. COMPLETE by its holder makes it EXPORTED under a manifest,
    again only under the same one. FAIL by its holder makes it EXPORT_FAILED.
    """
    stale = int(stale_seconds * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        status, holder, attempts, since, manifest = state
        key, at, _, command, export, digest = row
        mine = holder is not None and holder == export
        after, accepted = state, False
        if command == "CLAIM":
            free = status in ("READY", "EXPORT_FAILED") or (status == "EXPORTING" and since < at - stale)
            held = status == "EXPORTING" and mine
            accepted = held or free
            if free and not held:
                after = ("EXPORTING", export, attempts + 1, at, None)
        elif command == "COMPLETE":
            accepted = mine and status in ("EXPORTING", "EXPORTED") and manifest in (None, digest)
            after = ("EXPORTED", holder, attempts, since, digest)
        elif command == "FAIL":
            accepted = mine and status == "EXPORTING"
            after = ("EXPORT_FAILED", holder, attempts, since, manifest)
        state = after if accepted else state
        return state, (key, at, command, export, accepted, state[0], state[1], state[2], state[4])

    rows = _micros(commands.select("id", "at", "seq", "command", "export_id", "manifest"))
    return fold(rows, ["id"], ["at", "seq"], Machine(("READY", None, 0, 0, None), step, EXPORT_SCHEMA))


def lease_history(commands: DataFrame, stale_seconds: float) -> DataFrame:
    """Every command on a medium that retention deletes (id, at, seq, command, lease_id) with what it came to.

    A medium begins KEPT. CLAIM makes one that is KEPT or FAILED, or whose lease is older than stale_seconds, DELETING
    under a new lease. DELETE and FAIL count only under the lease that holds it then: otherwise the lease was lost.
    """
    stale = int(stale_seconds * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        kind, holder, since = state
        key, at, _, command, lease = row
        if command == "CLAIM":
            accepted, after = kind in ("KEPT", "FAILED") or (kind == "DELETING" and since < at - stale), ("DELETING", lease, at)
        else:
            accepted = kind == "DELETING" and holder == lease and command in ("DELETE", "FAIL")
            after = ("DELETED" if command == "DELETE" else "FAILED", None, at)
        state = after if accepted else state
        return state, (key, at, command, lease, accepted, state[0], state[1])

    return fold(_micros(commands.select("id", "at", "seq", "command", "lease_id")), ["id"], ["at", "seq"], Machine(("KEPT", None, 0), step, LEASE_SCHEMA))


def health_upserts(reports: DataFrame, every_seconds: float) -> DataFrame:
    """The reports (camera_id, at, seq, forced) that are stored: forced ones, and those that come every_seconds or more
    after the one stored before them."""
    every = int(every_seconds * 1_000_000)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        camera, at, seq, forced = row
        stored = bool(forced) or state[0] is None or at - state[0] >= every
        return (at,) if stored else state, (camera, at, seq) if stored else None

    rows = _micros(reports.select("camera_id", "at", "seq", "forced"))
    return fold(rows, ["camera_id"], ["at", "seq"], Machine((None,), step, "camera_id string, at long, seq long"))


def claim_media(media: DataFrame, pinned: DataFrame, older_than, stale_before, limit: int) -> DataFrame:
    """Media that retention may delete now (event_id, key, reclaimed), the oldest first, at most `limit`.

    media: event_id, occurred_at, key, state (null, FAILED, DELETING, DELETED), updated_at; pinned: key. First those that
    are kept or failed and not pinned, then those whose lease went stale; a pin no longer holds what is being deleted.
    """
    old = media.where((F.col("occurred_at") < older_than) & F.col("key").isNotNull())
    new = old.where("state IS NULL OR state = 'FAILED'").join(pinned.select("key").distinct(), "key", "left_anti")
    stale = old.where((F.col("state") == "DELETING") & (F.col("updated_at") < stale_before))
    both = new.select("event_id", "occurred_at", "key", F.lit(False).alias("reclaimed")).unionByName(stale.select("event_id", "occurred_at", "key", F.lit(True).alias("reclaimed")))
    return both.orderBy("reclaimed", "occurred_at", "event_id").limit(limit).select("event_id", "key", "reclaimed")


def deletable_events(events: DataFrame, media: DataFrame, samples: DataFrame, older_than) -> DataFrame:
    """Ids of events that are older, have no medium left or being deleted, and are no source of a sample in work.

    media: event_id, key, state; samples: source_event_id, status.
    """
    busy = media.where("(key IS NOT NULL AND coalesce(state, '') <> 'DELETED') OR state = 'DELETING'").select(F.col("event_id").alias("id"))
    pins = samples.where(F.col("status").isin("READY", "EXPORTING", "EXPORT_FAILED")).select(F.col("source_event_id").alias("id"))
    return events.where(F.col("occurred_at") < older_than).select("id").join(busy.union(pins).where("id IS NOT NULL").distinct(), "id", "left_anti")
