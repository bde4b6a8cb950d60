"""Registered queries of lifecycles under commands; their SQL walks each record's commands by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platehouse.operators import histories, lifecycles
from platehouse.plans import fixtures as fx
from platehouse.plans.registry import query

_STALE = 86_400.0


def _walk_sql(commands: str, columns: dict[str, tuple[str, str]], accepted: str, returned: str) -> str:
    """SQL of a machine: columns are {name: (at first, after an accepted command)}, of w (the state) and c (the command)."""
    first = ", ".join(f"{a} AS {n}" for n, (a, _) in columns.items())
    after = ", ".join(f"CASE WHEN {accepted} THEN {b} ELSE w.{n} END" for n, (_, b) in columns.items())
    return (f"WITH RECURSIVE {{ve}}, k AS ({commands}), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS n FROM k), "
            f"w AS (SELECT id, 0::BIGINT AS n, false AS accepted, {first} FROM (SELECT DISTINCT id FROM k) UNION ALL SELECT c.id, c.n, coalesce({accepted}, false), {after} FROM w JOIN c ON c.id = w.id AND c.n = w.n + 1) "
            f"SELECT c.id, epoch_us(c.t) AS \"at\", c.command, {returned} FROM w JOIN c USING (id, n)")


_ACTIONS = "SELECT 'act_' || user_id AS id, occurred_at AS t, event_id AS seq, CASE WHEN event_id % 9 < 4 THEN 'CLAIM' WHEN event_id % 9 < 7 THEN 'FAIL' WHEN event_id % 9 = 7 THEN 'RELEASE' WHEN event_id % 2 = 0 THEN 'SUCCEED' ELSE 'ABANDON' END AS command FROM ve WHERE event_id % 13 <> 0"
_CLAIMED = "(c.command = 'CLAIM' AND (w.status IS NULL OR NOT (w.status = 'SUCCEEDED' OR w.attempts >= 5 OR (w.status = 'RUNNING' AND w.since >= epoch_us(c.t) - 86400000000))))"


@query(_walk_sql(_ACTIONS, {"status": ("NULL::VARCHAR", "CASE c.command WHEN 'CLAIM' THEN 'RUNNING' WHEN 'SUCCEED' THEN 'SUCCEEDED' ELSE 'FAILED' END"), "attempts": ("0::INT", "CASE c.command WHEN 'CLAIM' THEN w.attempts + 1 WHEN 'ABANDON' THEN 5 WHEN 'RELEASE' THEN greatest(0, w.attempts - 1) ELSE w.attempts END"), "since": ("0::BIGINT", "epoch_us(c.t)")}, f"({_CLAIMED} OR (c.command <> 'CLAIM' AND w.status IS NOT NULL))", "w.accepted, w.status, w.attempts"))
def action_history(spark, sf_dir):
    """ST9: claims, successes, failures of every kind and stale reclaims of actions, command by command."""
    kind = "CASE WHEN event_id % 9 < 4 THEN 'CLAIM' WHEN event_id % 9 < 7 THEN 'FAIL' WHEN event_id % 9 = 7 THEN 'RELEASE' WHEN event_id % 2 = 0 THEN 'SUCCEED' ELSE 'ABANDON' END AS command"
    rows = fx.events(spark, sf_dir).where("event_id % 13 <> 0").selectExpr("concat('act_', CAST(user_id AS STRING)) AS id", "occurred_at AS at", "event_id AS seq", kind)
    return lifecycles.action_history(rows, _STALE, 5)


_EXPORTS = "SELECT 'smp_' || (user_id % 97) AS id, occurred_at AS t, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'CLAIM' WHEN 3 THEN 'COMPLETE' ELSE 'CLAIM' END AS command, 'exp_' || (event_id % 3) AS export_id, 'm' || (event_id % 2) AS manifest FROM ve"
_FREE = "(w.status IN ('READY', 'EXPORT_FAILED') OR (w.status = 'EXPORTING' AND w.since < epoch_us(c.t) - 86400000000))"
_HELD = "(w.status = 'EXPORTING' AND w.holder IS NOT DISTINCT FROM c.export_id)"
_EXPORT_OK = f"((c.command = 'CLAIM' AND ({_FREE} OR {_HELD})) OR (c.command = 'COMPLETE' AND w.holder IS NOT DISTINCT FROM c.export_id AND w.status IN ('EXPORTING', 'EXPORTED') AND coalesce(w.manifest = c.manifest, true)) OR (c.command = 'FAIL' AND {_HELD}))"
_ANEW = f"c.command = 'CLAIM' AND NOT {_HELD}"


@query(_walk_sql(_EXPORTS, {"status": ("'READY'", "CASE c.command WHEN 'CLAIM' THEN 'EXPORTING' WHEN 'COMPLETE' THEN 'EXPORTED' ELSE 'EXPORT_FAILED' END"), "holder": ("NULL::VARCHAR", f"CASE WHEN {_ANEW} THEN c.export_id ELSE w.holder END"), "attempts": ("0::INT", f"CASE WHEN {_ANEW} THEN w.attempts + 1 ELSE w.attempts END"), "since": ("0::BIGINT", f"CASE WHEN {_ANEW} THEN epoch_us(c.t) ELSE w.since END"), "manifest": ("NULL::VARCHAR", f"CASE WHEN {_ANEW} THEN NULL WHEN c.command = 'COMPLETE' THEN c.manifest ELSE w.manifest END")}, _EXPORT_OK, "c.export_id, w.accepted, w.status, w.holder, w.attempts, w.manifest"))
def export_history(spark, sf_dir):
    """ST20: samples claimed, resumed, completed under a manifest and failed, command by command."""
    kind = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'CLAIM' WHEN 3 THEN 'COMPLETE' ELSE 'CLAIM' END AS command"
    rows = fx.events(spark, sf_dir).selectExpr("concat('smp_', CAST(user_id % 97 AS STRING)) AS id", "occurred_at AS at", "event_id AS seq", kind, "concat('exp_', CAST(event_id % 3 AS STRING)) AS export_id", "concat('m', CAST(event_id % 2 AS STRING)) AS manifest")
    return lifecycles.export_history(rows, _STALE)


_LEASES = "SELECT 'med_' || (user_id % 61) AS id, occurred_at AS t, event_id AS seq, CASE WHEN event_id % 4 < 2 THEN 'CLAIM' WHEN event_id % 12 = 3 THEN 'DELETE' ELSE 'FAIL' END AS command, 'ret_' || (event_id % 2) AS lease_id FROM ve"
_LEASED = "((c.command = 'CLAIM' AND (w.state IN ('KEPT', 'FAILED') OR (w.state = 'DELETING' AND w.since < epoch_us(c.t) - 86400000000))) OR (c.command <> 'CLAIM' AND w.state = 'DELETING' AND w.holder = c.lease_id))"


@query(_walk_sql(_LEASES, {"state": ("'KEPT'", "CASE c.command WHEN 'CLAIM' THEN 'DELETING' WHEN 'DELETE' THEN 'DELETED' ELSE 'FAILED' END"), "holder": ("NULL::VARCHAR", "CASE c.command WHEN 'CLAIM' THEN c.lease_id END"), "since": ("0::BIGINT", "epoch_us(c.t)")}, _LEASED, "c.lease_id, w.accepted, w.state, w.holder"))
def lease_history(spark, sf_dir):
    """ST19: leases on media that are taken, lost, kept to deletion or failed, command by command."""
    kind = "CASE WHEN event_id % 4 < 2 THEN 'CLAIM' WHEN event_id % 12 = 3 THEN 'DELETE' ELSE 'FAIL' END AS command"
    rows = fx.events(spark, sf_dir).selectExpr("concat('med_', CAST(user_id % 61 AS STRING)) AS id", "occurred_at AS at", "event_id AS seq", kind, "concat('ret_', CAST(event_id % 2 AS STRING)) AS lease_id")
    return lifecycles.lease_history(rows, _STALE)


_STATE = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DELETING' WHEN 2 THEN 'DELETED' END"
_MEDIA = f"m AS (SELECT id AS event_id, occurred_at, CASE WHEN event_id % 7 <> 0 THEN 'img/' || event_id END AS key, {_STATE} AS state, occurred_at + INTERVAL 1 DAY AS updated_at, event_id AS e FROM ve)"


def _media(spark, sf_dir) -> DataFrame:
    return fx.events(spark, sf_dir).selectExpr("id AS event_id", "occurred_at", "CASE WHEN event_id % 7 <> 0 THEN concat('img/', CAST(event_id AS STRING)) END AS key", f"{_STATE} AS state", "occurred_at + INTERVAL 1 DAY AS updated_at", "event_id AS e")


@query("WITH {ve}, " + _MEDIA + ", o AS (SELECT * FROM m WHERE occurred_at < TIMESTAMP '2024-01-20' AND key IS NOT NULL) SELECT event_id, key, state IS NOT DISTINCT FROM 'DELETING' AS reclaimed FROM o WHERE ((state IS NULL OR state = 'FAILED') AND e % 3 <> 0) OR (state = 'DELETING' AND updated_at < TIMESTAMP '2024-01-10') ORDER BY reclaimed, occurred_at, event_id LIMIT 5000")
def retention_claims(spark, sf_dir):
    """ST19, J7: media that a pass may delete: kept and failed ones without a pin, then stale leases."""
    media = _media(spark, sf_dir)
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    return lifecycles.claim_media(media, media.where("e % 3 = 0").select("key"), stamp("2024-01-20"), stamp("2024-01-10"), 5000)


@query("WITH {ve}, " + _MEDIA + " SELECT event_id AS id FROM m WHERE occurred_at < TIMESTAMP '2024-01-20' AND NOT ((key IS NOT NULL AND coalesce(state, '') <> 'DELETED') OR coalesce(state, '') = 'DELETING') AND NOT (e % 11 = 0 AND e % 2 = 0)")
def deletable_events(spark, sf_dir):
    """ST19: expired events whose media are gone and that no sample in work needs."""
    media = _media(spark, sf_dir)
    samples = media.where("e % 11 = 0").select(F.col("event_id").alias("source_event_id"), F.when(F.col("e") % 2 == 0, "READY").otherwise("EXPORTED").alias("status"))
    return lifecycles.deletable_events(fx.events(spark, sf_dir), media, samples, F.lit("2024-01-20").cast("timestamp_ntz"))


_STEP = "row_number() OVER (PARTITION BY hub ORDER BY t, seq) AS n"


@query("WITH RECURSIVE {ve}, c AS (SELECT *, " + _STEP + " FROM (SELECT 'hub-' || (user_id % 23) AS hub, occurred_at AS t, event_id AS seq, 'k' || (event_id % 41) AS id FROM ve)), w AS (SELECT hub, 0::BIGINT AS n, []::VARCHAR[] AS ids, false AS admitted FROM (SELECT DISTINCT hub FROM c) UNION ALL SELECT c.hub, c.n, CASE WHEN list_contains(w.ids, c.id) THEN w.ids ELSE list_append(CASE WHEN len(w.ids) >= 12 THEN w.ids[2:] ELSE w.ids END, c.id) END, NOT list_contains(w.ids, c.id) FROM w JOIN c ON c.hub = w.hub AND c.n = w.n + 1) SELECT hub, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS \"at\", seq, id, admitted FROM w JOIN c USING (hub, n)")
def replay_admissions(spark, sf_dir):
    """U8: what a hub passes on, given the last twelve ids that it admitted; an id that left them is admitted again."""
    rows = fx.events(spark, sf_dir).selectExpr("concat('hub-', CAST(user_id % 23 AS STRING)) AS hub", "occurred_at AS at", "event_id AS seq", "concat('k', CAST(event_id % 41 AS STRING)) AS id")
    return histories.admissions(rows, 12).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_MINE = "list_filter(w.held, lambda e: e.c = c.camera_id)"
_OTHERS = "list_filter(w.held, lambda e: e.c <> c.camera_id)"


@query("WITH RECURSIVE {ve}, c AS (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY t, seq) AS n FROM (SELECT 'mon-' || (user_id % 19) AS monitor, occurred_at AS t, event_id AS seq, camera_id FROM ve)), "
       "w AS (SELECT monitor, 0::BIGINT AS n, []::STRUCT(c VARCHAR, k INT)[] AS held, NULL::VARCHAR AS evicted_camera, 0 AS evicted_frames FROM (SELECT DISTINCT monitor FROM c) UNION ALL "
       "SELECT c.monitor, c.n, CASE WHEN len(" + _MINE + ") > 0 THEN list_append(" + _OTHERS + ", {'c': c.camera_id, 'k': least(3, " + _MINE + "[1].k + 1)::INT}) ELSE list_append(CASE WHEN len(w.held) >= 5 THEN w.held[2:] ELSE w.held END, {'c': c.camera_id, 'k': 1::INT}) END, "
       "CASE WHEN len(" + _MINE + ") > 0 THEN CASE WHEN " + _MINE + "[1].k = 3 THEN c.camera_id END WHEN len(w.held) >= 5 THEN w.held[1].c END, CASE WHEN len(" + _MINE + ") > 0 THEN (" + _MINE + "[1].k = 3)::INT WHEN len(w.held) >= 5 THEN w.held[1].k ELSE 0 END FROM w JOIN c ON c.monitor = w.monitor AND c.n = w.n + 1) "
       "SELECT monitor, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS \"at\", seq, camera_id, evicted_camera, evicted_frames, len(held)::INT AS cameras FROM w JOIN c USING (monitor, n)")
def live_buffers(spark, sf_dir):
    """ST12: buffers of three frames for five cameras a monitor; the camera unseen for longest makes room."""
    rows = fx.events(spark, sf_dir).selectExpr("concat('mon-', CAST(user_id % 19 AS STRING)) AS monitor", "occurred_at AS at", "event_id AS seq", "camera_id")
    return histories.live_buffers(rows, 5, 3).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("WITH RECURSIVE {ve}, c AS (SELECT camera_id, epoch_us(occurred_at) AS t, event_id AS seq, event_id % 97 = 0 AS forced, row_number() OVER (PARTITION BY camera_id ORDER BY occurred_at, event_id) AS n FROM ve), w AS (SELECT camera_id, 0::BIGINT AS n, NULL::BIGINT AS last, false AS stored FROM (SELECT DISTINCT camera_id FROM c) UNION ALL SELECT c.camera_id, c.n, CASE WHEN c.forced OR w.last IS NULL OR c.t - w.last >= 7200000000 THEN c.t ELSE w.last END, c.forced OR w.last IS NULL OR c.t - w.last >= 7200000000 FROM w JOIN c ON c.camera_id = w.camera_id AND c.n = w.n + 1) SELECT camera_id, t AS \"at\", seq FROM w JOIN c USING (camera_id, n) WHERE stored")
def throttled_health(spark, sf_dir):
    """ST13: health reports that are stored, at most one in two hours for a camera unless forced."""
    rows = fx.events(spark, sf_dir).selectExpr("camera_id", "occurred_at AS at", "event_id AS seq", "event_id % 97 = 0 AS forced")
    return lifecycles.health_upserts(rows, 7200.0)
