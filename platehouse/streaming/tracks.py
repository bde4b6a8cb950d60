"""Tracks as a stream: sessions close by their camera's progress, not by wall-clock time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from platehouse.streaming.starting import SORTED, settings

GAP_SECONDS = 2.0
SESSIONS = "camera_id string, epoch long, track_id string, first_seen double, last_seen double, observations long, cause string"
_NAMES = [c.split()[0] for c in SESSIONS.split(", ")]
#: Closed sessions that a task holds before it hands them on.
FLUSH = 10_000


def advance(open_: dict[str, list], gone: dict[str, float], at: float, seen: list[str], crossed: set[str], gap: float = GAP_SECONDS) -> list[tuple]:
    """One tick of a camera: update the tracks that it saw, then close those unseen for `gap` seconds. Changes its arguments.

    open_ maps a track to [first, last, observations], gone a track closed by crossing to the time up to which it is
    remembered: sightings of such a track are dropped and renew it. Returns closed (track, first, last, observations, cause).
    """
    for track in [t for t, stamp in gone.items() if at - stamp >= gap]:
        del gone[track]
    out = []
    for track in seen:
        if track in gone:
            gone[track] = at
        elif track in open_:
            open_[track][1:] = at, open_[track][2] + 1
        else:
            open_[track] = [at, at, 1]
        if track in crossed and track in open_:
            out.append((track, *open_.pop(track), "CROSSING"))
            gone[track] = at
    for track in [t for t, v in open_.items() if at - v[1] >= gap]:
        out.append((track, *open_.pop(track), "TIMEOUT"))
    return out


def _ticks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(epoch, at, tracks in order of arrival, those that crossed, whether one row is final) of sorted rows; rows without an
    epoch or time go. A tick may go on in the next batch."""
    held = None
    for batch in batches:
        rows = batch[batch["epoch"].notna() & batch["at"].notna()]
        for epoch, at, track, crossed, final in zip(*[rows[c].tolist() for c in ("epoch", "at", "track_id", "crossed", "final")], strict=True):
            if held is None or held[0] != epoch or held[1] != at:
                if held is not None:
                    yield held
                held = (epoch, at, {}, set(), [])
            if isinstance(track, str):
                held[2][track] = None
                if crossed:
                    held[3].add(track)
            if final:
                held[4].append(final)
    if held is not None:
        yield held


def _walk(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A camera's rows of one micro-batch, sorted by time: one batch of them is held. A new epoch closes all tracks."""
    epoch, open_, gone = json.loads(state.get[0]) if state.exists else (None, {}, {})
    out = []
    for this, at, seen, crossed, final in _ticks(batches):
        if epoch is not None and this < epoch:
            continue  # a frame of a connection that is over
        if epoch is not None and this > epoch:
            out += [(key[0], epoch, t, *v, "EPOCH") for t, v in open_.items()]
            open_, gone = {}, {}
        epoch = int(this)
        out += [(key[0], epoch, *x) for x in advance(open_, gone, float(at), list(seen), crossed)]
        if final:
            out += [(key[0], epoch, t, *v, "END") for t, v in open_.items()]
            open_, gone = {}, {}
        if len(out) >= FLUSH:
            yield pd.DataFrame(out, columns=_NAMES)
            out = []
    state.update((json.dumps((epoch, open_, gone)),))
    if out:
        yield pd.DataFrame(out, columns=_NAMES)


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """_walk for rows in any order: all that a micro-batch has of a camera are held and sorted here."""
    return _walk(key, [pd.concat(list(batches)).sort_values(["epoch", "at"], kind="stable")], state)


def sessions(ticks: DataFrame, ordered: bool = False) -> DataFrame:
    """Closed sessions of a stream of ticks (camera_id, epoch, at in seconds, track_id, crossed, final).

    Every frame has a row for each track that it saw, or one without a track; heartbeats are rows without a track. `final`
    marks the end of a stream, which closes what is open. State is the open tracks of a camera. With `ordered`, Spark deals
    and sorts each micro-batch before the state, so that tasks hold no camera's rows; such a stream is started with `start`.
    """
    rows = ticks.select("camera_id", "epoch", "at", "track_id", "crossed", "final")
    if ordered:
        rows = rows.repartition("camera_id").sortWithinPartitions("camera_id", "epoch", "at")
    return rows.groupBy("camera_id").applyInPandasWithState(_walk if ordered else _run, SESSIONS, "state string", "append", GroupStateTimeout.NoTimeout)


def start(ticks: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the sessions of a stream as Parquet files until what is there has been read, or without end at intervals of `every`."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with settings(ticks.sparkSession, SORTED):
        return sessions(ticks, ordered=True).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
