"""Bounded histories: replay without repeats, and live buffers that evict the camera unseen for longest; folds over ranges."""

from __future__ import annotations

from collections import OrderedDict, deque

from pyspark.sql import DataFrame

from platehouse.functions.folding import Machine, fold

_ADMITTED = "hub string, at timestamp_ntz, seq long, id string, admitted boolean"
_BUFFERED = "monitor string, at timestamp_ntz, seq long, camera_id string, evicted_camera string, evicted_frames int, cameras int"


class _History:
    """The ids that a hub admitted last."""

    def __init__(self, ids, most: int):
        self.order, self.ids, self.most = deque(ids), set(ids), most

    def admits(self, key: str) -> bool:
        if key in self.ids:
            return False
        if self.most:
            if len(self.order) >= self.most:
                self.ids.discard(self.order.popleft())
            self.order.append(key)
            self.ids.add(key)
        return True


def admissions(events: DataFrame, most: int) -> DataFrame:
    """Every event (hub, at, seq, id) of a hub with whether it is passed on: not while its id is among the `most` that were
    admitted last. An id that has left that history is admitted again; a repeat doesn't renew its place.

    State is the history, so `most` ids a range come to the driver.
    """
    step = lambda history, row: (history, (*row, history.admits(row[3])))
    machine = Machine((), step, _ADMITTED, thaw=lambda ids: _History(ids, most), freeze=lambda h: tuple(h.order))
    return fold(events.select("hub", "at", "seq", "id"), ["hub"], ["at", "seq"], machine)


def live_buffers(frames: DataFrame, most_cameras: int, buffer: int) -> DataFrame:
    """Every frame (monitor, at, seq, camera_id) with what its arrival evicts and how many cameras are buffered then.

    A camera keeps its last `buffer` frames. A frame of a new camera, when most_cameras are buffered, evicts all frames of
    the one that has been without a frame for longest.
    """

    def step(held: OrderedDict, row: tuple) -> tuple[OrderedDict, tuple]:
        camera, evicted, gone = row[3], None, 0
        if camera in held:
            held.move_to_end(camera)
            gone = int(held[camera] == buffer)
            held[camera] = min(buffer, held[camera] + 1)
            evicted = camera if gone else None
        else:
            if len(held) >= most_cameras:
                evicted, gone = held.popitem(last=False)
            held[camera] = 1
        return held, (*row, evicted, gone, len(held))

    machine = Machine((), step, _BUFFERED, thaw=lambda pairs: OrderedDict(map(tuple, pairs)), freeze=lambda held: tuple(held.items()))
    return fold(frames.select("monitor", "at", "seq", "camera_id"), ["monitor"], ["at", "seq"], machine)
