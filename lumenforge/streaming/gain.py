"""The gain controller on a stream of frames, by keyed state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenforge.operators.temporal import Controller, Gain

OUTPUT = "stream_id string, frame_index long, gain double, late boolean"
STATE = "last double, last_luma double, history array<double>, frame_index long"


class GainProcessor(StatefulProcessor):
    """Holds one `Gain` a stream, and the index of the last frame that it has seen.

    Frames of a micro-batch are folded in order of their index; a batch holds one row a frame, never pixels. A frame that
    comes after one of a higher or equal index can't be folded any more: it is given out with a null gain as late, and
    leaves no trace in the state.
    """

    def __init__(self, controller: Controller):
        self.controller = controller

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gain", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gain, seen = Gain(self.controller.window), None
        if self.state.exists():
            last, last_luma, history, seen = self.state.get()
            gain.last, gain.last_luma, gain.history = last, last_luma, deque(history or [])
        frames = [f for part in rows for f in zip(part.frame_index, part.frame_time_ms, part.luma, part.locked, strict=True)]
        out = []
        for index, t, y, k in sorted(frames, key=lambda f: f[0]):
            late = seen is not None and index <= seen
            out.append((key[0], index, None if late else self.controller.apply(gain, t, y, bool(k)), late))
            seen = seen if late else index
        self.state.update((gain.last, gain.last_luma, list(gain.history), seen))
        yield pd.DataFrame(out, columns=["stream_id", "frame_index", "gain", "late"])

    def close(self) -> None:
        pass


def stabilise_stream(frames: DataFrame, controller: Controller = Controller()) -> DataFrame:  # noqa: B008
    """(stream_id, frame_index, gain, late) of a streaming DataFrame of frames; needs the RocksDB state store."""
    return frames.groupBy("stream_id").transformWithStateInPandas(GainProcessor(controller), OUTPUT, "append", "none")
