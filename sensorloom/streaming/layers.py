"""The layer a print is on, from its height as it comes in: it rises by one at a time, once the height has stayed there."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACKED = "run_id string, t double, z double, layer int, z_offset double"


@dataclass
class Tracker:
    """zs: the layers' heights.  The first settled height gives the constant by which the sensor is off."""

    zs: list[float]
    seen: deque = field(default_factory=lambda: deque(maxlen=51))
    layer: int = -1
    offset: float | None = None
    since: float | None = None

    def add(self, t: float, z: float) -> int:
        self.seen.append(z)
        if len(self.seen) < 25 or not self.zs:
            return self.layer
        mid = float(np.median(self.seen))
        if self.offset is None:
            if np.ptp(list(self.seen)[-25:]) > 0.05:
                return self.layer
            self.offset, self.layer = mid - self.zs[0], 0
        if self.layer + 1 < len(self.zs):
            edge = (self.zs[self.layer] + self.zs[self.layer + 1]) / 2
            if mid - self.offset <= edge:
                self.since = None
            elif self.since is None:
                self.since = t
            elif t - self.since >= 1.5:
                self.layer, self.since = self.layer + 1, None
        return self.layer


def _run(state: Tracker, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("t")
    got = [(r.run_id, r.t, r.z, state.add(r.t, r.z), state.offset) for r in pdf.itertuples()]
    return pd.DataFrame(got, columns=[c.split()[0] for c in TRACKED.split(", ")])


def track_batch(heights: DataFrame) -> DataFrame:
    """heights: run_id, t, z, zs (the plan's layer heights, an array)."""
    return heights.groupBy("run_id").applyInPandas(lambda pdf: _run(Tracker(list(pdf.zs.iloc[0])), pdf), TRACKED)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    whole = pd.concat(list(batches))
    tracker = pickle.loads(state.get[0]) if state.exists else Tracker(list(whole.zs.iloc[0]))
    yield _run(tracker, whole)
    state.update((pickle.dumps(tracker),))
    state.setTimeoutDuration(3_600_000)


def track_stream(heights: DataFrame) -> DataFrame:
    return heights.groupBy("run_id").applyInPandasWithState(_step, TRACKED, "tracker binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
