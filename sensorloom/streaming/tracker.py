"""The layer a print is on, told from the head's position as it comes in, and corrected by heights that the printer reports.

The measured height is off by a constant, and a head that picks up a tool or
wipes passes through heights of layers.  So nothing is taken for a layer until
the head has followed the first layer's path for a while; from then on the
layer rises by one at a time, once its height has stayed.  A reported height
is on the layers' own scale; while reports are fresh, they alone decide, and
may take the layer back.  Each row depends on what was decided before it, so a
run is a state, in batch as on a stream.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLLOWED = "run_id string, t double, layer int, z_offset double, decided string"

# Samples of the median's window and before it counts; seconds that a measured and a reported height must
# stay, and that a report is fresh.
WINDOW, ENOUGH, STAYS, REPORT_STAYS, FRESH = 51, 25, 1.5, 1.0, 4.0
# Fixed values of the start: distance from the path, seconds and way on it, greatest speed and gap, offset, margin of the print.
NEAR, HOLDS, WAY, FASTEST, GAP, OFF, MARGIN = 1.0, 0.35, 2.0, 80.0, 0.20, 20.0, 2.0


@dataclass
class Plan:
    """What is printed: layer heights, the first layer's path (x0, y0, x1, y1 by row), and the box (x and y from, to)."""

    zs: list[float]
    path: np.ndarray
    box: tuple[float, float, float, float]

    @property
    def pitch(self) -> float:
        steps = [b - a for a, b in zip(self.zs, self.zs[1:])]
        middle = median(steps) if steps else 0.0
        return middle if middle > 0.02 else 0.3

    def nearest(self, z: float) -> int:
        return min(range(len(self.zs)), key=lambda k: (abs(self.zs[k] - z), k))

    def inside(self, x: float, y: float) -> bool:
        a, b, c, d = self.box
        return a - MARGIN <= x <= b + MARGIN and c - MARGIN <= y <= d + MARGIN

    def on_path(self, x: float, y: float) -> bool:
        if not len(self.path):
            return False
        start, step = self.path[:, :2], self.path[:, 2:] - self.path[:, :2]
        size = np.maximum((step**2).sum(1), 1e-18)
        along = np.clip((((x, y) - start) * step).sum(1) / size, 0, 1)
        return bool((np.hypot(*((x, y) - start - along[:, None] * step).T) <= NEAR).any())


class _Dwell:
    """A layer that is about to be taken, and since when it has been."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.layer: int | None = None
        self.since: float | None = None

    def stayed(self, layer: int, t: float, seconds: float) -> bool:
        if layer != self.layer:
            self.layer, self.since = layer, t
            return False
        return t - self.since >= seconds


@dataclass
class Follower:
    """start: the layer on which a run is joined, if it is reported; seeded: the first report that stays begins the run."""

    plan: Plan
    start: int | None = None
    seeded: bool = False
    layer: int = -1
    offset: float | None = None
    heights: deque = field(default_factory=lambda: deque(maxlen=WINDOW))
    rising: _Dwell = field(default_factory=_Dwell)
    reporting: _Dwell = field(default_factory=_Dwell)
    reported: float | None = None
    lead: list | None = None  # since when, way so far, last t, x, y on the first layer's path

    def _take(self, layer: int, how: str) -> str:
        self.layer = layer
        self.rising.clear()
        return how

    def report(self, t: float, z: float) -> str | None:
        """A height from the printer: far from every layer, or more than one layer away, it is that of a hop."""
        if not self.plan.zs or self.layer < 0 and not self.seeded:
            return None
        self.reported = t
        at = self.plan.nearest(z)
        if abs(self.plan.zs[at] - z) > max(0.2 * self.plan.pitch, 0.04) or self.layer >= 0 and abs(at - self.layer) > 1 or at == self.layer:
            self.reporting.clear()
            return None
        if not self.reporting.stayed(at, t, REPORT_STAYS):
            return None
        self.reporting.clear()
        self.seeded = False
        return self._take(at, "reported")

    def _settled(self, layer: int) -> float | None:
        """The measured height's distance from a layer's, if it stands still."""
        middle = median(self.heights)
        if median(abs(h - middle) for h in self.heights) > max(0.45 * self.plan.pitch, 0.08) or abs(middle - self.plan.zs[layer]) > OFF:
            return None
        return middle - self.plan.zs[layer]

    def _begun(self, t: float, x: float, y: float) -> bool:
        """Whether the head has followed the first layer's path for long enough."""
        if len(self.heights) < ENOUGH or not self.plan.on_path(x, y):
            self.lead = None
            return False
        if self.lead:
            gap, way = t - self.lead[2], math.hypot(x - self.lead[3], y - self.lead[4])
            if not 0 < gap <= GAP or way > 0.05 and way / gap > FASTEST:
                self.lead = None
            else:
                self.lead[1] += way
        self.lead = [*(self.lead[:2] if self.lead else (t, 0.0)), t, x, y]
        return t - self.lead[0] >= HOLDS and self.lead[1] >= WAY

    def move(self, t: float, x: float, y: float, z: float) -> str | None:
        """A measured position."""
        if not self.plan.zs or self.reported is not None and t - self.reported <= FRESH or self.layer >= 0 and self.offset is None:
            return None
        here = self.plan.inside(x, y)
        if self.layer < 0 and self.start is not None and not here:
            self.heights.clear()  # what stands still outside of the print says nothing
            return None
        self.heights.append(z)
        if self.layer < 0:
            first = self.start if self.start is not None else 0
            ready = len(self.heights) >= ENOUGH if self.start is not None else not self.seeded and self._begun(t, x, y)
            if not ready or (off := self._settled(first)) is None:
                return None
            self.offset = off
            return self._take(first, "joined" if self.start is not None else "path")
        if len(self.heights) < ENOUGH:
            return None
        height = median(self.heights) - self.offset
        at = self.plan.nearest(height)
        if not here or at != self.layer + 1 or abs(self.plan.zs[at] - height) > max(0.6 * self.plan.pitch, 0.3):
            self.rising.clear()
            return None
        return self._take(at, "height") if self.rising.stayed(at, t, STAYS) else None


def _run(state: Follower, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for run, t, x, y, z, said in pdf.sort_values(["t", "reported"], na_position="first")[["run_id", "t", "x", "y", "z", "reported"]].itertuples(index=False):
        how = state.report(t, said) if not pd.isna(said) else None
        if not (pd.isna(x) or pd.isna(y) or pd.isna(z)):
            how = state.move(t, x, y, z) or how
        out.append((run, t, state.layer, state.offset, how))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])


def _follower(pdf: pd.DataFrame) -> Follower:
    one = pdf.iloc[0]
    path = np.array([list(p.values()) if isinstance(p, dict) else list(p) for p in one.path], dtype=float).reshape(-1, 4)
    return Follower(Plan(list(one.zs), path, tuple(one.box)), None if pd.isna(one.start_layer) else int(one.start_layer), bool(one.seeded))


def follow_batch(positions: DataFrame) -> DataFrame:
    """positions: run_id, t, x, y, z (null in a report), reported (a height, or null), zs, path, box, start_layer, seeded.

    The plan's columns are the same in all rows of a run.  decided tells by
    what a row has changed the layer: path, joined, height or reported.
    """
    return positions.groupBy("run_id").applyInPandas(lambda pdf: _run(_follower(pdf), pdf), FOLLOWED)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    whole = pd.concat(list(batches))
    follower = pickle.loads(state.get[0]) if state.exists else _follower(whole)
    yield _run(follower, whole)
    state.update((pickle.dumps(follower),))
    state.setTimeoutDuration(3_600_000)


def follow_stream(positions: DataFrame) -> DataFrame:
    """The same on a stream, whose batches must come in the order of time; a restarted query goes on from its checkpoint."""
    return positions.groupBy("run_id").applyInPandasWithState(_step, FOLLOWED, "follower binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
