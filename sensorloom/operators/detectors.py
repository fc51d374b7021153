"""Detectors whose every decision depends on the ones before: one run's arrays at a time, in numpy.

They get a run's signals as sorted arrays of times and values; sweep.py runs
them grouped by run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Plan:
    """A sweep's plan: per K its value, start after t0, duration and cycles; one period for all."""

    k: np.ndarray
    start: np.ndarray
    duration: np.ndarray
    cycles: np.ndarray
    period: float
    slow_half: float

    @property
    def total(self) -> int:
        return int(self.cycles.sum())

    @property
    def length(self) -> float:
        return float(self.start[-1] + self.duration[-1])

    def firsts(self) -> np.ndarray:
        """The number of each K's first cycle."""
        return np.concatenate([[0], np.cumsum(self.cycles)[:-1]]).astype(int)


def rising_edges(t: np.ndarray, y: np.ndarray, gap: float = 0.5, spread: float = 50.0, least: int = 50, level: float | None = None) -> np.ndarray:
    """Interpolated times at which the signal rises through the middle of its 10-90 % range, each at least `gap` after
    the last one kept; none for short or flat signals."""
    if len(t) < least:
        return np.zeros(0)
    lo, hi = np.percentile(y, [10, 90])
    if hi - lo < spread:
        return np.zeros(0)
    mid = (lo + hi) / 2 if level is None else level
    i = np.flatnonzero((y[:-1] <= mid) & (y[1:] > mid))
    at = t[i] + (mid - y[i]) / (y[i + 1] - y[i]) * (t[i + 1] - t[i])
    kept: list[float] = []
    for x in at.tolist():
        if not kept or x - kept[-1] >= gap:
            kept.append(x)
    return np.array(kept)


def peaks(t: np.ndarray, x: np.ndarray, amplitude: float | None = None, share: float = 0.30, least: float = 0.02, moving: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Times and directions (+1 a peak, -1 a trough) of reversals, each confirmed once the signal has come back by more
    than the deadband: max(share * amplitude, least).

    The signal has no direction until it is further than the deadband from
    where it began.  Fewer than five samples, or an amplitude below `moving`,
    have no reversals.
    """
    none = np.zeros(0), np.zeros(0, dtype=int)
    if len(t) < 5:
        return none
    if amplitude is None or amplitude <= 0:
        amplitude = float(np.subtract(*np.percentile(x, [95, 5])))
    if amplitude < moving:
        return none
    dead = max(share * amplitude, least)
    begun = np.abs(x - x[0]) > dead
    if not begun.any():
        return none
    at = int(begun.argmax())
    way = 1 if x[at] > x[0] else -1
    times, turns = [], []
    while True:
        ahead = way * x[at:]
        back = np.maximum.accumulate(ahead) - ahead > dead
        if not back.any():
            return np.array(times), np.array(turns, dtype=int)
        stop = int(back.argmax())
        times.append(t[at + int(ahead[:stop].argmax())])
        turns.append(way)
        at, way = at + stop, -way


def velocity_starts(t: np.ndarray, x: np.ndarray, quiet: float = 0.1) -> np.ndarray:
    """Times at which the smoothed velocity turns from backwards or rest to forwards."""
    if len(t) < 10:
        return np.zeros(0)
    speed = np.gradient(x, t, edge_order=1) if (np.diff(t) > 0).all() else np.gradient(x) / max(np.median(np.diff(t)), 1e-9)
    speed = np.convolve(speed, np.ones(5) / 5, mode="same")
    limit = quiet * np.percentile(np.abs(speed), 95)
    if limit <= 0:
        return np.zeros(0)
    sign = np.where(speed > limit, 1, np.where(speed < -limit, -1, 0))
    index = np.where(sign != 0, np.arange(len(sign)), 0)
    latched = sign[np.maximum.accumulate(index)]
    return t[1:][(latched[1:] > 0) & (latched[:-1] <= 0)]


def marker(t: np.ndarray, z: np.ndarray, lift: float = 2.0, base: float | None = None, settle: float = 0.5, guard: float = 0.25, still: float = 0.5, back: float = 1.5, after: float = 1.0) -> float | None:
    """The time at which a lift-and-return pulse is back: from a settled level (near `base`, if known) up by half the
    lift at least, back below 0.3 of it in time, and settled from then on."""
    n = len(t)
    for i in range(n):
        window = (t >= t[i] - guard - settle) & (t <= t[i] - guard)
        if window.sum() < 3 or np.ptp(z[window]) > still:
            continue
        level = np.median(z[window])
        if base is not None and abs(level - base) > 1.0 or z[i] - level <= 0.5 * lift:
            continue
        later = np.flatnonzero((t > t[i]) & (t <= t[i] + back) & (z - level < 0.3 * lift))
        if not len(later):
            continue
        j = int(later[0])
        rest = z[(t >= t[j]) & (t <= t[j] + after)]
        if len(rest) < 3 or np.abs(rest - level).max() > max(still, 0.3 * lift) or t[-1] - t[j] < 0.5 * after:
            continue
        a, b = z[j - 1] - level, z[j] - level
        share = (a - 0.3 * lift) / (a - b) if a != b else 1.0
        return float(t[j - 1] + np.clip(share, 0, 1) * (t[j] - t[j - 1]))
    return None


def first_motion(t: np.ndarray, x: np.ndarray, amplitude: float, period: float, settle: float = 0.5) -> float | None:
    """The first time that the position leaves a settled level by half the amplitude and stays within two of it for a period."""
    for i in range(1, len(t)):
        before = x[(t >= t[i] - settle) & (t < t[i])]
        if len(before) < 3 or np.ptp(before) > 0.25 * amplitude:
            continue
        level = np.median(before)
        if abs(x[i] - level) > 0.5 * amplitude:
            ahead = x[(t >= t[i]) & (t <= t[i] + period)]
            if np.abs(ahead - level).max() <= 2 * amplitude and np.abs(ahead - level).min() <= 0.5 * amplitude:
                return float(t[i])
    return None


def burst_onset(t: np.ndarray, y: np.ndarray, period: float, slow_half: float, cycles: int = 4, sustain: int = 1) -> float | None:
    """Where the rolling deviation over a cycle first stays above a quarter of its maximum for a cycle, refined to the
    earliest shift at which a few cycles' square wave fits nearly best."""
    if len(t) < 50:
        return None
    dt = float(np.median(np.diff(t)))
    n = max(3, int(round(period / dt)))
    if dt <= 0 or len(t) < 2 * n:
        return None
    centred = y - y.mean()
    s1, s2 = np.concatenate([[0], np.cumsum(centred)]), np.concatenate([[0], np.cumsum(centred**2)])
    mean = (s1[n:] - s1[:-n]) / n
    std = np.sqrt(np.maximum((s2[n:] - s2[:-n]) / n - mean**2, 0))
    busy = std > 0.25 * std.max()
    need = sustain * n
    run = np.convolve(busy, np.ones(need), mode="valid") >= need - 0.5
    if not run.any():
        return None
    coarse = t[int(np.argmax(run))] + period / 2
    shifts = np.arange(coarse - 2 * period, coarse + 2 * period, dt)
    phase = np.arange(0, cycles * period, dt)
    model = np.where(phase % period >= slow_half, 1.0, -1.0)
    model -= model.mean()
    at = np.interp(shifts[:, None] + phase[None, :], t, y)
    at -= at.mean(axis=1, keepdims=True)
    score = at @ model
    return float(shifts[int(np.argmax(score >= 0.95 * score.max()))])


def periodic_run(starts: np.ndarray, period: float, n: int = 3, tolerance: float = 0.3) -> int | None:
    """The first of n + 1 starts in a row that lie a period apart."""
    gaps = np.abs(np.diff(starts) - period) <= tolerance * period
    for i in range(len(gaps) - n + 1):
        if gaps[i : i + n].all():
            return i
    return None


def rectified(starts: np.ndarray, total: int, period: float) -> np.ndarray:
    """`total` starts: those that come within half a period dropped, missed ones put in, the tail carried on."""
    out = [float(starts[0])]
    for s in starts[1:].tolist():
        gap = s - out[-1]
        if gap < 0.5 * period:
            continue
        for _ in range(int(round(gap / period)) - 1):
            out.append(out[-1] + period)
        out.append(s)
    while len(out) < total:
        out.append(out[-1] + period)
    return np.array(out[:total])


def windows_of(starts: np.ndarray, plan: Plan) -> np.ndarray:
    """(n_k, 2): each K from its first cycle's start to its last one's end."""
    first = plan.firsts()
    return np.stack([starts[first], starts[first + plan.cycles - 1] + plan.period], axis=1)


def by_position(t: np.ndarray, x: np.ndarray, plan: Plan) -> tuple[float, np.ndarray] | None:
    """(t0, windows) from periodic velocity starts."""
    starts = velocity_starts(t, x)
    if len(starts) < plan.total:
        return None
    at = periodic_run(starts, plan.period, min(3, max(1, plan.total - 1)))
    if at is None:
        return None
    good = rectified(starts[at:], plan.total, plan.period)
    return float(good[0] - plan.start[0]), windows_of(good, plan)


def by_force(edges: np.ndarray, plan: Plan) -> tuple[float, np.ndarray] | None:
    """(t0, windows) from force edges: a periodic run, carried back while edges fit, then carried on cycle by cycle,
    each time to the nearest edge within 0.3 periods of the last start plus a period."""
    at = periodic_run(edges, plan.period) if len(edges) >= 4 else None
    if at is None:
        return None
    limit = 0.3 * plan.period
    start, earlier = edges[at], edges[:at]
    while len(earlier):
        j = int(np.argmin(np.abs(earlier - (start - plan.period))))
        if abs(earlier[j] - (start - plan.period)) > limit:
            break
        start, earlier = earlier[j], earlier[:j]
    found = [float(start)]
    for _ in range(plan.total - 1):
        want = found[-1] + plan.period
        j = int(np.argmin(np.abs(edges - want)))
        found.append(float(edges[j]) if abs(edges[j] - want) <= limit else want)
    starts = np.array(found) - plan.slow_half  # an edge is where the fast leg begins
    return float(starts[0] - plan.start[0]), windows_of(starts, plan)


def by_transitions(t: np.ndarray, x: np.ndarray, plan: Plan, t0: float, amplitude: float) -> tuple[float, np.ndarray] | None:
    """(t0, windows) from strictly alternating position reversals, two a cycle; the first K begins where the position
    last leaves its base level."""
    inside = (t >= t0) & (t <= t0 + plan.length + 2 * plan.period)
    if amplitude <= 0 or inside.sum() < 20:
        return None
    own = float(np.clip(np.subtract(*np.percentile(x[inside], [95, 5])), 0.05, 50.0))
    size = max(min(amplitude, own), 0.05)
    times, turns = peaks(t, x, size)
    keep = times >= t0 - 0.5 * plan.period
    times, turns = times[keep], turns[keep]
    up = np.flatnonzero(turns > 0)
    if not len(up):
        return None
    times, turns = times[up[0] :][: 2 * plan.total], turns[up[0] :][: 2 * plan.total]
    if len(times) < 2 * plan.total or (turns != np.tile([1, -1], plan.total)).any():
        return None
    ends = times[1::2]
    near = x[np.abs(t - ends[0]) <= 0.3]
    if len(near) < 3:
        return None
    base = float(near.min())
    threshold = min(max(0.05 * size, 0.03), 0.2 * size)
    before = np.flatnonzero((t >= min(times[0] - 60.0, t0 - plan.period)) & (t <= times[0]) & (np.abs(x - base) <= threshold))
    start = t0 + plan.start[0]
    if len(before) and before[-1] + 1 < len(t):
        i = int(before[-1])
        step = x[i + 1] - x[i]
        share = np.clip((base + threshold - x[i]) / step, 0, 1) if step else 0.5
        start = float(t[i] + share * (t[i + 1] - t[i]))
    first = plan.firsts()
    lo = np.concatenate([[start], ends[first[1:] - 1]])
    return start - float(plan.start[0]), np.stack([lo, ends[first + plan.cycles - 1]], axis=1)


@dataclass
class Anchor:
    t0: float
    windows: np.ndarray  # absolute, one row per K
    source: str


def resolve(plan: Plan, force: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], z: tuple[np.ndarray, np.ndarray], t0: float, given: bool = False, lift: float = 2.0, base_z: float | None = None, amplitude: float = 0.0) -> Anchor:
    """Where the sweep begins and which window each K has; the first of these that answers: the caller, the marker
    (refined by position reversals), periodic motion, first motion, the force's own deviation.  All but the first two
    are then checked against the force's cycles, which win if they are half a period off."""
    planned = np.stack([plan.start, plan.start + plan.duration], axis=1)
    end = force[0][-1] if len(force[0]) else -np.inf
    source, windows = ("given", None) if given else ("plan", None)
    moves = len(x[0]) >= 10 and amplitude > 0
    if not given and len(z[0]) >= 10 and (back := marker(*z, lift, base_z)) is not None:
        t0, source = back, "marker"
        refined = by_transitions(*x, plan, t0, amplitude) if moves else None
        if refined:
            (t0, windows), source = refined, "transitions"
    if source == "plan" and moves:
        found = by_position(*x, plan)
        if found and found[0] + plan.length <= end + plan.period:
            (t0, windows), source = found, "periodic"
        else:
            start = first_motion(*x, amplitude, plan.period)
            if start is not None and start - plan.start[0] + plan.length <= end + plan.period:
                t0, source = start - float(plan.start[0]), "first_motion"
    if source == "plan" and (start := burst_onset(*force, plan.period, plan.slow_half)) is not None:
        t0, source = start - float(plan.start[0]), "force"
    if source not in ("given", "marker", "transitions"):
        found = by_force(rising_edges(*force, gap=0.5 * plan.period), plan)
        if found:
            if abs(found[0] - t0) > 0.5 * plan.period:
                t0, source = found[0], "force_cycles"
            windows = found[1]
    return Anchor(t0, planned + t0 if windows is None else windows, source)


def segments(plan: Plan, anchor: Anchor, force: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], amplitude: float = 0.0) -> list[tuple[int, int, float, float, str]]:
    """(K's number, segment, rise, fall, source): from force edges where at least 0.7 of a K's cycles have them, else
    from position reversals, else from the model."""
    out = []
    times, turns = peaks(*x, amplitude) if len(x[0]) >= 10 and amplitude > 0 else (np.zeros(0), np.zeros(0, dtype=int))
    for i, (lo, hi) in enumerate(anchor.windows):
        cycles, need = int(plan.cycles[i]), max(2, int(0.7 * plan.cycles[i]))
        own = (force[0] >= lo) & (force[0] <= hi + plan.slow_half)
        t, y = force[0][own], force[1][own]
        up, down = rising_edges(t, y, 0.5 * plan.period), rising_edges(t, -y, 0.5 * plan.period)
        pairs, source = _paired(up, down), "force"
        if len(pairs) < need:
            inside = (times >= lo) & (times <= hi)
            # the fast leg ends in the far reversal; it began half a fast leg's motion before
            tops, fast = times[inside & (turns > 0)], plan.period - plan.slow_half
            pairs, source = [(a - fast, a) for a in tops.tolist()], "position"
        if len(pairs) < need:
            at = hi - cycles * plan.period + np.arange(cycles) * plan.period
            pairs, source = [(a + plan.slow_half, a + plan.period) for a in at.tolist()], "model"
        out += [(i, j, a, b, source) for j, (a, b) in enumerate(pairs[:cycles])]
    return out


def _paired(up: np.ndarray, down: np.ndarray) -> list[tuple[float, float]]:
    """Each rise with the next fall, if that comes before the next rise."""
    out = []
    for i, a in enumerate(up.tolist()):
        later = down[down > a]
        if len(later) and (i + 1 == len(up) or later[0] < up[i + 1]):
            out.append((a, float(later[0])))
    return out


def command_wave(t: np.ndarray, start: float, period: float, slow_half: float, slow: float, fast: float, accel: float) -> np.ndarray:
    """Commanded speed: slow legs, then fast ones, with ramps of at most half a leg."""
    phase = np.mod(t - start, period)
    ramp = max(min(abs(fast - slow) / max(accel, 1e-9), slow_half / 2, (period - slow_half) / 2), 1e-9)
    wave = np.where(phase < slow_half, np.maximum(slow, fast + (slow - fast) * phase / ramp), np.minimum(fast, slow + (fast - slow) * (phase - slow_half) / ramp))
    return np.where(t - start < ramp, slow, wave)


def phase_lag(force: np.ndarray, command: np.ndarray, dt: float, longest: float = 1.0) -> float:
    """Milliseconds by which force follows command: the peak of the cross-correlation of detrended, scaled signals,
    refined by a parabola; NaN if it lies at the edge."""
    n = min(len(force), len(command))
    if n < 8:
        return float("nan")

    def prepared(v: np.ndarray) -> np.ndarray:
        i = np.arange(n)
        flat = v[:n] - np.polyval(np.polyfit(i, v[:n], 1), i)
        return flat / (flat.std() + 1e-12)

    f, c = prepared(force), prepared(command)
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(f, size) * np.conj(np.fft.rfft(c, size)), size)
    most = min(int(round(longest / dt)), n - 1)
    lags = np.arange(-most, most + 1)
    corr = full[lags % size]
    i = int(np.argmax(corr))
    if i in (0, len(corr) - 1):
        return float("nan")
    a, b, d = corr[i - 1 : i + 2]
    bend = a - 2 * b + d
    shift = 0.5 * (a - d) / bend if bend else 0.0
    return float((lags[i] + np.clip(shift, -1, 1)) * dt * 1000)


def gcode_wave(grid: np.ndarray, t: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Commanded speed from a log of absolute extruder positions: constant from each line to the next, the last for 1 ms, zero elsewhere."""
    if not len(t):
        return np.zeros(len(grid))
    step = np.diff(np.concatenate([[0.0], e]))
    length = np.concatenate([np.diff(t), [1e-3]])
    speed = np.divide(step, length, out=np.zeros_like(step), where=length > 0)
    i = np.searchsorted(t, grid, side="right") - 1
    inside = (i >= 0) & (grid < (t + length)[np.maximum(i, 0)])
    return np.where(inside, speed[np.maximum(i, 0)], 0.0)
