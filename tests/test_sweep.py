import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import detectors as d
from sensorloom.operators import sweep
from sensorloom.plans import tables
from tests import generators as g


def plan_of(k=5, cycles=4, slow=0.4, fast=0.4, dwell=0.0):
    period = slow + fast
    start = 0.5 + np.arange(k) * (cycles * period + dwell)
    return d.Plan(np.arange(k) * 0.01, start, np.full(k, cycles * period), np.full(k, cycles), period, slow)


def test_phase_lag_of_a_delayed_wave():
    t = np.arange(0, 8, 1e-3)
    wave = d.command_wave(t, 0.0, 0.8, 0.4, 0.8, 8.0, 5000.0)
    for delay in (-0.03, 0.0, 0.05):
        delayed = d.command_wave(t - delay, 0.0, 0.8, 0.4, 0.8, 8.0, 5000.0)
        assert abs(d.phase_lag(delayed, wave, 1e-3) - delay * 1000) < 2.0


def test_edges_and_force_windows():
    plan = plan_of()
    t = np.arange(0, 25, 1 / 200)
    rng = np.random.default_rng(0)
    t0 = 3.0
    inside = (t >= t0 + 0.5) & (t < t0 + 0.5 + plan.total * 0.8)
    y = 100 + rng.normal(0, 2, len(t)) + np.where(inside & (((t - t0 - 0.5) % 0.8) >= 0.4), 1000, 0)
    got = d.resolve(plan, (t, y), (np.zeros(0), np.zeros(0)), (np.zeros(0), np.zeros(0)), 0.0)
    assert got.t0 == pytest.approx(t0, abs=0.05)
    assert got.windows[0, 0] == pytest.approx(t0 + 0.5, abs=0.05) and got.windows[-1, 1] == pytest.approx(t0 + plan.length, abs=0.1)
    found = d.segments(plan, got, (t, y), (np.zeros(0), np.zeros(0)))
    assert len(found) == plan.total and all(b - a == pytest.approx(0.4, abs=0.03) for _, _, a, b, _ in found)


def test_reversals_alternate():
    t = np.arange(0, 10, 0.01)
    x = np.abs((t % 2) - 1)
    times, turns = d.peaks(t, x, 1.0)
    assert (np.diff(turns) != 0).all() and np.allclose(times, np.round(times), atol=0.02)


def test_marker_returns():
    t = np.arange(0, 10, 0.02)
    z = np.full(len(t), 5.0)
    z[(t > 4) & (t < 4.6)] = 7.0
    assert d.marker(t, z, 2.0, 5.0) == pytest.approx(4.6, abs=0.05)
    assert d.marker(t, np.full(len(t), 5.0)) is None


def test_rectified_fills_and_drops():
    assert np.allclose(d.rectified(np.array([0.0, 1.0, 1.2, 3.0]), 6, 1.0), [0, 1, 2, 3, 4, 5])


def test_command_from_log():
    grid = np.array([0.5, 1.5, 2.5, 5.0])
    assert np.allclose(d.gcode_wave(grid, np.array([1.0, 2.0, 3.0]), np.array([2.0, 5.0, 5.0])), [0, 2.0, 3.0, 0])


def test_sweep_end_to_end(spark):
    """The planted best K comes out of the composite cost, from force alone."""
    force, _ = g.step_response(best=0.030, ks=11, cycles=6)
    runs = spark.createDataFrame(pd.DataFrame([dict(run_id="r", k_values=[round(i * 0.005, 4) for i in range(11)], slow_half_s=0.8, fast_half_s=0.8, cycles=6, first_slow_leg_factor=1.0, dwell_s=0.0, sweep_t0=9.0, slow_feed=0.8, fast_feed=8.0, accel=5000.0)]))
    plan = tables.sweep_segments(runs)
    got = sweep.analyse_sweep(spark.createDataFrame(force, g.SIGNAL), plan, runs)
    ks = got["per_k"].toPandas()
    assert len(ks) == 11 and ks.keep.all()
    est = got["estimates"].toPandas().set_index("method").k_opt
    assert abs(est["composite_cost"] - 0.030) < 0.010


def test_reversals_like_a_plain_scan():
    """Sample by sample: a direction once the start is left by the deadband, then the extremum behind each turn."""
    rng = np.random.default_rng(6)
    for trial in range(60):
        n = int(rng.integers(2, 300))
        t = np.arange(n) / 50
        x = np.cumsum(rng.normal(0, 0.2, n)) * (0.01 if trial % 10 == 0 else 1)
        size = float(np.subtract(*np.percentile(x, [95, 5])))
        want, way, far = [], 0, 0
        dead = max(0.3 * size, 0.02)
        for i in range(n if n >= 5 and size >= 0.05 else 0):
            gain = (x[i] - x[far]) * (way or 1)
            if way == 0 and abs(gain) > dead:
                way, far = (1 if gain > 0 else -1), i
            elif way and gain > 0:
                far = i
            elif way and gain < -dead:
                want.append((t[far], way))
                way, far = -way, i
        times, turns = d.peaks(t, x)
        assert list(zip(times.tolist(), turns.tolist())) == want
    assert len(d.peaks(np.arange(100) / 50, 0.045 * (np.arange(100) % 2))[0]) == 0
