"""Lags by blocks against the correlation of whole signals."""

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import cells, detectors, phase


@pytest.mark.parametrize("block", [16, 8192])
def test_lags_like_whole_signals(spark, monkeypatch, block):
    monkeypatch.setattr(phase, "BLOCK", block)
    rng = np.random.default_rng(12)
    frames, want = [], {}
    for run, n, lag in (("late", 300, 7), ("early", 203, -4), ("edge", 90, 20), ("short", 6, 0), ("ten", 10, 1), ("flat", 40, 0)):
        base = np.convolve(rng.normal(size=n + 80), np.ones(5) / 5, "same")
        c = base[40 : 40 + n] + 0.05 * np.arange(n)
        f = base[40 - lag : 40 - lag + n] * 3 - 0.2 * np.arange(n) + rng.normal(0, 0.01, n)
        if run == "flat":
            c = np.zeros(n)
        frames.append(pd.DataFrame({"run": run, "k": np.arange(n) * 3, "f": f, "c": c}))
        want[run] = (detectors.phase_lag(f, c, 0.01, 0.2), ((f[1:] - f.mean()) * np.sign(np.diff(c))).sum() * 0.01, n)
    df = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=3))
    got = {r.run: r for r in phase.phase_lags(df, ["run"], ["k"], "f", "c", 0.01, 0.2).collect()}
    assert got.keys() == want.keys()
    for run, (lag, area, n) in want.items():
        assert got[run].n == n and got[run].area == pytest.approx(area)
        if run != "flat":
            assert got[run].phase_lag_ms == (None if np.isnan(lag) else pytest.approx(lag, abs=1e-6)), run
    assert got["late"].phase_lag_ms == pytest.approx(70, abs=5) and got["early"].phase_lag_ms == pytest.approx(-40, abs=5) and got["edge"].phase_lag_ms is None


def test_no_rows(spark):
    assert phase.phase_lags(spark.createDataFrame([], "run string, k long, f double, c double"), ["run"], ["k"], "f", "c", 0.01).count() == 0
    assert cells.BLOCK > 0
