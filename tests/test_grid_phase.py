"""Scores of grid shifts against sums over each shift's measured parts."""

import numpy as np

from sensorloom.operators import flow

GRID = "run_id string, t_start double, width double, settle double, clean int"


def test_scores_like_sums_over_windows(spark):
    rng = np.random.default_rng(5)
    grids = [("a", 10.0, 3.0, 0.4, 5), ("b", -2.0, 0.7, 0.95, 3), (None, 0.0, 1.0, 0.01, 4), ("idle", 0.0, 1.0, 0.5, 3)]
    rises = []
    for run, start, width, _, clean in grids[:3]:
        ts = start + rng.integers(-2_000_000, int((clean + 2) * 1e6), 400) / 1e6 * width  # also before, after and on edges
        ts[:40] = start + np.arange(40) * width / 20
        rises += [(run, float(t), float(g)) for t, g in zip(ts, rng.integers(1, 10**9, 400) / 1e6)]
    rises.append(("stray", 1.0, 1.0))
    got = {(r.run_id, r.shift): (r.delta, r.score) for r in flow.shift_scores(spark.createDataFrame(rises, "run_id string, t double, g double"), spark.createDataFrame(grids, GRID)).collect()}
    assert len(got) == 3 * 121  # rows without a run take no part
    for run, start, width, settle, clean in (grids[0], grids[1], grids[3]):
        w, s = round(width * 1e6), round(settle * width * 1e6)
        for j in range(121):
            want = 0.0
            for r, t, g in rises:
                x = 120 * round((t - start) * 1e6) + (60 - j) * w
                if r == run and 0 <= x < 120 * clean * w and x % (120 * w) >= 120 * s:
                    want += g
            delta, score = got[run, j]
            assert abs(score - want) < 1e-4 and abs(delta - width * (j / 120 - 0.5)) < 1e-12


def test_empty(spark):
    none = spark.createDataFrame([], "run_id string, t double, g double")
    assert flow.shift_scores(none, spark.createDataFrame([], GRID)).count() == 0
    rows = flow.shift_scores(none, spark.createDataFrame([("a", 0.0, 1.0, 0.5, 3)], GRID)).collect()
    assert len(rows) == 121 and {r.score for r in rows} == {0.0}
