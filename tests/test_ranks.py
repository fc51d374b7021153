"""Exact percentiles by selection, against numpy, with cells small enough that several rounds are needed."""

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import ranks, robust


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 5)
    monkeypatch.setattr(ranks, "BUCKETS", 4)


def check(spark, groups, wanted):
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", wanted, "n").collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = np.array([x for x in xs if x == x])
        assert got[g].n == len(xs)
        for k, p in wanted.items():
            if len(xs) == 0:
                assert got[g][k] is None
            else:
                assert got[g][k] == pytest.approx(np.percentile(xs, 100 * p), rel=1e-12, abs=1e-300), (g, k)


def test_odd_distributions_in_many_rounds(spark, tiny):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=400),
        "ties": rng.integers(0, 3, 300),
        "one value": [7.5] * 50,
        "single": [3.0],
        "outliers": [*rng.normal(size=200), 1e300, -1e300, 1e12],
        "huge": [1.7e308, -1.7e308, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
        "missing": [float("nan"), float("nan")],
        "partly": [float("nan"), *range(30)],
        "close": 1 + np.arange(40) * 2.0**-52,
    }
    check(spark, groups, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p999": 0.999, "least": 0.0, "most": 1.0})


def test_null_keys_no_keys_and_nothing(spark, tiny):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", 4.0)], "g string, v double")
    assert {r.g: r.median for r in ranks.median(df, ["g"], "v").collect()} == {None: 1.5, "a": 4.0}
    assert [r.median for r in ranks.median(df, [], "v").collect()] == [2.0]
    assert ranks.median(df.where("v > 9"), ["g"], "v").count() == 0


def test_deviations(spark, tiny):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 600), "v": rng.normal(size=600)})
    got = {r.k: r for r in robust.mad(spark.createDataFrame(pdf), ["k"], "v").collect()}
    for k, xs in pdf.groupby("k").v:
        mid = np.median(xs)
        assert got[k].n == len(xs) and got[k].median == pytest.approx(mid) and got[k].mad == pytest.approx(1.4826 * np.median(np.abs(xs - mid)))
        assert got[k].iqr == pytest.approx(np.percentile(xs, 75) - np.percentile(xs, 25))
