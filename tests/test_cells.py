"""Scans and frames by cells against plain loops, with cells and blocks of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import cells, series


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rng = np.random.default_rng(8)
    data = [(g, k, None if rng.random() < 0.2 else float(rng.integers(-9, 9)), float(rng.normal())) for g, n in (("a", 150), ("b", 1), (None, 40), ("c", 23)) for k in range(n)]
    yield spark.createDataFrame(data, "g string, k long, v double, x double").repartition(3), data
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def series_of(data):
    out = {}
    for g, k, v, x in data:
        out.setdefault(g, []).append((k, v, x))
    return out


def test_scans(rows):
    df, data = rows
    at = cells.dealt(df, ["g"], ["k"])
    assert at.select("_cell").distinct().count() > 3
    got = {(r.g, r.k): r for r in cells.scan(at, ["g"], ["k"], {"s": F.col("v")}, {"h": F.col("v")}, {"l": F.col("v")}, {"p": F.col("v")}).collect()}
    places = {(r.g, r.k): r._place for r in cells.placed(at, ["g"], ["k"]).collect()}
    assert len(got) == len(data)
    for g, own in series_of(data).items():
        held, before = [], None
        for i, (k, v, _) in enumerate(own):
            r = got[g, k]
            held += [v] if v is not None else []
            assert (r.s, r.h, r.l) == ((sum(held), max(held), held[-1]) if held else (None, None, None)) and r.p == before and places[g, k] == i
            before = v


@pytest.mark.parametrize("before, after", [(0, 0), (3, 5), (20, 1), (0, 30), (200, 200)])
def test_frames(rows, before, after):
    df, data = rows
    at = cells.placed(cells.dealt(df, ["g"], ["k"]), ["g"], ["k"])
    got = {(r.g, r.k): (r.n, r.m) for r in cells.framed(at, ["g"], before, after, {"n": lambda w: F.count("*").over(w), "m": lambda w: F.max("x").over(w)}).collect()}
    assert len(got) == len(data)
    for g, own in series_of(data).items():
        for i, (k, _, _) in enumerate(own):
            frame = [x for _, _, x in own[max(0, i - before) : i + after + 1]]
            assert got[g, k] == (len(frame), max(frame))


def test_rolling_median_and_path(rows):
    df, data = rows
    got = {(r.g, r.k): r for r in series.arc_length(series.rolling_median(df, ["g"], ["k"], "x", 9, "m"), ["g"], ["k"], "x", "m", "s").collect()}
    for g, own in series_of(data).items():
        x = np.array([p[2] for p in own])
        padded = np.concatenate([[x[0]] * 4, x, [x[-1]] * 4])
        m = np.array([np.median(padded[i : i + 9]) for i in range(len(x))])
        s = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(m)))])
        for i, (k, _, _) in enumerate(own):
            assert got[g, k].m == m[i] and got[g, k].s == pytest.approx(s[i])


def test_monotone_times(spark, rows):
    _, data = rows
    df = spark.createDataFrame([(g, k, int(v or 0) + k // 3) for g, k, v, _ in data], "g string, k long, us long")
    got = {(r.g, r.k): r.t for r in cells.monotone_times(df, ["g"], ["k"], "us", "t").collect()}
    for g, own in series_of(data).items():
        last = None
        for k, v, _ in own:
            us = int(v or 0) + k // 3
            last = last + 1 if last is not None and us <= last else us
            assert got[g, k] == last
    assert cells.monotone_times(df.limit(0), ["g"], ["k"], "us", "t").count() == 0


def test_clock_with_wraps_and_restarts(spark, rows):
    rng = np.random.default_rng(2)
    ticks = np.concatenate([np.arange(40) * 20, np.arange(60) * 7]) % 256
    recv = np.arange(100) * 1.0 + rng.random(100)
    df = spark.createDataFrame([("p", i, int(c), float(r)) for i, (c, r) in enumerate(zip(ticks, recv))], "g string, k long, c long, r double")
    got = sorted(series.clock_offset(df, ["g"], ["k"], "c", "r", 0.05, window=10, wrap=256).collect(), key=lambda r: r.k)
    epoch = turns = 0
    delays = []
    for i, r in enumerate(got):
        back = int(ticks[i - 1] - ticks[i]) if i else 0
        if back > 128:
            turns += 1
        elif back > 0:
            epoch, turns, delays = epoch + 1, 0, []
        whole = int(ticks[i]) + 256 * turns
        delays.append(recv[i] - whole * 0.05)
        assert (r.epoch, r.unwrapped) == (epoch, whole) and r.offset == pytest.approx(min(delays[-10:])) and r.emit == pytest.approx(whole * 0.05 + min(delays[-10:]))
    assert got[-1].epoch > 0
