"""The follower of layers: where it begins, how it rises, and what a reported height overrides."""

import numpy as np
import pandas as pd
import pytest

from sensorloom.streaming import tracker

SQUARE = [(0.0, 0.0, 30.0, 0.0), (30.0, 0.0, 30.0, 30.0), (30.0, 30.0, 0.0, 30.0), (0.0, 30.0, 0.0, 0.0)]
SCHEMA = "run_id string, t double, x double, y double, z double, reported double, zs array<double>, path array<array<double>>, box array<double>, start_layer int, seeded boolean"


def follower(**more):
    return tracker.Follower(tracker.Plan([0.2, 0.4, 0.6, 0.8], np.array(SQUARE), (0.0, 30.0, 0.0, 30.0)), **more)


def around(t, speed=40.0):
    """A place on the square."""
    s = t * speed % 120
    k, r = divmod(s, 30)
    return ((r, 0.0), (30.0, r), (30 - r, 30.0), (0.0, 30 - r))[int(k)]


def feed(f, t0, t1, z, place=around, rate=78, junk=0):
    seen = []
    for k, t in enumerate(np.arange(t0, t1, 1 / rate)):
        x, y = place(t)
        f.move(t, x, y, 168.0 if junk and k % junk == 0 else z)
        seen.append(f.layer)
    return seen


def test_a_staircase_with_junk_and_an_offset():
    """40 s, a constant of 0.1, and a quarter of all heights at 168."""
    f = follower()
    seen = feed(f, 0, 20, 0.3, junk=4) + feed(f, 20, 40, 0.5, junk=4)
    assert f.offset == pytest.approx(0.1) and f.layer == 1 and max(seen) == 1
    begun, risen = seen.index(0) / 78, seen.index(1) / 78
    assert 0.35 <= begun < 1.0 and 21.5 <= risen < 23


def test_only_the_path_begins_a_print():
    away, wiping = lambda t: (15.0, 15.0 + t % 1), lambda t: (-60.0, 3.0)
    f = follower()
    assert set(feed(f, 0, 10, 0.2, away)) == {-1} and set(feed(f, 10, 20, 0.4, wiping)) == {-1}
    assert set(feed(f, 20, 25, 0.2, lambda t: around(t, 200.0))) == {-1}  # too fast
    assert set(feed(f, 25, 30, 0.2, lambda t: (0.0, 5.0))) == {-1}  # no way
    assert feed(f, 30, 32, 0.2)[-1] == 0


def test_hops_wipes_and_jumps_do_not_rise():
    f = follower()
    feed(f, 0, 3, 0.2)
    feed(f, 3, 4.2, 0.46)  # a hop of 1.2 s
    assert f.layer == 0
    feed(f, 4.2, 7, 0.2)
    feed(f, 7, 12, 0.4, lambda t: (-60.0, 3.0))  # outside of the print
    assert f.layer == 0
    feed(f, 12, 20, 0.8)  # three layers at once
    assert f.layer == 0
    feed(f, 20, 26, 0.4)
    assert f.layer == 1
    feed(f, 26, 32, 0.2)  # never back by measured heights
    assert f.layer == 1


def test_reports_override_and_take_back():
    f = follower()
    assert f.report(0.0, 0.2) is None  # not begun
    feed(f, 1, 3, 0.2)
    feed(f, 3, 8, 0.4)
    assert f.layer == 1
    said = [f.report(8 + k / 2, 0.2) for k in range(5)]
    assert said == [None, None, "reported", None, None] and f.layer == 0
    feed(f, 10, 13.9, 0.4)  # reports are fresh: measured heights don't count
    assert f.layer == 0
    assert [f.report(14 + k, 0.46) for k in range(4)] == [None] * 4 and [f.report(18 + k, 0.8) for k in range(4)] == [None] * 4 and f.layer == 0
    assert f.report(22, 0.4) is None and f.report(22.5, 0.46) is None and f.report(23.5, 0.4) is None and f.report(24.6, 0.4) == "reported" and f.layer == 1
    feed(f, 40, 46, 0.6)  # no report for more than four seconds
    assert f.layer == 2


def test_joined_midway_and_seeded():
    f = follower(start=2)
    assert set(feed(f, 0, 5, 0.2, lambda t: (-60.0, 3.0))) == {-1}
    feed(f, 5, 6, 0.7)
    assert (f.layer, f.offset) == (2, pytest.approx(0.1))
    f = follower(seeded=True)
    assert set(feed(f, 0, 3, 0.2)) == {-1}
    assert [f.report(4 + k, 0.6) for k in range(2)] == [None, "reported"] and f.layer == 2 and f.offset is None
    feed(f, 20, 30, 0.8)  # without an offset, reports alone decide
    assert f.layer == 2


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for run in ("a", "b"):
        for t in np.arange(0, 14, 1 / 60):
            x, y = around(t)
            rows.append((run, float(t), x, y, 0.3 + 0.2 * (t > 6) + float(rng.normal(0, 0.01)), None))
        rows += [(run, 10.2 + k / 3, None, None, None, 0.2) for k in range(6 if run == "b" else 0)]
    pdf = pd.DataFrame(rows, columns=["run_id", "t", "x", "y", "z", "reported"]).sort_values("t")
    full = lambda some: spark.createDataFrame([(*r, [0.2, 0.4, 0.6], [list(s) for s in SQUARE], [0.0, 30.0, 0.0, 30.0], None, False) for r in some.replace({np.nan: None}).itertuples(index=False, name=None)], SCHEMA)
    want = sorted(tuple(r) for r in tracker.follow_batch(full(pdf)).select("run_id", "t", "layer", "decided").na.fill("").collect())
    assert {(r[0], r[3]) for r in want if r[3]} == {("a", "path"), ("a", "height"), ("b", "path"), ("b", "height"), ("b", "reported")}
    folder = str(tmp_path / "in")
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), 4)):
        full(pdf.iloc[part]).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = tracker.follow_stream(source).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("followed").select("run_id", "t", "layer", "decided").na.fill("").collect()) == want
