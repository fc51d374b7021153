"""Force placed by positions: against a plain rule, and on a stream with late and disordered rows."""

import numpy as np
import pandas as pd

from sensorloom.streaming import placement

FORCE = "run_id string, seq long, t double, v double"
POS = "run_id string, axis string, t double, v double"


def plain(force, pos, reach):
    def at(run, axis, t):
        own = sorted((p[2], p[3]) for p in pos if p[0] == run and p[1] == axis)
        back = [p for p in own if t - reach <= p[0] <= t]
        ahead = [p for p in own if t < p[0] <= t + reach]
        if not back:
            return ahead[0][1] if ahead else None
        t0 = back[-1][0]
        v0 = min(v for u, v in back if u == t0)
        if not ahead or t0 == t:
            return v0
        return v0 + (ahead[0][1] - v0) * (t - t0) / (ahead[0][0] - t0)

    found = [(*f, at(f[0], "x", f[2]), at(f[0], "y", f[2])) for f in force]
    return sorted(((r, s, t, v, round(x, 9), round(y, 9)) for r, s, t, v, x, y in found if x is not None and y is not None), key=repr)


def rows(df):
    return sorted(((r.run_id, r.seq, r.t, r.v, round(r.x, 9), round(r.y, 9)) for r in df.collect()), key=repr)


def signals(seed=3, seconds=40, since=100.0):
    rng = np.random.default_rng(seed)
    force, pos = [], []
    for run in ("a", "b"):
        ts = np.sort(since + rng.uniform(0, seconds, 40 * seconds)).round(4)
        force += [(run, i, float(t), float(np.sin(t))) for i, t in enumerate(ts)]
        for axis in "xy":
            up = np.sort(since + rng.uniform(0, seconds, 12 * seconds)).round(4)
            pos += [(run, axis, float(t), float(5 * np.cos(t / 3))) for t in up if not since + 11 < t < since + 14]  # a hole wider than the reach
    return force, pos


def test_like_the_plain_rule(spark):
    force, pos = signals(seconds=20)
    got = rows(placement.placed(spark.createDataFrame(force, FORCE), spark.createDataFrame(pos, POS), 0.4, 1.5))
    assert got == plain(force, pos, 0.4) and 0 < len(got) < len(force)


def test_edges(spark):
    nan = float("nan")
    force = [("a", 1, 1.0, None), ("a", 1, 1.0, None), ("a", 2, None, 3.0), ("a", 3, nan, 3.0), (None, 4, -0.2, 4.0), ("z", 5, 1.0, 5.0), ("a", 6, 1.5, 6.0)]
    pos = [("a", "x", 1.0, 7.0), ("a", "x", 1.0, 5.0), ("a", "x", 1.2, None), ("a", "x", 1.4, nan), ("a", "y", 0.7, 1.0), ("a", "y", 1.3, 3.0), ("a", "y", None, 9.0), ("a", "e", 1.0, 9.0), (None, "x", 0.1, 2.0), (None, "y", -0.5, 1.0), ("z", "x", 1.0, 1.0), ("a", None, 1.0, 1.0)]
    f, p = spark.createDataFrame(force, FORCE), spark.createDataFrame(pos, POS)
    got = rows(placement.placed(f, p.selectExpr("*", "1 as seq", "2 as x"), 0.5))
    assert got == [("a", 1, 1.0, None, 5.0, 2.0), ("a", 1, 1.0, None, 5.0, 2.0), ("a", 6, 1.5, 6.0, 5.0, 3.0), (None, 4, -0.2, 4.0, 2.0, 1.0)]
    assert rows(placement.placed(f.limit(0), p)) == [] == rows(placement.placed(f, p.limit(0)))


def test_stream_like_the_table(spark, tmp_path):
    """Rows come up to 4 s late and out of order in eight files a side; the last ones move both streams on."""
    force, pos = signals()
    rng = np.random.default_rng(9)
    end = 1e4
    tail_f, tail_p = [("end", 0, end, 0.0)], [("end", a, end, 0.0) for a in "xy"]
    for name, data, columns, tail in (("f", force, FORCE, tail_f), ("p", pos, POS, tail_p)):
        (tmp_path / name).mkdir()
        cols = [c.split()[0] for c in columns.split(", ")]
        at = np.array([r[2] for r in data]) + rng.uniform(0, 4, len(data))  # arrival
        order = np.argsort(at)
        for i in range(8):
            part = [data[k] for k in order[i * len(data) // 8 : (i + 1) * len(data) // 8]]
            pd.DataFrame(part, columns=cols).to_parquet(tmp_path / name / f"{i}.parquet")
        pd.DataFrame(tail, columns=cols).to_parquet(tmp_path / name / "9.parquet")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = placement.placed(read("f", FORCE), read("p", POS), 0.4, 1.0, late=10.0)
    q = out.writeStream.format("memory").queryName("placed_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r for r in rows(spark.table("placed_rows")) if r[0] != "end"]
    want = rows(placement.placed(spark.createDataFrame(force, FORCE), spark.createDataFrame(pos, POS), 0.4))
    assert got == want == plain(force, pos, 0.4)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"]) == 0
