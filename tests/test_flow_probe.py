import pandas as pd

from sensorloom.operators import flow, probe
from tests import generators as g


def test_flow_breakdown(spark):
    runs = [g.flow_steps("soft", dev=14.0, var=15.0), g.flow_steps("none"), g.flow_steps("drop", collapse=19.0)]
    force = spark.createDataFrame(pd.concat([r[0] for r in runs]), g.SIGNAL)
    levels = spark.createDataFrame(pd.concat([r[1] for r in runs]))
    per_level, per_run = flow.analyse_flow(force, levels)
    rows = per_run.toPandas().set_index("run_id")
    assert ((rows.t_start - 40).abs() < 1.5).all(), rows.t_start
    assert abs(rows.loc["none"].b - 0.55) < 0.1 and rows.loc["none"].r2 > 0.99
    assert rows.loc["none"].recommended == 21.0
    assert 14 <= rows.loc["soft"].deviation_level <= 20 and 15 <= rows.loc["soft"].variance_onset <= 18
    assert rows.loc["drop"].collapse_level == 19.0
    assert abs(per_level.where("run_id = 'none'").toPandas().tare - 1500).max() < 2


def test_power_law_recovers_its_parameters(spark):
    q = pd.DataFrame({"run_id": "a", "q": [float(i) for i in range(1, 15)]})
    q["y"] = 3 * q.q**0.55 + 4
    row = flow.power_law(spark.createDataFrame(q), ["run_id"], "q", "y").first()
    assert abs(row.b - 0.55) < 1e-3 and abs(row.a - 3) < 0.02 and abs(row.c - 4) < 0.02 and row.r2 > 0.999999


def test_probe_contact_and_flat(spark):
    one, flat = g.probe_touches("hit"), g.probe_touches("flat", stiffness=0.0)
    force = spark.createDataFrame(pd.concat([one[0], flat[0]]), g.SIGNAL)
    pos = spark.createDataFrame(pd.concat([one[1], flat[1]]), g.SIGNAL)
    runs = spark.createDataFrame(pd.DataFrame([dict(run_id=r, standoff=100.0, dir_sign=1, creep_mm=1.0, slow_mm_s=0.5, n_touches=5) for r in ("hit", "flat", "gone")]))
    _, per_run = probe.analyse_probe(force, pos, runs)
    rows = per_run.toPandas().set_index("run_id")
    hit = rows.loc["hit"]
    assert hit.n_contacts == 5 and abs(hit.contact_pos_mean - 0.6) < 0.05 and hit.contact_pos_std < 0.02 and hit.snr > 20 and hit.verdict == "usable"
    assert rows.loc["flat"].n_contacts == 0 and rows.loc["flat"].verdict == "no clear signal"
    assert rows.loc["gone"].verdict == "no creeps detected"
