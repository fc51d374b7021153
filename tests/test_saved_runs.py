"""Saved runs of each kind, read and analysed end to end."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import scalar
from sensorloom.operators import flow, gcode, livemap, probe
from sensorloom.plans import tables
from sensorloom.sources import runs
from sensorloom.streaming import live
from tests import generators as g


def one(x):
    return np.array([x])


def test_sweep_parameters_from_json_or_scalars(spark, tmp_path):
    base = {"force_t": np.arange(5.0), "force_y": np.ones(5), "sweep_t0": one(3.0)}
    text = json.dumps({"K_values": [0.0, 0.02], "cycles_per_K": 3, "slow_half_s": 0.4, "odd": 1})
    x = 30 + np.tile([0.0, 0.8], 100)
    old = {"k_values": np.array([0.01]), "cycles_per_K": one(4), "slow_half_s": one(0.5), "fast_half_s": one(0.25), "slow_feed_mm_s": one(0.8), "fast_feed_mm_s": one(6.0), "pos_t": np.arange(200.0), "pos_x": x}
    for name, held in (("run_1", base | {"sweep_params_json": one(text)}), ("run_2", base | old), ("run_3", base | old | {"sweep_params_json": one("{broken"), "coupled_dx_mm": one(1.5)})):
        (tmp_path / f"{name}.npz").write_bytes(runs.to_npz(held))
    info = runs.catalogue(spark, str(tmp_path))
    got = {r.run_id: r for r in runs.with_amplitude(runs.sweep_runs(info), runs.read_signals(spark, str(tmp_path))).collect()}
    a, b, c = got["run_1"], got["run_2"], got["run_3"]
    assert (a.k_values, a.cycles, a.slow_half_s, a.fast_half_s, a.first_slow_leg_factor, a.coupled_dx) == ([0.0, 0.02], 3, 0.4, 0.25, 1.0, 0.05)
    assert (b.k_values, b.cycles, b.fast_feed, b.first_slow_leg_factor) == ([0.01], 4, 6.0, 10.0) and b.coupled_dx == pytest.approx(0.8)
    assert c.coupled_dx == 1.5
    meta = {(r.run_id, r.key): r.value for r in runs.meta_rows(info).collect()}
    assert float(meta["run_1", "sweep_t0"]) == 3.0


def test_flow_run_end_to_end(spark, tmp_path):
    force, plan = g.flow_steps("x")
    held = {"force_t": force.t.to_numpy(), "force_y": force.v.to_numpy(), "min_flow_mm3_s": one(2.0), "max_flow_mm3_s": one(21.0), "settle_frac": one(0.4), "printer_model": one("COREONEINDX"), "tool_index": one(3)}
    (tmp_path / "flow_7.npz").write_bytes(runs.to_npz(held))
    params = runs.flow_runs(runs.catalogue(spark, str(tmp_path)))
    row = params.first()
    assert (row.printer_model, row.tool_index, row.dwell_s, row.step_flow, row.sweep_t0) == ("COREONEINDX", 3, 3.0, 1.0, None)
    levels = runs.flow_levels(params)
    assert [r.level for r in levels.orderBy("level_idx").collect()] == plan.level.tolist()
    _, per_run = flow.analyse_flow(runs.read_signals(spark, str(tmp_path)).where("metric = 'loadcell_value'"), levels)
    got = per_run.first()
    assert abs(got.b - 0.55) < 0.1 and got.recommended == 21.0


def test_probe_run_end_to_end(spark, tmp_path):
    force, pos = g.probe_touches("p")
    held = {"force_t": force.t.to_numpy(), "force_y": force.v.to_numpy(), "pos_y_t": pos.t.to_numpy(), "pos_y": pos.v.to_numpy(), "pos_x_t": np.arange(3.0), "pos_x": np.ones(3), "probe_axis": one("Y"), "start_y": one(100.0), "slow_feed_mm_min": one(30.0)}
    (tmp_path / "probe_7.npz").write_bytes(runs.to_npz(held))
    params, signals = runs.probe_runs(runs.catalogue(spark, str(tmp_path))), runs.read_signals(spark, str(tmp_path))
    _, verdicts = probe.analyse_probe(signals.where("metric = 'loadcell_value'"), runs.probe_position(signals, params), params)
    got = verdicts.first()
    assert got.n_contacts == 5 and abs(got.contact_pos_mean - 0.6) < 0.05 and got.verdict == "usable"
    assert tables.probe_touches(params).count() == 5


def test_map_run_without_heights_goes_by_the_way_travelled(spark, tmp_path):
    text = "G90\nM83\nG1 F1800\n" + "".join(f";LAYER_CHANGE\n;Z:{z}\nG0 X10 Y10 Z{z} F9000\n;TYPE:Perimeter\nG1 F1800\nG1 X40 Y10 E1\nG1 X40 Y40 E1\nG1 X10 Y40 E1\nG1 X10 Y10.5 E1\n" for z in (0.2, 0.4))
    moves = gcode.moves(spark.createDataFrame([("m", text)], "run_id string, text string"))
    rows = moves.where("layer >= 0").orderBy("move_idx").toPandas()
    t = np.arange(rows.t_start.iloc[0], rows.t_end.iloc[-1], 1 / 120)
    knots = np.concatenate([[rows.t_start.iloc[0]], rows.t_end])
    x, y = (np.interp(t, knots, np.concatenate([[rows[f"{a}0"].iloc[0]], rows[f"{a}1"]])) for a in "xy")
    held = {"force_t": t, "force_y": np.full(len(t), 900.0), "pos_x_t": t, "pos_x": x, "pos_y_t": t, "pos_y": y, "gcode_bytes": np.frombuffer(text.encode(), np.uint8), "attach_layer_index": one(-1), "attach_axis_z": one(np.nan)}
    (tmp_path / "livemap_1.npz").write_bytes(runs.to_npz(held))
    program = runs.read_programs(spark, str(tmp_path))
    assert [tuple(r) for r in program.select("run_id", "start_layer", "start_z").collect()] == [("livemap_1", 0, None)]
    moves = gcode.moves(program.select("run_id", "text"))
    points = livemap.on_print(runs.read_signals(spark, str(tmp_path)), moves)
    assert livemap.cross_check(points, moves).first().agreement == "good"
    mapped = livemap.map_runs(runs.read_signals(spark, str(tmp_path)), moves)
    counts = {r.layer: r.n for r in livemap.layer_counts(mapped, moves).collect()}
    assert set(counts) == {0, 1} and min(counts.values()) > 100


def test_breaks_at_holes_that_hide_a_turn(spark):
    """Two lines 0.4 apart, run through at 40 mm/s; the hole of 30 ms hides the turn, or lies on a line."""
    def run(name, hole):
        way = np.arange(0, 40.4, 0.2)
        keep = ~((way > hole) & (way < hole + 1.2))
        x = np.where(way < 20, way, np.where(way < 20.4, 20, 40.4 - way))
        y = np.where(way < 20, 0, np.where(way < 20.4, way - 20, 0.4))
        return pd.DataFrame({"run_id": name, "seq": np.arange(len(way)), "t": way / 40, "x": x, "y": y, "snap_s": way})[keep].assign(idx=lambda d: np.arange(len(d)))

    points = spark.createDataFrame(pd.concat([run("turn", 19.5), run("line", 9.5), run("left out", 9.5).assign(idx=lambda d: d.idx + (d.t > 0.3))]))
    got = livemap.line_breaks(points).where("is_break").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"turn": 2, "line": 1, "left out": 2}


def test_written_runs_read_back(spark, tmp_path):
    streams = pd.concat([g.signal("r1", "loadcell_value", [2.0, 1.0], [5.0, 4.0]), g.signal("r1", "pos_z", [1.0], [0.5]), g.signal("r2", "loadcell_value", [1.0], [9.0])])
    scalars = spark.createDataFrame([("r1", 0.5, [1.0, 2.0]), ("r2", None, None)], "run_id string, dwell_s double, flow_levels array<double>")
    runs.write_runs(spark.createDataFrame(streams, g.SIGNAL), scalars, str(tmp_path / "out"), "flow")
    got = runs.read_written(spark, str(tmp_path / "out")).orderBy("run_id", "metric", "seq").collect()
    assert [(r.kind, r.run_id, r.metric, r.t, r.v) for r in got] == [("flow", "flow_r1", "loadcell_value", 1.0, 4.0), ("flow", "flow_r1", "loadcell_value", 2.0, 5.0), ("flow", "flow_r1", "pos_z", 1.0, 0.5), ("flow", "flow_r2", "loadcell_value", 1.0, 9.0)]


def test_sheets_refuse_odd_lengths(spark, tmp_path):
    (tmp_path / "run_1.npz").write_bytes(runs.to_npz({"force_t": np.arange(5.0), "force_y": np.arange(4.0)}))
    (tmp_path / "run_2.npz").write_bytes(runs.to_npz({"force_t": np.arange(5.0), "force_y": np.arange(5.0), "sweep_t0": one(1.0)}))
    odd, signals = runs.lengths_that_differ(spark, str(tmp_path)), runs.read_signals(spark, str(tmp_path))
    assert [tuple(r) for r in odd.collect()] == [("run_1", "loadcell_value", 5, 4)]
    with pytest.raises(ValueError, match="5 times and 4 values"):
        runs.write_sheets(signals, str(tmp_path / "sheets"), odd=odd)
    runs.write_sheets(signals.where("run_id = 'run_2'"), str(tmp_path / "sheets"), meta=runs.meta_rows(runs.catalogue(spark, str(tmp_path))), odd=odd.where("run_id = 'run_2'"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets/streams")).count() == 5
    assert ("run_2", "sweep_t0", "1.0") in [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "sheets/meta")).collect()]


def test_weights_file(spark, tmp_path):
    path = str(tmp_path / "w")
    assert runs.read_weights(spark, path) is None
    runs.write_weights(spark, {"weights": {"overshoot": 4.0, "tail_area": 1.0}, "alpha": 0.1}, path)
    held = runs.read_weights(spark, path)
    assert held["weights"] == {"overshoot": 1.0, "tail_area": 0.25} and held["alpha"] == 0.1
    (tmp_path / "bad").write_text("[1]")
    assert runs.read_weights(spark, str(tmp_path / "bad")) is None
    table = {r.metric: r.weight for r in runs.weights_table(spark, {"overshoot": 2.0, "rise_delay": 1.0}, held["weights"]).collect()}
    assert table == {"overshoot": 1.0, "rise_delay": 1.0, "tail_area": 0.25}


def test_unknown_models_and_tools_are_errors(spark):
    df = spark.range(1)
    assert df.select(scalar.printer_model(F.lit(None).cast("string")), scalar.tool_index(F.lit("COREONE"), F.lit(12))).first()[:] == ("COREONE", 12)
    for bad in (scalar.printer_model(F.lit("MK4")), scalar.printer_model(F.lit("core-one")), scalar.tool_index(F.lit("COREONEINDX"), F.lit(8)), scalar.tool_index(F.lit("COREONE"), F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="unknown printer model|no such tool"):
            df.select(bad).collect()


def test_live_frames(spark, tmp_path):
    rows = pd.DataFrame({"metric": ["a"] * 150 + ["b"] * 3 + ["a"], "t": [*map(float, range(150)), 1.0, 1.0, 0.0, None], "v": [float(i) for i in range(154)]})
    got = {(r.metric, r.frame): r for r in live.frames(spark.createDataFrame(rows)).collect()}
    assert {k: r.n for k, r in got.items()} == {("a", 0): 64, ("a", 1): 64, ("a", 2): 22, ("b", 0): 3}
    assert [s.v for s in got["b", 0].samples] == [152.0, 150.0, 151.0]
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("metric string, t double, v double").parquet(str(tmp_path / "in"))
    query = live.send(stream, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 153
