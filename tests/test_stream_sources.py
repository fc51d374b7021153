import socket

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import optimiser
from sensorloom.sources import runs, udp
from sensorloom.streaming import layers, retime

PACKETS = "printer string, packet long, line_no int, name string, off_us long, fw_seq long, fw_tm long, recv double, v double"


def packets(n=40):
    jitter = [0.005, 0.001, 0.003, 0.0, 0.002]
    rows = []
    for i in range(n):
        for line in range(3):
            rows.append(("p", i, line, "load", -2000 + line * 1000, 10 + i + (3 if i >= 30 else 0), int(4_294_000_000 + i * 100_000) % (1 << 32), 50 + i * 0.1 + jitter[i % 5], float(i)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKETS.split(", ")])


def test_clock_unit_wrap_and_loss(spark):
    got = retime.retime_batch(spark.createDataFrame(packets(), PACKETS)).toPandas().sort_values("t")
    assert got.lost.sum() == 3 and set(got.how) == {"offsets", "clock"}
    clock = got[(got.how == "clock") & (got.line_no == 2)]
    assert np.allclose(np.diff(clock.t), 0.1, atol=1e-5) and (np.diff(got.t) > 0).all()


def test_stream_equals_batch(spark, tmp_path):
    rows = packets()
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[rows.packet < 15], rows[rows.packet >= 15])):
        part.astype({"line_no": "int32"}).to_parquet(tmp_path / "in" / f"part-{k}.parquet")
    source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = retime.retime_stream(source).writeStream.format("memory").queryName("retimed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    live = spark.table("retimed").toPandas().sort_values(["packet", "line_no"]).reset_index(drop=True)
    batch = retime.retime_batch(spark.createDataFrame(rows, PACKETS)).toPandas().sort_values(["packet", "line_no"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(live, batch)
    rates = retime.rates(spark.createDataFrame(batch)).toPandas()
    assert rates.n.sum() == 120 and rates.lost.sum() == 3


def test_layers_rise_one_by_one():
    tracker = layers.Tracker([0.2, 0.4, 0.6])
    got = [tracker.add(i / 50, 5.0 + (0.2 if i < 400 else 0.4 if i < 800 else 0.6)) for i in range(1200)]
    assert got[0] == -1 and got[30] == 0 and got[399] == 0 and got[600] == 1 and got[-1] == 2
    assert tracker.offset == pytest.approx(5.0)


def test_udp_reader():
    reader = udp.PacketReader({"host": "127.0.0.1", "port": "0", "waitSeconds": "0.3"})
    port = reader.socket.getsockname()[1]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(f"m v={i}".encode(), ("127.0.0.1", port))
    rows, end = reader.read(reader.initialOffset())
    assert [r[2] for r in rows] == [b"m v=0", b"m v=1", b"m v=2"] and end == {"packet": 3}
    assert len(list(reader.readBetweenOffsets({"packet": 1}, end))) == 2
    reader.commit(end)
    assert not reader.kept


def test_npz_round_trip_and_annotations(spark, tmp_path):
    arrays = {"force_t": np.arange(5.0), "force_y": np.arange(5.0) * 2, "pos_t": np.arange(3.0), "pos_x": np.ones(3), "k_values": np.array([0.0, 0.01]), "sweep_t0": np.array([3.5]), "user_k_opt": np.array([np.nan])}
    (tmp_path / "run_1.npz").write_bytes(runs.to_npz(arrays))
    (tmp_path / "run_2.npz").write_bytes(b"broken")
    got = runs.read_signals(spark, str(tmp_path)).toPandas()
    assert len(got) == 8 and got[got.metric == "loadcell_value"].v.tolist() == [0, 2, 4, 6, 8]
    info = runs.catalogue(spark, str(tmp_path)).collect()
    assert [r.run_id for r in info] == ["run_1"] and '"user_k_opt": null' in info[0].scalars
    assert runs.catalogue(spark, str(tmp_path), errors=True).count() == 2
    params = runs.sweep_runs(runs.catalogue(spark, str(tmp_path))).first()
    assert params.k_values == [0.0, 0.01] and params.sweep_t0 == 3.5
    path = str(tmp_path / "notes")
    runs.annotate(spark, path, spark.createDataFrame([("run_1", 0.04, "good"), ("x", 0.1, None)], "run_id string, user_k_opt double, notes string"))
    table = runs.annotate(spark, path, spark.createDataFrame([("run_1", None, "")], "run_id string, user_k_opt double, notes string"))
    assert {(r.run_id, r.user_k_opt) for r in table.collect()} == {("run_1", None), ("x", 0.1)}
    out = runs.export_rows(runs.read_signals(spark, str(tmp_path)), spark.createDataFrame([("run_1", 0.0, 100.0)], "run_id string, mono double, unix double")).where("metric = 'loadcell_value' and seq = 2").first()
    assert out.t_rel_s == 2.0 and out.wall.timestamp() == 102.0
    assert runs.as_json(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")).first().value == '{"a":null,"b":1.0}'


def test_optimiser_finds_the_telling_metric(spark):
    rng = np.random.default_rng(0)
    rows = []
    for run, best in (("a", 0.03), ("b", 0.05)):
        for k in np.arange(9) * 0.01:
            for s in range(6):
                row = {m: float(rng.normal(1, 0.3)) for m in optimiser.METRICS} | {"overshoot": float(abs(k - best) * 100 + rng.normal(0, 0.1))}
                rows.append({"run_id": run, "k": float(k), "seg_idx": s, "excluded": False, **row})
    got = optimiser.optimise(spark.createDataFrame(pd.DataFrame(rows)), spark.createDataFrame([("a", 0.03), ("b", 0.05)], "run_id string, user_k_opt double"), draws=40, size=3, rounds=12)
    assert got["rms"] < 0.005 and max(got["weights"], key=got["weights"].get) == "overshoot"


def test_clock_like_a_plain_one():
    """Delays of all the last pairs, taken anew each time; wraps, a restart and a counter of no known unit."""
    rng = np.random.default_rng(1)
    for unit in (1e-3, 1e-6, 0.013):
        clock, pairs = retime.Clock(), []
        base, began, shift = (1 << 32) - int(20 / unit) % (1 << 32), 0.0, 0
        for i in range(900):
            now = i * 0.05
            if i == 700:
                base, began, pairs, shift = 5, now, [], 0
            raw = base + int((now - began) / unit)
            recv = 100 + now + float(rng.uniform(0, 0.02))
            pairs = [*pairs, (raw, recv)][-512:]
            got = clock.host_time(raw % (1 << 32), recv)
            known = unit != 0.013 and len(pairs) >= 20 and pairs[-1][1] - pairs[0][1] >= 2
            if got is None:
                assert not known
            else:
                assert known and abs(got - (raw * unit + min(r - x * unit for x, r in pairs))) < 1e-4
