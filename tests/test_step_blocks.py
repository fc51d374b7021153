import numpy as np
import pandas as pd

from sensorloom.operators import steps
from tests import generators as g


def test_blocks_give_what_rows_give(spark):
    """Blocks of 100 samples that reach over segments and stretches, two segments that overlap."""
    force, segments = g.step_response(ks=3, cycles=5)
    force = force.iloc[: len(force) // 100 * 100]
    extra = segments.iloc[[4]].assign(seg_idx=99)
    extra[["t_rise", "t_fall"]] += 0.1
    segments = spark.createDataFrame(pd.concat([segments, extra]))
    rows = spark.createDataFrame(force, g.SIGNAL)
    parts = [force.iloc[i : i + 100] for i in range(0, len(force), 100)]
    blocks = spark.createDataFrame([(p.run_id.iloc[0], int(p.seq.iloc[0]), float(p.t.min()), float(p.t.max()), p.t.tolist(), p.v.tolist()) for p in parts], "run_id string, seq long, t_lo double, t_hi double, ts array<double>, vs array<double>")

    def unpack(table):
        return tuple(np.stack([np.array(x) for x in table[c].to_pylist()]) for c in ("ts", "vs"))

    def got(*force, **how):
        out = steps.step_metrics(*force, segments, **how)
        areas = steps.integral_area(*force, out, **how)
        return sorted(map(repr, out.collect())), sorted(map(repr, areas.collect()))

    was, steps.STRETCH = steps.STRETCH, 7.0
    try:
        assert got(blocks, unpack=unpack) == got(rows)
    finally:
        steps.STRETCH = was
    assert got(blocks, unpack=unpack) == got(rows)
