import numpy as np

from sensorloom.operators import fits, steps
from tests import generators as g


def test_cost_minimum_is_near_the_planted_k(spark):
    force, segments = g.step_response(best=0.040)
    got = steps.step_metrics(spark.createDataFrame(force, g.SIGNAL), spark.createDataFrame(segments)).cache()
    rows = got.toPandas()
    assert len(rows) == 13 * 6
    assert rows[rows.seg_idx == 0].reasons.map(lambda r: "first cycle" in r).all()
    assert (~rows.excluded).mean() > 0.7, rows.reasons.value_counts()
    row = rows[(rows.seg_idx == 2) & np.isclose(rows.k, 0.0)].iloc[0]
    assert abs(row.high_level - 1100) < 30 and abs(row.baseline_noise_std) < 60
    medians = steps.aggregate(got)
    k = fits.argmin_parabolic(fits.cost(fits.normalise(medians, ["run_id"]), ["run_id"]), ["run_id"], "cost").toPandas().k_opt[0]
    assert abs(k - 0.040) < 0.010


def test_segments_without_samples_are_excluded(spark):
    force, segments = g.step_response(ks=1, cycles=4)
    segments.loc[0, "t_rise"] += 10_000
    segments.loc[0, "t_fall"] += 10_000
    got = steps.step_metrics(spark.createDataFrame(force, g.SIGNAL), spark.createDataFrame(segments)).toPandas()
    row = got[got.seg_idx == 0].iloc[0]
    assert row.n_samples == 0 and row.excluded and np.isnan(row.overshoot)
