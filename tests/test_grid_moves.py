from sensorloom.operators import flow


def test_of_equal_moves_the_earlier_one(spark):
    """One rise amid a measured part: the grid may move by 28 shifts to either side."""
    force = spark.createDataFrame([("a", i, i / 5 - 19.95, float(i >= 207)) for i in range(400)], "run_id string, seq long, t double, v double")
    levels = spark.createDataFrame([("a", i, 12.0, 0.56) for i in range(5)], "run_id string, level_idx int, dwell_s double, settle_frac double")
    sweep = spark.createDataFrame([("a", 0.0)], "run_id string, t_start double")
    assert abs(flow.align_grid(force, sweep, levels).collect()[0].t_start + 12 * 28 / 120) < 1e-9
