from sensorloom.queries import series


def test_of_events_at_one_time_the_first_ends_the_gap(spark, tmp_path):
    """Event 0 comes at the time of event 41, but later in the table."""
    rows = []
    for i in range(40):
        second = i * 10 + (7200 if i >= 20 else 0)
        rows.append((i * 2 + 1, second, 100.0 * (i >= 20)))
    rows.append((0, 200 + 7200, 100.0))
    df = spark.createDataFrame([(i, 1, "view", v, "{}", s) for i, s, v in rows], "event_id long, user_id long, event_type string, value double, props string, s long")
    df.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.event_id, r.gap, r.jump) for r in series.event_gaps_dropouts(spark, str(tmp_path)).collect()] == [(0, 7210.0, 100.0)]
