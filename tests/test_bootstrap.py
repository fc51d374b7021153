from pyspark.sql import functions as F

from sensorloom.operators import fits
from sensorloom.queries import curves


def test_picks_of_long_groups_do_not_overflow(spark, tmp_path):
    n = 46_400  # the square of the last place exceeds 32 bits
    spark.range(n).select((F.col("id") * 9).alias("event_id"), (F.col("id") % 100).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    long, index = curves.bootstrap_values(spark, str(tmp_path))
    got = long.where(f"i = {n - 1} and metric = 'a'").withColumn("draw", F.lit(3)).select("n", index.alias("pick")).collect()
    i = n - 1
    assert [(r.n, r.pick) for r in got] == [(n, (i * 7919 + 3 * 104729 + i * i % 1009 * 31) % n)]


def test_metrics_of_different_counts(spark):
    rows = [(float(k), m, i, n, float(10 * (k - b) ** 2 + i)) for k in range(5) for m, n, b in (("a", 7, 2), ("b", 4, 2)) for i in range(n)]
    values = spark.createDataFrame(rows, "k double, metric string, i long, n long, value double")
    got = fits.bootstrap_minima(values, [], 3, (F.col("i") * 3 + F.col("draw")) % F.col("n"), {"a": 1.0, "b": 1.0}).orderBy("draw").collect()
    assert [(r.draw, r.k_opt) for r in got] == [(0, 2.0), (1, 2.0), (2, 2.0)]
