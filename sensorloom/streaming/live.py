"""Live delivery: a stream's samples in small frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import robust
from sensorloom.operators.series import over


def frames(samples: DataFrame, most: int = 64) -> DataFrame:
    """(metric, frame, n, samples): each metric's samples of a batch in order of time, at most `most` to a frame.

    samples: metric, t, v.  Rows of equal time stay in order of value; samples
    without a finite time aren't sent.
    """
    numbered = robust.finite(samples, "t").withColumn("frame", F.floor((F.row_number().over(over(["metric"], "t", "v")) - 1) / most).cast("int"))
    return numbered.groupBy("metric", "frame").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("samples"))


def send(stream: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", most: int = 64):
    """Starts a query that hands each batch's frames, and the batch's number, to `deliver`.

    After a failure Spark repeats the last batch under its number, so `deliver`
    should overwrite what it stored for that number.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: deliver(frames(batch, most), number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
