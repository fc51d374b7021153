"""Fan-out to subscribers with bounded queues that drop their oldest samples, and the collector of a run.

A queue with room for so many samples, read by so many a tick, is a sum that
is held between two bounds.  Such steps compose: any stretch of ticks acts on
the number waiting before it as one step, an addition held between a least and
a greatest value.  So stretches are summed up by themselves, one row each, and
no task walks through the whole life of a queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ranks import joined
from sensorloom.operators.series import interval_join

#: Ticks of a stretch.
STRETCH = 1024
#: More than any queue holds.
_ALL = 1 << 60


def subscribed(samples: DataFrame, name: str = "name", every: str = "*") -> DataFrame:
    """Each sample once for the subscribers of its name, and once for those of everything: adds `subscriber`."""
    return samples.withColumn("subscriber", F.explode(F.array(F.col(name), F.lit(every))))


def _then(step: Column, s: Column, low: Column, high: Column) -> Column:
    """struct(s, low, high) of a step followed by x -> min(high, max(low, x + s))."""
    hold = lambda x: F.least(high, F.greatest(low, x))
    return F.struct((step["s"] + s).alias("s"), hold(step["low"] + s).alias("low"), hold(step["high"] + s).alias("high"))


def queues(arrivals: DataFrame, by: list[str], tick: str, n: str, room: int = 4096, reads: int = 64) -> DataFrame:
    """(by, tick, arrived, dropped, delivered, waiting) for each tick with arrivals.

    In a tick all arrivals come first, each one into a full queue pushing out
    the oldest; then up to `reads` are read.  Ticks without arrivals are read
    in, too; what they deliver counts for the next row.  arrivals: one row for
    each (by, tick), n of them; `reads` is at most `room`.
    """
    rows = arrivals.select(*by, F.col(tick).cast("long").alias("_tick"), F.col(n).cast("long").alias("_n")).withColumn("_stretch", F.floor(F.col("_tick") / STRETCH))
    held = rows.groupBy(*by, "_stretch").agg(F.sort_array(F.collect_list(F.struct("_tick", "_n"))).alias("_ticks"))  # at most STRETCH of them
    zero, top, much = F.lit(0).cast("long"), F.lit(room - reads).cast("long"), F.lit(_ALL).cast("long")

    def composed(acc: Column, x: Column) -> Column:
        idle = F.greatest(x["_tick"] - acc["at"] - 1, F.lit(0)) * -reads
        step = _then(_then(acc["step"], idle, zero, much), x["_n"] - reads, zero, top)
        return F.struct(x["_tick"].alias("at"), step.alias("step"))

    same = F.struct(zero.alias("s"), F.lit(-_ALL).cast("long").alias("low"), much.alias("high"))
    whole = F.aggregate("_ticks", F.struct((F.element_at("_ticks", 1)["_tick"] - 1).alias("at"), same.alias("step")), composed)
    stretches = held.withColumn("_whole", F.struct("_stretch", F.element_at("_ticks", 1)["_tick"].alias("first"), whole["at"].alias("last"), whole["step"].alias("step")))

    def carried(acc: Column, x: Column) -> Column:
        """What waits at the beginning of each stretch, on its first tick's eve."""
        eve = F.when(acc["last"].isNull(), zero).otherwise(F.greatest(zero, acc["waiting"] - reads * (x["first"] - acc["last"] - 1)))
        after = F.least(x["step"]["high"], F.greatest(x["step"]["low"], eve + x["step"]["s"]))
        before = F.when(acc["last"].isNull(), zero).otherwise(acc["waiting"])
        return F.struct(x["last"].alias("last"), after.alias("waiting"), F.array_append(acc["begin"], F.struct(x["_stretch"].alias("_stretch"), acc["last"].alias("_last"), before.alias("_waiting"))).alias("begin"))

    none = F.expr("struct(cast(null as bigint) as last, cast(0 as bigint) as waiting, cast(array() as array<struct<_stretch:bigint,_last:bigint,_waiting:bigint>>) as begin)")
    starts = stretches.groupBy(*by).agg(F.sort_array(F.collect_list("_whole")).alias("_all")).select(*by, F.explode(F.aggregate("_all", none, carried)["begin"]).alias("_b")).select(*by, "_b.*")

    def walk(acc: Column, x: Column) -> Column:
        left = F.when(acc["at"].isNull(), zero).otherwise(F.greatest(zero, acc["waiting"] - reads * (x["_tick"] - acc["at"] - 1)))
        full = F.least(F.lit(room).cast("long"), left + x["_n"])
        out = F.least(F.lit(reads).cast("long"), full)
        row = F.struct(x["_tick"].alias("tick"), x["_n"].alias("arrived"), (left + x["_n"] - full).alias("dropped"), (acc["waiting"] - left + out).alias("delivered"), (full - out).alias("waiting"))
        return F.struct(x["_tick"].alias("at"), (full - out).alias("waiting"), F.array_append(acc["rows"], row).alias("rows"))

    both = joined(held, starts, [*by, "_stretch"])
    begin = F.struct(F.col("_last").alias("at"), F.col("_waiting").alias("waiting"), F.expr("cast(array() as array<struct<tick:bigint,arrived:bigint,dropped:bigint,delivered:bigint,waiting:bigint>>)").alias("rows"))
    return both.select(*by, F.explode(F.aggregate("_ticks", begin, walk)["rows"]).alias("_r")).select(*by, "_r.*")


def delivered_last(samples: DataFrame, by: list[str], order: list[str], room: int = 4096) -> DataFrame:
    """What a queue holds that is read at the end only: a subscriber's newest `room` samples."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= room).drop("_r")


def collected(samples: DataFrame, runs: DataFrame, by: list[str], t: str, v: str, width: float = 60.0) -> DataFrame:
    """(run_id, n, t_first, t_last, total) of what a collector keeps from a run's start until it is stopped.

    runs: run_id, by, started, stopped (null: never).  The first time is
    latched by the first sample while the run goes on; a run that gets none
    has zero samples and no times.
    """
    latest = samples.agg(F.max(t)).first()[0]
    ended = runs.withColumn("_stop", F.coalesce("stopped", F.lit(latest).cast("double") + 1.0))
    inside = interval_join(samples.select(*by, t, v), ended.select("run_id", *by, F.col("started").alias("_start"), "_stop"), by, t, "_start", "_stop", width, closed=False)
    kept = inside.groupBy("run_id").agg(F.count("*").alias("n"), F.min(t).alias("t_first"), F.max(t).alias("t_last"), F.sum(v).alias("total"))
    return runs.select("run_id").join(kept, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
