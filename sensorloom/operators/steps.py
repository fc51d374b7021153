"""Step responses: the seventeen metrics of a rise and fall, and whether a segment counts.

Samples and segments meet in stretches of a run's time, and a stretch is
measured as a whole: numpy reduces the samples of all its segments at once.
Samples may come as blocks that are unpacked only there, so that what travels
is a row for each block and not for each sample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sensorloom.operators import fits, ranks, robust, series

SEGMENT = ["run_id", "k", "seg_idx"]
METRICS = [
    "baseline_median", "baseline_noise_std", "high_level", "plateau_slope", "plateau_creep", "overshoot", "rise_delay", "rise_slope", "rise_error_area", "rise_signed_area",
    "fall_delay", "fall_error_area", "fall_signed_area", "k_estimate", "undershoot", "tail_area", "settling_time",
]
#: Seconds of a stretch, if no segment is longer.
STRETCH = 600.0
#: Times and values, a row each, of a table of blocks.
Unpack = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
_COUNTS = ["n_samples", "_n_base", "_n_peak", "_n_plat", "_n_trough"]
_VALUES = ["_base", "_noise", "_peak", "_high", "_plat_std", "_trough", "_fall", "t_rise_end", "t_fall_start", "t_fall_end", "t_peak", "t_trough", "_slope", "_span", "rise_error_area", "rise_signed_area", "fall_error_area", "fall_signed_area", "tail_area", "_settled"]


def _met(force: DataFrame, spans: DataFrame, lo: str, hi: str, unpack: Unpack | None, measure, out: list[StructField]) -> DataFrame:
    """The spans with the columns `out`: what measure(t, v, spans) gives, by name, for the samples of a stretch in order
    of time and all spans that begin in it."""
    longest = spans.agg(F.max(F.when(F.abs(F.col(hi) - F.col(lo)) < float("inf"), F.col(hi) - F.col(lo)))).first()[0] or 0.0
    size = max(STRETCH, float(longest))
    reach = float(longest) * (1 + 1e-9) + 1e-6
    keys = ["run_id", "_stretch"]
    parts = int(force.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, last = ("t_lo", "t_hi") if unpack else ("t", "t")
    known = force if unpack else robust.finite(force, "t", "v")
    at = known.where("run_id is not null").withColumn("_stretch", F.explode(F.sequence(F.floor((F.col(first) - reach) / size), F.floor(F.col(last) / size))))
    at = at.repartition(parts, *keys)  # a stretch is work enough for a task, however few bytes it has
    begun = spans.withColumn("_stretch", F.floor(F.col(lo) / size))
    schema = StructType([*spans.schema.fields, *out])
    names = [f.name for f in out]

    def measured(samples: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.drop_columns(["_stretch"])
        got = measure(*_sorted(samples, unpack), spans)
        for name in names:
            x = got[name]
            spans = spans.append_column(name, pa.array(x, mask=np.isnan(x) if x.dtype == float else None))
        return spans

    return at.groupBy(*keys).cogroup(begun.groupBy(*keys)).applyInArrow(measured, schema)


def _sorted(samples: pa.Table, unpack: Unpack | None) -> tuple[np.ndarray, np.ndarray]:
    """Times and values in order of time and number; a block's samples follow each other."""
    seq = samples["seq"].to_numpy()
    if unpack:
        t, v = unpack(samples)
        seq = (seq[:, None] + np.arange(t.shape[1])).ravel()
        t, v = t.ravel(), v.ravel()
    else:
        t, v = _number(samples, "t"), _number(samples, "v")
    good = np.isfinite(t) & np.isfinite(v)
    if not good.all():
        t, v, seq = t[good], v[good], seq[good]
    if len(t) and not (np.diff(t) > 0).all():
        order = np.lexsort((seq, t))
        t, v = t[order], v[order]
    return t, v


def _number(spans: pa.Table, name: str) -> np.ndarray:
    return spans[name].cast(pa.float64()).to_numpy()


class _Spans:
    """The samples of many spans, which may overlap, laid out one span after the other; reductions by span."""

    def __init__(self, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.begin, end = np.searchsorted(t, lo, "left"), np.searchsorted(t, hi, "right")
        self.n = np.maximum(end - self.begin, 0)
        self.offset = np.cumsum(self.n) - self.n
        self.of = np.repeat(np.arange(len(lo)), self.n)
        self.at = np.arange(len(self.of)) + np.repeat(self.begin - self.offset, self.n)
        self.full = np.flatnonzero(self.n)

    def reduced(self, f: np.ufunc, x: np.ndarray, empty) -> np.ndarray:
        out = np.full(len(self.n), empty, dtype=np.result_type(x.dtype, type(empty)))
        if len(self.full):
            out[self.full] = f.reduceat(x, self.offset[self.full])
        return out

    def count(self, mask: np.ndarray) -> np.ndarray:
        return self.reduced(np.add, mask.astype(np.int64), 0)

    def sum(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        """NaN where nothing is in the mask."""
        return np.where(self.count(mask) > 0, self.reduced(np.add, np.where(mask, x, 0.0), 0.0), np.nan)

    def least(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        found = self.reduced(np.minimum, np.where(mask, x, np.inf), np.inf)
        return np.where(found < np.inf, found, np.nan)

    def most(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        return -self.least(mask, -x)

    def median(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        x, of = x[mask], self.of[mask]
        n = np.bincount(of, minlength=len(self.n))
        x = x[np.lexsort((x, of))]
        first = np.cumsum(n) - n
        out = np.full(len(n), np.nan)
        some = np.flatnonzero(n)
        a, b = first[some] + (n[some] - 1) // 2, first[some] + n[some] // 2
        out[some] = np.where(a == b, x[a], 0.5 * x[a] + 0.5 * x[b])
        return out

    def deviation(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = self.count(mask)
        away = x - (self.sum(mask, x) / np.maximum(n, 1))[self.of]
        return np.sqrt(self.sum(mask, away * away) / np.maximum(n, 1))


def _features(t: np.ndarray, v: np.ndarray, spans: pa.Table) -> dict[str, np.ndarray]:
    """_COUNTS and _VALUES of a stretch's segments, NaN where there is none."""
    t_rise, t_fall, slow, fast, t_start, t_end = (_number(spans, c) for c in ("t_rise", "t_fall", "slow", "fast", "t_start", "t_end"))
    s = _Spans(t, t_start, t_end)
    of, at = s.of, s.at
    us = np.round(t * 1e6).astype(np.int64)
    soon_lo, soon_hi = np.searchsorted(us, us + 1, "left"), np.searchsorted(us, us + 50_000, "right")
    t, v = t[at], v[at]

    def between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (t >= lo[of]) & (t <= hi[of])  # false for NaN

    def first_of(*xs: np.ndarray) -> np.ndarray:
        out = xs[0]
        for x in xs[1:]:
            out = np.where(np.isnan(out), x, out)
        return out

    base_in = between(t_start + 0.15 * slow, t_rise - 0.05 * slow)
    n_base = s.count(base_in)
    enough = (n_base >= 4) & (s.n >= 20)
    base, noise = np.where(enough, s.median(base_in, v), np.nan), np.where(enough, s.deviation(base_in, v), np.nan)
    y = v - base[of]
    coarse_in = between(t_rise + 0.5 * fast, t_fall - 0.05 * fast)
    coarse = np.where(s.count(coarse_in) >= 3, s.median(coarse_in, y), np.nan)
    coarse = np.where(coarse > 0, coarse, np.nan)
    is_high = y >= (0.9 * coarse)[of]
    rise_end = s.least(between(t_rise, t_rise + 0.5 * fast) & is_high, t)
    since_ = np.fmax(first_of(rise_end + 0.05, t_rise + 0.3 * fast), t_fall - 0.3 * fast)
    # whether a segment's next 50 ms hold a high value
    seen = np.concatenate([[0], np.cumsum(is_high)])
    shift = (s.offset - s.begin)[of]
    a, b = soon_lo[at] + shift, np.minimum(soon_hi[at] + shift, (s.offset + s.n)[of])
    a = np.minimum(a, b)
    low = y < (0.9 * coarse)[of]
    fall_start = s.least(between(since_, t_fall + 0.1 * fast) & low & (seen[b] == seen[a]), t)
    fall = first_of(fall_start, t_fall)
    fall_end = s.least(between(fall, fall + 0.5 * slow) & (y <= (0.1 * coarse)[of]), t)

    def extreme(mask: np.ndarray, find) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = s.count(mask)
        best = find(mask & ~np.isnan(y), y)
        when = s.least(mask & (y == best[of]), t)
        when = np.where(np.isnan(best), s.least(mask, t), when)  # without a base, the first of the samples
        return n, np.where(n >= 2, best, np.nan), np.where(n >= 2, when, np.nan)

    n_peak, peak, t_peak = extreme(between(t_rise, first_of(rise_end + 0.10 * fast, t_rise + 0.20 * fast)), s.most)
    settle = np.maximum(0.03, 0.1 * fast)
    lo = first_of(rise_end + settle, np.where(np.isnan(t_peak), np.nan, np.fmax(t_peak, t_rise) + settle), t_rise + 0.5 * fast)
    plat = between(lo, fall - np.maximum(0.02, 0.1 * fast)) & ~np.isnan(base)[of]
    n_plat = s.count(plat)
    high, plat_std = np.where(n_plat >= 3, s.median(plat, y), np.nan), np.where(n_plat >= 6, s.deviation(plat, y), np.nan)
    n_trough, trough, t_trough = extreme(between(fall, first_of(fall_end + 0.30 * slow, t_fall + 0.5 * slow)), s.least)
    # pairs of neighbours within a segment
    t2, y2 = np.append(t[1:], np.nan), np.append(y[1:], np.nan)
    final = s.offset[s.full] + s.n[s.full] - 1
    t2[final] = y2[final] = np.nan
    step = t2 - t

    def area(lo: np.ndarray, hi: np.ndarray, f) -> np.ndarray:
        pair = (t >= lo[of]) & (t2 <= hi[of])
        each = (f(y) + f(y2)) / 2 * step
        return s.sum(pair & ~np.isnan(each), each)

    recover = first_of(fall_end + np.maximum(0.03, 0.05 * slow), t_trough + 0.10 * slow)
    # settling: rows in a run of small values since at least 0.1 s
    ok = (t >= first_of(t_trough, fall_end, t_fall)[of]) & (np.abs(y) < np.fmax(3 * noise, 1e-9)[of])
    ahead = np.append(False, ok[:-1])
    ahead[s.offset[s.full]] = False
    began = np.maximum.accumulate(np.where(ok & ~ahead, np.arange(len(t)), 0)) if len(t) else np.arange(0)
    since = t[began]
    n = np.maximum(n_plat, 1)
    x = t - t_rise[of]
    dx = x - (s.sum(plat, x) / n)[of]
    dy = y - (s.sum(plat, y) / n)[of]
    span = s.most(plat, t) - s.least(plat, t)
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = np.where(span > 1e-6, s.sum(plat, dx * dy) / s.sum(plat, dx * dx), np.nan)
    return {
        "n_samples": s.n.astype(np.int64), "_n_base": n_base, "_n_peak": n_peak, "_n_plat": n_plat, "_n_trough": n_trough,
        "_base": base, "_noise": noise, "_peak": peak, "_high": high, "_plat_std": plat_std, "_trough": trough, "_fall": fall, "t_rise_end": rise_end, "t_fall_start": fall_start, "t_fall_end": fall_end,
        "t_peak": t_peak, "t_trough": t_trough, "_slope": slope, "_span": span,
        "rise_error_area": area(t_rise, fall, lambda v: np.abs(high[of] - v)), "rise_signed_area": area(t_rise, fall, lambda v: v - high[of]),
        "fall_error_area": area(fall, t_end, np.abs), "fall_signed_area": area(fall, t_end, lambda v: v),
        "tail_area": area(recover, t_end - 0.05 * slow, np.abs),
        "_settled": s.least(ok & (t - since >= 0.10), since),
    }


def step_metrics(force: DataFrame, segments: DataFrame, dropouts: DataFrame | None = None, unpack: Unpack | None = None) -> DataFrame:
    """One row per segment with METRICS, the feature times, n_samples, excluded and reasons.

    force: run_id, seq, t, v.  segments: run_id, k, seg_idx, t_rise, t_fall,
    slow, fast (leg durations), cycles (of the K).  dropouts: run_id, t.
    Segments without samples come back, excluded, with nulls.  With `unpack`,
    force holds blocks of equally many samples: run_id, seq of the first one,
    t_lo and t_hi, and what `unpack` makes the samples from.
    """
    bounds = segments.withColumn("t_start", F.col("t_rise") - F.col("slow")).withColumn("t_end", F.col("t_fall") + F.col("slow"))
    info = ["t_rise", "t_fall", "slow", "fast", "cycles", "t_start", "t_end"]
    c = F.col
    keys = [x for x in bounds.columns if x in (*SEGMENT, *info)]
    got = _met(force, bounds.select(*keys), "t_start", "t_end", unpack, _features, [*[StructField(x, LongType()) for x in _COUNTS], *[StructField(x, DoubleType()) for x in _VALUES]])
    level = c("_high")

    def noise_gain(n: Column) -> Column:
        return F.sqrt(2 * F.log(F.greatest(F.lit(2), n).cast("double")))

    has = c("_base").isNotNull()
    out = got.withColumns(
        {
            "baseline_median": c("_base"),
            "baseline_noise_std": c("_noise"),
            "high_level": level + c("_base"),
            "plateau_slope": F.when(c("_n_plat") >= 4, c("_slope")),
            "plateau_creep": F.when(c("_n_plat") >= 4, F.abs("_slope") * c("_span")),
            "overshoot": c("_peak") - level - F.greatest(F.coalesce("_plat_std", "_noise"), c("_noise")) * noise_gain(c("_n_peak")),
            "rise_delay": F.when(has & c("t_peak").isNotNull(), F.greatest(F.lit(0.0), c("t_peak") - c("t_rise"))),
            "rise_slope": c("_peak") / F.greatest(c("t_peak") - c("t_rise"), F.lit(1e-9)),
            "fall_delay": F.when(has & c("t_trough").isNotNull(), F.greatest(F.lit(0.0), c("t_trough") - c("_fall"))),
            "k_estimate": F.when(level > 0, c("k") + c("fall_signed_area") / level),
            "undershoot": -c("_trough") - c("_noise") * noise_gain(c("_n_trough")),
            "settling_time": F.when(c("tail_area").isNotNull(), c("_settled") - c("t_fall")),
        }
    )
    every = out
    if dropouts is not None:
        zones = bounds.select(*SEGMENT, (c("t_rise") - 0.1 * c("slow")).alias("lo"), (c("t_fall") + 0.5 * c("slow")).alias("hi"))
        hit = series.interval_join(dropouts.select("run_id", "t"), zones, ["run_id"], "t", "lo", "hi", 2.0).select(*SEGMENT).distinct().withColumn("_drop", F.lit(True))
        every = every.join(hit, SEGMENT, "left")
    else:
        every = every.withColumn("_drop", F.lit(None).cast("boolean"))
    n = c("n_samples")
    noisy = (c("_noise") > 0) & level.isNotNull()
    rules = [
        ("few samples", n < 20),
        ("dropout", (n >= 20) & c("_drop")),
        ("low rate", (n >= 20) & (n / (c("t_end") - c("t_start")) < 40)),
        ("narrow baseline", (n >= 20) & (c("_n_base") < 4)),
        ("weak rise", noisy & (level < 3 * c("_noise"))),
        ("noisy baseline", noisy & (level > 0) & (c("_noise") > 0.30 * level)),
        ("spike", noisy & (level > 3 * c("_noise")) & (F.abs(c("_trough")) > 5 * level)),
        ("first cycle", (c("seg_idx") == 0) & (c("cycles") >= 3)),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    times = ["t_rise_end", "t_fall_start", "t_fall_end", "t_peak", "t_trough"]
    return every.withColumn("reasons", reasons).select(*keys, *times, "n_samples", *METRICS, (F.size("reasons") > 0).alias("excluded"), "reasons")


def aggregate(segments: DataFrame, least: int = 4) -> DataFrame:
    """(run_id, k, metric, n, median, mad, iqr, included, total) over included segments; only K with at least `least` of
    them have medians."""
    counts = segments.groupBy("run_id", "k").agg(F.count_if(~F.col("excluded")).alias("included"), F.count(F.lit(1)).alias("total"))
    if (counts.agg(F.max("included")).first()[0] or 0) <= ranks.SMALL:  # a K's segments fit in a task, all metrics side by side
        keys = [F.col(x).isNotNull() for x in ("run_id", "k")]
        used = [F.when(~F.col("excluded") & ~F.isnan(m), F.col(m)) for m in METRICS]
        held = segments.where(keys[0] & keys[1]).groupBy("run_id", "k").agg(F.count_if(~F.col("excluded")).alias("included"), F.count(F.lit(1)).alias("total"), *[F.sort_array(F.collect_list(x)).alias(m) for x, m in zip(used, METRICS)])
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("_sorted")) for m in METRICS])).alias("_m")
        long = held.where(F.col("included") >= least).select("run_id", "k", "included", "total", each).select("run_id", "k", "included", "total", "_m.*")
        return robust.mad_of_sorted(long, "_sorted").select("run_id", "k", "metric", "n", "median", "mad", "iqr", "included", "total")
    long = segments.where("not excluded").select("run_id", "k", *METRICS).unpivot(["run_id", "k"], METRICS, "metric", "value")
    return fits.per_k(long, ["run_id"]).join(counts, ["run_id", "k"]).where(F.col("included") >= least)


def _areas(t: np.ndarray, v: np.ndarray, spans: pa.Table) -> dict[str, np.ndarray]:
    """The area around the rise less that around the fall of a stretch's segments; NaN if either has less than two samples."""
    total = 0.0
    for edge, sign in (("t_rise", 1), ("t_fall", -1)):
        at, half = _number(spans, edge), _number(spans, "half")
        s = _Spans(t, at - half, at + half)
        y = v[s.at]
        y = y - (s.sum(np.ones(len(y), bool), y) / np.maximum(s.n, 1))[s.of]
        pair = np.append(s.of[1:] == s.of[:-1], False) if len(y) else np.zeros(0, bool)
        x = t[s.at]
        total = total + sign * s.sum(pair, (y + np.roll(y, -1)) / 2 * (np.roll(x, -1) - x))
    return {"a": total}


def integral_area(force: DataFrame, segments: DataFrame, longest: float = 0.075, unpack: Unpack | None = None) -> DataFrame:
    """(run_id, k, area, n): over included segments, the area around the rise less that around the fall, each against
    its window's own mean; the half window is at most half the fast leg.  Blocks with `unpack` as for step_metrics()."""
    used = segments.where("not excluded").select(*SEGMENT, "t_rise", "t_fall", F.least(F.lit(longest), F.col("fast") / 2).alias("half"))
    used = used.withColumn("lo", F.least(F.col("t_rise"), F.col("t_fall")) - F.col("half")).withColumn("hi", F.greatest(F.col("t_rise"), F.col("t_fall")) + F.col("half"))
    each = _met(force, used, "lo", "hi", unpack, _areas, [StructField("a", DoubleType())]).where("a is not null")
    return each.groupBy("run_id", "k").agg(F.sum("a").alias("area"), F.count(F.lit(1)).alias("n"))
