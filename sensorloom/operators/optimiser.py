"""Weights that make the composite cost agree with annotated runs, stably under resampling.

Input: segments (run_id, k, metrics as columns, excluded) and annotations
(run_id, user_k_opt).  A run's resampled medians do not depend on the weights,
so they are made once, in parallel by run; what the search then holds is one
small array per annotated run.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.fits import CLIPPED, DEFAULT_WEIGHTS

METRICS = list(DEFAULT_WEIGHTS)
DRAWN = "run_id string, target double, n_segments long, ks array<double>, shape array<int>, values binary"


@dataclass
class Run:
    name: str
    target: float
    n_segments: int
    k: np.ndarray
    medians: np.ndarray  # (draws, K, metrics), normalised


def resample(pdf: pd.DataFrame, metrics: list[str], draws: int, seed: int) -> pd.DataFrame:
    """One run's normalised medians by draw: segments of each K are drawn with replacement; the scale is that of the
    undrawn medians.  A run needs three K with four segments each."""
    names = [c.split()[0] for c in DRAWN.split(", ")]
    groups = [(k, g[metrics].to_numpy(dtype=float)) for k, g in pdf.sort_values(["k", "seg_idx"]).groupby("k") if len(g) >= 4]
    if len(groups) < 3:
        return pd.DataFrame(columns=names)
    run = pdf.run_id.iloc[0]
    rng = np.random.default_rng([seed, zlib.crc32(run.encode())])
    with np.errstate(all="ignore"):
        centre = np.stack([np.nanmedian(v, axis=0) for _, v in groups])
        scale = np.nanmax(np.abs(centre), axis=0)
        drawn = np.stack([np.nanmedian(v[rng.integers(0, len(v), size=(draws, len(v)))], axis=1) for _, v in groups], axis=1)
        out = drawn / np.where(scale > 0, scale, np.nan)
    clip = [i for i, m in enumerate(metrics) if m in CLIPPED]
    out[:, :, clip] = np.maximum(out[:, :, clip], 0)
    return pd.DataFrame([(run, float(pdf.user_k_opt.iloc[0]), sum(len(v) for _, v in groups), [float(k) for k, _ in groups], list(out.shape), out.astype("<f8").tobytes())], columns=names)


def minima(k: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """argmin with a parabola for each row of costs; NaN for rows without a finite one."""
    filled = np.where(np.isfinite(cost), cost, np.inf)
    i = filled.argmin(axis=1)
    out = np.where(np.isfinite(filled.min(axis=1)), k[i], np.nan)
    inner = np.flatnonzero((i > 0) & (i < len(k) - 1))
    j = i[inner]
    y0, y1, y2 = (filled[inner, j + s] for s in (-1, 0, 1))
    x0, x1, x2 = k[j - 1], k[j], k[j + 1]
    with np.errstate(all="ignore"):
        d1, d2 = (y1 - y0) / (x1 - x0), (y2 - y1) / (x2 - x1)
        bend = (d2 - d1) / (x2 - x0)
        vertex = np.clip((x0 + x1) / 2 - d1 / (2 * bend), x0, x2)
    good = np.isfinite(vertex) & (bend > 0)
    out[inner[good]] = vertex[good]
    return out


def loss(weights: np.ndarray, runs: list[Run], alpha: float = 1.0) -> float:
    """Σ sqrt(segments) * (squared miss of the mean + alpha * variance), over runs; a run without any minimum costs 1e6."""
    total = 0.0
    for run in runs:
        used = weights > 0
        k = minima(run.k, run.medians[:, :, used] @ weights[used]) if used.any() else np.array([np.nan])
        k = k[np.isfinite(k)]
        total += 1e6 if not len(k) else run.n_segments**0.5 * ((k.mean() - run.target) ** 2 + alpha * k.var())
    return float(total)


def evolve(f, bounds: np.ndarray, seed: int, size: int = 15, rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Differential evolution from a Latin hypercube, best one mutated by a scaled difference of two others."""
    rng = np.random.default_rng(seed)
    dims = len(bounds)
    n = max(5, size * dims)
    cells = np.stack([rng.permutation(n) for _ in range(dims)], axis=1)
    pop = bounds[:, 0] + (cells + rng.random((n, dims))) / n * (bounds[:, 1] - bounds[:, 0])
    value = np.array([f(x) for x in pop])
    for _ in range(rounds):
        for i in range(n):
            a, b = pop[rng.choice(n, 2, replace=False)]
            trial = pop[value.argmin()] + rng.uniform(0.5, 1.0) * (a - b)
            cross = rng.random(dims) < 0.7
            cross[rng.integers(dims)] = True
            trial = np.clip(np.where(cross, trial, pop[i]), bounds[:, 0], bounds[:, 1])
            v = f(trial)
            if v <= value[i]:
                pop[i], value[i] = trial, v
        if value.std() <= tolerance * abs(value.mean()):
            break
    best = int(value.argmin())
    return pop[best], float(value[best])


def optimise(segments: DataFrame, annotations: DataFrame, excluded: tuple[str, ...] = (), alpha: float = 1.0, draws: int = 200, seed: int = 0xC0FFEE, size: int = 15, rounds: int = 50, most_runs: int = 2000) -> dict:
    """weights (largest one scaled to its share), loss, and per run target, mean, std; rms, median error and mean std.

    `most_runs` bounds what the driver holds: more annotated runs than that are an error, not a sample.
    """
    columns = ["run_id", "k", "seg_idx", *METRICS]
    used = segments.where("not excluded").select(*columns).join(annotations.where("user_k_opt is not null and not isnan(user_k_opt)").select("run_id", "user_k_opt"), "run_id")
    drawn = used.groupBy("run_id").applyInPandas(lambda pdf: resample(pdf, METRICS, draws, seed), DRAWN)
    rows = drawn.limit(most_runs + 1).collect()
    if not rows:
        raise ValueError("no annotated run has three K of four segments")
    if len(rows) > most_runs:
        raise ValueError(f"more than {most_runs} annotated runs")
    runs = [Run(r.run_id, r.target, r.n_segments, np.array(r.ks), np.frombuffer(r.values, "<f8").reshape(r.shape)) for r in sorted(rows, key=lambda r: r.run_id)]
    active = [i for i, m in enumerate(METRICS) if m not in excluded]

    def whole(x: np.ndarray) -> np.ndarray:
        w = np.zeros(len(METRICS))
        w[active] = x
        return w

    best, value = evolve(lambda x: loss(whole(x), runs, alpha), np.tile([0.0, 1.0], (len(active), 1)), seed, size, rounds)
    weights = whole(best)
    per_run = []
    for run in runs:
        k = minima(run.k, run.medians @ weights) if weights.any() else np.array([np.nan])
        k = k[np.isfinite(k)]
        per_run.append({"run_id": run.name, "target": run.target, "mean": float(k.mean()) if len(k) else None, "std": float(k.std()) if len(k) else None})
    miss = np.array([r["mean"] - r["target"] for r in per_run if r["mean"] is not None])
    spread = [r["std"] for r in per_run if r["std"] is not None]
    return {
        "weights": {m: float(w) for m, w in zip(METRICS, weights / (weights.sum() or 1.0) * len(active))},
        "loss": value,
        "runs": per_run,
        "rms": float(np.sqrt((miss**2).mean())) if len(miss) else None,
        "median_error": float(np.median(np.abs(miss))) if len(miss) else None,
        "mean_std": float(np.mean(spread)) if spread else None,
    }


def weights_json(result: dict) -> str:
    return json.dumps({"weights": result["weights"], "loss": result["loss"]}, indent=1)


def annotated(catalogue: DataFrame, annotations: DataFrame) -> DataFrame:
    """Catalogue rows that have a known K."""
    return catalogue.join(annotations.where(F.col("user_k_opt").isNotNull() & ~F.isnan("user_k_opt")), "run_id")
