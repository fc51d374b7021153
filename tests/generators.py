"""Signals with a planted truth."""

import numpy as np
import pandas as pd

SIGNAL = "run_id string, metric string, seq long, t double, v double"


def signal(run, metric, t, v):
    return pd.DataFrame({"run_id": run, "metric": metric, "seq": np.arange(len(t)), "t": np.asarray(t, float), "v": np.asarray(v, float)})


def step_response(run="r", best=0.040, ks=13, step=0.005, cycles=6, rate=200.0, slow=0.8, fast=0.8, seed=1, noise=3.0):
    """Force of fast and slow legs whose overshoot grows with the distance from the best K, and the segments' times."""
    rng = np.random.default_rng(seed)
    t0, t, v, segments = 10.0, [], [], []
    at = t0
    for i in range(ks):
        k = i * step
        off = abs(k - best)
        for c in range(cycles):
            rise, fall, end = at + slow, at + slow + fast, at + slow + fast + slow
            own = np.arange(at, at + slow + fast, 1 / rate)
            y = np.full(len(own), 100.0)
            up = own >= rise
            y[up] = 1100 + 8000 * off * np.exp(-(own[up] - rise) / 0.04)
            if c or i:
                lead = own < rise
                y[lead] -= 9000 * last * np.exp(-(own[lead] - at) / 0.10)
            t.append(own)
            v.append(y)
            segments.append((run, k, c, rise, fall, slow, fast, cycles))
            at, last = fall, off
    tail = np.arange(at, at + slow, 1 / rate)
    t.append(tail)
    v.append(100 - 9000 * last * np.exp(-(tail - at) / 0.10))
    t, v = np.concatenate(t), np.concatenate(v)
    v = v + rng.normal(0, noise, len(v))
    return signal(run, "loadcell_value", t, v), pd.DataFrame(segments, columns=["run_id", "k", "seg_idx", "t_rise", "t_fall", "slow", "fast", "cycles"])


def flow_steps(run="f", levels=20, dwell=3.0, rate=180.0, start=40.0, dev=None, var=None, collapse=None, exponent=0.55, offset=1500.0, tail=20.0, seed=2):
    rng = np.random.default_rng(seed)
    q = 2.0 + np.arange(levels)
    t = np.arange(0, start + levels * dwell + tail, 1 / rate)
    v = np.full(len(t), offset) + rng.normal(0, 0.3, len(t))
    for i, f in enumerate(q):
        own = (t >= start + i * dwell) & (t < start + (i + 1) * dwell)
        y = 3 * f**exponent + 4
        if dev is not None and f > dev:
            y += 0.8 * (f - dev) ** 2
        sigma = 0.3 + (1.5 * (f - var) if var is not None and f > var else 0.0)
        if collapse is not None and f >= collapse:
            y *= 0.55
        v[own] = offset + y + rng.normal(0, sigma, int(own.sum()))
    plan = pd.DataFrame({"run_id": run, "level_idx": np.arange(levels), "level": q, "dwell_s": dwell, "settle_frac": 0.4})
    return signal(run, "loadcell_value", t, v), plan


def probe_touches(run="p", touches=5, stiffness=250.0, contact=0.6, creep=1.0, speed=0.5, rate=180.0, noise=0.4, seed=3):
    rng = np.random.default_rng(seed)
    t, pos, at, x = [np.arange(0, 3, 1 / rate)], [np.zeros(int(3 * rate))], 3.0, 0.0

    def leg(seconds, end):
        nonlocal at, x
        own = np.arange(at, at + seconds, 1 / rate)
        t.append(own)
        pos.append(np.linspace(x, end, len(own)))
        at, x = own[-1] + 1 / rate, end

    for _ in range(touches):
        leg(0.5, 0.0)
        leg(creep / speed, creep)
        leg(0.3, creep)
        leg(0.1, 0.0)
    leg(1.0, 0.0)
    t, pos = np.concatenate(t), np.concatenate(pos)
    n = min(len(t), len(pos))
    t, pos = t[:n], pos[:n]
    v = 1500 + stiffness * np.clip(pos - contact, 0, None) + rng.normal(0, noise, n)
    return signal(run, "loadcell_value", t, v), signal(run, "pos_x", t[::3], 100 + pos[::3])
