"""Bounded queues against a plain one, sample by sample; the collector."""

from collections import deque

import numpy as np
import pytest

from sensorloom.streaming import fanout


@pytest.mark.parametrize("room, reads, stretch", [(20, 6, 4), (8, 8, 1024), (50, 1, 7)])
def test_queues_like_a_plain_one(spark, monkeypatch, room, reads, stretch):
    monkeypatch.setattr(fanout, "STRETCH", stretch)
    rng = np.random.default_rng(room)
    rows, want = [], {}
    for who in ("a", "b", None):
        queue, dropped, given = deque(), 0, 0
        for tick in range(120):
            n = int(rng.integers(0, 2 * room)) if rng.random() < 0.15 else int(rng.integers(0, 2 * reads)) if rng.random() < 0.5 else 0
            for k in range(n):
                if len(queue) == room:
                    queue.popleft()
                    dropped += 1
                queue.append((tick, k))
            out = min(reads, len(queue))
            for _ in range(out):
                queue.popleft()
            given += out
            if n:
                rows.append((who, tick - 30, n))
                want[who, tick - 30] = (n, dropped, given, len(queue))
                dropped = given = 0
    got = {(r.who, r.tick): (r.arrived, r.dropped, r.delivered, r.waiting) for r in fanout.queues(spark.createDataFrame(rows, "who string, tick long, n long"), ["who"], "tick", "n", room, reads).collect()}
    assert got == want and sum(r[1] for r in got.values()) > 0


def test_subscribers_and_collector(spark):
    samples = spark.createDataFrame([("x", float(t), t * 10.0) for t in range(6)] + [("y", 2.5, 1.0)], "name string, t double, v double")
    seen = {}
    for r in fanout.subscribed(samples).collect():
        seen.setdefault(r.subscriber, []).append(r.t)
    assert {k: len(x) for k, x in seen.items()} == {"x": 6, "y": 1, "*": 7}
    last = fanout.delivered_last(fanout.subscribed(samples), ["subscriber"], ["t"], 2).collect()
    assert sorted((r.subscriber, r.t) for r in last) == [("*", 4.0), ("*", 5.0), ("x", 4.0), ("x", 5.0), ("y", 2.5)]
    runs = spark.createDataFrame([("r1", "x", 0.5, 3.0), ("r2", "x", 4.5, None), ("r3", "y", 3.0, 9.0)], "run_id string, name string, started double, stopped double")
    got = {r.run_id: (r.n, r.t_first, r.t_last, r.total) for r in fanout.collected(samples, runs, ["name"], "t", "v", 1.0).collect()}
    assert got == {"r1": (2, 1.0, 2.0, 30.0), "r2": (1, 5.0, 5.0, 50.0), "r3": (0, None, None, None)}
