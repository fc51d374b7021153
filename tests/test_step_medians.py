import random

from sensorloom.operators import ranks, robust, steps


def test_sorted_at_once_or_by_selection(spark, monkeypatch):
    """K of few segments need no rounds of selection; both ways agree, nulls, NaN and excluded rows included."""
    rng = random.Random(3)
    odd = [None, float("nan"), 1.5]
    rows = [(f"r{i % 3}", (i % 7) / 100, i % 5 == 0, *[rng.choice(odd) if m == 4 else None if m == 5 else rng.random() for m in range(len(steps.METRICS))]) for i in range(150)]
    rows += [("few", 0.0, False, *[1.0] * len(steps.METRICS))] * 3 + [(None, 0.0, False, *[1.0] * len(steps.METRICS))] * 5
    table = spark.createDataFrame(rows, "run_id string, k double, excluded boolean, " + ", ".join(f"{m} double" for m in steps.METRICS)).cache()

    def got():
        return sorted(repr([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in steps.aggregate(table).collect())

    calls, mad = [], robust.mad
    monkeypatch.setattr(robust, "mad", lambda *a: calls.append(a) or mad(*a))
    at_once = got()
    assert len(at_once) == 21 * len(steps.METRICS) and not calls
    monkeypatch.setattr(ranks, "SMALL", 2)
    assert got() == at_once and calls
