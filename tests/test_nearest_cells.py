import numpy as np
import pyarrow as pa

from sensorloom.operators import series


def test_a_row_for_each_place_of_a_cell():
    """A cell's pairs are measured in parts; ties go to the first segment, whatever the order of the rows."""
    rng = np.random.default_rng(4)
    p, s = rng.random((23, 2)), rng.random((7, 4))
    s[3], s[5] = s[6], [0.2, 0.2, 0.2, 0.2]  # two equal ones, one without length
    points = pa.table({"run": ["a"] * 23, "x": p[:, 0], "y": p[:, 1]})
    segments = pa.table({"seg": [6, 5, 4, 3, 2, 1, 0], **{c: s[::-1, i] for i, c in enumerate(("x0", "y0", "x1", "y1"))}})
    got = series._nearest(points, segments, ["run", "x", "y"], "x", "y", "seg", most=20)
    for row, (x, y) in zip(got.to_pylist(), p):
        best = []
        for k, (x0, y0, x1, y1) in enumerate(s):
            d = (x1 - x0) ** 2 + (y1 - y0) ** 2
            u = min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / d)) if d else 0.0
            best.append(((x - x0 - u * (x1 - x0)) ** 2 + (y - y0 - u * (y1 - y0)) ** 2, k))
        assert abs(row["_d2"] - min(best)[0]) < 1e-12 and row["_o"] == min(best)[1] and row["_o"] != 6
    assert len(got) == 23 and len(series._nearest(points, segments.slice(0, 0), ["run", "x", "y"], "x", "y", "seg")) == 0
