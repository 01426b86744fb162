"""Simplification in rounds against the walk with a stack."""

import math
import random

import pytest

from chronoterra.operators import geometry, trajectory


@pytest.mark.parametrize(("tolerance", "walked"), [(0.0, 10_000), (0.05, 20)])
def test_rounds_keep_what_the_walk_keeps(spark, monkeypatch, tolerance, walked):
    monkeypatch.setattr(trajectory, "WALKED", walked)  # 20: long intervals are split in rounds first
    r = random.Random(4)
    paths = {
        1: [(t / 10, math.sin(t / 7) + r.gauss(0, 0.05)) for t in range(90)],
        2: [(t % 2, t % 3) for t in range(20)],
        3: [(1.0, 1.0), (2.0, 2.0)],
        4: [(5.0, 5.0)],
        5: [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)],  # ends where it begins
    }
    rows = [(k, float(i), i, float(x), float(y)) for k, p in paths.items() for i, (x, y) in enumerate(p)]
    rows += [(6, 0.0, 0, None, 1.0), (1, 1.5, 7, None, None)]
    r.shuffle(rows)
    fixes = spark.createDataFrame(rows, "traj long, ts double, seq long, lng double, lat double")
    got = {x.traj: x for x in trajectory.simplify(fixes, tolerance).collect()}
    assert set(got) == set(paths)
    for k, p in paths.items():
        want = geometry.simplified_path([(float(x), float(y)) for x, y in p], tolerance)
        assert [(q.x, q.y) for q in got[k].path] == want
        assert (got[k].before, got[k].after) == (len(p), len(want))


def test_fixes_of_one_time_and_none(spark):
    kind = "traj long, ts double, seq long, lng double, lat double"
    fixes = spark.createDataFrame([(1, 0.0, i, float(i), float(i % 2)) for i in range(6)], kind)
    assert [q.x for q in trajectory.simplify(fixes, 0.1).first().path] == [0, 1, 2, 3, 4, 5]
    assert trajectory.simplify(spark.createDataFrame([], kind)).collect() == []


def test_a_batch_of_paths_is_not_held_as_objects():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    x, y = r.random(200_000), r.random(200_000)
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    paths = pa.ListArray.from_arrays(pa.array(range(0, 200_001, 100), pa.int32()), points).slice(3)
    tracemalloc.start()
    got = trajectory._kept_inside(paths, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [geometry.kept_places(list(zip(x[i : i + 100], y[i : i + 100], strict=True)), 0.5)[1:-1] for i in range(300, 200_000, 100)]
    assert got.to_pylist() == want and peak < 10_000_000  # all positions as dicts take 48 MB
