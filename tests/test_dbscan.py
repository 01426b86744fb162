"""Clusters by cells against all pairs."""

import random

import pytest

from chronoterra.operators import geometry, spatial


def brute(rows, eps, least):
    pts = [r for r in rows if r[1] is not None and r[2] is not None]
    near = {a[0]: [b[0] for b in pts if ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= eps] for a in pts}
    core = {a for a, n in near.items() if len(n) >= least}
    root = {a: a for a in core}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in core:
        for b in near[a]:
            if b in core:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((a, min(find(b) for b in near[a] if b in core)) for a in near if any(b in core for b in near[a]))


def clusters(spark, rows, eps, least):
    d = spark.createDataFrame(rows, "feature_id long, lng double, lat double")
    return sorted(map(tuple, spatial.dbscan(d, eps, least).select("feature_id", "cluster").collect()))


@pytest.mark.parametrize(("seed", "eps", "least", "crowded"), [(1, 0.8, 3, 20_000), (2, 1.5, 6, 5), (3, 0.5, 2, 20_000)])
def test_clusters_equal_brute_force(spark, monkeypatch, seed, eps, least, crowded):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    r = random.Random(seed)
    rows = [(i, r.uniform(-8, 8), r.uniform(-8, 8)) for i in range(120)]
    rows += [(200 + i, 3 + r.gauss(0, 0.4), -2 + r.gauss(0, 0.4)) for i in range(150)] + [(400 + i, -4.0, 4.0) for i in range(9)] + [(500, None, 1.0), (501, 2.0, None)]
    assert clusters(spark, rows, eps, least) == brute(rows, eps, least)


@pytest.mark.parametrize("halvings", [10, 1])
def test_dense_cells_that_barely_meet(spark, monkeypatch, halvings):
    monkeypatch.setattr(spatial, "HALVINGS", halvings)
    group = lambda first, x, y: [(first + i, x + i * 1e-5, y) for i in range(5)]
    rows = group(0, 0.0, 0.0) + group(10, 0.99999, 0.0) + group(20, 0.0, 1.00001) + group(30, 3.0, 3.0) + group(40, 3.9, 3.9)
    assert clusters(spark, rows, 1.0, 4) == brute(rows, 1.0, 4)


def test_a_crowded_cell_costs_no_square(spark):
    d = spark.range(60_000).selectExpr("id as feature_id", "(id % 300) * 1e-6 as lng", "(id / 300) * 1e-8 as lat")
    got = spatial.dbscan(d, 1.0, 5)
    assert got.count() == 60_000 and {r.cluster for r in got.select("cluster").distinct().collect()} == {0}


def test_no_points(spark):
    assert clusters(spark, [], 1.0, 3) == [] and clusters(spark, [(1, 0.0, 0.0)], 1.0, 2) == []


def test_the_hull_is_partial_before_it_is_one_task(spark):
    d = spark.range(0, 1000, 1, 4).selectExpr("id as feature_id", "cast(id % 17 as double) as lng", "cast(id % 13 as double) as lat")
    plan = geometry.convex_hull(d)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("MapInArrow") >= 2 and "SinglePartition" in plan
