"""Clusters by density, components and joins in crowded places, against plain loops."""

import numpy as np
import pytest
from geomill.kernels import density
from geomill.operators import detections as det
from geomill.operators import graph


def by_pairs(ids, at, eps, least):
    near = ((at[:, None] - at[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    name = np.where(core, ids, ids.max() + 1)
    while True:
        new = np.array([min(name[near[i] & core]) if core[i] else name[i] for i in range(len(ids))])
        if (new == name).all():
            break
        name = new
    return {int(ids[i]): (int(min(name[near[i] & core])) if (near[i] & core).any() else None) for i in range(len(ids))}


@pytest.mark.parametrize(("n", "wide", "eps", "least"), [(500, 400, 9.0, 4), (700, 160, 5.0, 6), (300, 60, 2.5, 1), (400, 30, 2.0, 9)])
def test_dbscan_against_all_pairs(spark, n, wide, eps, least):
    r = np.random.default_rng(n)
    at = np.floor(r.random((n, 2)) * wide * 2) / 2 - wide / 3  # some places hold several points, some lie below zero
    ids = r.permutation(n)
    rows = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in zip(ids, at, strict=True)] + [(n, None, 1.0), (n + 1, float("nan"), 1.0)], "id int, x double, y double")
    got = {r.id: r.cluster for r in det.dbscan(rows, eps, least).collect()}
    assert got == by_pairs(ids, at, eps, least) | {n: None, n + 1: None}


def test_dbscan_of_a_crowd(spark):
    """90 billion pairs lie within eps: they can't be written down."""
    rows = spark.range(300_000).selectExpr("id", "cast(id % 50 as double) AS x", "cast(id % 20 as double) AS y").union(spark.createDataFrame([(-5, 400.0, 0.0)], "id long, x double, y double"))
    got = det.dbscan(rows, 100.0, 4).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in got} == {0: 300_000, None: 1}


def test_merged_and_linked(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 3000, 2200), r.integers(0, 3000, 2200)
    want = list(range(3000))
    for i, j in zip(a, b, strict=True):
        i, j = want[i], want[j]
        if i != j:
            want = [min(i, j) if k == max(i, j) else k for k in want]
    assert density.merged(3000, a, b).tolist() == want
    edges = spark.createDataFrame([(f"é{i}" if i % 2 else str(i), f"é{j}" if j % 2 else str(j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)] + [(None, "1")], "a string, b string")
    one = sorted(map(tuple, graph.linked(edges).collect()))
    assert one == sorted(map(tuple, graph.linked(edges, few=10).collect())) and one


def test_cluster_shapes_of_a_crowd(spark):
    """One cluster of 200,000 members in 2,500 places, and one of two members that is too small for a shape."""
    rows = spark.range(200_000).selectExpr("id", "cast(id % 50 as double) AS x", "cast(floor(id / 50) % 50 as double) AS y", "0.5D AS confidence")
    rows = rows.union(spark.createDataFrame([(200_001, 900.0, 0.0, 0.1), (200_002, 901.0, 0.0, 0.1)], "id long, x double, y double, confidence double"))
    got = det.cluster_shapes(det.dbscan(rows, 60.0, 2)).collect()
    assert [(r.cluster, r.nb_detect, r.area_m2, len(r.hull)) for r in got] == [(0, 200_000, 49.0 * 49, 4)]


def test_run_clusters_of_a_crowd(spark):
    """A class of 200,000 detections in 2,500 places is one cluster, and another class does not see it."""
    rows = spark.range(200_000).selectExpr("id", "if(id = 7, 'b', 'a') AS class_name", "0.5D AS confidence", "cast(id % 50 as double) AS x", "cast(floor(id / 50) % 50 as double) AS y")
    shapes, tagged = det.run_clusters(rows, [{"target_classes": ["a"], "buffer_m": 0.0}, {"target_classes": ["b"], "min_cluster_size": 1, "min_samples": 2}])
    assert [(r.cluster_id, r.nb_detect, r.area_m2) for r in shapes.collect()] == [("cluster_a_0", 199_999, 49.0 * 49)]
    assert {r.cluster_id: r["count"] for r in tagged.groupBy("cluster_id").count().collect()} == {"cluster_a_0": 199_999, None: 1}
