from __future__ import annotations

import numpy as np
import pytest
from conftest import SF, same

from terravane.functions.eigen import with_smallest
from terravane.operators.delaunay import delaunay
from terravane.plans import registry

@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    same([r.asDict() for r in registry.QUERIES[name](spark, SF).collect()], registry.SQL[name], SF)


@pytest.mark.parametrize("name", ["baseline_pairs", "greedy_pairs"])
def test_no_point_is_paired_with_every_view(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_baseline_pairs_deals_tracks_and_pairs_once(spark):
    """Two shuffles, of elements by point and of pairs by images: every further one puts all pairs on disk again."""
    plan = registry.QUERIES["baseline_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_measured_bowl(spark):
    """The query over all positions against the bowl's volume, depth * pi * R^2 * (1/2 - 2/pi^2)."""
    truth = 6 * np.pi * 18**2 * (0.5 - 2 / np.pi**2)
    r = registry.QUERIES["prism_volume"](spark, SF).first()
    assert abs(r["cut_volume_m3"] - truth) < 0.01 * truth and r["fill_volume_m3"] < 0.01 * truth and r["datum"] == "rim_plane"
    p = registry.QUERIES["robust_plane"](spark, SF).first()
    assert abs(p["nx"] / p["nz"] + 0.05) < 1e-3 and p["n_kept"] > 0.9 * p["n"]


def test_smallest_eigenvector(spark):
    a = np.random.default_rng(1).normal(size=(20, 5, 3))
    m = [np.cov(x.T, bias=True) for x in a]
    rows = [(i, *map(float, (c[0, 0], c[0, 1], c[0, 2], c[1, 1], c[1, 2], c[2, 2]))) for i, c in enumerate(m)]
    df = spark.createDataFrame(rows, "i int, xx double, xy double, xz double, yy double, yz double, zz double")
    for r in with_smallest(df, ["xx", "xy", "xz", "yy", "yz", "zz"], ["nx", "ny", "nz"]).collect():
        want = np.linalg.eigh(m[r["i"]])[1][:, 0]
        assert abs(abs(want @ np.array([r["nx"], r["ny"], r["nz"]])) - 1) < 1e-6


def test_delaunay_covers_the_hull_with_empty_circles():
    p = np.random.default_rng(2).random((60, 2))
    t = delaunay(p)
    for a, b, c in p[t]:
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        s = [x @ x for x in (a, b, c)]
        o = np.array([(s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1])) / d, (s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])) / d])
        assert (np.linalg.norm(p - o, axis=1) >= np.linalg.norm(a - o) - 1e-9).all()
    assert len(delaunay(np.zeros((5, 2)))) == 0
