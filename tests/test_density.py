"""Density clustering against brute force, with every branch of the grid forced once."""

import math
import random

import numpy as np
import pytest

from patronage.operators import dbscan as module
from patronage.operators import places, segments
from patronage.operators.components import connected_components
from patronage.operators.dbscan import dbscan


def brute(points, eps, min_samples):
    """id -> cluster by the textbook definition; ids are processed in order."""
    ids = sorted(points)
    near = {i: [j for j in ids if math.dist(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= min_samples}
    label, number = {}, 0
    for i in ids:
        if i in core and i not in label:
            stack = [i]
            while stack:
                p = stack.pop()
                if p in label:
                    continue
                label[p] = number
                if p in core:
                    stack.extend(q for q in near[p] if q not in label)
            number += 1
    return {i: label.get(i, -1) for i in ids}, core


def run(spark, points, eps, min_samples, **options):
    d = len(next(iter(points.values())))
    names = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame([(i, *p) for i, p in points.items()],
                               "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    rows = dbscan(df, "id", names, eps, min_samples, scale=False, **options).collect()
    assert len(rows) == len(points)
    return {r.id: r.cluster for r in rows}, {r.id for r in rows if r.is_core}


def test_two_groups_and_a_far_point(spark):
    points = {i: (0.1 * i, 0.0) for i in range(5)}
    points.update({5 + i: (9.0, 9.0 + 0.1 * i) for i in range(5)})
    points[10] = (50.0, -50.0)
    got, core = run(spark, points, 0.5, 5)
    assert got == {**{i: 0 for i in range(5)}, **{i: 1 for i in range(5, 10)}, 10: -1}
    assert core == set(range(10))


def blobs(seed, d, n):
    rng = random.Random(seed)
    centers = [[rng.uniform(-3, 3) for _ in range(d)] for _ in range(4)]
    return {i: tuple(rng.gauss(c, 0.5) for c in centers[i % 4]) if i % 5 else
            tuple(rng.uniform(-4, 4) for _ in range(d)) for i in range(n)}


@pytest.mark.parametrize("d,eps,min_samples", [(2, 0.3, 5), (4, 0.9, 4)])
def test_matches_brute_force(spark, d, eps, min_samples):
    points = blobs(d, d, 300)
    assert run(spark, points, eps, min_samples) == brute(points, eps, min_samples)


def crowd():
    """A third of all points on one spot, dense and thin areas, and a bridge of border points."""
    rng = random.Random(3)
    points = {i: (1.0, 1.0) for i in range(200)}
    for i in range(200, 400):
        points[i] = (rng.uniform(0, 2.2), rng.uniform(0, 2.2))
    for i in range(400, 500):
        points[i] = (rng.uniform(2.9, 3.4), rng.uniform(0, 1))
    for i in range(500, 600):
        points[i] = (rng.uniform(-6, 9), rng.uniform(-6, 9))
    return points


@pytest.mark.parametrize("eps", [0.25, 0.9])
def test_hot_cells_are_salted_and_split(spark, monkeypatch, eps):
    """Tiny limits: many hot cells, many chunks, and crowded cell pairs split repeatedly."""
    monkeypatch.setattr(module, "CHUNK_ROWS", 7)
    monkeypatch.setattr(module, "MAX_HOT_CELLS", 50)
    monkeypatch.setattr(module, "DIRECT_PAIRS", 4)
    points = crowd()
    assert run(spark, points, eps, 6) == brute(points, eps, 6)


def test_distance_equal_to_eps_counts(spark):
    points = {i: (float(i), 0.0) for i in range(6)}
    assert run(spark, points, 1.0, 3) == brute(points, 1.0, 3)


def test_everything_noise(spark):
    points = {i: (float(10 * i), 0.0) for i in range(4)}
    got, core = run(spark, points, 1.0, 2)
    assert set(got.values()) == {-1} and not core


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1200)] + [(5000, 5001)]
    found = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 200, 301]
    assert all(root in nodes for root, nodes in groups.items())


def test_plan_has_no_all_pairs_join(spark, folder):
    from patronage.plans.catalog import QUERIES
    plan = QUERIES["dbscan_clusters"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_anomaly_summary(spark):
    df = spark.createDataFrame([(1, -1, 30.0, 1.0), (2, 0, 10.0, 1.0), (3, 0, 10.0, 1.0), (4, 1, 10.0, 1.0)],
                               "id bigint, cluster int, x double, y double")
    r = segments.anomaly_summary(df).first()
    assert (r.total_customers, r.n_outliers, r.n_clusters, r.outlier_percentage) == (4, 1, 2, 25.0)
    rows = segments.outlier_characteristics(df, ["x", "y"]).collect()
    assert [(r.feature, r.diff_pct) for r in rows] == [("x", 200.0)]
    assert [r.id for r in segments.outlier_sample(df, "id").collect()] == [1]
    none = segments.anomaly_summary(df.filter("cluster >= 0")).first()
    assert (none.n_outliers, none.outlier_percentage) == (0, 0.0)


def spread_out(seed, n):
    """Twelve features: groups on lower-dimensional shapes, scattered points, copies of one point."""
    rng = random.Random(seed)
    points = {}
    for i in range(n):
        if i % 6 == 0:
            points[i] = tuple(rng.uniform(-2, 2) for _ in range(12))
        elif i % 6 == 1:
            points[i] = (0.5,) * 12
        else:
            t, group = rng.uniform(0, 3), i % 4
            points[i] = tuple(math.sin(t + 0.4 * j + group) + 2 * (group == j % 4) + rng.gauss(0, 0.08)
                              for j in range(12))
    return points


@pytest.mark.parametrize("eps,min_samples", [(0.6, 5), (1.0, 8), (0.3, 3)])
def test_twelve_features_match_brute_force(spark, eps, min_samples):
    points = spread_out(int(10 * eps), 360)
    labels, core = brute(points, eps, min_samples)
    assert run(spark, points, eps, min_samples) == (labels, core)
    assert len(set(labels.values())) > 2


def test_pivots_and_grid_agree(spark):
    points = blobs(9, 3, 300)
    want = brute(points, 0.6, 4)
    assert run(spark, points, 0.6, 4, pivots=True) == run(spark, points, 0.6, 4, pivots=False) == want


def test_full_partitions_are_split(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK_ROWS", 10)
    monkeypatch.setattr(module, "MAX_HOT_CELLS", 50)
    monkeypatch.setattr(module, "MOST_PIVOTS", 2)
    points = spread_out(4, 240)
    assert run(spark, points, 0.7, 5) == brute(points, 0.7, 5)


def test_met_balls_hold_all_near_pairs_once(spark):
    points = spread_out(8, 300)
    df = spark.createDataFrame([(i, *p) for i, p in points.items()],
                               "_id bigint, " + ", ".join(f"x{j} double" for j in range(12)))
    grid = module._Grid(df, 12, 0.8, 5)
    met = [tuple(sorted((r.a_cell, r.b_cell))) for r in grid.met_balls().select(
        "a_cell", "b_cell").collect()]
    assert len(met) == len(set(met))
    near = {tuple(sorted((r.a, r.b))) for r in grid.near_balls().select("a", "b").collect()}
    cells = {r["cell"]: (r["lo"], r["hi"]) for r in grid.cells.selectExpr(
        "cell", "array(" + ",".join(f"lo{j}" for j in range(12)) + ") AS lo",
        "array(" + ",".join(f"hi{j}" for j in range(12)) + ") AS hi").collect()}

    def gap(a, b):
        return math.sqrt(sum(max(p - q, r - s, 0) ** 2 for p, q, r, s in zip(
            cells[a][0], cells[b][1], cells[b][0], cells[a][1])))

    names = sorted(cells)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if gap(a, b) <= 0.8}
    assert near == want and near <= set(met)
    assert len(met) < len(names) * (len(names) - 1) / 2


def test_met_balls_become_rows_only_when_near(spark, monkeypatch):
    """Far from the origin, compared in small blocks: no row for a pair that the boxes rule out."""
    monkeypatch.setattr(module, "MET_PAIRS", 64)
    points = {i: tuple(x + 1e5 for x in p) for i, p in spread_out(5, 240).items()}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()],
                               "_id bigint, " + ", ".join(f"x{j} double" for j in range(12)))
    grid = module._Grid(df, 12, 0.8, 5)
    met = grid.met_balls().select("a_cell", "b_cell").collect()
    near = grid.near_balls().count()
    assert near == len({tuple(sorted(r)) for r in met}) == len(met) > 100
    assert run(spark, points, 0.8, 5) == brute(points, 0.8, 5)


def small_places(monkeypatch, rows=30, sent=2):
    monkeypatch.setattr(places, "PLACE_ROWS", rows)
    monkeypatch.setattr(places, "SENT", sent)
    monkeypatch.setattr(places, "HOT_PARTS", 3)


@pytest.mark.parametrize("rows,eps,min_samples", [(30, 0.6, 5), (8, 0.3, 3)])
def test_many_places_match_brute_force(spark, monkeypatch, rows, eps, min_samples):
    """With eight rows to a place, the copies of one point are dealt to several."""
    small_places(monkeypatch, rows)
    points = spread_out(int(10 * eps), 360)
    assert run(spark, points, eps, min_samples) == brute(points, eps, min_samples)


def test_large_parts_apart_and_a_distance_of_eps(spark, monkeypatch):
    """Parts that touch in one pair of points only, which the few that are sent first do not show."""
    small_places(monkeypatch, rows=25, sent=1)
    points = {3 * i + k: (0.25 * i, 40.0 * k, 0.0, 0.0, 0.0, 0.0) for i in range(60) for k in range(3)}
    points[900] = (0.0, -0.5, 0.0, 0.0, 0.0, 0.0)
    assert run(spark, points, 0.5, 3) == brute(points, 0.5, 3)


def test_no_pair_becomes_a_row(spark, monkeypatch):
    """Everything is near everything; what meets is joined by few edges, and nobody writes neighbours."""
    small_places(monkeypatch, rows=50, sent=64)
    written = []
    monkeypatch.setattr(places, "settle", lambda df: written.append(module.settle(df)) or written[-1])
    rng = random.Random(6)
    points = {i: tuple(rng.gauss(0, 0.05) for _ in range(7)) for i in range(400)}
    got, core = run(spark, points, 2.0, 5)
    assert set(got.values()) == {0} and len(core) == 400
    for df in written:
        assert df.count() <= 400
        if "arms" in df.columns:
            assert df.selectExpr("max(size(arms))").first()[0] in (0, None)


def test_near_is_exact_and_places_agree_with_it(monkeypatch):
    monkeypatch.setattr(places, "BLOCK_ROWS", 16)
    pick = np.random.default_rng(2)
    x = np.concatenate([pick.integers(0, 4, (150, 6)) * 0.5, np.full((40, 6), 0.5)]) + 1e4
    x = np.concatenate([x, [[1e300] * 6, [1e300] * 6]])
    want = np.zeros((len(x), len(x)), bool)
    with np.errstate(all="ignore"):
        for j in range(len(x)):
            want[:, j] = sum((x[:, f] - x[j, f]) ** 2 for f in range(6)) <= 1.0
    assert (places.near(x, x, 1.0) == want).all()
    place = places.Place(x, 1.0)
    assert sorted(np.concatenate(place.blocks).tolist()) == list(range(len(x)))
    found, _, i, j = place.judge(np.zeros(len(x), bool), 8)
    assert ((found >= 8) == (want.sum(1) >= 8)).all()
    few = np.flatnonzero(want.sum(1) < 8)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in few.tolist() for b in np.flatnonzero(want[a]).tolist()}
    label, reach = place.components(), np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(np.float32) @ (reach | want).astype(np.float32)) > 0
    assert ((label[:, None] == label) == reach).all()
    # Without a key only the points of one's own cell count.
    found, same, _, _ = place.around(x[:5], np.ones(5, bool), np.zeros(5, np.int64), 1000)
    assert (found == same).all() and (found <= want[:5].sum(1)).all()
