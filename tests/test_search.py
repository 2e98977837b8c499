"""Searches over many units at once: elastic nets against plain proximal gradients, and the choice of parameters."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework import session
from latticework.plans import elastic, search, within


def rows_of(units=2, n=160, seed=0):
    rng, out = np.random.default_rng(seed), []
    for u in range(units):
        x = rng.normal(size=(n, 3))
        z = 1.5 * x[:, 0] - (0.8 + u) * x[:, 1] - 0.7
        y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
        out += [(u, u * 1000 + k, *map(float, x[k]), rng.choice(["p", "q"]), int(y[k]), float(k % 13), float(k % 7)) for k in range(n)]
    return out


SCHEMA = "city_id int, cell_id long, a double, b double, c double, kind string, hotspot_10pct int, centroid_lon double, centroid_lat double"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


def proximal(x, y, l1, l2, steps=20_000):
    b, rate = np.zeros(x.shape[1]), 4 / np.linalg.eigvalsh(x.T @ x)[-1]
    keep = np.append(0.0, np.ones(len(b) - 1))
    for _ in range(steps):
        b = b - rate * (x.T @ (1 / (1 + np.exp(-x @ b)) - y) + l2 * keep * b)
        b[1:] = np.sign(b[1:]) * np.maximum(np.abs(b[1:]) - rate * l1, 0)
    return b


@pytest.mark.parametrize("bound", [200_000, 1])
def test_elastic_nets_are_optimal(spark, monkeypatch, bound):
    """Also where the table of coefficients is too large for one task."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", bound)
    candidates = [{"C": 1.0, "l1_ratio": 1.0}, {"C": 0.1, "l1_ratio": 0.5}, {"C": 10.0, "l1_ratio": 0.0}, {"C": 0.001, "l1_ratio": 1.0}]
    data = rows_of()
    frame = spark.createDataFrame([(r[0], r[1] % 3, r[6], [1.0, *r[2:5]]) for r in data], "_unit long, _inner int, y int, _x array<double>").repartition(5)
    got = {(r["_unit"], r.candidate, r.inner_fold): (np.array(r.coefficients), r.residual) for r in elastic.fit(frame, candidates, [0, 1, 2, -1], "y").collect()}
    assert len(got) == 2 * 4 * 4 and all(residual <= elastic.TOLERANCE for _, residual in got.values())
    for (unit, c, fold), (b, _) in got.items():
        if fold not in (1, -1) or bound == 1:
            continue
        mine = [r for r in data if r[0] == unit and r[1] % 3 != fold]
        want = proximal(np.array([[1.0, *r[2:5]] for r in mine]), np.array([r[6] for r in mine], float), *elastic.penalties(candidates[c]))
        assert np.allclose(b, want, atol=1e-4) and ((b == 0) == (np.abs(want) < 1e-12)).all()
        assert c != 3 or not b[1:].any()


def test_halving_of_bad_steps(spark):
    """Nearly separable rows, on which plain Newton steps overshoot."""
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(60), rng.normal(size=60) * 50])
    y = (x[:, 1] + rng.normal(size=60) * 5 > 0).astype(int)
    frame = spark.createDataFrame([(0, 0, int(b), a.tolist()) for a, b in zip(x, y)], "_unit long, _inner int, y int, _x array<double>")
    assert elastic.fit(frame, [{"C": 100.0, "l1_ratio": 0.1}], [-1], "y", 60).first().residual <= elastic.TOLERANCE


def test_stratified_inner_folds(spark, cells):
    got = search.stratified_inner(cells, ["city_id"], 4).groupBy("city_id", "hotspot_10pct", "_inner").count().toPandas()
    spread = got.groupby(["city_id", "hotspot_10pct"])["count"]
    assert (spread.max() - spread.min() <= 1).all() and (spread.size() == 4).all()
    few = cells.filter("city_id = 1 or hotspot_10pct = 0 or cell_id % 1000 < 9")
    assert search.stratified_inner(few, ["city_id"], 200).filter("city_id = 0").agg(F.max("_inner")).first()[0] + 1 == few.filter("city_id = 0 and hotspot_10pct = 1").count()
    with pytest.raises(Exception, match="two rows of each class"):
        search.stratified_inner(cells.filter("hotspot_10pct = 0"), ["city_id"], 3).collect()


@pytest.mark.parametrize("family,grid", [
    ("random_forest", [{"n_estimators": [4], "max_depth": [0, 3], "max_features": [None], "min_samples_leaf": [5]}]),
    ("logistic_saga", [{"C": [1e-6, 1.0], "l1_ratio": [0.5]}]),
])
def test_the_better_candidate_is_chosen(spark, cells, family, grid):
    out, table = within.within_group_search(cells, family, ["a", "b", "c"], ["kind"], grid=grid, splits=3, cap=100, repeats=1)
    table = table.toPandas()
    assert len(table) == 4 and table[table.chosen].candidate.tolist() == [1, 1]
    for _, t in table.groupby("city_id"):
        assert t.set_index("candidate").mean_average_precision[1] > t.set_index("candidate").mean_average_precision[0] + 0.1
    assert {json.loads(p).get("max_depth", json.loads(p).get("C")) for p in table[table.chosen].params} <= {3, 1.0}
    metrics = out.toPandas()
    tests = {u: sum(max(1, round(0.2 * n)) for n in counts) for u, counts in ((u, [sum(r[6] == y for r in rows_of() if r[0] == u) for y in (0, 1)]) for u in (0, 1))}
    assert all(r.row_count == tests[r.city_id] for r in metrics.itertuples()) and len(metrics) == 4
    model, base = (metrics[(metrics.model_name == family) == side].roc_auc.mean() for side in (True, False))
    assert model > 0.6 and (math.isclose(base, 0.5) or model > base)


def test_held_out_boosting(spark):
    frame = spark.createDataFrame(rows_of(4, 90), SCHEMA)
    folds = spark.createDataFrame([(u, u % 2) for u in range(4)], "city_id int, outer_fold int")
    grid = [{"learning_rate": [0.3], "max_leaf_nodes": [2, 4], "min_samples_leaf": [5], "max_iter": [1], "l2_regularization": [1.0]}]
    scored, table = within.held_out_search(frame, folds, "hist_gradient_boosting", ["a", "b", "c"], ["kind"], grid=grid, splits=2)
    out = scored.toPandas()
    assert len(out) == 360 and out.cell_id.is_unique and (out.outer_fold == out.city_id % 2).all() and out.predicted_probability.between(0, 1).all()
    assert out[out.hotspot_10pct == 1].predicted_probability.mean() > out[out.hotspot_10pct == 0].predicted_probability.mean()
    assert table.count() == 4 and table.filter("chosen").count() == 2 and table.filter("inner_folds = 2").count() == 4


@pytest.mark.parametrize("l1, l2", [(0.0, 1.0), (0.5, 0.5), (500.0, 500.0)])
def test_descent_is_optimal_with_many_rows_and_dependent_entries(l1, l2):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3)), np.eye(5)[rng.integers(0, 5, 400)]], 1)  # the last five add up to the first
    hessian, slope = x.T @ x * 20_000, x.T @ rng.normal(size=400) * 20_000  # as of 8 million rows
    start = np.zeros(x.shape[1])
    b = elastic.descend(hessian, slope, start, l1, l2)
    assert elastic.unmet(slope + hessian @ b, b, l1, l2) < 1e-6
