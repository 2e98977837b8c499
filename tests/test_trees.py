"""Grouped trees against trees grown by plain search."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.plans import trees

ORDERED, SETS = [0, 1], [2]


def table(seed=0, n=500, missing=0.1, fits=("a", "b")):
    rng, out = np.random.default_rng(seed), []
    for i, fit in enumerate(fits):
        x = rng.integers(0, 12, (n, 3))
        x[:, 2] = rng.integers(0, 6, n)
        x[:, :2][rng.random((n, 2)) < missing] = -1
        odds = (x[:, 0] > 5 + i) * 1.5 + np.isin(x[:, 2], [1, 4]) * 2.0 - (x[:, 1] < 0) - 1.2
        y = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(int)
        out += [(fit, k, int(y[k]), x[k].tolist()) for k in range(n)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "fit string, row long, y int, bins array<int>").repartition(3)


def best(x, a, b, l2, min_leaf, features):
    """(gain, feature, left bins, missing goes left), by trying every cut of every feature."""
    top = None
    for f in features:
        v = x[:, f]
        seen = sorted(set(v[v >= 0].tolist()))
        if f in SETS:
            seen.sort(key=lambda k: (a[v == k].sum() / (b[v == k].sum() + l2), k))
        for i in range(len(seen)):
            inside = np.isin(v, seen[: i + 1])
            lacking = v < 0
            for side in ([False, True] if lacking.any() else [None]):
                left = inside | lacking if side else inside
                if left.sum() < min_leaf or (~left).sum() < max(min_leaf, 1):
                    continue
                part = lambda m: a[m].sum() ** 2 / (b[m].sum() + l2)
                gain = part(left) + part(~left) - part(np.ones(len(a), bool))
                if gain > 1e-12 and (top is None or round(gain, 9) > round(top[0], 9)):
                    top = (gain, f, seen[: i + 1], bool(left.sum() > (~left).sum()) if side is None else side)
    return top


def goes(x, cut):
    _, f, bins, side = cut
    v = x[:, f]
    known = np.isin(v, bins) if f in SETS else v <= max(bins)
    return np.where(v < 0, side, known)


def grown(x, y, depth, min_leaf, node=1, level=0):
    out = {node: y.mean()}
    cut = best(x, y, np.ones(len(y)), 0.0, min_leaf, range(3)) if level < depth else None
    if cut:
        left = goes(x, cut)
        out |= grown(x[left], y[left], depth, min_leaf, 2 * node, level + 1) | grown(x[~left], y[~left], depth, min_leaf, 2 * node + 1, level + 1)
    return out


@pytest.mark.parametrize("depth,min_leaf", [(4, 5), (None, 60), (0, 1)])
def test_one_tree_per_fit(spark, depth, min_leaf):
    rows = table()
    fits = spark.createDataFrame([("a", 1, depth, min_leaf, 3), ("b", 1, depth, min_leaf, 3)], "fit string, n_trees int, max_depth int, min_leaf int, n_features int")
    data = frame(spark, rows)
    model = trees.grow_forest(data, fits, ["fit"], 3, "y", "row", SETS, bootstrap=False)
    scored = {(r.fit, r.row): r.predicted_probability for r in trees.predict(data, model, ["fit"], "row").collect()}
    for fit in "ab":
        mine = [r for r in rows if r[0] == fit]
        x, y = np.array([r[3] for r in mine]), np.array([float(r[2]) for r in mine])
        want = grown(x, y, 99 if depth is None else depth, min_leaf)
        got = {r.node: r.value for r in model.filter(F.col("fit") == fit).collect()}
        assert got == pytest.approx(want)
        cuts = {r.node: r for r in model.filter((F.col("fit") == fit) & F.col("feature").isNotNull()).collect()}
        for k, v in enumerate(x):  # walk the wanted tree by the stored splits
            node = 1
            while node in cuts:
                c = cuts[node]
                b = v[c.feature]
                left = c.missing_left if b < 0 else b in c.left_set if c.left_set is not None else b <= c.bin
                node = 2 * node + (not left)
            assert scored[fit, k] == pytest.approx(want[node])


def test_forest_of_drawn_rows_and_features(spark, monkeypatch):
    monkeypatch.setattr(trees, "CHUNK_ROWS", 100)
    rows = table(3, 800)
    fits = spark.createDataFrame([("a", 12, 6, 5, 1), ("b", 7, None, 5, 2)], "fit string, n_trees int, max_depth int, min_leaf int, n_features int")
    data = frame(spark, rows)
    model = trees.grow_forest(data.filter("row < 400"), fits, ["fit"], 3, "y", "row", SETS)
    roots = model.filter("node = 1").groupBy("fit").agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high"), F.countDistinct("feature").alias("f")).collect()
    assert {r.fit: r.n for r in roots} == {"a": 12, "b": 7} and all(330 < r.low < r.high < 470 for r in roots) and all(r.f > 1 for r in roots)
    out = trees.predict(data, model, ["fit"], "row").filter("row >= 400").toPandas()
    assert len(out) == 800 and out.predicted_probability.between(0, 1).all()
    assert all(g.predicted_probability[g.y == 1].mean() > g.predicted_probability[g.y == 0].mean() + 0.1 for _, g in out.groupby("fit"))
    again = trees.predict(data, trees.grow_forest(data.filter("row < 400"), fits, ["fit"], 3, "y", "row", SETS), ["fit"], "row").filter("row >= 400").toPandas()
    assert np.allclose(*[d.sort_values(["fit", "row"]).predicted_probability for d in (out, again)])
    other = trees.predict(data.withColumn("fit", F.lit("c")).limit(5), model, ["fit"], "row").collect()
    assert len(other) == 5 and all(r.predicted_probability is None for r in other)


def boosted(x, y, rounds, rate, leaves, min_leaf, l2):
    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        a, b = y - p, p * (1 - p)
        parts = {1: np.ones(len(y), bool)}
        cut = lambda m: best(x[m], a[m], b[m], l2, min_leaf, range(3))
        open_ = {1: cut(parts[1])}
        while len(parts) < leaves:
            node = max((n for n in open_ if open_[n]), key=lambda n: (round(open_[n][0], 9), -n), default=None)
            if node is None:
                break
            whole, found = parts.pop(node), open_.pop(node)
            left = np.zeros(len(y), bool)
            left[whole] = goes(x[whole], found)
            for child, m in ((2 * node, left), (2 * node + 1, whole & ~left)):
                parts[child], open_[child] = m, cut(m)
        for m in parts.values():
            raw[m] += rate * a[m].sum() / (b[m].sum() + l2)
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("leaves,l2,missing", [(5, 1.5, 0.15), (3, 0.0, 0.0)])
def test_boosting_equals_a_plain_search(spark, leaves, l2, missing):
    rows = table(5, 500, missing)
    settings = {"a": (2, 0.3, leaves, 20, l2), "b": (1, 0.1, leaves + 2, 10, l2)}
    fits = spark.createDataFrame([(k, *v) for k, v in settings.items()], "fit string, max_iter int, learning_rate double, max_leaf_nodes int, min_leaf int, l2 double")
    data = frame(spark, rows)
    model = trees.boost(data, fits, ["fit"], 3, "y", "row", SETS)
    got = {(r.fit, r.row): r.predicted_probability for r in trees.predict(data, model, ["fit"], "row", combine="boosted").collect()}
    for fit, (rounds, rate, most, least, l) in settings.items():
        mine = [r for r in rows if r[0] == fit]
        want = boosted(np.array([r[3] for r in mine]), np.array([float(r[2]) for r in mine]), rounds, rate, most, least, l)
        assert [got[fit, k] for k in range(len(mine))] == pytest.approx(want.tolist())
        leaf_counts = model.filter((F.col("fit") == fit) & (F.col("tree") >= 0) & F.col("feature").isNull()).groupBy("tree").count().collect()
        assert len(leaf_counts) == rounds and all(r["count"] <= most for r in leaf_counts)


def test_bins(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": ["u"] * 300 + ["v"] * 100, "x": rng.random(400), "c": rng.choice(["p", "q", "r"], 400), "train": [True] * 250 + [False] * 50 + [True] * 100})
    data.loc[::17, "x"] = None
    data.loc[data.g == "v", "c"] = "only"
    data.loc[260, "c"] = "strange"
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "g string, x double, c string, train boolean")
    got = trees.binned(df, "train", ["g"], ["x"], ["c"], bins=8).toPandas()
    for g, part in got.groupby("g"):
        known = data[(data.g == g) & data.train]
        edges = np.unique(np.quantile(known.x.dropna(), np.arange(1, 8) / 8))
        levels = sorted(set(known.c))
        for r in part.itertuples():
            if np.abs(edges - r.x).min() < 1e-9:  # the rounding of an edge decides
                continue
            x = -1 if math.isnan(r.x) else int((edges < r.x).sum())
            assert list(r.bins) == [x, levels.index(r.c) if r.c in levels else -1]
    filled = trees.binned(df, "train", ["g"], ["x"], ["c"], bins=8, impute=True, ordinal=True).toPandas()
    assert all(b[0] >= 0 and b[1] >= 0 for b in filled.bins)


def test_boosting_reads_rows_of_the_same_bins_once(spark, monkeypatch):
    """Copies of rows grow the same trees, but a round reads one row per fit, label and set of bins."""
    rng = np.random.default_rng(23)
    plain = [(0, i, int(rng.random() < 0.3 + 0.1 * (i % 5)), [int(i % 5), int(i % 3) - 1]) for i in range(90)]
    rows = [(f, i + 1000 * copy, y, bins) for f, i, y, bins in plain for copy in range(4)]
    df = spark.createDataFrame(rows, "fit int, row long, y int, bins array<int>")
    fits = spark.createDataFrame([(0, 2, 0.3, 4, 5, 1.0)], "fit int, max_iter int, learning_rate double, max_leaf_nodes int, min_leaf int, l2 double")
    sizes, stored = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda d: sizes.append(d.count() if "_raw" in d.columns else 0) or stored(d))
    once = trees.boost(trees.counted(df, ["fit"], "y"), fits, ["fit"], 2, "y", "row").select("tree", "node", F.round("value", 9), "feature", "bin")
    monkeypatch.setattr(trees, "counted", lambda d, *_: d.withColumn(trees.ROWS, F.lit(1)))
    distinct = len({(y, tuple(bins)) for _, _, y, bins in plain})
    assert max(sizes) == distinct
    every = trees.boost(df, fits, ["fit"], 2, "y", "row").select("tree", "node", F.round("value", 9), "feature", "bin")
    assert sorted(map(str, once.collect())) == sorted(map(str, every.collect())) and max(sizes) == len(rows)
