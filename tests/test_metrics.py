import numpy as np
import pandas as pd
import pytest

from latticework.operators import encode, folds, metrics, sample


def brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tp = np.cumsum(y)[last]
    recall, precision = tp / y.sum(), tp / (last + 1)
    return float(np.sum(np.diff(np.r_[0, recall]) * precision))


def brute_auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    p, n = y.sum(), len(y) - y.sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 700
    frame = pd.DataFrame({
        "city_id": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 5, n)), "cell_id": np.arange(n),
        "hotspot_10pct": (rng.random(n) < 0.3).astype(int),
        "predicted_probability": np.where(rng.random(n) < 0.4, 0.25, np.round(rng.random(n), 2)),
    })
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("slices", [100_000, 30])
def test_metrics_equal_brute_force(scored, slices):
    frame, df = scored
    for keys in (["city_id"], []):
        got = metrics.prediction_metrics(df, keys, slices=slices).toPandas()
        groups = frame.groupby("city_id") if keys else [(None, frame)]
        for name, part in groups:
            row = got[got.city_id == name].iloc[0] if keys else got.iloc[0]
            y, s = part.hotspot_10pct.to_numpy(), part.predicted_probability.to_numpy()
            assert row.pr_auc == pytest.approx(brute_ap(y, s), abs=1e-12)
            assert row.roc_auc == pytest.approx(brute_auc(y, s), abs=1e-12)
            top = part.sort_values(["predicted_probability", "city_id", "cell_id"], ascending=[False, True, True]).head(int(np.ceil(len(part) * 0.1)))
            assert row.recall_at_top_10pct == pytest.approx(top.hotspot_10pct.sum() / y.sum())


def test_single_class_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0.5), (1, 2, 1, 0.4), (2, 1, 0, 0.5), (None, 1, 1, 0.9), (None, 2, 0, 0.1)],
        "city_id int, cell_id int, hotspot_10pct int, predicted_probability double",
    )
    got = {r.city_id: r for r in metrics.prediction_metrics(df, ["city_id"]).collect()}
    assert got[1].pr_auc is None and got[2].recall_at_top_10pct is None and got[None].pr_auc == 1.0 and got[None].row_count == 2
    lenient = {r.city_id: r for r in metrics.prediction_metrics(df, ["city_id"], single_class="positives").collect()}
    assert lenient[1].pr_auc == 1.0 and lenient[2].pr_auc is None


def test_recall_fixture(spark):
    df = spark.createDataFrame(
        [(1, i, y, s) for i, (y, s) in enumerate(zip([1, 0, 1, 0, 1], [0.9, 0.2, 0.8, 0.1, 0.7]))],
        "city_id int, cell_id int, hotspot_10pct int, predicted_probability double",
    )
    assert metrics.prediction_metrics(df, [], fraction=0.4).first().recall_at_top_10pct == pytest.approx(2 / 3)


def test_map_labels_fixture(spark):
    df = spark.createDataFrame(
        [(1, i, y, s) for i, (y, s) in enumerate(zip([1, 0, 1, 0], [0.95, 0.60, 0.20, 0.10]))],
        "city_id int, cell_id int, hotspot_10pct int, predicted_probability double",
    )
    rows = metrics.map_labels(df, fraction=0.25).orderBy("cell_id").collect()
    assert [r.error_type for r in rows] == ["true_positive", "true_negative", "false_negative", "true_negative"]
    top = metrics.top_flags(
        spark.createDataFrame([(1, 0, i, v) for i, v in enumerate([5.0, 5.0, 4.0, 3.0, 2.0])], "g int, r int, c int, v double"),
        ["g"], "v", ["r", "c"], 0.4,
    ).orderBy("c").collect()
    assert [r.in_top for r in top] == [True, True, False, False, False]


@pytest.mark.parametrize("slices", [100_000, 50])
def test_spearman_and_calibration(scored, slices):
    frame, df = scored
    got = {r.city_id: r.spearman for r in metrics.spearman(df, ["city_id"], "predicted_probability", "hotspot_10pct", slices=slices).collect()}
    for name, part in frame.groupby("city_id"):
        want = np.corrcoef(part.predicted_probability.rank(), part.hotspot_10pct.rank())[0, 1]
        assert got[name] == pytest.approx(want, abs=1e-12)
    points = metrics.calibration(df, [], slices=slices).toPandas().sort_values("bin_index")
    s, y = frame.predicted_probability.to_numpy(), frame.hotspot_10pct.to_numpy()
    which = np.searchsorted(np.percentile(s, np.arange(1, 10) * 10), s)
    want = [(s[which == b].mean(), y[which == b].mean()) for b in np.unique(which)]
    assert np.allclose(points[["predicted_probability_mean", "observed_positive_rate"]].to_numpy(), want)
    assert points.bin_index.tolist() == list(range(len(want)))


def reference_allocation(n, p, wanted):
    """Plain statement of the allocation rule, used to check the column form."""
    size = min(wanted, n)
    if size <= 0:
        return 0, 0
    if n <= wanted or p in (0, n):
        return min(size, p), min(size, n - p)
    pos = max(1, round(size * (p / n)))
    neg = size - pos
    if neg <= 0:
        pos, neg = size - 1, 1
    pos, neg = min(pos, p), min(neg, n - p)
    while pos + neg < size and pos < p:
        pos += 1
    while pos + neg < size and neg < n - p:
        neg += 1
    return pos, neg


def test_sample_counts_and_determinism(spark):
    shapes = [(1, 100, 10), (2, 7, 3), (3, 50, 0), (4, 40, 40), (5, 200, 1), (6, 200, 199), (7, 90, 25)]
    rows = [(c, i, int(i < p)) for c, n, p in shapes for i in range(n)]
    df = spark.createDataFrame(rows, "city_id int, cell_id int, hotspot_10pct int")
    for wanted in (1, 5, 20):
        plan = {r.city_id: (r.positive_take, r.negative_take) for r in sample.sample_plan(df, wanted).collect()}
        assert plan == {c: reference_allocation(n, p, wanted) for c, n, p in shapes}
    for slices in (None, 15):
        drawn = sample.stratified_sample(df, 20, slices=slices)
        got = {(r.city_id, r.hotspot_10pct): r["count"] for r in drawn.groupBy("city_id", "hotspot_10pct").count().collect()}
        for c, n, p in shapes:
            assert (got.get((c, 1), 0), got.get((c, 0), 0)) == reference_allocation(n, p, 20)
        again = sample.stratified_sample(df.repartition(7), 20)
        assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))


def test_splits(spark):
    df = spark.createDataFrame([(1, i, int(i < 20)) for i in range(100)], "city_id int, cell_id int, hotspot_10pct int")
    rows = sample.stratified_splits(df, repeats=2).groupBy("repeat_id", "hotspot_10pct", "is_test").count().collect()
    assert {(r.repeat_id, r.hotspot_10pct, r.is_test): r["count"] for r in rows if r.is_test} == {
        (0, 0, True): 16, (0, 1, True): 4, (1, 0, True): 16, (1, 1, True): 4}


PUBLISHED = [
    (1, 3199440, 2), (2, 1779906, 0), (3, 1718669, 3), (4, 1336755, 4), (5, 738527, 4), (6, 1859393, 1), (7, 863557, 1),
    (8, 459104, 1), (9, 382964, 0), (10, 475828, 2), (11, 5054661, 2), (12, 1055916, 2), (13, 1481846, 0), (14, 700063, 3),
    (15, 2847118, 0), (16, 3635068, 3), (17, 1664542, 2), (18, 7081699, 0), (19, 1896996, 3), (20, 1680248, 4),
    (21, 2831875, 2), (22, 1496116, 1), (23, 1466276, 3), (24, 817627, 0), (25, 4736063, 4), (26, 1948679, 4),
    (27, 6722963, 1), (28, 2946162, 1), (29, 3702849, 4), (30, 4813984, 3),
]


def test_fold_assignment_gives_the_published_folds(spark):
    sizes = spark.createDataFrame([(c, n) for c, n, _ in PUBLISHED], "city_id int, row_count bigint")
    want = {c: f for c, _, f in PUBLISHED}
    assert {r.city_id: r.outer_fold for r in folds.balanced_folds(sizes).collect()} == want
    with pytest.raises(ValueError):
        folds.balanced_folds(sizes.limit(2), 3)


def test_fold_contract_and_split(spark):
    table = spark.createDataFrame([(1, 0), (2, 1)], "city_id int, outer_fold int")
    assert folds.requested_folds(folds.check_folds(table)) == [0, 1]
    with pytest.raises(ValueError, match="7"):
        folds.requested_folds(table, [0, 7])
    with pytest.raises(ValueError):
        folds.check_folds(table.filter("outer_fold = 0"))
    rows = spark.createDataFrame([(1,), (2,), (99,)], "city_id int")
    assert {r.city_id: r.outer_fold for r in folds.with_fold(rows, table).collect()} == {1: 0, 2: 1, 99: None}
    train, test = folds.train_test(rows, table, 0)
    assert [r.city_id for r in train.collect()] == [2] and [r.city_id for r in test.collect()] == [1]


def test_quadrant_fixture(spark):
    lon, lat = [-1.0, 1.0, -1.0, 1.0, 0.0], [-1.0, -1.0, 1.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(lon, lat))], "city_id int, cell_id int, centroid_lon double, centroid_lat double")
    placed = folds.spatial_blocks(df)
    assert [r.spatial_block_id for r in placed.orderBy("cell_id").collect()] == ["southwest", "southeast", "northwest", "northeast", "northeast"]
    assert folds.block_splits(placed).filter("is_test").count() == 5 and folds.block_splits(placed).count() == 20


@pytest.mark.parametrize("slices", [None, 20])
def test_baselines_match_a_loop_over_folds(spark, slices):
    rng = np.random.default_rng(2)
    n = 240
    frame = pd.DataFrame({
        "cell_id": np.arange(n), "outer_fold": rng.integers(0, 3, n), "y": (rng.random(n) < 0.3).astype(int),
        "cls": rng.choice(["a", "b", "c", None], n, p=[0.5, 0.3, 0.1, 0.1]), "x": np.round(rng.random(n) * 10, 1),
    })
    frame.loc[(frame.outer_fold == 0) & (frame.index % 9 == 0), "cls"] = "only_here"
    frame.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(frame.assign(x=frame.x.astype(object).where(frame.x.notna(), None)), "cell_id int, outer_fold int, y int, cls string, x double")
    got = encode.fold_baselines(df, "y", {"cat": "cls"}, {"bins": "x"}, bins=4, slices=slices).toPandas()
    wide = got.pivot(index="cell_id", columns="model_name", values="predicted_probability")
    for fold in range(3):
        train, test = frame[frame.outer_fold != fold], frame[frame.outer_fold == fold]
        mean = train.y.mean()
        cats = train.groupby(train.cls.fillna("__MISSING__")).y.mean()
        want_cat = test.cls.fillna("__MISSING__").map(cats).fillna(mean)
        edges = np.unique(np.quantile(train.x.dropna(), np.linspace(0, 1, 5)))
        edges[0], edges[-1] = edges[0] - 1e-9, edges[-1] + 1e-9
        bins = pd.cut(train.x, edges, labels=False, include_lowest=True)
        want_bin = pd.cut(test.x, edges, labels=False, include_lowest=True).map(train.groupby(bins).y.mean()).fillna(mean)
        part = wide.loc[test.cell_id]
        assert np.allclose(part["global_mean_baseline"], mean)
        assert np.allclose(part["cat"], want_cat) and np.allclose(part["bins"], want_bin)
