import threading
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators import metrics
from latticework.plans import models, newton, within


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    n = 600
    frame = pd.DataFrame({
        "city_id": np.repeat(np.arange(1, 7), n // 6), "cell_id": np.tile(np.arange(n // 6), 6),
        "impervious_pct": rng.random(n) * 100, "elevation_m": rng.normal(100, 20, n),
        "land_cover_class": rng.choice([21, 22, 41], n), "climate_group": np.repeat(["hot_arid", "mild_cool"], n // 2),
        "centroid_lon": rng.random(n), "centroid_lat": rng.random(n),
    })
    chance = 1 / (1 + np.exp(-(frame.impervious_pct - 60) / 8))
    frame["hotspot_10pct"] = (rng.random(n) < chance).astype(int)
    df = spark.createDataFrame(frame)
    df = df.withColumn("elevation_m", F.when(F.col("cell_id") % 11 != 0, F.col("elevation_m")))
    folds = spark.createDataFrame([(c, c % 3) for c in range(1, 7)], "city_id int, outer_fold int")
    return frame, df.persist(), folds


FEATURES = ["impervious_pct", "elevation_m", "land_cover_class", "climate_group"]


def test_preprocessing_is_fitted_on_training_rows_only(spark, cells):
    _, df, _ = cells
    train = df.filter("city_id <= 3")
    prep = models.fit_preprocessing(train, FEATURES, "linear")
    names = models.feature_names(prep, FEATURES)
    assert names == ["impervious_pct", "elevation_m", "land_cover_class_21", "land_cover_class_22", "land_cover_class_41", "climate_group_hot_arid"]
    vectors = np.array([r.features.toArray() for r in prep.transform(train).select("features").collect()])
    assert np.allclose(vectors[:, :2].mean(0), 0, atol=1e-9) and np.allclose(vectors[:, :2].std(0), 1)
    unseen = np.array([r.features.toArray() for r in prep.transform(df.filter("city_id = 6")).select("features").collect()])
    assert (unseen[:, 5] == 0).all()  # a climate not seen in training is all zero
    crossed = models.fit_preprocessing(df, FEATURES, "linear", interact="climate_group")
    wide = models.feature_names(crossed, FEATURES)
    row = crossed.transform(df.filter("city_id = 1 and cell_id = 1")).first().features.toArray()
    assert len(wide) == len(row) and "elevation_m__x__climate_group_mild_cool" in wide
    at = dict(zip(wide, row))
    assert at["impervious_pct__x__climate_group_hot_arid"] == pytest.approx(at["impervious_pct"]) and at["impervious_pct__x__climate_group_mild_cool"] == 0
    forest = models.fit_preprocessing(train, FEATURES, "forest")
    codes = {r.o_t_climate_group for r in forest.transform(df).select("o_t_climate_group").distinct().collect()}
    assert codes == {0.0, -1.0}


@pytest.mark.parametrize("model, grid", [
    ("logistic_saga", [{"C": [1.0, 0.01], "l1_ratio": [0.0]}]),
    ("random_forest", [{"n_estimators": [10], "max_depth": [3], "max_features": ["sqrt"], "min_samples_leaf": [5]}]),
    ("hist_gradient_boosting", [{"learning_rate": [0.1], "max_leaf_nodes": [7], "min_samples_leaf": [5], "max_iter": [5]}]),
])
def test_nested_evaluation(spark, cells, tmp_path, model, grid):
    frame, df, folds = cells
    path = str(tmp_path / "predictions")
    scored, best = models.evaluate_model(df, folds, model, FEATURES, path, grid=grid, splits=2, selected=[0, 1])
    assert scored.count() == 400 and best.count() == 2
    assert {r.outer_fold for r in scored.select("outer_fold").distinct().collect()} == {0, 1}
    ap = metrics.average_precision(scored.withColumn("k", F.lit(1)), ["k"]).first().pr_auc
    assert ap > frame.hotspot_10pct.mean() + 0.2
    if model == "logistic_saga":
        fitted = []
        again, every = models.evaluate_model(df, folds, model, FEATURES, path, grid=grid, splits=2, on_fold=lambda fold, _: fitted.append(fold))
        assert fitted == [2] and again.count() == 600  # only the missing fold is fitted, the results are those of all folds
        columns = ["outer_fold", "best_params_json", "best_inner_cv_average_precision", "fit_seconds"]
        before, after = (sorted(map(tuple, t.select(columns).collect())) for t in (best, every))
        assert after[:2] == before and [r[0] for r in after] == [0, 1, 2] and all(r[1] for r in after)
        tables = models.evaluation_tables(again)
        assert tables["summary"].first().heldout_row_count == 600 and tables["by_city"].count() == 6 and tables["calibration"].count() > 10


@pytest.mark.parametrize("model, params", [("logistic_saga", {"C": [1.0], "max_iter": [5]}), ("random_forest", {"n_estimators": [2], "max_depth": [2]})])
def test_fitted_models_can_be_sent_after_a_tagged_job(spark, cells, model, params):
    _, df, _ = cells
    spark.addTag("any")  # the session then holds a thread local, which can't be serialized
    spark.removeTag("any")
    fitted, _, _, _ = models.grid_search(df, model, ["impervious_pct"], [params], 2)
    assert models.materialize(models.score(fitted, df)).filter("predicted_probability between 0 and 1").count() == 600


def test_logistic_matches_a_numpy_fit(spark, cells):
    frame, df, _ = cells
    prep = models.fit_preprocessing(df, ["impervious_pct"], "linear")
    data = prep.transform(df)
    fitted = models.classifier("logistic_saga", {"C": 0.5, "l1_ratio": 0.0, "tol": 1e-10}, len(frame), "hotspot_10pct").fit(data)
    x, y = frame.impervious_pct.to_numpy(), frame.hotspot_10pct.to_numpy()
    design = np.c_[np.ones(len(x)), (x - x.mean()) / x.std()]
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        penalty = np.diag([0, 1 / 0.5])
        beta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ beta)
    assert fitted.coefficients[0] == pytest.approx(beta[1], rel=1e-3) and fitted.intercept == pytest.approx(beta[0], rel=1e-3)


def test_grouped_newton_matches_numpy(spark, cells):
    frame, df, folds = cells
    rows = within.fold_rows(df, folds)
    assert all(r.overlapping_groups == 0 and r.train_groups == 4 for r in within.leak_check(rows).collect())
    scored, model = within.newton_run(df, folds, ["impervious_pct", "elevation_m"], ["climate_group"])
    assert scored.count() == 600 and all(r.converged or r.iterations == 6 for r in model.collect())
    local = df.toPandas()
    train = local[local.city_id % 3 != 0]
    columns = [np.ones(len(train))]
    for c in ("impervious_pct", "elevation_m"):
        v = train[c].astype(float)
        columns += [((v - v.mean()) / v.std(ddof=0)).fillna(0), v.isna().astype(float)]
    for level in ["__MISSING__", "__UNSEEN__", "hot_arid", "mild_cool"]:
        columns.append((train.climate_group == level).astype(float))
    x, y = np.column_stack(columns), train.hotspot_10pct.to_numpy()
    beta = np.zeros(x.shape[1])
    penalty = np.eye(len(beta))
    penalty[0, 0] = 0
    for _ in range(6):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        beta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + np.eye(len(beta)) * 1e-9, x.T @ (p - y) + penalty @ beta)
    got = {r.held_out: r.coefficients for r in model.collect()}[0]
    assert np.allclose(got, beta, atol=1e-6)


def test_stump_matches_a_search(spark, cells):
    frame, df, folds = cells
    scored, rule = within.stump_run(df, folds, 0, ["impervious_pct", "elevation_m"], ["climate_group"], min_leaf=20)
    r = rule.first()
    train = frame[frame.city_id % 3 != 0]
    z = (train.impervious_pct - train.impervious_pct.mean()) / train.impervious_pct.std(ddof=0)
    best = min(
        (sum(len(s) * (1 - s.mean() ** 2 - (1 - s.mean()) ** 2) for s in (train.hotspot_10pct[z <= t], train.hotspot_10pct[z > t])) / len(z), t)
        for t in np.quantile(z, np.arange(1, 10) / 10)
    )
    assert r.split_feature == "impervious_pct_zscore" and r.threshold == pytest.approx(best[1]) and r.sample_rows == 400
    assert scored.count() == 200 and {round(x.predicted_probability, 9) for x in scored.collect()} == {round(r.left_probability, 9), round(r.right_probability, 9)}


def test_within_group_and_spatial_runs(spark, cells):
    _, df, _ = cells
    out = within.within_group_run(df, ["impervious_pct"], [], cap=80, repeats=2).toPandas()
    assert len(out) == 6 * 2 * 2 and (out[out.model_name == "logistic"].pr_auc.mean() > out[out.model_name != "logistic"].pr_auc.mean())
    spatial = within.spatial_run(df, ["impervious_pct"], [], cap=80)
    assert spatial.select("held_out_block").distinct().count() == 4


def test_importance_and_packages(spark, cells, tmp_path):
    _, df, _ = cells
    path = str(tmp_path / "package")
    fitted = models.save_package(df, "logistic_saga", {"C": 1.0, "l1_ratio": 0.0}, FEATURES, path)
    rows = models.permutation_importance(fitted, df.filter("city_id <= 2"), FEATURES, 0, repeats=2).collect()
    drops = {r.feature_name: r.pr_auc_drop_mean for r in rows}
    assert max(drops, key=drops.get) == "impervious_pct" and drops["impervious_pct"] > 0.05 and len(drops) == 4
    coefficients = models.coefficient_table(fitted, FEATURES, 0)
    assert {c[2] for c in coefficients} == set(FEATURES)
    city = df.filter("city_id = 1").drop("hotspot_10pct")
    out = models.apply_package(spark, path, city)
    assert out["predictions"].count() == 100 and out["summary"].first().predicted_hotspot_count == 10 and out["deciles"].count() == 10
    with pytest.raises(ValueError, match="one city"):
        models.apply_package(spark, path, df.filter("city_id <= 2").withColumn("cell_id", F.col("city_id") * 1000 + F.col("cell_id")))


def test_baselines_run(spark, cells):
    frame, df, folds = cells
    scored = models.evaluate_baselines(df, folds)
    assert scored.count() == 4 * 600
    flat = scored.filter("model_name = 'global_mean_baseline'").groupBy("outer_fold").agg(F.countDistinct("predicted_probability").alias("n")).collect()
    assert all(r.n == 1 for r in flat)


def test_presets():
    splits, grid = models.tuning_preset("random_forest", "full")
    assert splits == 4 and len(models.grid_points(grid)) == 81
    assert len(models.grid_points(models.LOGISTIC_FULL)) == 20
    with pytest.raises(ValueError):
        models.tuning_preset("hist_gradient_boosting", "full")
    assert schema.split_features(FEATURES) == (FEATURES[:2], FEATURES[2:])


def test_stump_rules_of_all_folds_share_their_scans(spark, monkeypatch):
    """The rule of each fold is that of a run of its own, and the first rows per group are ranked once, not once per fold."""
    rng = np.random.default_rng(17)
    frame = pd.DataFrame({"city_id": np.arange(240) % 6, "cell_id": np.arange(240), "x": rng.normal(size=240), "k": [None, "a", "b"] * 80})
    frame["label"] = (frame.x + rng.normal(size=240) > 0).astype(int)
    df = spark.createDataFrame(frame)
    folds = spark.createDataFrame([(c, c % 3) for c in range(6)], "city_id long, outer_fold int")
    args = (["x"], ["k"], "label")
    want = {f: within.stump_run(df, folds, f, *args, per_group=30, min_leaf=5)[1].first() for f in range(3)}
    calls, plain = [], within.first_rows
    monkeypatch.setattr(within, "first_rows", lambda *a: calls.append(1) or plain(*a))
    got = {r["held_out"]: r for r in within.stump_rules(df, folds, *args, per_group=30, min_leaf=5).collect()}
    assert len(calls) == 1 and {f: tuple(r)[:-1] for f, r in got.items()} == {f: tuple(r) for f, r in want.items()}


def test_stump_rules_use_every_training_row(spark):
    """By default no row is left out: groups of more than 5,000 rows, where the last rows tell another rule than the first; equal to a search."""
    rng = np.random.default_rng(23)
    n = 4 * 5_600
    frame = pd.DataFrame({"city_id": np.arange(n) % 4, "cell_id": np.arange(n) // 4, "x": rng.normal(size=n).round(2), "z": rng.normal(size=n), "k": rng.choice(["a", "b"], n)})
    frame["label"] = np.where(frame.cell_id < 5_000, frame.x > 1.5, (frame.z > 0.2) ^ (rng.random(n) < 0.02)).astype(int)
    frame.loc[frame.cell_id % 7 == 0, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    folds = spark.createDataFrame([(c, c % 2) for c in range(4)], "city_id long, outer_fold int")
    got = {r["held_out"]: r for r in within.stump_rules(df, folds, ["x", "z"], ["k"], "label").collect()}
    gini = lambda s: 1 - s.mean() ** 2 - (1 - s.mean()) ** 2
    for fold in range(2):
        train = frame[frame.city_id % 2 != fold]
        found = []
        for c in ("x", "z"):
            v = ((train[c] - train[c].mean()) / train[c].std(ddof=0)).fillna(0.0)
            for t in np.quantile(v, np.arange(1, 10) / 10):
                left, right = train.label[v <= t], train.label[v > t]
                found.append(((len(left) * gini(left) + len(right) * gini(right)) / len(v), f"{c}_zscore", t, left.mean(), right.mean()))
        _, name, t, left, right = min(found)
        r = got[fold]
        assert r.sample_rows == len(train) == 11_200 and r.split_feature == name
        assert (r.threshold, r.left_probability, r.right_probability) == pytest.approx((t, left, right))


def test_newton_run_stores_rows_without_their_design(spark, monkeypatch):
    """Each step reads the stored rows again, so they hold a value per number and not one per design column."""
    rows = [(i % 4, i, float(i % 7) if i % 5 else None, "abc"[i % 3], int(i % 7 + i % 2 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "city_id long, cell_id long, x double, k string, label int")
    folds = spark.createDataFrame([(c, c % 2) for c in range(4)], "city_id long, outer_fold int")
    stored, plain = [], newton.materialize
    monkeypatch.setattr(newton, "materialize", lambda d: stored.append(d.columns) or plain(d))
    scored, _ = within.newton_run(df, folds, ["x"], ["k"], "label")
    assert scored.count() == 200 and stored and not any("_x" in columns for columns in stored)


def test_inner_folds_are_fitted_together(spark, cells, monkeypatch):
    """Every inner fold reaches its fit while the others wait there; scores and model are those of one fold after another."""
    barrier, calls, fit = threading.Barrier(2), [], models.fit_classifier

    def met(*args, **options):
        calls.append(1)
        if len(calls) <= 2:
            barrier.wait(60)
        return fit(*args, **options)

    monkeypatch.setattr(models, "fit_classifier", met)
    grid = [{"C": [1.0], "l1_ratio": [0.0], "max_iter": [5]}]
    found = [models.grid_search(cells[1], "logistic_saga", FEATURES, grid, 2)]
    monkeypatch.setattr(models, "fit_classifier", fit)
    monkeypatch.setattr(models, "TOGETHER", 1)
    found.append(models.grid_search(cells[1], "logistic_saga", FEATURES, grid, 2))
    together, apart = ([(r.inner_fold, round(r.average_precision, 9)) for r in table.orderBy("inner_fold").collect()] for _, table, _, _ in found)
    assert len(calls) == 3 and together == apart
    assert np.allclose(*[m.stages[-1].coefficients.toArray() for m, *_ in found], atol=1e-9)


def test_package_fit_reads_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    frame = spark.createDataFrame([(i, i % 2, float(i % 7), "ab"[i % 3 % 2]) for i in range(60)], "cell_id int, y int, v double, k string")
    types = {"v": "numeric", "k": "categorical"}
    models.save_package(frame.withColumn("v", counted.asNondeterministic()("v")), "logistic_saga", {"C": 1.0}, ["v", "k"], str(tmp_path), "y", types)
    assert seen.value == 60


def test_number_labels(spark):
    for kind, values in (("double", [0.0, 1.0, -0.0, float("nan"), None]), ("boolean", [True, False, None]), ("int", [0, 1, None]), ("decimal(3,1)", [Decimal(0), Decimal(1), None])):
        df = spark.createDataFrame([(v,) for v in values], f"y {kind}")
        for r in df.select(schema.number_label("y").alias("a"), schema.binary_label("y", "y").alias("b")).collect():
            assert r.a == r.b
    with pytest.raises(Exception, match="must be binary. Found: 2"):
        schema.drop_unlabelled(spark.createDataFrame([(2,)], "y int"), "y").collect()
