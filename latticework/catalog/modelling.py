"""Models on the order cells: label = finished orders, groups = nations. No SQL form; checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog.base import CELLS, cells, rounded, scratch, table
from latticework.operators import metrics
from latticework.plans import models, within

QUERIES, SQL = {}, {}
TYPES = {"lst": "numeric", "lon": "numeric", "passes": "numeric", "klass": "categorical", "climate_group": "categorical"}
FEATURES = list(TYPES)


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rows(spark, folder):
    """Label from value and balance with noise from a hash of the key, so classes overlap."""
    noise = F.pmod(F.xxhash64("cell_id"), F.lit(300_000))
    return cells(spark, folder).withColumn("label", (F.col("lst") + 20 * F.col("lon") + noise > 500_000).cast("int"))


def folds(spark, folder, k=2):
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("city_id"), (F.col("n_nationkey") % k).alias("outer_fold"))


def _heldout(spark, folder, model, grid):
    scored, _ = models.evaluate_model(rows(spark, folder), folds(spark, folder), model, FEATURES, grid=grid, splits=2, label="label", types=TYPES)
    return rounded(metrics.prediction_metrics(scored, ["model_name", "outer_fold"], "label", ties=("city_id", "cell_id")))


@query("m1_m2_m6_logistic_heldout")
def logistic(spark, folder):
    return _heldout(spark, folder, "logistic_saga", [{"C": [0.1, 1.0], "l1_ratio": [0.0], "max_iter": [30]}])


@query("m3_logistic_interactions_heldout")
def interactions(spark, folder):
    return _heldout(spark, folder, "logistic_saga_climate_interactions", [{"C": [1.0], "l1_ratio": [0.5], "max_iter": [20]}])


@query("m4_random_forest_heldout")
def forest(spark, folder):
    return _heldout(spark, folder, "random_forest", [{"n_estimators": [10], "max_depth": [5], "max_features": ["sqrt"], "min_samples_leaf": [5]}])


@query("m5_boosted_trees_heldout")
def boosting(spark, folder):
    return _heldout(spark, folder, "hist_gradient_boosting", [{"learning_rate": [0.1], "max_leaf_nodes": [15], "min_samples_leaf": [20], "max_iter": [5]}])


@query("m8_newton_logistic_all_folds")
def newton(spark, folder):
    scored, _ = within.newton_run(rows(spark, folder), folds(spark, folder, 5), ["lst", "lon", "passes"], ["klass", "climate_group"], "label")
    return rounded(metrics.prediction_metrics(scored, ["outer_fold"], "label", ties=("city_id", "cell_id"), single_class="positives"), 4)


@query("m9_decision_stump")
def stump(spark, folder):
    """The rule of every fold."""
    return rounded(within.stump_rules(rows(spark, folder), folds(spark, folder, 5), ["lst", "lon"], ["climate_group"], "label"), 4)


@query("m6_heldout_rows", f"""WITH {CELLS}, r AS (SELECT city_id, cell_id, city_id % 2 AS outer_fold FROM cells)
SELECT CAST(outer_fold AS INTEGER) AS outer_fold, count(*) AS row_count, count(DISTINCT cell_id) AS cells, count(DISTINCT city_id) AS cities, 0 AS unscored FROM r GROUP BY 1""")
def heldout_rows(spark, folder):
    """Every row of every group is scored once, by the model of the fold that holds its group out."""
    grid = [{"C": [1.0], "l1_ratio": [0.0], "max_iter": [5]}]
    scored, _ = models.evaluate_model(rows(spark, folder), folds(spark, folder), "logistic_saga", FEATURES, grid=grid, splits=2, label="label", types=TYPES)
    missing = F.count_if(F.col("predicted_probability").isNull() | ~F.col("predicted_probability").between(0, 1)).cast("int")
    return scored.groupBy(F.col("outer_fold").cast("int").alias("outer_fold")).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("cell_id").alias("cells"), F.countDistinct("city_id").alias("cities"), missing.alias("unscored"))


@query("m10_leak_check", f"""WITH {CELLS}, r AS (SELECT city_id % 5 AS f FROM cells), k AS (SELECT f, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(f AS INT) AS held_out, 20 AS train_groups, 5 AS test_groups, CAST(sum(n) OVER () - n AS BIGINT) AS train_rows, n AS test_rows, 0 AS overlapping_groups FROM k""")
def leaks(spark, folder):
    counts = cells(spark, folder).groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))
    return within.leak_check(within.fold_rows(counts, folds(spark, folder, 5)))


@query("m11_within_group_models")
def within_group(spark, folder):
    return rounded(within.within_group_run(rows(spark, folder), ["lst", "lon"], [], 500, 2, label="label"), 4)


@query("m12_spatial_block_models")
def spatial(spark, folder):
    return rounded(within.spatial_run(rows(spark, folder), ["lst", "lon"], [], 500, label="label", lon="lon", lat="lat"), 4)


FOREST_GRID = [{"n_estimators": [5], "max_depth": [2, 4], "max_features": ["sqrt"], "min_samples_leaf": [5]}]


def _told(out):
    """What SQL can tell of a run: held-out rows, positives and prevalence of the model and its baseline."""
    return out.select(*[c for c in out.columns if c in ("city_id", "repeat_id", "held_out_block", "model_name")], "row_count", "positive_count", "prevalence")


COUNTS_SQL = f"""WITH {CELLS}, r AS (
  SELECT city_id, cell_id, CASE WHEN cell_id % 3 = 0 OR lst > 200000 THEN 1 ELSE 0 END AS label FROM cells),
c AS (SELECT city_id, label, greatest(1, CAST(round_even(0.2 * count(*), 0) AS BIGINT)) AS n FROM r GROUP BY 1, 2)
SELECT city_id, repeat_id, model_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n * label) AS BIGINT) AS positive_count, round(sum(n * label) / sum(n), 6) AS prevalence,
  2 AS candidates, 1 AS chosen
FROM c, (VALUES (0), (1)) t(repeat_id), (VALUES ('random_forest'), ('city_prevalence_baseline')) m(model_name) GROUP BY ALL"""
HELD_OUT_SQL = f"""WITH {CELLS}, r AS (SELECT city_id, cell_id, city_id % 2 AS outer_fold FROM cells)
SELECT CAST(outer_fold AS INTEGER) AS outer_fold, count(*) AS row_count, count(DISTINCT cell_id) AS cells, count(DISTINCT city_id) AS cities, 0 AS unscored, FITS AS optimal, 1 AS chosen
FROM r GROUP BY 1"""


def _counts(spark, folder, family, grid):
    data = cells(spark, folder).withColumn("label", ((F.col("cell_id") % 3 == 0) | (F.col("lst") > 200_000)).cast("int"))
    out, table = within.within_group_search(data, family, ["lst", "lon", "passes"], ["klass", "climate_group"], grid=grid, splits=2, cap=300, repeats=2, label="label")
    good = F.col("residual") <= 1e-4 if "residual" in table.columns else F.lit(True)
    searched = table.groupBy("city_id", "repeat_id").agg(F.count_if(good).alias("candidates"), F.count_if("chosen").alias("chosen"))
    return rounded(_told(out)).join(searched, ["city_id", "repeat_id"])


def _covered(scored):
    missing = F.count_if(F.col("predicted_probability").isNull() | ~F.col("predicted_probability").between(0, 1)).cast("int")
    return scored.groupBy(F.col("outer_fold").cast("int").alias("outer_fold")).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("cell_id").alias("cells"), F.countDistinct("city_id").alias("cities"), missing.alias("unscored"))


@query("m11_forest_search_counts", COUNTS_SQL)
def forest_counts(spark, folder):
    """Forests inside each nation with an inner search, two repeats: the held-out rows of both models."""
    return _counts(spark, folder, "random_forest", FOREST_GRID)


@query("m11_elastic_search_counts", COUNTS_SQL.replace("random_forest", "logistic_saga"))
def elastic_counts(spark, folder):
    """Elastic nets inside each nation with an inner search: held-out rows, and that every fit of the search is optimal."""
    return _counts(spark, folder, "logistic_saga", [{"C": [0.1, 1.0], "l1_ratio": [0.5]}])


@query("m2_m6_elastic_net_folds", HELD_OUT_SQL.replace("FITS", "4"))
def elastic_folds(spark, folder):
    """Elastic nets of all held-out folds, inner folds and candidates in one loop of scans."""
    scored, table = within.held_out_search(
        rows(spark, folder), folds(spark, folder), "logistic_saga", ["lst", "lon", "passes"], ["klass", "climate_group"],
        grid=[{"C": [0.001, 1.0], "l1_ratio": [0.0, 0.5]}], splits=2, label="label")
    optimal = table.groupBy("outer_fold").agg(F.count_if(F.col("residual") <= 1e-4).alias("optimal"), F.count_if("chosen").alias("chosen"))
    return _covered(scored).join(optimal.withColumn("outer_fold", F.col("outer_fold").cast("int")), "outer_fold")


@query("m5_leaf_limited_boosting", HELD_OUT_SQL.replace("FITS", "2"))
def boosting_folds(spark, folder):
    """Boosted trees with a leaf limit, L2 and category sets, for all held-out folds, inner folds and candidates together."""
    scored, table = within.held_out_search(
        rows(spark, folder), folds(spark, folder), "hist_gradient_boosting", ["lst", "lon", "passes"], ["klass", "climate_group"],
        grid=[{"learning_rate": [0.1, 0.3], "max_leaf_nodes": [4], "min_samples_leaf": [20], "max_iter": [2], "l2_regularization": [1.0]}], splits=2, label="label")
    searched = table.groupBy("outer_fold").agg(F.count_if(F.col("inner_folds") == 2).alias("optimal"), F.count_if("chosen").alias("chosen"))
    return _covered(scored).join(searched.withColumn("outer_fold", F.col("outer_fold").cast("int")), "outer_fold")


@query("m12_forest_search_counts", f"""WITH {CELLS}, r AS (
  SELECT city_id, lon, lat, CASE WHEN cell_id % 3 = 0 OR lst > 200000 THEN 1 ELSE 0 END AS label FROM cells),
m AS (SELECT city_id, median(lon) AS mx, median(lat) AS my FROM r GROUP BY 1),
b AS (SELECT r.city_id, CASE WHEN lat >= my THEN 'north' ELSE 'south' END || CASE WHEN lon >= mx THEN 'east' ELSE 'west' END AS held_out_block, label FROM r JOIN m USING (city_id))
SELECT city_id, held_out_block, model_name, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positive_count, round(avg(label), 6) AS prevalence
FROM b, (VALUES ('random_forest'), ('city_prevalence_baseline')) m(model_name) GROUP BY ALL""")
def spatial_counts(spark, folder):
    """Forests that hold out one quadrant of each nation: the held-out rows of both models."""
    data = cells(spark, folder).withColumn("label", ((F.col("cell_id") % 3 == 0) | (F.col("lst") > 200_000)).cast("int"))
    out, _ = within.spatial_search(data, "random_forest", ["lst", "lon", "passes"], ["klass", "climate_group"], grid=FOREST_GRID, splits=2, cap=300, label="label", lon="lon", lat="lat")
    return rounded(_told(out))


@query("m13_permutation_importance")
def importance(spark, folder):
    data = rows(spark, folder)
    train, test = data.filter("city_id % 2 = 0"), data.filter("city_id % 2 = 1")
    prep = models.prepare(train, "logistic_saga", FEATURES, TYPES)
    fitted = models.fit_classifier(prep.transform(train), "logistic_saga", {"C": 1.0}, train.count(), "label")
    pipeline = models.PipelineModel([*prep.stages, fitted])
    return rounded(models.permutation_importance(pipeline, test, FEATURES, 0, 2, label="label"), 4)


@query("m14_m15_transfer_package")
def package(spark, folder):
    path = scratch(spark)
    data = rows(spark, folder)
    models.save_package(data, "logistic_saga", {"C": 1.0, "l1_ratio": 0.0}, FEATURES, path, "label", TYPES)
    out = models.apply_package(spark, path, data.drop("label").withColumn("city_id", F.lit(1)))
    return rounded(out["deciles"], 4)


@query("m16_held_out_alignment")
def alignment(spark, folder):
    """Supplier x month cells: fit on two return flags, score the third, compare surfaces."""
    from latticework.catalog.base import shipments
    from latticework.functions import crs
    from latticework.plans import alignment as plan

    data = shipments(spark, folder).withColumns({
        "e": 500_000.0 + 30 * F.col("col"), "n_": 4_000_000.0 - 30 * F.col("row"), "epsg": F.lit(32612), "hotspot_10pct": (F.col("v") > 80_000).cast("int")})
    data = crs.from_utm(data, "e", "n_", "epsg", "centroid_lon", "centroid_lat").select("city_id", "centroid_lon", "centroid_lat", "q", "n", "hotspot_10pct")
    flags = data.select("city_id").distinct()
    fold_table = flags.withColumn("outer_fold", F.ascii("city_id") % 3)
    grid = [{"n_estimators": [5], "max_depth": [4], "min_samples_leaf": [5]}]
    scored = plan.score_held_out_groups(data, data, fold_table, flags, "random_forest", ["q", "n"], grid, 2, types={"q": "numeric", "n": "numeric"})
    return rounded(plan.held_out_alignment(scored, (300.0,)), 4)
