import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import crs, numeric, params, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_slug_and_stem(spark):
    row = one(spark, text.slug(F.lit("  San José (CA)! ")), text.stem(F.lit(7), F.lit("Salt Lake City"), F.lit("UT")), text.slug(F.lit("!!"), "city"))
    assert tuple(row) == ("san_jos_ca", "07_salt_lake_city_ut", "city")


def test_run_names(spark):
    folds = F.array(*map(F.lit, [4, 0, 2, 1]))
    at = F.lit(dt.datetime(2026, 4, 7, 23, 58, 25))
    row = one(
        spark, text.fold_scope(folds), text.fold_scope(F.lit(None).cast("array<int>")), text.fold_scope(F.array(F.lit(3))),
        text.run_name(F.lit("full"), F.lit(None).cast("array<int>"), F.lit(5000), F.lit("Sampled full -- allfolds, and more text"), at),
        text.run_name(F.lit(None).cast("string"), folds, F.lit(None).cast("int"), F.lit("--"), at),
    )
    assert tuple(row) == (
        "f0-2_f4", "allfolds", "f3", "full_allfolds_s5000_sampled-full-allfolds-an_2026-04-07_235825",
        "custom_f0-2_f4_fullrows_2026-04-07_235825",
    )


def test_keys_and_labels(spark):
    row = one(
        spark, text.tile_key(F.lit("x/USGS_13_N34W113.tif"), F.lit("")), text.basin_key(F.lit("a/NHDPLUS_H_1506_HU4_GPKG.zip"), F.lit("")),
        text.basin_key(F.lit(""), F.lit("NHDPlus HU) 4 - 0205")), text.tile_key(F.lit(""), F.lit("none")),
        text.scale_label(F.lit(300.2)), text.scale_label(F.lit(450.0)), text.climate_label(F.lit("hot_arid")),
        text.climate_label(F.lit("very_wet")), text.land_cover_label(F.lit(21)), text.land_cover_label(F.lit(77)),
        text.land_cover_label(F.lit(None).cast("int")), text.sample_label(F.lit(5000)), text.sample_label(F.lit(12345)),
    )
    assert tuple(row) == (
        "n34w113", "1506", "0205", None, "medium", "r450m", "Hot arid", "Very-Wet", "Developed, Open Space", "Class 77",
        "Missing", "5k sampled", "12,345 sampled",
    )


def test_categories_status_and_feature_names(spark):
    row = one(
        spark, text.category(F.lit(21.4), numeric=True), text.category(F.lit("  ")), text.category(F.lit(" a ")),
        text.base_feature(F.lit("categorical__land_cover_class_21"), ["land_cover", "land_cover_class"]),
        text.is_success(F.lit(" Completed ")), text.is_incomplete(F.lit(None).cast("string")),
        text.remote_status(F.lit(" "), F.lit("Done")),
    )
    assert tuple(row) == ("21", "__MISSING__", "a", "land_cover_class", True, True, "done")


def test_canonical_json_and_signature(spark):
    a, b = '{"b": [1, 2], "a": {"z": 1, "c": null}}', '{"a":{"c":null,"z":1},"b":[1,2]}'
    row = one(spark, params.canonical_json(F.lit(a)), params.signature(F.lit(a)) == params.signature(F.lit(b)), params.canonical_json(F.lit("{oops")))
    assert tuple(row) == (b, True, None)


@pytest.mark.parametrize("model, grid, slug", [
    ("logistic_saga", '[{"model__l1_ratio":[0.0]},{"model__l1_ratio":[1.0]},{"model__l1_ratio":[0.5]}]', "l1_ratio_family_complete"),
    ("logistic_saga", '[{"model__penalty":["l2"]}]', "explicit_penalty_grid"),
    ("logistic_saga", '[{"model__l1_ratio":[0.2,0.8]}]', "elasticnet_only"),
    ("random_forest", '[{"model__n_estimators":[200],"model__max_depth":[10,null],"model__max_features":["sqrt"],"model__min_samples_leaf":[5,1]}]', "depth_feature_leaf_smoke"),
    ("random_forest", '[{"model__n_estimators":[50],"model__max_depth":[10],"model__max_features":["sqrt"],"model__min_samples_leaf":[1]}]', "depth_feature_leaf_custom"),
    ("random_forest", '[{"model__n_estimators":[50]}]', "custom_rf_grid"),
    ("hist_gradient_boosting", '[{"model__learning_rate":[0.1,0.05],"model__max_leaf_nodes":[15,31],"model__min_samples_leaf":[20],"model__l2_regularization":[0.0]}]', "phase1_smoke_lr_leaf"),
    ("other", "[]", "generic_grid"),
])
def test_search_contracts(spark, model, grid, slug):
    version = one(spark, params.search_contract(F.lit(model), F.lit("full"), F.lit(4), F.lit(None).cast("int"), F.lit(grid))["version"])[0]
    assert version == f"{model}__full__{slug}__cv4__pcna"


def test_lists_and_summaries(spark):
    row = one(
        spark, params.as_int_list(F.lit("[1, 2]")), params.as_int_list(F.lit(None).cast("string")), params.as_int(F.lit("x")),
        params.grid_summary(F.lit('[{"model__C":[0.1,1.0],"model__l1_ratio":[0.0]},{"model__max_features":"sqrt"}]')),
        params.best_params_text(F.lit('{"model__b":2,"model__a":"x"}')),
        params.comparison_descriptor(F.lit("v"), F.array(F.lit(0), F.lit(2)), F.lit(None).cast("int"), F.lit("parquet")),
    )
    assert tuple(row) == ([1, 2], [], None, "C: 0.1/1.0; l1_ratio: 0.0 | max_features: sqrt", "a=x, b=2", "v; folds_0-2; all_rows; dataset=parquet")


def test_numbers(spark):
    row = one(
        spark, numeric.sigmoid(F.lit(100.0)), numeric.gini(F.lit(1), F.lit(4)), numeric.top_count(F.lit(100), 0.07),
        numeric.scaled_valid(F.lit(-3000.0), 0.0001, 0.0, -0.2, 1.0), numeric.without_nodata(F.lit(-9999.0), F.lit(-9999.0)),
        numeric.decile(F.lit(1), F.lit(3)),
    )
    assert row[0] == pytest.approx(1 / (1 + np.exp(-35))) and tuple(row)[1:] == (pytest.approx(0.375), 8, None, None, 4)


def test_utm_zones_and_projection(spark):
    points = [(-112.0740, 33.4484, 32612), (151.2093, -33.8688, 32756), (-80.1918, 25.7617, 32617), (180.0, 10.0, 32660)]
    df = spark.createDataFrame(points, "lon double, lat double, want int").withColumn("epsg", crs.utm_epsg("lon", "lat"))
    assert all(r.epsg == r.want for r in df.collect())
    there = crs.to_utm(df, "lon", "lat", "epsg")
    back = crs.from_utm(there, "x_m", "y_m", "epsg", "lon2", "lat2").collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in back)
    tower = spark.createDataFrame([(-79.387139, 43.642567, 32617)], "lon double, lat double, epsg int")
    got = crs.to_utm(tower, "lon", "lat", "epsg").first()  # widely published example position
    assert abs(got.x_m - 630084) < 1 and abs(got.y_m - 4833438) < 1


def test_utm_central_meridian_is_the_scaled_meridian_arc(spark):
    lat = 47.3
    grid = np.linspace(0, np.radians(lat), 200_001)
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)
    arc = np.trapezoid(crs.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(grid) ** 2) ** 1.5, grid)
    df = spark.createDataFrame([(9.0, lat, 32632)], "lon double, lat double, epsg int")
    got = crs.to_utm(df, "lon", "lat", "epsg").first()
    assert got.x_m == pytest.approx(500_000, abs=1e-6) and got.y_m == pytest.approx(arc * crs.K0, abs=1e-3)
