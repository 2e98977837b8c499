import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions.params import canonical_json
from latticework.operators import compare, history, label, profile, rules, select, status
from latticework.plans import assemble
from latticework.sources import geojson, inventory, runs, tables

CELLS = "city_id long, cell_id long, land_cover_class long, lst_median_may_aug double, n_valid_ecostress_passes long"


def test_final_rules_and_label_fixture(spark):
    rows = [(1, 1, 11, 30.0, 5), (1, 2, 21, 40.0, 2), (1, 3, 22, 50.0, 5), (2, 1, 23, None, None)]
    df = spark.createDataFrame(rows, CELLS)
    final = assemble.merge_final(df)
    got = {(r.city_id, r.cell_id): r.hotspot_10pct for r in final.collect()}
    assert got == {(1, 3): True, (2, 1): None} and final.columns == schema.CELL_COLUMNS
    counts = {r.city_id: r.row_count for r in tables.per_group_counts(final).collect()}
    row = tables.provenance(final, 4).first()
    assert counts == {1: 1, 2: 1} and (row.row_count, row.column_count, row.dropped_row_count) == (2, 17, 2)


def test_city_rules_differ_from_final_rules_on_missing_values(spark):
    rows = [(1, 1, 21, None, 1), (1, 2, None, 50.0, 9), (1, 3, 21, 50.0, 3), (2, 1, None, None, None), (3, 1, 11, None, 0), (3, 2, 21, None, 0)]
    df = spark.createDataFrame(rows, CELLS)
    keep = lambda out: {(r.city_id, r.cell_id) for r in out.collect()}
    assert keep(rules.group_rules(df)) == {(1, 3), (2, 1), (3, 2)}
    assert keep(rules.final_rules(df)) == {(1, 1), (1, 3), (2, 1), (3, 2)}


def test_label_quantile_ties_and_slices(spark):
    df = spark.createDataFrame([(1, i, float(i // 2)) for i in range(40)] + [(2, 1, None)], "city_id int, cell_id int, lst_median_may_aug double")
    for slices in (None, 10):
        got = {(r.city_id, r.cell_id): r.hotspot_10pct for r in label.label_top_share(df, slices=slices).collect()}
        assert {c for (g, c), v in got.items() if v} == {36, 37, 38, 39} and got[(2, 1)] is None


def test_cell_filter_modes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "cell_id int, is_core_city_cell boolean")
    assert [r.cell_id for r in rules.cell_filter(df, "core_city").collect()] == [1]
    assert rules.cell_filter(df).count() == 3
    with pytest.raises(ValueError, match="all null"):
        rules.cell_filter(df.filter("cell_id = 3"), "core_city")
    with pytest.raises(ValueError, match="Unsupported"):
        rules.cell_filter(df, "nowhere")


def test_contracts(spark):
    with pytest.raises(ValueError, match="a, b"):
        schema.require_columns(["c"], ["b", "a", "c"])
    with pytest.raises(ValueError, match="label away"):
        schema.require_features(["cell_id"], ["cell_id"])
    with pytest.raises(ValueError, match="declared type"):
        schema.require_features(["other"], ["other"])
    df = spark.createDataFrame([("True",), ("0",), (None,), ("1.0",), ("nan",)], "y string")
    assert [r.y for r in df.select(schema.binary_label("y").alias("y")).collect()] == [1, 0, None, 1, None]
    schema.require_binary(df, "y")
    with pytest.raises(ValueError, match="maybe"):
        schema.require_binary(spark.createDataFrame([("maybe",), ("1",)], "hotspot_10pct string"))
    with pytest.raises(Exception, match="binary"):
        schema.drop_unlabelled(spark.createDataFrame([("2",)], "hotspot_10pct string")).collect()
    coerced = schema.coerce_types(spark.createDataFrame([("1", "7", "21.0", "x", float("nan"), "True")], "city_id string, cell_id string, land_cover_class string, elevation_m string, impervious_pct double, hotspot_10pct string"))
    assert tuple(coerced.first()) == (1, 7, 21, None, None, True)
    with pytest.raises(Exception, match="city_id"):
        schema.coerce_types(spark.createDataFrame([("x",)], "city_id string")).collect()


def test_readers_and_writers(spark, tmp_path):
    cities = tmp_path / "cities.csv"
    cities.write_text("city_id,city_name,state,climate_group,lat,lon,extra\n1,Reno,NV,hot_arid,39.5,-119.8,x\n2,Boston,MA,mild_cool,42.4,-71.1,y\n")
    df = tables.read_cities(spark, str(cities))
    assert df.columns == [f.name for f in schema.CITY] and df.first().lat == 39.5
    assert rules.city_record(df, city_name=" boston ").first().city_id == 2
    with pytest.raises(ValueError, match="not found"):
        rules.city_record(df, city_id=9)
    (tmp_path / "bad.csv").write_text("city_id,city_name\n1,a\n")
    with pytest.raises(ValueError, match="climate_group"):
        tables.read_cities(spark, str(tmp_path / "bad.csv"))
    cells = schema.complete_columns(spark.createDataFrame([(1, 1, True), (2, 1, None)], "city_id long, cell_id long, hotspot_10pct boolean"))
    for _ in range(2):  # a second write replaces the first
        stored = tables.write_parquet_and_csv(cells, str(tmp_path / "p"), str(tmp_path / "c"))
    assert stored.count() == 2
    back = tables.scan_csv(spark, str(tmp_path / "c"), columns=["city_id", "hotspot_10pct"])
    assert {tuple(r) for r in back.collect()} == {(1, True), (2, None)} and dict(back.dtypes)["city_id"] == "bigint"
    merged = tables.read_feature_files(spark, str(tmp_path / "p"), with_source=True)
    assert merged.columns == [*schema.CELL_COLUMNS, "source_file"] and tables.source_files(merged).count() == 2
    many = tables.keep_ids(spark.range(5000).withColumnRenamed("id", "city_id"), list(range(1500)) + [1])
    assert many.count() == 1500
    pruned = tables.keep_ids(tables.scan(spark, str(tmp_path / "p"), ["cell_id", "city_id"]), [2])
    assert "PartitionFilters" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 1


def test_profiles_with_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 0), (1, None, None), (1, 9.0, 1)], "city_id int, v double, hotspot_10pct int")
    for slices in (None, 2):
        row = profile.numeric_summary(df, ["v", "gone"], slices=slices).first()
        assert (row.n_non_missing, row.missing_pct, row.median, row.min, row.max) == (3, 25.0, 2.0, 1.0, 9.0)
        assert row.skew == pytest.approx(pd.Series([1.0, 2.0, 9.0]).skew())
    shares = {r.category: (r.n_rows, r.share_pct) for r in profile.label_composition(df).collect()}
    assert shares["missing"] == (1, 25.0) and shares["hotspot"][1] == pytest.approx(200 / 3)
    quadrants = spark.createDataFrame([(-1.0, -1.0, 1), (1.0, 1.0, 0), (0.0, 0.0, 1)], "centroid_lon double, centroid_lat double, hotspot_10pct int")
    assert {r.quadrant: r.n_cells for r in profile.quadrant_shares(quadrants).collect()} == {"south_west": 2, "north_east": 1}


def test_joins_and_pairs(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "city_id int, cell_id int, v string")
    update = spark.createDataFrame([(1, 2, "z"), (1, 9, "y")], "city_id int, cell_id int, v string")
    assert {(r.cell_id, r.v) for r in compare.replace_columns(base, update).collect()} == {(1, None), (2, "z")}
    with pytest.raises(ValueError, match="repeated"):
        compare.replace_columns(base, update.union(update))
    summary = compare.consensus_parameters(spark.createDataFrame(
        [(0, 0.18, '{"b":1,"n": 200}'), (1, 0.21, '{"n":300,"b":1}'), (2, 0.24, '{"b": 1, "n":300}')], "outer_fold int, best_inner_cv_average_precision double, best_params_json string"))
    best = compare.consensus_choice(summary).first()
    assert (best.params, best.fold_count) == ('{"b":1,"n":300}', 2)
    wrong = spark.createDataFrame([(1, 2)], "k int, other int")
    with pytest.raises(ValueError, match="disagrees"):
        compare.checked_lookup(spark.createDataFrame([(1, 3)], "k int, mine int"), wrong, "k", {"mine": "other"})


def test_selection_fixture(spark):
    rows = [(0, 1, "A", "x", 0.10), (0, 2, "B", "y", 0.30), (0, 3, "C", "x", 0.12), (1, 4, "D", "y", 0.20), (1, 5, "E", "z", 0.16), (1, 6, "F", "x", 0.18), (1, 7, "Denver", "x", 0.50)]
    df = spark.createDataFrame(rows, "outer_fold int, city_id int, city_name string, climate_group string, pr_auc double")
    got = {r.city_id: r.selection_reason for r in select.representatives(df).collect()}
    assert set(got) == {3, 4, 5, 7} and got[7] == "forced"
    assert select.representatives(df, "all").count() == 7 and select.representatives(df, "forced_only").first().city_id == 7
    with pytest.raises(ValueError, match="99"):
        select.representatives(df, ids=[1, 99])
    preferred = select.nearest_to_median(df.filter("climate_group = 'y'"), "climate_group", "pr_auc", ["pr_auc", "city_name"], prefer={"y": "B"}).first()
    assert preferred.city_id == 2


def test_history(spark):
    rows = [("c", "2026-01-03T00:00:00Z", "m", "success", 0.3, "s1", "k"), ("a", "2026-01-01T00:00:00Z", "m", "success", float("nan"), "s1", "k"),
            ("b", "2026-01-02T00:00:00Z", "m", "success", 0.2, "s1", "k"), ("d", "2026-01-04T00:00:00Z", "m", "failed", None, "s2", "k2"),
            ("e", "2026-01-05T00:00:00Z", "m", "success", 0.25, "s1", "k2")]
    df = spark.createDataFrame(rows, "run_id string, timestamp_utc string, model_type string, run_status string, pooled_pr_auc double, comparison_signature string, search_contract_signature string")
    for slices in (None, 2):
        out = history.previous_run(history.frontier(history.run_order(df, slices=slices), slices=slices), slices=slices)
        got = {r.run_id: r for r in out.collect()}
        assert [got[k].run_order for k in "abcde"] == [1, 2, 3, 4, 5] and got["a"].timestamp_utc == "2026-01-01T00:00:00+00:00"
        assert got["b"].moved_frontier and got["b"].prior_best is None and got["c"].delta_vs_prior_best == pytest.approx(0.1)
        assert got["e"].moved_frontier is False and got["e"].prior_best == 0.3 and got["d"].moved_frontier is None
        assert got["d"].contract_changed and got["e"].comparison_changed and not got["e"].contract_changed and got["a"].previous_run_id is None
    notes = spark.createDataFrame([("a", " "), ("b", "keep")], "run_id string, manual string")
    template = history.annotation_template(df, notes, "run_id", ["model_type"], ["manual", "paper"])
    assert {(r.run_id, r.manual, r.paper) for r in template.collect()} >= {("b", "keep", ""), ("c", "", "")}


def test_registry_round_trip(spark, tmp_path):
    meta = {"selected_feature_columns": ["b", "a"], "selected_outer_folds": [0, 2], "inner_cv_splits_requested": 4, "sample_rows_per_city": 5000,
            "param_grid": [{"model__l1_ratio": [0.0, 1.0, 0.5]}], "search_space": {"param_candidate_count": 3, "estimated_total_inner_fits": 60}}
    record = {"run_id": "r1", "timestamp_utc": "2026-01-01T00:00:00Z", "status": "success", "model_type": "logistic_saga", "preset": "full", "dataset_format": "parquet",
              "outer_folds_used": [1], "sample_rows_per_city": 1, "metrics": {"pooled_pr_auc": 0.14}, "notes": ["x", " ", "y"], "metadata_path": "m.json", "output_dir": "/o/run1/"}
    (tmp_path / "runs.jsonl").write_text(json.dumps(record) + "\n\n" + json.dumps({**record, "run_id": "r2", "metadata_path": None}) + "\n")
    registry = runs.read_runs(spark, str(tmp_path / "runs.jsonl")).filter("run_id is not null")
    metadata = spark.createDataFrame([("m.json", json.dumps(meta))], "metadata_path string, meta string")
    rows = {r.run_id: r for r in runs.history_rows(registry, metadata).collect()}
    assert (rows["r1"].outer_folds_used, rows["r1"].sample_rows_per_city, rows["r1"].pooled_pr_auc, rows["r1"].registry_notes) == ("0,2", 5000, 0.14, "x | y")
    assert rows["r1"].search_contract_version == "logistic_saga__full__l1_ratio_family_complete__cv4__pc3" and rows["r1"].output_dir_name == "run1"
    assert (rows["r2"].outer_folds_used, rows["r2"].sample_rows_per_city) == ("1", 1) and rows["r1"].search_contract_signature != rows["r2"].search_contract_signature
    runs.append_runs(registry.limit(1), str(tmp_path / "more"))
    runs.append_runs(registry.limit(1), str(tmp_path / "more"))
    assert runs.read_runs(spark, str(tmp_path / "more")).count() == 2
    assert spark.range(1).select(canonical_json(F.lit("[2,1]"))).first()[0] == "[2,1]"


def test_status_tables(spark):
    df = spark.createDataFrame([(1, "a", "completed", ""), (1, "b", "failed", "boom"), (2, "a", "skipped_existing", None), (3, "a", "blocked", None), (4, "a", "odd", "x")], "city_id int, dataset string, status string, error string")
    got = {r.city_id: (r.status, r.error, r.message) for r in status.roll_up_datasets(df).collect()}
    assert got == {1: ("failed", "boom", "a=completed; b=failed"), 2: ("skipped_existing", "", "a=skipped_existing"),
                   3: ("failed", "raw support acquisition blocked", "a=blocked"), 4: ("failed", "raw_support_status_unrecognized", "a=odd")}
    stages = spark.createDataFrame([(1, "raw_support_acquisition", "completed"), (1, "support_layer_prep", "pending"), (2, "raw_support_acquisition", "Completed")], "city_id int, stage string, status string")
    assert {r.city_id: (r.overall_status, r.primary_stage) for r in status.overall_status(stages).collect()} == {1: ("not_started", "support_layer_prep"), 2: ("completed", None)}
    unmet = status.unmet_prerequisites(stages, {"raw_support_acquisition": "raw", "support_layer_prep": "prep"})
    assert {r.city_id: r.blocked_by for r in unmet.collect()} == {1: ["prep"], 2: ["prep"]}
    record = status.stage_record(df, "raw", "all").first()
    assert record.n_records == 5 and json.loads(record.status_counts_json)["failed"] == 1


def test_inventory(spark, tmp_path):
    for name in ["raw/ndvi/reno/MOD13A1_NDVI_doy1_aid1.tif", "raw/ndvi/reno/MOD13A1_NDVI_quality_doy1_aid1.tif", "raw/ndvi/el_paso/x_ndvi_a.tif", "raw/dem/reno/a/reno_dem.tif",
                 "raw/nlcd/reno/reno_imp.tif", "raw/nlcd/reno/reno_land.tif", "raw/hydro/reno/w.gpkg", "areas/01_reno_nv_study_area.gpkg", "grids/01_reno_nv_grid_30m.gpkg"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = inventory.list_files(spark, str(tmp_path))
    assert files.count() == 9 and "content" not in files.columns
    cities = spark.createDataFrame([(1, "Reno", "NV"), (5, "El Paso", "TX")], "city_id int, city_name string, state string")
    found = inventory.product_rasters(inventory.city_folder_files(files, cities, f"{tmp_path}/raw/ndvi"), ["_ndvi_"], "ndvi")
    assert {(r.city_id, r.path.split("/")[-1]) for r in found.collect()} == {(1, "MOD13A1_NDVI_doy1_aid1.tif"), (5, "x_ndvi_a.tif")}
    named = spark.createDataFrame([("/f/reno_1.tif",), ("/f/other.tif",)], "path string")
    assert {(r.city_id, r.path) for r in inventory.city_or_global(named, cities).collect()} == {(1, "/f/reno_1.tif"), (5, "/f/reno_1.tif"), (5, "/f/other.tif")}
    dirs = {"study_areas": f"{tmp_path}/areas", "city_grids": f"{tmp_path}/grids", "raw_dem": f"{tmp_path}/raw/dem", "raw_nlcd": f"{tmp_path}/raw/nlcd", "raw_hydro": f"{tmp_path}/raw/hydro", "support_layers": f"{tmp_path}/support"}
    flags = inventory.support_flags(cities, files, dirs)
    ready = {r.city_id: r for r in status.readiness(flags, inventory.PREP_BLOCKERS, inventory.FEATURE_BLOCKERS).collect()}
    assert ready[1].support_prep_ready and ready[1].feature_extraction_ready and not ready[5].support_prep_ready
    assert ready[5].prep_blocking_reasons.startswith("study_area_missing;dem_source_missing")
    cache = spark.createDataFrame(
        [("/c/cache/hydro/extracted/H1.gpkg", 10), ("/c/cache/hydro/packages/H1.v2.zip", 5), ("/c/cache/nlcd/extracted/LndCov_a.tif", 7), ("/c/cache/x.part", 1), ("/c/cache/odd.bin", 2)], "path string, length long"
    ).withColumn("modificationTime", F.lit(dt.datetime(2024, 1, 1)))
    report = {r.relative_path: r.prune_block_reason for r in inventory.cache_report(cache, "/c/cache", F.lit("2024-01-05")).collect()}
    assert report == {"hydro/extracted/H1.gpkg": "", "hydro/packages/H1.v2.zip": "mode_excluded", "nlcd/extracted/LndCov_a.tif": "missing_source_bundle", "x.part": "", "odd.bin": "mode_excluded"}


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"GEOID": "1", "NAME": "One"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"properties": {"UA": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [5, 6], [5, 5]]]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    areas = geojson.read_boundaries(spark, str(tmp_path / "a.geojson"))
    assert {(r.poly_id, r.name) for r in areas.collect()} == {("1", "One"), ("2", "Unknown Urban Area")}
    edges = geojson.boundary_edges(areas)
    assert {(r.poly_id, r.ring): r["count"] for r in edges.groupBy("poly_id", "ring").count().collect()} == {("1", 0): 3, ("2", 0): 3, ("2", 1): 3}


def test_plans_have_no_pairwise_joins(spark):
    from latticework.operators import geometry, lattice

    edges = spark.createDataFrame([("p", 0, i, float(i), 0.0, float(i + 1), 50.0) for i in range(5)], "poly_id string, ring int, i int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(1, r, c, r == c) for r in range(4) for c in range(4)], "city_id int, row int, col int, w boolean")
    for df in (geometry.polygon_grid(edges, 30.0), lattice.distance_to_marked(cells, "w"), lattice.window_means(cells, {"m": F.col("row")}, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_extent_rounds_halves_to_even(spark):
    from latticework.operators import profile

    df = spark.createDataFrame([(1, 0.5, 8997.5, 3.0), (1, 9998.5, 1.5, 4.0), (1, 7.0, 2.0, 9.0)], "g int, x double, y double, v double")
    assert profile.profile_bundle(df, "g", ["v"], ("x", "y", "x", "y")).first().extent == "[0, 2, 9998, 8998]"
