import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import crs
from latticework.operators import align, geometry, lattice


def grid_rows(array, city=1):
    return [(city, r, c, None if v is None else float(v)) for r, line in enumerate(array) for c, v in enumerate(line)]


def to_map(df, value):
    return {(r.row, r.col): r[value] for r in df.collect()}


PIXELS = "city_id int, row int, col int, v double"


@pytest.mark.parametrize("rasters, scaling, want, counts", [
    ([[[1, 2], [3, 4]], [[1, None], [5, 7]]], None, [1, 2, 4, 5.5], [2, 1, 2, 2]),
    ([[[10000, None], [5000, 12000]], [[8000, 0], [7000, 11000]]], lattice.NDVI_SCALING, [0.9, 0.0, 0.6, None], [2, 1, 2, 0]),
    ([[[1, 4], [7, 10]], [[2, 5], [8, 11]], [[3, None], [9, 12]]], None, [2, 4.5, 8, 11], [3, 2, 3, 3]),
])
def test_stack_median_fixtures(spark, rasters, scaling, want, counts):
    rows = [(1, 2 * r + c + 1, None if v is None else float(v)) for a in rasters for r, line in enumerate(a) for c, v in enumerate(line)]
    df = spark.createDataFrame(rows, "city_id int, cell_id int, value double")
    got = lattice.stack_median(df, scaling=scaling).orderBy("cell_id").collect()
    assert [r.n_valid for r in got] == counts
    assert [None if r.median is None else pytest.approx(r.median) for r in got] == want


def test_window_fixtures(spark):
    df = spark.createDataFrame(grid_rows([[1, 2, 3], [4, None, 6], [7, 8, 9]]), PIXELS)
    got = to_map(lattice.window_means(df, {"m": F.col("v")}, 1), "m")
    assert got[(1, 1)] == pytest.approx(5.0) and got[(0, 0)] == pytest.approx(7 / 3)
    df = spark.createDataFrame(grid_rows([[41, 42, None], [24, 41, 24], [24, 24, 24]]), PIXELS)
    got = to_map(lattice.window_means(df, {"m": lattice.class_share("v", [41, 42])}, 1), "m")
    assert got[(1, 1)] == pytest.approx(3 / 8) and got[(0, 0)] == pytest.approx(3 / 4)
    assert lattice.window_radius(30) == 4 and lattice.window_radius(10) == 13 and lattice.window_radius(500) == 0


def test_window_equals_brute_force_on_a_lattice_with_holes(spark):
    rng = np.random.default_rng(1)
    rows = [(k, r, c, None if rng.random() < 0.2 else float(rng.integers(0, 9))) for k in (1, 2) for r in range(8) for c in range(11) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, PIXELS)
    got = {(r.city_id, r.row, r.col): r.m for r in lattice.window_means(df, {"m": F.col("v")}, 2).collect()}
    assert set(got) == {(k, r, c) for k, r, c, _ in rows}
    for k, r, c, _ in rows:
        near = [v for k2, r2, c2, v in rows if k2 == k and abs(r2 - r) <= 2 and abs(c2 - c) <= 2 and v is not None]
        assert got[(k, r, c)] == (pytest.approx(np.mean(near)) if near else None)


def test_distance_fixtures_and_brute_force(spark):
    empty = spark.createDataFrame([(1, r, c, False) for r in range(2) for c in range(2)], "city_id int, row int, col int, w boolean")
    assert all(r.distance is None for r in lattice.distance_to_marked(empty, "w").collect())
    rng = np.random.default_rng(4)
    rows = [(k, r, c, bool(rng.random() < 0.05)) for k in (1, 2) for r in range(14) for c in range(17) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "city_id int, row int, col int, w boolean")
    for r in lattice.distance_to_marked(df, "w", 30.0).collect():
        want = min(np.hypot(r2 - r.row, c2 - r.col) for k2, r2, c2, w in rows if k2 == r.city_id and w) * 30
        assert r.distance == pytest.approx(want, abs=1e-9)


def test_distance_never_sums_up_the_rest_of_a_column_per_row(spark):
    df = spark.createDataFrame([(1, r, 0, r == 5) for r in range(9)], "city_id int, row int, col int, w boolean")
    out = lattice.distance_to_marked(df, "w", 1.0)
    assert [r.distance for r in out.orderBy("row").collect()] == [5.0, 4.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0, 3.0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # Spark evaluates such a frame in quadratic time


def test_gaussian_equals_two_dimensional_sum(spark):
    rng = np.random.default_rng(7)
    sigma, reach = 1.3, int(4 * 1.3 + 0.5)
    cells = {(r, c): float(rng.random()) for r in range(9) for c in range(6) if rng.random() < 0.75}
    df = spark.createDataFrame([(1, r, c, v, sigma) for (r, c), v in cells.items()], "city_id int, row int, col int, v double, s double")
    got = to_map(lattice.gaussian_smooth(df, ["v"], "s", "true"), "v")
    assert set(got) == set(cells)
    for (r, c) in cells:
        w = {k: np.exp(-((k[0] - r) ** 2 + (k[1] - c) ** 2) / (2 * sigma**2)) for k in cells if abs(k[0] - r) <= reach and abs(k[1] - c) <= reach}
        assert got[(r, c)] == pytest.approx(sum(w[k] * cells[k] for k in w) / sum(w.values()), rel=1e-12)


def edges_of(points, poly="p", ring=0):
    return [(poly, ring, i, *map(float, points[i]), *map(float, points[(i + 1) % len(points)])) for i in range(len(points))]


EDGES = "poly_id string, ring int, i int, x1 double, y1 double, x2 double, y2 double"


def test_grid_fixtures(spark):
    square = spark.createDataFrame(edges_of([(0, 0), (90, 0), (90, 90), (0, 90)]), EDGES)
    cells = geometry.polygon_grid(square, 30).orderBy("cell_id").collect()
    assert [(r.cell_id, r.row, r.col) for r in cells] == [(i + 1, i // 3, i % 3) for i in range(9)]
    assert (cells[0].x0, cells[0].y1) == (0.0, 90.0)
    triangle = spark.createDataFrame(edges_of([(0, 0), (90, 0), (0, 90)]), EDGES)
    got = {(r.row, r.col) for r in geometry.polygon_grid(triangle, 30).collect()}
    assert got == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)}


def segment_box_distance(p, q, box):
    """Dense sampling of the segment is enough for a tolerance test."""
    t = np.linspace(0, 1, 4001)
    x, y = p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])
    dx = np.maximum(np.maximum(box[0] - x, x - box[2]), 0)
    dy = np.maximum(np.maximum(box[1] - y, y - box[3]), 0)
    return np.hypot(dx, dy).min()


def inside(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


@pytest.mark.parametrize("buffer_m", [0.0, 47.0])
def test_grid_and_core_flags_equal_brute_force(spark, buffer_m):
    rng = np.random.default_rng(11)
    angles = np.sort(rng.random(9) * 2 * np.pi)
    points = [(float(400 + r * np.cos(a)), float(300 + r * np.sin(a))) for a, r in zip(angles, 60 + 140 * rng.random(9))]
    edges = spark.createDataFrame(edges_of(points), EDGES)
    spec = geometry.snapped_spec(edges, 30, buffer_m)
    s = spec.first()
    cells = geometry.polygon_grid(edges, 30, buffer_m)
    flagged = geometry.core_flags(cells, edges, spec, buffer_m)
    got = {(r.row, r.col): r.is_core_city_cell for r in flagged.collect()}
    for r in range(s.height):
        for c in range(s.width):
            x0, y1 = s.minx + c * 30, s.maxy - r * 30
            box = (x0, y1 - 30, x0 + 30, y1)
            gap = min(segment_box_distance(points[i], points[(i + 1) % len(points)], box) for i in range(len(points)))
            centre_in = inside(points, x0 + 15, y1 - 15)
            if abs(gap - buffer_m) < 0.05 and not (buffer_m == 0 and gap == 0):
                continue  # too close to call by sampling
            assert ((r, c) in got) == (centre_in or gap <= buffer_m), (r, c, gap)
            if (r, c) in got:
                assert got[(r, c)] == (centre_in if buffer_m else True)


def test_burned_line_and_distance_fixture(spark):
    spec = spark.createDataFrame([(1, 0.0, 60.0, 2, 2, 30.0)], "city_id int, minx double, maxy double, width int, height int, res double")
    line = spark.createDataFrame([(1, 15.0, 0.0, 15.0, 60.0)], "city_id int, x1 double, y1 double, x2 double, y2 double")
    burned = geometry.burn(line, spec)
    assert {(r.row, r.col) for r in burned.collect()} == {(0, 0), (1, 0)}
    cells = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(2)], "city_id int, row int, col int")
    marked = cells.join(burned.withColumn("w", F.lit(True)), ["city_id", "row", "col"], "left")
    got = to_map(lattice.distance_to_marked(marked, "w", 30.0), "distance")
    assert got == {(0, 0): 0.0, (1, 0): 0.0, (0, 1): 30.0, (1, 1): 30.0}


def test_water_features(spark):
    rows = [(1, "NHDArea", 7, 390, 0.0, 0.0, 5.0, 5.0), (1, "NHDArea", 8, 390, 0.0, 0.0, 5.0, 5.0), (1, "NHDArea", 9, 1, 0.0, 0.0, 9.0, 9.0),
            (1, "NHDFlowline", 3, 1, 0.0, 0.0, 1.0, 1.0), (1, "NHDWaterbody", 4, 5, 100.0, 100.0, 101.0, 101.0), (1, "Other", 5, 390, 0.0, 0.0, 1.0, 1.0)]
    segments = spark.createDataFrame(rows, "city_id int, source_layer string, feature_id int, ftype int, x1 double, y1 double, x2 double, y2 double")
    bounds = spark.createDataFrame([(1, -1.0, -1.0, 50.0, 50.0)], "city_id int, minx double, miny double, maxx double, maxy double")
    got = geometry.water_features(segments, bounds).collect()
    assert {(r.source_layer, r.feature_id) for r in got} == {("NHDArea", 7), ("NHDFlowline", 3)}


def test_segments_are_cut_at_the_box(spark):
    rows = [(1, -5.0, 5.0, 15.0, 5.0), (2, 0.0, -10.0, 20.0, 10.0), (3, 11.0, 0.0, 11.0, 9.0), (4, 2.0, 2.0, 2.0, 2.0), (5, 3.0, 20.0, 3.0, -20.0), (6, -1.0, 5.0, 5.0, -9.0)]
    frame = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double")
    boxed = frame.withColumns({"minx": F.lit(0.0), "miny": F.lit(0.0), "maxx": F.lit(10.0), "maxy": F.lit(10.0)})
    got = {r.i: (r.x1, r.y1, r.x2, r.y2) for r in geometry.clip_segments(boxed).collect()}
    want = {1: (0, 5, 10, 5), 2: (10, 0, 10, 0), 4: (2, 2, 2, 2), 5: (3, 10, 3, 0), 6: (0, 5 - 14 / 6, -1 + 6 * 5 / 14, 0)}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_sampling_and_mosaic(spark):
    rasters = spark.createDataFrame([(1, "a", 0.0, 60.0, 30.0, -9999.0)], "city_id int, raster_id string, rx0 double, ry0 double, rres double, nodata double")
    pixels = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("a", 1, 0, 5.0), ("a", 1, 1, -9999.0)], "raster_id string, row int, col int, value double")
    points = spark.createDataFrame([(1, 1, 30.0, 30.0), (1, 2, 40.0, 50.0), (1, 3, 45.0, 15.0)], "city_id int, cell_id int, x double, y double")
    near = {r.cell_id: r.value for r in lattice.sample_nearest(points, pixels, rasters).collect()}
    assert near == {1: None, 2: 3.0, 3: None}
    smooth = {r.cell_id: r.value for r in lattice.sample_bilinear(points, pixels, rasters, ["city_id", "cell_id"]).collect()}
    assert smooth[1] == pytest.approx((1 + 3 + 5) / 3) and smooth[3] is None
    tiles = spark.createDataFrame([(1, 0, 0, 2, 9.0), (1, 0, 0, 1, None), (1, 0, 1, 1, 4.0), (1, 0, 1, 2, 5.0)], "city_id int, row int, col int, o int, value double")
    assert to_map(lattice.mosaic(tiles, "o"), "value") == {(0, 0): 9.0, (0, 1): 4.0}


def centroid_points(spark, cells):
    df = spark.createDataFrame([(1, 500_000.0 + 30 * c, 4_000_000.0 - 30 * r, 32612, y, s) for r, c, y, s in cells],
                               "city_id int, e double, n double, epsg int, hotspot_10pct double, predicted_probability double")
    return crs.from_utm(df, "e", "n", "epsg", "centroid_lon", "centroid_lat")


def test_grid_reconstruction_with_a_duplicate(spark):
    cells = [(r, c, float((r, c) == (1, 1)), 1.0 if (r, c) == (1, 1) else 0.1) for r in range(3) for c in range(3)] + [(1, 1, 0.0, 0.5)]
    got = lattice.reconstruct_grid(centroid_points(spark, cells)).collect()
    centre = next(r for r in got if (r.row, r.col) == (1, 1))
    assert len(got) == 9 and centre.hotspot_10pct == 0.5 and centre.predicted_probability == 0.75
    assert centre.status == "duplicate_grid_cells_1" and centre.cell_m == pytest.approx(30, abs=0.02) and centre.epsg == 32612


def test_alignment_fixture(spark):
    rows = [(1, 300.0, r, c, float((r, c) == (1, 1)), float((r, c) == (1, 1)), 30.0 * c, -30.0 * r, 30.0) for r in range(3) for c in range(3)]
    surfaces = spark.createDataFrame(rows, "city_id int, smoothing_radius_m double, row int, col int, observed double, predicted double, x double, y double, cell_m double")
    m = align.alignment_metrics(surfaces, fraction=1 / 9).first()
    assert m.valid_cell_count == 9 and m.spearman_surface_corr == pytest.approx(1) and m.top_region_overlap_fraction == 1 and m.observed_mass_captured == 1
    assert m.centroid_distance_m == 0 and m.median_nearest_region_distance_m == 0
    assert (m.observed_top_cell_count, m.predicted_top_cell_count, m.overlap_cell_count) == (1, 1, 1)


def test_alignment_report_against_numpy(spark):
    rng = np.random.default_rng(3)
    cells = [(r, c, float(rng.random() < 0.2), float(rng.random())) for r in range(12) for c in range(10)]
    out = {r.smoothing_radius_m: r for r in align.alignment_report(centroid_points(spark, cells), radii=(60.0, 150.0)).collect()}
    assert set(out) == {60.0, 150.0} and out[150.0].scale_label == "fine" and out[60.0].status == "ok"
    obs, pred = np.zeros((12, 10)), np.zeros((12, 10))
    for r, c, y, s in cells:
        obs[r, c], pred[r, c] = y, s
    for radius, row in out.items():
        sigma = radius / 2 / row.cell_m
        reach = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        k /= k.sum()
        blur = lambda a: np.apply_along_axis(lambda v: np.convolve(v, k)[reach:-reach], 0, np.apply_along_axis(lambda v: np.convolve(v, k)[reach:-reach], 1, a))
        weight = blur(np.ones_like(obs))
        o, p = (blur(obs) / weight).ravel(), (blur(pred) / weight).ravel()
        top = lambda v: set(np.lexsort((np.arange(v.size), -v))[:12])
        assert row.top_region_overlap_fraction == pytest.approx(len(top(o) & top(p)) / len(top(o) | top(p)))
        assert row.observed_mass_captured == pytest.approx(o[list(top(p))].sum() / o.sum())
        ij = lambda s: np.array([(i // 10, i % 10) for i in s])
        gaps = np.sqrt(((ij(top(o))[:, None] - ij(top(p))[None]) ** 2).sum(-1)).min(1)
        assert row.median_nearest_region_distance_m == pytest.approx(np.median(gaps) * row.cell_m)


@pytest.mark.parametrize("name", ["g12_burned_lines", "g2_j13_buffered_grid_and_core"])
def test_boxes_with_sides_on_lattice_lines_equal_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from latticework.catalog import lattices

    rows = [((k * 25 + n) * 7 + 1, n, round(50 * (k - 20) - 32.1, 2)) for k in range(12) for n in (0, 4, 10)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    out = lattices.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    con.execute("CREATE TABLE want AS " + lattices.SQL[name])
    want = con.execute("FROM want").fetchall()
    got = out.select(*[r[0] for r in con.execute("DESCRIBE want").fetchall()]).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == set(want)


def test_layers_read_pixels_once(spark):
    from latticework.plans import assemble

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    products = [("dem", "b"), ("dem", "a"), ("land_cover", "c"), ("impervious", "d"), ("ndvi", "e"), ("ndvi", "f"), ("lst", "g"), ("lst", "h"), ("lst", "i"), ("other", "j")]
    rasters = spark.createDataFrame([(r, 1, p, 0.0, 120.0, 60.0, -1.0) for p, r in products], "raster_id string, city_id int, product string, rx0 double, ry0 double, rres double, nodata double")
    value = {(r, i, j): None if (k + i + j) % 5 == 4 else -1.0 if (k + i + j) % 5 == 3 else float(100 * k + 10 * i + j) for k, (_, r) in enumerate(products) for i in range(2) for j in range(2)}
    pixels = spark.createDataFrame([(*k, v) for k, v in value.items()], "raster_id string, row int, col int, value double")
    cells = spark.createDataFrame([(c, 10 * c + i, r, col, 30.0 * col, 120.0 - 30.0 * r, 32612) for c in (1, 2) for i, (r, col) in enumerate([(0, 0), (1, 3), (3, 1), (3, 3)])],
                                  "city_id int, cell_id int, row int, col int, x0 double, y1 double, epsg int")
    cities = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "city_id int, city_name string, climate_group string")
    edges = spark.createDataFrame([(1, 5.0, 100.0, 5.0, 110.0)], "city_id int, x1 double, y1 double, x2 double, y2 double")
    read = pixels.withColumn("value", counted.asNondeterministic()("value"))
    got = {r.cell_id: r for r in assemble.assemble_cells(cells, cities, rasters, read, edges)[0].collect()}
    assert seen.value == len(value)  # not once per product

    def at(r, i, j):
        v = value.get((r, i, j))
        return None if v == -1.0 else v

    def smooth(r, x, y):
        u, v = x / 60 - 0.5, (120 - y) / 60 - 0.5
        i, j = int(np.floor(v)), int(np.floor(u))
        parts = [(at(r, i + a, j + b), (v - i if a else 1 - v + i) * (u - j if b else 1 - u + j)) for a in (0, 1) for b in (0, 1)]
        weight = sum(w for x, w in parts if x is not None)
        return sum(w * x for x, w in parts if x is not None) / weight if weight else None

    def middle(values):
        return float(np.median(values)) if values else None

    for row, col in [(0, 0), (1, 3), (3, 1), (3, 3)]:
        r = next(x for x in got.values() if (x.city_id, x.row, x.col) == (1, row, col))
        x, y = 30 * (col + 0.5), 120 - 30 * (row + 0.5)
        lst = [v for k in "ghi" if (v := smooth(k, x, y)) is not None]
        ndvi = [v * 0.0001 for k in "ef" if (v := smooth(k, x, y)) is not None]
        want = [at("c", row // 2, col // 2), smooth("a", x, y) if smooth("a", x, y) is not None else smooth("b", x, y), middle(ndvi), middle(lst), len(lst)]
        have = [r.land_cover_class, r.elevation_m, r.ndvi_median_may_aug, r.lst_median_may_aug, r.n_valid_ecostress_passes]
        assert have == [None if w is None else pytest.approx(w) for w in want]
    assert [x.n_valid_ecostress_passes for x in got.values() if x.city_id == 2] == [None] * 4
    assert [x.dist_to_water_m for x in got.values() if (x.city_id, x.row, x.col) == (1, 3, 3)] == [pytest.approx(30 * 18 ** 0.5)]


def test_interval_plan_does_not_repeat_its_parts(spark):
    edges = spark.createDataFrame([(1, 5.0, 100.0, 65.0, 10.0)], "poly_id int, x1 double, y1 double, x2 double, y2 double")
    plan = geometry.touched_intervals(edges, geometry.snapped_spec(edges))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("sqrt") <= 12
