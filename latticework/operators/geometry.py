"""Polygons and lines on the lattice, from edge tables.

A polygon is its edges ``(poly, x1, y1, x2, y2)``. For one edge and one lattice row, the part of the
row within a distance of the edge is a single interval of columns (a buffered segment is convex), so
every operator here is: explode edges to rows, compute one interval each, merge intervals per row,
explode to cells. Joins are on (polygon, row); nothing compares all edges with all cells.

A cell is touched when the shape passes through its inside or lies on its left or top border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.ordering import rank_in_group
from latticework.operators.rules import prefer_codes
from latticework.session import attach, materialize, settle

# --- fixed values: feature-type codes of the water layers ----------------------------------------
WATER_CODES = {"NHDArea": [390, 436, 445, 460, 484], "NHDFlowline": [334, 336, 343, 428, 460, 558]}
WATER_LAYERS = ["NHDWaterbody", "NHDArea", "NHDFlowline"]
# -------------------------------------------------------------------------------------------------


def _spread(edges: DataFrame) -> DataFrame:
    """Edges over all tasks, wherever they were read: each may be exploded to many rows."""
    return edges.repartition("x1", "y1", "x2", "y2")


def snapped_spec(edges: DataFrame, res: float = 30.0, buffer_m: float = 0.0, poly: str = "poly_id") -> DataFrame:
    """Bounds of each (buffered) polygon snapped outward to the resolution, with width and height."""
    if res <= 0:
        raise ValueError("resolution must be positive")
    snap = lambda c, f: f(c / res) * F.lit(float(res))
    box = edges.groupBy(poly).agg(
        snap(F.min(F.least("x1", "x2")) - buffer_m, F.floor).alias("minx"), snap(F.min(F.least("y1", "y2")) - buffer_m, F.floor).alias("miny"),
        snap(F.max(F.greatest("x1", "x2")) + buffer_m, F.ceil).alias("maxx"), snap(F.max(F.greatest("y1", "y2")) + buffer_m, F.ceil).alias("maxy"),
    )
    return box.select(
        poly, "minx", "maxy", F.rint((F.col("maxx") - F.col("minx")) / res).cast("int").alias("width"),
        F.rint((F.col("maxy") - F.col("miny")) / res).cast("int").alias("height"), F.lit(float(res)).alias("res"),
    )


def _with_reach(rows: DataFrame, sign: int, y: Column, b: Column, name: str) -> DataFrame:
    """Adds the furthest x (to the right for +1, to the left for -1, as ``sign * x``) of the buffered segment at height y.

    Step by step in columns: written as one expression its parts repeat, and the code made of it is too long to be compiled well.
    """
    x1, x2 = sign * F.col("x1"), sign * F.col("x2")
    y1, y2 = F.col("y1"), F.col("y2")
    placed = rows.withColumns({"_y": y, "_length": F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))})
    y, length = F.col("_y"), F.col("_length")
    disc = lambda cx, cy: F.when(F.abs(y - cy) <= b, cx + F.sqrt(F.greatest(F.lit(0.0), b * b - (y - cy) * (y - cy))))
    # outward normal of the side facing +x
    nx = F.try_divide(F.abs(y2 - y1), length)
    ny = F.try_divide(F.when(y2 >= y1, -(x2 - x1)).otherwise(x2 - x1), length)
    placed = placed.withColumns({"_nx": nx, "_t": F.try_divide(y - y1 - b * ny, y2 - y1)})
    t = F.col("_t")
    side = F.when((t >= 0) & (t <= 1), x1 + t * (x2 - x1) + b * F.col("_nx"))
    return placed.withColumn(name, F.greatest(disc(x1, y1), disc(x2, y2), side)).drop("_y", "_length", "_nx", "_t")


def touched_intervals(edges: DataFrame, spec: DataFrame, buffer_m: float = 0.0, poly: str = "poly_id") -> DataFrame:
    """``(poly, row, c0, c1)``: columns of each lattice row within ``buffer_m`` of each edge."""
    b = F.lit(float(buffer_m))
    joined = attach(edges, spec.select(poly, "minx", "maxy", "width", "height", "res"), poly, "inner")
    res, maxy = F.col("res"), F.col("maxy")
    top, bottom = F.greatest("y1", "y2") + b, F.least("y1", "y2") - b
    r0 = F.floor((maxy - top) / res)
    r1 = F.greatest(r0, F.ceil((maxy - bottom) / res) - 1)
    last = F.col("height") - 1
    # a line exactly on the last border belongs to the last row
    inside = (r1 >= 0) & (r0 <= F.col("height"))
    yb, ya = maxy - F.col("row") * res, maxy - (F.col("row") + 1) * res
    near = 0
    if buffer_m > 0:  # the divisions round: one row more on each side, and the borders themselves decide
        near, inside = 1, (r1 >= -1) & (r0 <= F.col("height") + 1)
    clip = lambda r: F.least(last, F.greatest(F.lit(0), r)).cast("int")
    rows = joined.filter(inside).withColumn("row", F.explode(F.sequence(clip(r0 - near), clip(r1 + near))))
    if near:
        rows = rows.filter(((yb > bottom) & (ya < top)) | ((F.col("row") == last) & (ya == top)))
    spans = rows.withColumns({"_lo": F.greatest(ya, bottom), "_hi": F.least(yb, top)})
    for sign, name in ((1, "_right"), (-1, "_left")):
        peak = F.when(sign * F.col("x1") >= sign * F.col("x2"), F.col("y1")).otherwise(F.col("y2"))
        spans = _with_reach(spans, sign, F.least(F.col("_hi"), F.greatest(F.col("_lo"), peak)), b, name)
    spans = spans.withColumn("_c0", F.floor((-F.col("_left") - F.col("minx")) / res))
    spans = spans.withColumn("_c1", F.greatest(F.col("_c0"), F.ceil((F.col("_right") - F.col("minx")) / res) - 1))
    last_col = F.col("width") - 1
    clipped = lambda c: F.least(last_col, F.greatest(F.lit(0), F.col(c))).cast("int")
    kept = F.when((F.col("_c1") >= 0) & (F.col("_c0") <= F.col("width")), F.array(F.struct(clipped("_c0").alias("c0"), clipped("_c1").alias("c1"))))
    # exploded, not filtered: a filter would be moved below the steps and repeat them all
    return spans.select(poly, "row", F.explode(kept).alias("_k")).select(poly, "row", "_k.c0", "_k.c1")


def border_runs(edges: DataFrame, spec: DataFrame, poly: str = "poly_id") -> DataFrame:
    """``(poly, row, c0, c1)``: columns whose centres lie exactly on an edge."""
    joined = attach(edges, spec.select(poly, "minx", "maxy", "width", "height", "res"), poly, "inner")
    res, maxy = F.col("res"), F.col("maxy")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    r0 = F.greatest(F.lit(0), F.floor((maxy - high) / res - 0.5)).cast("int")
    r1 = F.least(F.col("height") - 1, F.ceil((maxy - low) / res - 0.5)).cast("int")
    rows = joined.filter(r1 >= r0).withColumn("row", F.explode(F.sequence(r0, r1)))
    y = maxy - (F.col("row") + 0.5) * res
    flat = F.col("y1") == F.col("y2")
    x = F.col("x1") + F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    place = lambda v: (v - F.col("minx")) / res - 0.5
    a, b = F.when(flat, F.least("x1", "x2")).otherwise(x), F.when(flat, F.greatest("x1", "x2")).otherwise(x)
    c0, c1 = F.greatest(F.lit(0), F.ceil(place(a))).cast("int"), F.least(F.col("width") - 1, F.floor(place(b))).cast("int")
    return rows.filter((low <= y) & (y <= high)).select(poly, "row", c0.alias("c0"), c1.alias("c1")).filter("c1 >= c0")


def interior_runs(edges: DataFrame, spec: DataFrame, poly: str = "poly_id") -> DataFrame:
    """``(poly, row, c0, c1)``: columns whose centres lie inside the polygon (even-odd over all rings)."""
    joined = attach(edges.filter(F.col("y1") != F.col("y2")), spec.select(poly, "minx", "maxy", "width", "height", "res"), poly, "inner")
    res, maxy = F.col("res"), F.col("maxy")
    # centre line of row r is at maxy - (r + 0.5) * res
    r0 = F.greatest(F.lit(0), F.ceil((maxy - F.greatest("y1", "y2")) / res - 0.5)).cast("int")
    r1 = F.least(F.col("height") - 1, F.floor((maxy - F.least("y1", "y2")) / res - 0.5)).cast("int")
    rows = joined.filter(r1 >= r0).withColumn("row", F.explode(F.sequence(r0, r1)))
    y = maxy - (F.col("row") + 0.5) * res
    crossing = (F.col("y1") > y) != (F.col("y2") > y)
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = rows.filter(crossing).withColumn("_u", (x - F.col("minx")) / res - 0.5)
    along = Window.partitionBy(poly, "row").orderBy("_u")  # edges crossing one lattice row
    paired = hits.withColumns({"_i": F.row_number().over(along), "_next": F.lead("_u").over(along)}).filter(F.col("_i") % 2 == 1)
    c0, c1 = F.greatest(F.lit(0), F.ceil("_u")).cast("int"), F.least(F.col("width") - 1, F.floor("_next")).cast("int")
    return paired.select(poly, "row", c0.alias("c0"), c1.alias("c1")).filter("c1 >= c0")


def merged_cells(intervals: DataFrame, poly: str = "poly_id") -> DataFrame:
    """Distinct ``(poly, row, col)`` of overlapping intervals, merged before they are exploded."""
    along = Window.partitionBy(poly, "row").orderBy("c0", "c1")
    reach = F.max("c1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = intervals.withColumn("_new", F.coalesce((F.col("c0") > reach).cast("int"), F.lit(1)))
    islands = starts.withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(poly, "row", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    return runs.select(poly, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def polygon_grid(
    edges: DataFrame, res: float = 30.0, buffer_m: float = 0.0, poly: str = "poly_id", spec: DataFrame | None = None, slices: int | None = None
) -> DataFrame:
    """Cells touching each polygon (or within ``buffer_m`` of it), numbered row by row from 1."""
    spec, _ = settle(snapped_spec(edges, res, buffer_m, poly) if spec is None else spec)
    edges = _spread(edges)
    every = touched_intervals(edges, spec, buffer_m, poly).unionByName(interior_runs(edges, spec, poly))
    numbered = rank_in_group(materialize(merged_cells(every, poly)), [poly], [("row", True), ("col", True)], "cell_id", slices)
    placed = attach(numbered, spec.select(poly, "minx", "maxy", "res"), poly)
    return placed.select(
        poly, "cell_id", "row", "col", (F.col("minx") + F.col("col") * F.col("res")).alias("x0"), (F.col("maxy") - F.col("row") * F.col("res")).alias("y1")
    )


def core_flags(cells: DataFrame, core_edges: DataFrame, spec: DataFrame, buffer_m: float = 0.0, poly: str = "poly_id") -> DataFrame:
    """``is_core_city_cell`` (centre inside the core polygon or on its border) and ``is_buffer_ring_cell``.

    Without a buffer every cell is core. A polygon with a buffer but no core edges keeps NULL flags.
    """
    if buffer_m <= 0:
        return cells.withColumns({"is_core_city_cell": F.lit(True), "is_buffer_ring_cell": F.lit(False)})
    closed = interior_runs(core_edges, spec, poly).unionByName(border_runs(core_edges, spec, poly))
    inside = merged_cells(closed, poly).withColumn("_in", F.lit(True))
    known = core_edges.select(poly).distinct().withColumn("_known", F.lit(True))
    flagged = attach(cells, known, poly).join(inside, [poly, "row", "col"], "left")
    core = F.when(F.col("_known"), F.coalesce("_in", F.lit(False)))
    return flagged.withColumns({"is_core_city_cell": core, "is_buffer_ring_cell": ~core}).drop("_in", "_known")


def burn(segments: DataFrame, spec: DataFrame, poly: str = "city_id", filled: str | None = None) -> DataFrame:
    """Distinct lattice cells touched by lines, and by the inside of features marked ``filled``."""
    segments = _spread(segments)
    lines = touched_intervals(segments, spec, 0.0, poly)
    if filled is not None:
        areas = segments.filter(filled)
        keyed = areas.withColumn("_f", F.struct(poly, "feature_id"))
        own = attach(keyed.select("_f", poly).distinct(), spec, poly, "inner").drop(poly)
        inside = interior_runs(keyed.drop(poly), own, "_f").select(F.col(f"_f.{poly}").alias(poly), "row", "c0", "c1")
        lines = lines.unionByName(inside)
    return merged_cells(lines, poly)


def clip_segments(segments: DataFrame) -> DataFrame:
    """Segments cut at the box ``minx, miny, maxx, maxy`` of their row; those outside it are dropped.

    A point of the segment is ``start + t * (end - start)``; each side of the box bounds ``t`` from below where the
    segment comes in through it, from above where it goes out, and decides alone when the segment is parallel to it.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [(-dx, F.col("x1") - F.col("minx")), (dx, F.col("maxx") - F.col("x1")), (-dy, F.col("y1") - F.col("miny")), (dy, F.col("maxy") - F.col("y1"))]
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
    beside = F.lit(False)
    for p, q in sides:
        beside = beside | ((p == 0) & (q < 0))
    cut = segments.withColumns({"_t0": enter, "_t1": leave}).filter(~beside & (F.col("_t0") <= F.col("_t1")))
    at = lambda t, start, d, whole, plain: F.when(whole, F.col(plain)).otherwise(F.col(start) + F.col(t) * d)
    return cut.withColumns({
        "x1": at("_t0", "x1", dx, F.col("_t0") == 0, "x1"), "y1": at("_t0", "y1", dy, F.col("_t0") == 0, "y1"),
        "x2": at("_t1", "x1", dx, F.col("_t1") == 1, "x2"), "y2": at("_t1", "y1", dy, F.col("_t1") == 1, "y2"),
    }).drop("_t0", "_t1")


def water_features(
    segments: DataFrame, bounds: DataFrame, city: str = "city_id", layers: Sequence[str] = tuple(WATER_LAYERS), areas: Sequence[str] = ("NHDWaterbody", "NHDArea"),
) -> DataFrame:
    """Segments of the water layers: code filter, cut at the study-area box, repeated geometries dropped.

    ``bounds`` has ``minx, miny, maxx, maxy`` per city. Lines are cut. Shapes of the ``areas`` layers whose extent meets the box keep
    all their edges, as the inside of a shape is found by counting them; cells outside the lattice are never burned.
    Two features repeat when layer and the set of kept segments agree; the lowest id is kept.
    """
    coded = prefer_codes(segments.filter(F.col("source_layer").isin(list(layers))), "source_layer", "ftype", WATER_CODES)
    placed = attach(coded, bounds, city, "inner")
    is_area = F.col("source_layer").isin(list(areas))
    feature = [city, "source_layer", "feature_id"]
    extents = placed.filter(is_area).groupBy(*feature).agg(
        F.max(F.greatest("x1", "x2") - F.col("minx")).alias("e"), F.max(F.col("maxx") - F.least("x1", "x2")).alias("w"),
        F.max(F.greatest("y1", "y2") - F.col("miny")).alias("n"), F.max(F.col("maxy") - F.least("y1", "y2")).alias("s"),
    ).filter("e >= 0 and w >= 0 and n >= 0 and s >= 0")
    whole_shapes = placed.filter(is_area).join(extents.select(feature), feature, "left_semi")
    boxed = clip_segments(placed.filter(~is_area)).unionByName(whole_shapes).drop("minx", "miny", "maxx", "maxy")
    whole = F.xxhash64("x1", "y1", "x2", "y2")
    second = F.hash("y2", "x2", "y1", "x1").cast("long")
    shapes = boxed.groupBy(city, "source_layer", "feature_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(whole).alias("_a"), F.sum(second).alias("_b"), F.sum(F.pmod(whole, F.lit(2**31))).alias("_c")
    )
    kept = shapes.groupBy(city, "source_layer", "_n", "_a", "_b", "_c").agg(F.min("feature_id").alias("feature_id"))
    return boxed.join(kept.select(city, "source_layer", "feature_id"), [city, "source_layer", "feature_id"], "left_semi")
