"""Lattice (raster) operators on tables keyed by group, row and column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.crs import from_utm, to_utm, utm_epsg
from latticework.functions.numeric import scaled_valid, without_nodata
from latticework.operators.ordering import medians, previous_values
from latticework.session import attach, materialize

# --- fixed values: neighbourhood classes and widths ----------------------------------------------
TREE_CLASSES = [41, 42, 43]
VEGETATED_CLASSES = [41, 42, 43, 52, 71, 81, 82, 90, 95]
NEIGHBOURHOOD_M = 270
NDVI_SCALING = {"scale": 0.0001, "offset": 0.0, "low": -0.2, "high": 1.0}
LST_SCALING = {"scale": 1.0, "offset": 0.0}
# -------------------------------------------------------------------------------------------------


def grid_spec(cells: DataFrame, group: str = "city_id", res: float = 30.0, x0: str = "x0", y1: str = "y1") -> DataFrame:
    """Origin, width and height of each group's lattice from its cells' left and top coordinates."""
    width = F.rint((F.max(x0) + res - F.min(x0)) / res)
    height = F.rint((F.max(y1) - (F.min(y1) - res)) / res)
    return cells.groupBy(group).agg(
        F.min(x0).alias("minx"), F.max(y1).alias("maxy"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(float(res)).alias("res")
    )


def with_row_col(points: DataFrame, spec: DataFrame, group: str = "city_id", x: str = "x", y: str = "y", check: bool = True) -> DataFrame:
    """Row and column of each point in its group's lattice; points outside raise when ``check``."""
    placed = attach(points, spec.select(group, "minx", "maxy", "width", "height", "res"), group).withColumns({
        "row": F.floor((F.col("maxy") - F.col(y)) / F.col("res")).cast("int"),
        "col": F.floor((F.col(x) - F.col("minx")) / F.col("res")).cast("int"),
    })
    if check:
        outside = (F.col("row") < 0) | (F.col("row") >= F.col("height")) | (F.col("col") < 0) | (F.col("col") >= F.col("width"))
        placed = placed.withColumn("row", F.when(~outside, F.col("row")).otherwise(F.raise_error(F.lit("Computed row/col indices fall outside the lattice"))))
    return placed.drop("minx", "maxy", "width", "height", "res")


def base_cells(cells: DataFrame, cities: DataFrame, res: float = 30.0, group: str = "city_id") -> DataFrame:
    """City attributes and centroid longitude/latitude of every cell (``epsg`` comes with the cells)."""
    named = attach(cells, cities.select(group, "city_name", "climate_group"), group, "inner")
    centred = named.withColumns({"_x": F.col("x0") + res / 2.0, "_y": F.col("y1") - res / 2.0})
    return from_utm(centred, "_x", "_y", "epsg", "centroid_lon", "centroid_lat").drop("_x", "_y")


def city_points(cities: DataFrame) -> DataFrame:
    """City centres as points, with their UTM zone."""
    return cities.select("*", F.col("lon").alias("x"), F.col("lat").alias("y"), utm_epsg("lon", "lat").alias("epsg"))


def _listed(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def box_cells(df: DataFrame, group: str | Sequence[str] = "city_id", row: str = "row", col: str = "col") -> DataFrame:
    """Every (row, col) of each group's bounding box, once."""
    keys = _listed(group)
    box = df.groupBy(*keys).agg(F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1"))
    # spread before the wide explode; a fixed number, as the stage is short in bytes and long in work
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = box.withColumn(row, F.explode(F.sequence("r0", "r1"))).repartition(parts, *keys, row)
    return rows.withColumn(col, F.explode(F.sequence("c0", "c1"))).select(*keys, row, col)


def densify(df: DataFrame, group: str | Sequence[str] = "city_id", row: str = "row", col: str = "col") -> DataFrame:
    """Every (row, col) of each group's bounding box, values NULL where there was no row."""
    return box_cells(df, group, row, col).join(df, [*_listed(group), row, col], "left")


def stack_median(
    pixels: DataFrame, keys: Sequence[str] = ("city_id", "cell_id"), value: str = "value", scaling: dict | None = None,
    median: str = "median", count: str = "n_valid", slices: int | None = None,
) -> DataFrame:
    """Median and count of valid values per cell over all acquisitions, after scaling and range masking."""
    v = pixels.withColumn("_v", scaled_valid(F.col(value).cast("double"), **(scaling or {})))
    counts = v.groupBy(*keys).agg(F.count("_v").alias(count))
    return counts.join(medians(v, keys, {median: "_v"}, slices), list(keys), "left")


def listed_median(values: Column) -> Column:
    """Median of an array of doubles, computed as ``ordering.quantiles`` does; NULL when it is empty."""
    ordered, place = F.array_sort(values), (F.size(values) - 1) * F.lit(0.5)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def sample_nearest(cells: DataFrame, pixels: DataFrame, rasters: DataFrame, group: str = "city_id", x: str = "x", y: str = "y") -> DataFrame:
    """Value of the pixel holding each point for every raster of its group; nodata becomes NULL."""
    placed = attach(cells, rasters.select(group, "raster_id", "rx0", "ry0", "rres", "nodata"), group, "inner").withColumns({
        "prow": F.floor((F.col("ry0") - F.col(y)) / F.col("rres")).cast("int"), "pcol": F.floor((F.col(x) - F.col("rx0")) / F.col("rres")).cast("int"),
    })
    wanted = attach(pixels, rasters.select("raster_id").distinct(), "raster_id", "left_semi")  # before any shuffle of pixels
    values = wanted.select("raster_id", F.col("row").alias("prow"), F.col("col").alias("pcol"), F.col("value").alias("_raw"))
    joined = placed.join(values, ["raster_id", "prow", "pcol"], "left")
    return joined.withColumn("value", without_nodata("_raw", "nodata")).drop("_raw", "prow", "pcol", "rx0", "ry0", "rres", "nodata")


def _corner(dr: int, dc: int) -> Column:
    """Pixel of one of the four neighbours of a place ``_v, _u`` (in pixels), and its weight."""
    v, u = F.col("_v") - F.floor("_v"), F.col("_u") - F.floor("_u")
    return F.struct((F.floor("_v") + dr).cast("int").alias("prow"), (F.floor("_u") + dc).cast("int").alias("pcol"), ((v if dr else 1 - v) * (u if dc else 1 - u)).alias("w"))


def _weighted(x: Column, w: Column) -> Column:
    """Mean of the values present by their weights, NULL without any weight."""
    weight = F.sum(F.when(x.isNotNull(), w))
    return F.when(weight > 0, F.try_divide(F.sum(w * x), weight))


def sample_bilinear(cells: DataFrame, pixels: DataFrame, rasters: DataFrame, keys: Sequence[str], group: str = "city_id", x: str = "x", y: str = "y") -> DataFrame:
    """Four-neighbour weighted value per point and raster; missing neighbours drop out of the weights."""
    every = rasters.select(group, "raster_id", "rx0", "ry0", "rres", "nodata", F.lit(False).alias("nearest"))
    wanted = attach(pixels, rasters.select("raster_id").distinct(), "raster_id", "left_semi")  # before any shuffle of pixels
    return sample_rasters(cells, wanted, every, keys, (), group, x, y)


def sample_rasters(
    cells: DataFrame, pixels: DataFrame, rasters: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), group: str = "city_id", x: str = "x", y: str = "y"
) -> DataFrame:
    """``keys, raster_id, value`` of every point and raster of its group, all rasters in one join with the pixels.

    Rasters that are ``nearest`` give the pixel holding the point, others the four-neighbour weighted value, where missing
    neighbours drop out of the weights. ``carry`` are further columns of the rasters to keep. The rows come partitioned by ``keys``.
    """
    placed = attach(cells.select(*keys, *[c for c in (x, y) if c not in keys]), rasters.select(group, "raster_id", "rx0", "ry0", "rres", "nodata", "nearest", *carry), group, "inner").withColumns({
        "_u": (F.col(x) - F.col("rx0")) / F.col("rres"), "_v": (F.col("ry0") - F.col(y)) / F.col("rres")})
    placed = placed.withColumns({a: F.when(F.col("nearest"), F.col(a)).otherwise(F.col(a) - 0.5) for a in ("_u", "_v")})
    own = F.struct(F.floor("_v").cast("int").alias("prow"), F.floor("_u").cast("int").alias("pcol"), F.lit(1.0).alias("w"))
    corners = F.when(F.col("nearest"), F.array(own)).otherwise(F.array(_corner(0, 0), _corner(0, 1), _corner(1, 0), _corner(1, 1)))
    spread = placed.withColumn("_c", F.explode(corners)).select(*keys, "raster_id", *carry, "nodata", "_c.prow", "_c.pcol", "_c.w")
    values = pixels.select("raster_id", F.col("row").alias("prow"), F.col("col").alias("pcol"), F.col("value").alias("_raw"))
    joined = spread.join(values, ["raster_id", "prow", "pcol"], "left").withColumn("_x", without_nodata("_raw", "nodata"))
    # by the point alone: what follows per point needs no further shuffle
    return joined.repartition(*keys).groupBy(*keys, "raster_id", *carry).agg(_weighted(F.col("_x"), F.col("w")).alias("value"))


def window_means(
    df: DataFrame, planes: dict[str, Column], radius: int, group: str = "city_id", row: str = "row", col: str = "col", dense: bool = False,
    keep_all: bool = False,
) -> DataFrame:
    """Centred square-window mean of each plane over its non-null cells, clipped at the edges.

    Two passes of range windows, along rows and then along columns, so a task holds one lattice row or
    column. A lattice with holes is filled to its bounding box first; results are kept for its own cells.
    """
    if radius < 0:
        raise ValueError("radius must be non-negative")
    marked = df.withColumns({**{f"_p_{n}": p.cast("double") for n, p in planes.items()}, "_cell": F.lit(True)})
    full = marked if dense else densify(marked, group, row, col)
    across = Window.partitionBy(group, row).orderBy(col).rangeBetween(-radius, radius)
    down = Window.partitionBy(group, col).orderBy(row).rangeBetween(-radius, radius)
    first = full.withColumns({k: v for n in planes for k, v in ((f"_s_{n}", F.sum(f"_p_{n}").over(across)), (f"_n_{n}", F.count(f"_p_{n}").over(across)))})
    second = first.withColumns({k: v for n in planes for k, v in ((f"_S_{n}x", F.sum(f"_s_{n}").over(down)), (f"_N_{n}x", F.sum(f"_n_{n}").over(down)))})
    out = second if keep_all else second.filter("_cell")
    helpers = [f"{a}_{n}{b}" for n in planes for a, b in (("_p", ""), ("_s", ""), ("_n", ""), ("_S", "x"), ("_N", "x"))]
    return out.withColumns({n: F.try_divide(f"_S_{n}x", f"_N_{n}x") for n in planes}).drop("_cell", *helpers)


def class_share(klass: str, classes: Sequence[int]) -> Column:
    """1/0 indicator of a class set, NULL where the class is unknown (input of a window share)."""
    if not classes:
        raise ValueError("classes must contain at least one code")
    return F.when(F.col(klass).isNotNull(), F.col(klass).isin(list(classes)).cast("double"))


def window_radius(res: float, width_m: float = NEIGHBOURHOOD_M) -> int:
    """Radius in cells of an odd window about ``width_m`` wide."""
    if res <= 0:
        raise ValueError("resolution must be positive")
    cells = max(round(width_m / float(res)), 1)
    return (cells + 1 if cells % 2 == 0 else cells) // 2


def neighbourhood(df: DataFrame, klass: str, impervious: str, res: float = 30.0, group: str = "city_id", dense: bool = False) -> DataFrame:
    """Tree share, vegetated share and mean imperviousness around each cell, in one pass."""
    planes = {
        "tree_cover_proxy_pct_270m": class_share(klass, TREE_CLASSES),
        "vegetated_cover_proxy_pct_270m": class_share(klass, VEGETATED_CLASSES),
        "impervious_pct_mean_270m": F.col(impervious),
    }
    return window_means(df, planes, window_radius(res), group, dense=dense)


def mosaic(pixels: DataFrame, order: str, keys: Sequence[str] = ("city_id", "row", "col"), value: str = "value") -> DataFrame:
    """Overlapping tiles as one lattice: the first non-null value in source order."""
    seen = F.col(value).isNotNull()
    return pixels.groupBy(*keys).agg(F.min_by(F.when(seen, F.col(value)), F.when(seen, F.col(order))).alias(value))


def clip(pixels: DataFrame, cells: DataFrame, keys: Sequence[str] = ("city_id", "row", "col")) -> DataFrame:
    return pixels.join(cells.select(*keys).distinct(), list(keys), "left_semi")


def distance_to_marked(
    df: DataFrame, marked: str, res: float | str = 30.0, group: str | Sequence[str] = "city_id", row: str = "row", col: str = "col", name: str = "distance",
    dense: bool = False,
) -> DataFrame:
    """Exact Euclidean distance from each cell to the nearest marked cell; NULL in groups without one.

    First the distance inside each column by windows, then the minimum along each lattice row in numpy.
    """
    keys = _listed(group)
    base = df.withColumn("_m", F.coalesce(F.col(marked).cast("boolean"), F.lit(False)))
    slim = base.select(*keys, row, col, "_m", F.lit(True).alias("_cell"))
    full = slim if dense else densify(slim, keys, row, col)
    down = Window.partitionBy(*keys, col).orderBy(row)
    at = F.when(F.col("_m"), F.col(row))
    above = F.last(at, True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    # from the end upwards: a frame that ends unbounded is summed up anew for every row
    below = F.last(at, True).over(Window.partitionBy(*keys, col).orderBy(F.col(row).desc()).rowsBetween(Window.unboundedPreceding, 0))
    gaps = F.least(F.col(row) - above, below - F.col(row)).cast("double")
    column = full.withColumn("_gap", gaps).select(*keys, row, col, "_gap", "_cell")

    def along_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in whole_lines(batches, [*keys, row]):
            places_all, gaps_all = chunk[col].to_numpy(), chunk["_gap"].to_numpy(dtype="float64", na_value=np.inf) ** 2
            found = np.empty(len(chunk))
            for start, stop in line_bounds(chunk, [*keys, row]):
                places = places_all[start:stop] - places_all[start]
                best = np.full(places[-1] + 1, np.inf)
                best[places] = gaps_all[start:stop]
                gap, step = best.copy(), 1
                while step < len(gap) and step * step < best.max():
                    best[step:] = np.minimum(best[step:], gap[:-step] + step * step)
                    best[:-step] = np.minimum(best[:-step], gap[step:] + step * step)
                    step += 1
                found[start:stop] = np.sqrt(best[places])
            kept = chunk["_cell"].eq(True).to_numpy(dtype=bool)
            out = chunk.loc[kept, [*keys, row, col]]
            yield out.assign(_d=np.where(np.isfinite(found[kept]), found[kept], np.nan))

    shape = T.StructType([*[full.schema[k] for k in keys], full.schema[row], full.schema[col], T.StructField("_d", T.DoubleType())])
    found = by_line(column, [*keys, row], col).mapInPandas(along_rows, shape)
    metres = F.col("_d") * (F.col(res) if isinstance(res, str) else F.lit(float(res)))
    return df.join(found, [*keys, row, col], "left").withColumn(name, F.when(~F.isnan("_d"), metres)).drop("_d")


def by_line(df: DataFrame, lines: Sequence[str], along: str) -> DataFrame:
    """Rows of one lattice line together in one partition and in order."""
    # a fixed number: these stages are short in bytes and long in work, so AQE should not merge them
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *lines).sortWithinPartitions(*lines, along)


def line_bounds(chunk: pd.DataFrame, lines: Sequence[str]) -> list[tuple[int, int]]:
    """(start, stop) of each run of equal line keys."""
    changed = np.zeros(len(chunk) - 1, dtype=bool)
    for key in lines:
        values = chunk[key].to_numpy()
        changed |= values[1:] != values[:-1]
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(chunk)]
    return list(zip(edges[:-1], edges[1:]))


def whole_lines(batches: Iterator[pd.DataFrame], lines: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Arrow batches regrouped so that no line is split; holds one batch and one line at a time."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = line_bounds(batch, lines)[-1][0]
        if last:
            yield batch.iloc[:last].reset_index(drop=True)
        rest = batch.iloc[last:].reset_index(drop=True)
    if rest is not None:
        yield rest


def _kernel(sigma: float) -> np.ndarray:
    reach = int(4.0 * sigma + 0.5)
    offsets = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    return weights / weights.sum()


def gaussian_smooth(
    df: DataFrame, planes: Sequence[str], sigma: str, valid: str, groups: Sequence[str] = ("city_id",), row: str = "row", col: str = "col",
) -> DataFrame:
    """Mask-normalised Gaussian smoothing; ``sigma`` (in cells) is a column constant within a group.

    Values and the mask are filtered alike, zero outside, cut at four sigma; then value / weight. Rows
    first, then columns. Put the scale into ``groups`` for several at once.
    """
    planes = list(planes)
    groups = list(groups)
    base = df.filter(valid).select(*groups, row, col, sigma, *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in planes], F.lit(1.0).alias("_w"))
    numbers = [*planes, "_w"]

    def smooth(along: str, other: str, every: bool):
        lines = [*groups, other]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for chunk in whole_lines(batches, lines):
                where, sigmas = chunk[along].to_numpy(), chunk[sigma].to_numpy()
                source = {n: chunk[n].to_numpy() for n in numbers}
                flags = np.ones(len(chunk), dtype=bool) if every else chunk["_cell"].to_numpy(dtype=bool)
                parts, heads, sizes = [], [], []
                for start, stop in line_bounds(chunk, lines):
                    kernel = _kernel(float(sigmas[start]))
                    reach = len(kernel) // 2
                    first = where[start] - reach
                    size = where[stop - 1] - first + reach + 1
                    places = where[start:stop] - first
                    line = np.zeros((size, len(numbers) + 2))
                    line[:, 0] = np.arange(first, first + size)
                    for j, name in enumerate(numbers):
                        dense = np.zeros(size)
                        dense[places] = source[name][start:stop]
                        line[:, j + 1] = np.convolve(dense, kernel, mode="same") if size >= len(kernel) else np.convolve(dense, kernel)[reach:reach + size]
                    line[places, -1] = flags[start:stop]
                    parts.append(line)
                    heads.append(start)
                    sizes.append(size)
                values = np.concatenate(parts)
                out = chunk.iloc[np.repeat(heads, sizes)][[*lines, sigma]].reset_index(drop=True)
                out[along] = values[:, 0].astype("int32")
                for j, name in enumerate(numbers):
                    out[name] = values[:, j + 1]
                out["_cell"] = values[:, -1] > 0
                yield out[names]

        return run

    fields = [*[df.schema[g] for g in groups], T.StructField(row, T.IntegerType()), T.StructField(col, T.IntegerType()), df.schema[sigma],
              *[T.StructField(n, T.DoubleType()) for n in numbers], T.StructField("_cell", T.BooleanType())]
    shape = T.StructType(fields)
    names = shape.fieldNames()
    ints = base.withColumns({row: F.col(row).cast("int"), col: F.col(col).cast("int")})
    across = by_line(ints, [*groups, row], col).mapInPandas(smooth(col, row, True), shape)
    # only lattice columns that hold a cell are needed below
    used = ints.select(*groups, col).distinct()
    narrowed = across.join(used, [*groups, col], "left_semi")
    down = by_line(narrowed, [*groups, col], row).mapInPandas(smooth(row, col, False), shape)
    smoothed = down.filter("_cell").withColumns({p: F.when(F.col("_w") > 0, F.col(p) / F.col("_w")) for p in planes}).drop("_w", "_cell")
    return smoothed


def reconstruct_grid(
    points: DataFrame, group: str = "city_id", lon: str = "centroid_lon", lat: str = "centroid_lat", values: Sequence[str] = ("hotspot_10pct", "predicted_probability"),
    slices: int | None = None,
) -> DataFrame:
    """Lattice back from centroid coordinates: projected zone, spacing, row/col, duplicates averaged, status.

    Spacing is the median step above one metre between distinct coordinates of each axis, then the mean
    of the two axes. A single line of cells has only one axis with steps; that axis is used.
    """
    middle = medians(points, [group], {"_mlon": lon, "_mlat": lat}, slices).select(group, utm_epsg("_mlon", "_mlat").alias("epsg"))
    slim = points.select(group, lon, lat, *values)
    placed = to_utm(attach(slim, middle, group), lon, lat, "epsg").select(group, "epsg", "x_m", "y_m", *[F.col(v).cast("double").alias(v) for v in values])
    placed = materialize(placed)  # projected once, read by every step below

    def spacing(axis: str, name: str) -> DataFrame:
        distinct = placed.select(group, F.bround(axis, 2).alias("_c")).distinct()
        steps = previous_values(distinct, [group], [("_c", True)], {"_p": "_c"}, slices).withColumn("_d", F.col("_c") - F.col("_p"))
        return medians(steps.filter(F.col("_d") > 1.0), [group], {name: "_d"}, slices)

    extent = placed.groupBy(group).agg(F.min("x_m").alias("minx"), F.min("y_m").alias("miny"), F.max("y_m").alias("maxy"))
    spec = extent.join(spacing("x_m", "_sx"), group, "left").join(spacing("y_m", "_sy"), group, "left")
    spec = spec.withColumns({
        "cell_m": F.coalesce((F.col("_sx") + F.col("_sy")) / 2.0, "_sx", "_sy"),
        "_fallback": F.col("_sx").isNull() | F.col("_sy").isNull(),
    }).drop("_sx", "_sy")
    rows = attach(placed, spec, group).withColumns({
        "col": F.rint((F.col("x_m") - F.col("minx")) / F.col("cell_m")).cast("int"),
        "_up": F.rint((F.col("y_m") - F.col("miny")) / F.col("cell_m")).cast("int"),
        "_top": F.rint((F.col("maxy") - F.col("miny")) / F.col("cell_m")).cast("int"),
    })
    cells = rows.withColumn("row", F.col("_top") - F.col("_up")).groupBy(group, "row", "col").agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("_k"),
        *[F.first(c).alias(c) for c in ("epsg", "cell_m", "minx", "maxy", "_fallback")],
    )
    repeats = cells.groupBy(group).agg(F.sum(F.col("_k") - 1).alias("_dup"), F.sum("_k").alias("row_count"))
    size = F.col("cell_m")
    parts = F.array_compact(F.array(
        F.when(F.col("_fallback"), F.lit("spacing_inferred_from_nearest_neighbor")),
        F.when(~size.between(20.0, 40.0), F.concat(F.lit("unexpected_grid_cell_size_"), F.format_string("%.2f", size), F.lit("m"))),
        F.when(F.col("_dup") > 0, F.concat(F.lit("duplicate_grid_cells_"), F.col("_dup").cast("string"))),
    ))
    return attach(cells, repeats, group).withColumns({
        "x": F.col("minx") + F.col("col") * size, "y": F.col("maxy") - F.col("row") * size,
        "status": F.when(F.size(parts) == 0, "ok").otherwise(F.array_join(parts, ";")),
    }).drop("_k", "_dup", "_fallback", "minx", "maxy")
