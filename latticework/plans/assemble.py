"""One cell table for all cities from lattices, pixels and water lines, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions.numeric import scaled_valid
from latticework.operators import geometry, lattice, rules
from latticework.operators.label import label_top_share
from latticework.session import attach, materialize

# --- fixed values: stage names reported as blocked when a city lacks the product -------------------
STAGES = {
    "dem": ["dem"],
    "land_cover": ["nlcd_land_cover", "phase3a_tree_cover_proxy", "phase3a_vegetated_cover_proxy"],
    "impervious": ["nlcd_impervious", "phase3a_impervious_context"],
    "water": ["hydro_distance"],
    "ndvi": ["ndvi"],
    "lst": ["ecostress_lst"],
}
# ---------------------------------------------------------------------------------------------------

KEYS = ["city_id", "row", "col"]


def blocked_stages(cities: DataFrame, rasters: DataFrame, segments: DataFrame) -> DataFrame:
    """Sorted stage names per city whose product is absent."""
    have = rasters.select("city_id", "product").union(segments.select("city_id", F.lit("water").alias("product"))).distinct()
    seen = have.groupBy("city_id").agg(F.collect_set("product").alias("_have"))  # at most six each
    missing = F.array_sort(F.flatten(F.array(*[
        F.when(F.coalesce(F.array_contains("_have", p), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(*[F.lit(s) for s in stages]))
        for p, stages in STAGES.items()
    ])))
    return cities.select("city_id").join(seen, "city_id", "left").select("city_id", missing.alias("blocked_stages"))


def layers(points: DataFrame, pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """Sampled values of every point whose city has a raster, the pixels being read and shuffled once for all products.

    Of several rasters of a product, land cover, imperviousness and elevation take the first one with a value; the others
    give the median over rasters. A point's list of values is as long as its city has rasters of the product.
    """
    kinds = ["land_cover", "impervious", "dem", "ndvi", "lst"]
    used = rasters.filter(F.col("product").isin(kinds)).withColumns({"nearest": F.col("product") == "land_cover", "_kind": F.array_position(F.array(*map(F.lit, kinds)), F.col("product")).cast("byte")})
    values = lattice.sample_rasters(points, pixels, used, KEYS, ["_kind"])
    of = lambda product: F.col("_kind") == kinds.index(product) + 1
    first = lambda product: F.min_by("value", F.when(of(product) & F.col("value").isNotNull(), F.col("raster_id")))
    valid = lambda product, scaling: F.collect_list(F.when(of(product), scaled_valid(F.col("value"), **scaling)))
    found = values.groupBy(*KEYS).agg(
        first("land_cover").alias("land_cover_class"), first("impervious").alias("impervious_pct"), first("dem").alias("elevation_m"),
        valid("ndvi", lattice.NDVI_SCALING).alias("_ndvi"), valid("lst", lattice.LST_SCALING).alias("_lst"), F.count_if(of("lst")).alias("_passes"),
    )
    return found.withColumns({
        "ndvi_median_may_aug": lattice.listed_median(F.col("_ndvi")), "lst_median_may_aug": lattice.listed_median(F.col("_lst")),
        "n_valid_ecostress_passes": F.when(F.col("_passes") > 0, F.size("_lst").cast("long")),
    }).drop("_ndvi", "_lst", "_passes")


def assemble_cells(
    cells: DataFrame, cities: DataFrame, rasters: DataFrame, pixels: DataFrame, segments: DataFrame, res: float = 30.0,
    mode: str = "study_area", filled: str | None = None, context: Sequence[str] = tuple(schema.CONTEXT_FLAGS),
) -> tuple[DataFrame, DataFrame]:
    """(unfiltered, final) cell tables.

    ``cells``: city_id, cell_id, row, col, x0, y1, epsg and optional context flags. ``rasters``: raster_id,
    city_id, product, rx0, ry0, rres, nodata. Neighbourhoods and distances use the whole bounding box of a
    city, cells outside the study area included; the results are then joined to the cells.
    """
    cells = materialize(cells)  # the lattices below are read by every layer: stored once, like any shared table
    base = lattice.base_cells(cells, cities, res)
    spec = lattice.grid_spec(cells, "city_id", res)
    box = lattice.box_cells(cells)
    centred = materialize(attach(box, spec.select("city_id", "minx", "maxy"), "city_id").select(
        *KEYS, (F.col("minx") + (F.col("col") + 0.5) * res).alias("x"), (F.col("maxy") - (F.col("row") + 0.5) * res).alias("y")
    ))
    sampled = layers(centred, pixels, rasters)
    water = geometry.burn(segments, spec, "city_id", filled).withColumn("_water", F.lit(True))
    sampled = materialize(centred.select(*KEYS).join(sampled, KEYS, "left").join(water, KEYS, "left"))

    around = lattice.neighbourhood(sampled.drop("_water"), "land_cover_class", "impervious_pct", res, dense=True)
    # both layers are needed for any neighbourhood column
    both = sampled.groupBy("city_id").agg((F.max(F.col("land_cover_class").isNotNull()) & F.max(F.col("impervious_pct").isNotNull())).alias("_both"))
    around = attach(around, both, "city_id").withColumns({c: F.when(F.col("_both"), F.col(c)) for c in schema.NEIGHBOURHOOD_FEATURES}).drop("_both")
    distance = lattice.distance_to_marked(sampled.select(*KEYS, "_water"), "_water", res, name="dist_to_water_m", dense=True).drop("_water")

    joined = base.join(around, KEYS, "left").join(distance, KEYS, "left")
    joined = joined.withColumn("land_cover_class", F.rint("land_cover_class").cast("bigint"))
    unfiltered = materialize(schema.complete_columns(schema.coerce_types(joined), schema.CELL, [*context, "row", "col"]))
    kept = rules.cell_filter(unfiltered, mode, group="city_id") if mode == "core_city" else unfiltered
    ruled = rules.group_rules(kept, gates=unfiltered)
    final = schema.complete_columns(label_top_share(ruled), schema.CELL, [*context, "row", "col"])
    return unfiltered, final


def merge_final(tables: DataFrame) -> DataFrame:
    """Many cities' cell tables to the final one: final drop rules, label recomputed per city."""
    return schema.complete_columns(label_top_share(rules.final_rules(schema.coerce_types(schema.complete_columns(tables)))))
