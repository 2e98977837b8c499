"""File inventories as tables: which raster and vector files belong to which city, and storage reports.

Only path, size and time are read; file contents never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.text import slug
from latticework.session import attach, settle

# --- fixed values: name tokens, extensions, cache categories -------------------------------------
RASTER_EXTENSIONS = ["tif", "tiff"]
VECTOR_EXTENSIONS = ["gpkg", "shp", "geojson", "json"]
QUALITY_TOKENS = {"ndvi": ["quality", "qa", "qc"], "lst": ["cloud", "quality", "qa", "qc", "error", "err"]}
PRODUCT_TOKENS = {"ndvi": ["mod13a1"], "lst": ["eco", "l2t", "lste"]}
CATEGORY_PREFIXES = {
    "dem/tiles/": "dem_tile",
    "nlcd/bundles/": "nlcd_bundle",
    "nlcd/extracted/": "nlcd_extracted",
    "hydro/packages/": "hydro_package",
    "hydro/extracted/": "hydro_extracted",
}
RETENTION = {
    "dem_tile": "useful_to_keep_temporarily",
    "nlcd_bundle": "must_keep",
    "nlcd_extracted": "safe_to_delete_regenerate",
    "hydro_package": "useful_to_keep_temporarily",
    "hydro_extracted": "safe_to_delete_regenerate",
    "partial_download": "safe_to_delete_regenerate",
    "unknown": "useful_to_keep_temporarily",
}
PRUNE_MODES = {
    "partials": ["partial_download"],
    "nlcd-extracted": ["nlcd_extracted"],
    "hydro-extracted": ["hydro_extracted"],
    "extracted": ["nlcd_extracted", "hydro_extracted"],
    "regenerable": ["partial_download", "nlcd_extracted", "hydro_extracted"],
}
# -------------------------------------------------------------------------------------------------


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``(path, length, modificationTime)`` of every file below ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", "length", "modificationTime")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def name_tokens(path: Column | str) -> Column:
    stem = F.regexp_replace(F.lower(file_name(path)), r"\.[^.]*$", "")
    return F.filter(F.split(stem, "[^a-z0-9]+"), lambda t: t != "")


def is_value_layer(path: Column | str, layer: str) -> Column:
    """True for the value raster of a product download, false for its quality layers."""
    layer = layer.strip().lower()
    if layer not in QUALITY_TOKENS:
        raise ValueError(f"Unsupported layer: {layer}")
    tokens = name_tokens(path)
    marked = F.exists(tokens, lambda t: t.startswith("aid") | t.startswith("doy"))
    words = lambda names: F.array(*[F.lit(n) for n in names])
    return (
        F.array_contains(tokens, layer)
        & ~F.arrays_overlap(tokens, words(QUALITY_TOKENS[layer]))
        & (marked | F.arrays_overlap(tokens, words(PRODUCT_TOKENS[layer])))
    )


def city_folder_files(files: DataFrame, cities: DataFrame, root: str, extensions: Sequence[str] = tuple(RASTER_EXTENSIONS)) -> DataFrame:
    """Files under ``<root>/<city slug>/``, joined to their city on the folder name."""
    marker = root.rstrip("/") + "/"
    tail = F.substring_index("path", marker, -1)
    found = files.filter(F.col("path").contains(marker) & extension("path").isin(list(extensions)))
    keyed = found.withColumn("city_slug", F.when(tail.contains("/"), F.substring_index(tail, "/", 1)))
    return keyed.join(cities.select("city_id", "city_name", slug("city_name").alias("city_slug")), "city_slug")


def product_rasters(files: DataFrame, tokens: Sequence[str] = (), layer: str | None = None) -> DataFrame:
    """Per city: the value rasters of ``layer`` if there are any, else the files whose name has a token."""
    name = F.lower(file_name("path"))
    by_token = F.lit(not tokens)
    for token in tokens:
        by_token = by_token | name.contains(token.lower())
    if layer is None:
        return files.filter(by_token)
    marked = files.withColumns({"_native": is_value_layer("path", layer), "_token": by_token})
    any_native = marked.groupBy("city_id").agg(F.bool_or("_native").alias("_any"))
    return attach(marked, any_native, "city_id").filter(F.when(F.col("_any"), F.col("_native")).otherwise(F.col("_token"))).drop("_native", "_token", "_any")


def city_or_global(files: DataFrame, cities: DataFrame) -> DataFrame:
    """Files naming a city, by its name or id; a city named by none gets every file.

    Names are matched by joining every substring of a file name that is as long as some city key,
    so the join stays an equality. Cities that no file names are few by nature; they are settled as a small table and
    broadcast, and too many of them are an error.
    """
    lowered = F.regexp_replace(F.lower(F.trim("city_name")), " ", "_")
    keys = cities.select(
        "city_id",
        F.explode(F.array(lowered, F.concat(F.lit("_"), F.col("city_id").cast("string"), F.lit("_")), F.format_string("%02d_", F.col("city_id").cast("long")))).alias("_key"),
    )
    sizes = sorted(r[0] for r in keys.select(F.length("_key")).distinct().collect())  # lengths of names, a few dozen at most
    name = F.lower(file_name("path"))

    def substrings(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - size + 1))
        return F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))

    pieces = F.flatten(F.array(*[substrings(size) for size in sizes]))
    hits = files.select("path", F.explode(F.array_distinct(pieces)).alias("_key")).join(keys, "_key").select("path", "city_id").distinct()
    unnamed = cities.select("city_id").join(hits.select("city_id").distinct(), "city_id", "left_anti")
    unnamed, few = settle(unnamed)
    if not few:
        raise ValueError("Too many cities without a file of their own")
    everything = files.select("path").crossJoin(F.broadcast(unnamed))
    return hits.unionByName(everything)


def existing_paths(expected: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Expected paths with an ``exists`` flag."""
    return expected.join(files.select(F.col("path").alias(path), F.lit(True).alias("exists")).distinct(), path, "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))
    )


def cache_category(relative: Column | str) -> Column:
    text = F.lower(relative)
    out = F.when(text.endswith(".part"), "partial_download")
    for prefix, name in CATEGORY_PREFIXES.items():
        out = out.when(text.startswith(prefix), name)
    return out.otherwise("unknown")


def cache_report(files: DataFrame, root: str, now: Column, modes: Sequence[str] = ("regenerable",), recent_hours: float = 24.0) -> DataFrame:
    """Category, retention, age and the reason a cached file may not be removed (blank when it may)."""
    for mode in modes:
        if mode not in PRUNE_MODES:
            raise ValueError(f"Unsupported prune mode: {mode}")
    wanted = sorted({c for mode in modes for c in PRUNE_MODES[mode]})
    named = files.withColumn("relative_path", F.substring_index("path", root.rstrip("/") + "/", -1))
    named = named.withColumns({
        "category": cache_category("relative_path"), "_name": file_name("path"),
        "age_hours": (now.cast("timestamp").cast("double") - F.col("modificationTime").cast("double")) / 3600.0,
    })
    zips = named.filter((F.col("category") == "nlcd_bundle") & F.col("_name").endswith(".zip"))
    bundles = zips.agg(  # one row
        F.coalesce(F.bool_or(F.col("_name").contains("LndCov")), F.lit(False)).alias("_land"),
        F.coalesce(F.bool_or(F.col("_name").contains("FctImp")), F.lit(False)).alias("_imp"),
        (F.count(F.lit(1)) > 0).alias("_any"),
    )
    parts = F.split("_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    packages = named.filter((F.col("category") == "hydro_package") & (extension("path") == "zip")).select(
        F.explode(prefixes).alias("_stem"), F.lit(True).alias("_package")
    ).distinct()
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    joined = named.withColumn("_stem", stem).join(packages, "_stem", "left").crossJoin(F.broadcast(bundles))
    lower = F.lower("_name")
    bundle = F.when(lower.contains("lndcov"), F.col("_land")).when(lower.contains("fctimp"), F.col("_imp")).otherwise(F.col("_any"))
    reason = (
        F.when(~F.col("category").isin(wanted), "mode_excluded")
        .when(F.col("age_hours") < recent_hours, f"recent_file_under_{recent_hours:g}_hours")
        .when((F.col("category") == "nlcd_extracted") & ~bundle, "missing_source_bundle")
        .when((F.col("category") == "hydro_extracted") & F.col("_package").isNull(), "missing_source_package")
        .when(F.col("category") == "unknown", "unknown_category")
        .otherwise("")
    )
    retention = F.create_map(*[F.lit(x) for pair in RETENTION.items() for x in pair])
    return joined.select(
        "path", "relative_path", "category", retention[F.col("category")].alias("retention_class"), F.col("length").alias("size_bytes"),
        F.bround("age_hours", 2).alias("age_hours"), reason.alias("prune_block_reason"), (reason == "").alias("prune_eligible"),
    )


def storage_summary(report: DataFrame, keys: Sequence[str] = ("category", "retention_class")) -> DataFrame:
    return report.groupBy(*keys).agg(
        F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("file_count"),
        F.bround(F.sum("size_bytes") / float(1024**3), 3).alias("size_gb"), F.count_if("prune_eligible").alias("prune_eligible_count"),
    )


def folder_of(path: Column | str, root: str, depth: int = 1) -> Column:
    """First ``depth`` folders below ``root``."""
    return F.substring_index(F.substring_index(path, root.rstrip("/") + "/", -1), "/", depth)


def support_flags(cities: DataFrame, files: DataFrame, dirs: dict[str, str], resolution: int = 30) -> DataFrame:
    """Existence flags of study areas, grids, raw sources and prepared layers, one row per city.

    ``dirs`` names the folders: study_areas, city_grids, raw_dem, raw_nlcd, raw_hydro, support_layers.
    """
    from latticework.functions.text import stem as city_stem

    d = {k: v.rstrip("/") for k, v in dirs.items()}
    base = city_stem("city_id", "city_name", "state")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    prepared = join(d["support_layers"], "/", base, "/")
    expected = {
        "study_area_exists": join(d["study_areas"], "/", base, "_study_area.gpkg"),
        "grid_exists": join(d["city_grids"], "/", base, f"_grid_{int(resolution)}m.gpkg"),
        "dem_prepared_exists": join(prepared, "dem_prepared.tif"),
        "nlcd_land_cover_prepared_exists": join(prepared, "nlcd_land_cover_prepared.tif"),
        "nlcd_impervious_prepared_exists": join(prepared, "nlcd_impervious_prepared.tif"),
        "hydro_prepared_exists": join(prepared, "hydro_water_prepared.gpkg"),
    }
    plain = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    wanted = cities.select("city_id", F.explode(F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), v)])).alias("flag", "path"))
    found = existing_paths(wanted, plain).select("city_id", "flag", "exists")

    def sources(flag: str, folder: str, kinds: Sequence[str], keep: Column) -> DataFrame:
        inside = city_folder_files(plain, cities, d[folder], kinds).filter(keep)
        return inside.select("city_id", F.lit(flag).alias("flag"), F.lit(True).alias("exists"))

    imp = F.lower(file_name("path")).contains("imp")
    found = (
        found.unionByName(sources("dem_source_available", "raw_dem", RASTER_EXTENSIONS, F.lit(True)))
        .unionByName(sources("nlcd_land_cover_source_available", "raw_nlcd", RASTER_EXTENSIONS, ~imp))
        .unionByName(sources("nlcd_impervious_source_available", "raw_nlcd", RASTER_EXTENSIONS, imp))
        .unionByName(sources("hydro_source_available", "raw_hydro", VECTOR_EXTENSIONS, F.lit(True)))
    )
    flags = [*expected, "dem_source_available", "nlcd_land_cover_source_available", "nlcd_impervious_source_available", "hydro_source_available"]
    wide = found.groupBy("city_id").agg(*[F.coalesce(F.bool_or(F.when(F.col("flag") == f, F.col("exists"))), F.lit(False)).alias(f) for f in flags])
    return cities.select("city_id", slug("city_name").alias("city_slug")).join(wide, "city_id", "left")


#: Blockers of the readiness matrix, for ``status.readiness``.
PREP_BLOCKERS = {
    "study_area_exists": "study_area_missing",
    "dem_source_available": "dem_source_missing",
    "nlcd_land_cover_source_available": "nlcd_land_cover_source_missing",
    "nlcd_impervious_source_available": "nlcd_impervious_source_missing",
    "hydro_source_available": "hydro_source_missing",
}
FEATURE_BLOCKERS = {
    "grid": (["grid_exists"], "grid_missing"),
    "dem": (["dem_prepared_exists", "dem_source_available"], "dem_feature_input_missing"),
    "land_cover": (["nlcd_land_cover_prepared_exists", "nlcd_land_cover_source_available"], "nlcd_land_cover_feature_input_missing"),
    "impervious": (["nlcd_impervious_prepared_exists", "nlcd_impervious_source_available"], "nlcd_impervious_feature_input_missing"),
    "hydro": (["hydro_prepared_exists", "hydro_source_available"], "hydro_feature_input_missing"),
}
