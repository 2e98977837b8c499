"""GeoJSON boundaries as edge tables, and study areas back to GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.crs import from_utm

_FEATURES = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
_RINGS = "array<array<array<double>>>"


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon features as ``(poly_id, name, rings)``; multipolygon rings are listed one after another."""
    text = spark.read.text(path, wholetext=True)
    feature = text.select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f"))
    props, shape = F.col("f.properties"), F.col("f.geometry")
    rings = F.when(shape["type"] == "MultiPolygon", F.flatten(F.from_json(shape["coordinates"], f"array<{_RINGS}>"))).otherwise(
        F.from_json(shape["coordinates"], _RINGS)
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    return feature.select(
        F.coalesce(blank(props["GEOID"]), blank(props["UA"]), F.lit("")).alias("poly_id"),
        F.coalesce(blank(props["NAME"]), blank(props["BASENAME"]), F.lit("Unknown Urban Area")).alias("name"),
        rings.alias("rings"),
    )


def boundary_edges(boundaries: DataFrame) -> DataFrame:
    """One row per ring edge ``(poly_id, ring, i, x1, y1, x2, y2)``."""
    rings = boundaries.select("poly_id", F.posexplode("rings").alias("ring", "_pts"))
    steps = F.sequence(F.lit(0), F.size("_pts") - 2)
    pair = rings.filter(F.size("_pts") >= 2).select("poly_id", "ring", "_pts", F.explode(steps).alias("i"))
    at = lambda k, j: F.get(F.get("_pts", F.col("i") + k), F.lit(j))
    return pair.select("poly_id", "ring", "i", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


def area_geojson(edges: DataFrame, epsg: str = "epsg", properties: DataFrame | None = None, digits: int = 7) -> DataFrame:
    """One longitude/latitude GeoJSON text per polygon from projected edges, with an export status.

    A polygon's text is one value, so its own vertices meet in one row; polygons are independent.
    """
    placed = from_utm(edges, "x1", "y1", epsg, "lon", "lat")
    point = F.concat(F.lit("["), F.bround("lon", digits).cast("decimal(12,7)").cast("string"), F.lit(","), F.bround("lat", digits).cast("decimal(12,7)").cast("string"), F.lit("]"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))), lambda s: s["p"])
    rings = placed.groupBy("poly_id", "ring").agg(ordered.alias("_p"))
    ring_text = F.concat(F.lit("["), F.array_join(F.concat("_p", F.slice("_p", 1, 1)), ","), F.lit("]"))
    shapes = rings.groupBy("poly_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", ring_text.alias("t")))), lambda s: s["t"]), ",").alias("_rings")
    )
    if properties is None:
        props = shapes.withColumn("_props", F.to_json(F.struct("poly_id")))
    else:
        packed = properties.select("poly_id", F.to_json(F.struct(*[c for c in properties.columns if c != "poly_id"])).alias("_props"))
        props = packed.join(shapes, "poly_id", "left")
    text = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), F.col("_props"),
        F.lit(',"geometry":{"type":"Polygon","coordinates":['), F.col("_rings"), F.lit("]}}]}"),
    )
    return props.select(
        "poly_id", text.alias("geojson"), F.when(F.col("_rings").isNull(), "failed").otherwise("exported").alias("status"),
        F.when(F.col("_rings").isNull(), "study area has no edges").otherwise("").alias("error"),
    )
