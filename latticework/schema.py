"""Table contracts: declared schemas, column checks and type coercion.

Schemas are declared, never inferred. Missing values are ``NULL`` everywhere; ``NaN`` is turned into
``NULL`` on the way in.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column contracts -------------------------------------------------------------
CITY = T.StructType([
    T.StructField("city_id", T.IntegerType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("climate_group", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

#: tree_cover_* and vegetated_cover_* are 0-1 shares despite "pct"; impervious_* keep the raster's scale.
CELL = T.StructType([
    T.StructField("city_id", T.LongType(), False),
    T.StructField("city_name", T.StringType()),
    T.StructField("climate_group", T.StringType()),
    T.StructField("cell_id", T.LongType(), False),
    T.StructField("centroid_lon", T.DoubleType()),
    T.StructField("centroid_lat", T.DoubleType()),
    T.StructField("impervious_pct", T.DoubleType()),
    T.StructField("land_cover_class", T.LongType()),
    T.StructField("elevation_m", T.DoubleType()),
    T.StructField("dist_to_water_m", T.DoubleType()),
    T.StructField("ndvi_median_may_aug", T.DoubleType()),
    T.StructField("lst_median_may_aug", T.DoubleType()),
    T.StructField("n_valid_ecostress_passes", T.LongType()),
    T.StructField("hotspot_10pct", T.BooleanType()),
    T.StructField("tree_cover_proxy_pct_270m", T.DoubleType()),
    T.StructField("vegetated_cover_proxy_pct_270m", T.DoubleType()),
    T.StructField("impervious_pct_mean_270m", T.DoubleType()),
])
CONTEXT_FLAGS = ["is_core_city_cell", "is_buffer_ring_cell"]

PREDICTION = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("outer_fold", T.IntegerType()),
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("hotspot_10pct", T.ByteType()),
    T.StructField("predicted_probability", T.FloatType()),
])

TARGET = "hotspot_10pct"
GROUP = "city_id"
IDENTIFIERS = ["city_id", "city_name", "climate_group", "cell_id", "centroid_lon", "centroid_lat"]
DEFAULT_FEATURES = [
    "impervious_pct", "elevation_m", "dist_to_water_m", "ndvi_median_may_aug", "land_cover_class", "climate_group",
]
NEIGHBOURHOOD_FEATURES = [
    "tree_cover_proxy_pct_270m", "vegetated_cover_proxy_pct_270m", "impervious_pct_mean_270m",
]
FEATURE_TYPES = {
    "impervious_pct": "numeric",
    "elevation_m": "numeric",
    "dist_to_water_m": "numeric",
    "ndvi_median_may_aug": "numeric",
    "land_cover_class": "categorical",
    "climate_group": "categorical",
    "tree_cover_proxy_pct_270m": "numeric",
    "vegetated_cover_proxy_pct_270m": "numeric",
    "impervious_pct_mean_270m": "numeric",
}
LEAKAGE_COLUMNS = [
    "hotspot_10pct", "lst_median_may_aug", "n_valid_ecostress_passes", "cell_id", "city_id", "city_name",
    "centroid_lon", "centroid_lat",
]
# ------------------------------------------------------------------------------------------------

_CITY_FIELDS = [field.name for field in CITY]
CELL_COLUMNS = [field.name for field in CELL]


def column_names(table: DataFrame | Iterable[str]) -> list[str]:
    return list(table.columns) if isinstance(table, DataFrame) else list(table)


def require_columns(table: DataFrame | Iterable[str], required: Iterable[str], what: str = "Table") -> None:
    """Raise with the sorted missing names; looks at the schema only."""
    missing = sorted(set(required) - set(column_names(table)))
    if missing:
        raise ValueError(f"{what} missing required columns: {', '.join(missing)}")


def require_features(
    features: Iterable[str], available: DataFrame | Iterable[str], leakage: Iterable[str] = tuple(LEAKAGE_COLUMNS),
    types: dict[str, str] | None = None,
) -> list[str]:
    """Feature list without repeats, after checking presence, leakage and a declared type."""
    wanted = list(dict.fromkeys(features))
    checks = [
        ("Requested feature columns missing from dataset", set(wanted) - set(column_names(available))),
        ("These columns give the label away and can't be features", set(wanted) & set(leakage)),
        ("Feature columns without a declared type", set(wanted) - set(FEATURE_TYPES if types is None else types)),
    ]
    for message, offending in checks:
        if offending:
            raise ValueError(f"{message}: {', '.join(sorted(offending))}")
    return wanted


def split_features(features: Sequence[str], types: dict[str, str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns in the given order."""
    declared = FEATURE_TYPES if types is None else types
    numeric = [name for name in features if declared[name] == "numeric"]
    return numeric, [name for name in features if declared[name] == "categorical"]


def selected_columns(features: Sequence[str] | None = None, extra: Sequence[str] = ()) -> list[str]:
    """Columns a model run reads: identifiers, label, features, extras, without repeats."""
    return list(dict.fromkeys([*IDENTIFIERS, TARGET, *(DEFAULT_FEATURES if features is None else features), *extra]))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column with NaN replaced by NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def complete_columns(df: DataFrame, contract: T.StructType = CELL, extra: Sequence[str] = ()) -> DataFrame:
    """Contract columns in contract order, absent ones as typed NULL, then the extras that exist."""
    present = set(df.columns)
    columns = [F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in contract]
    return df.select(*columns, *[name for name in extra if name in present])


def _coerced(df: DataFrame, field: T.StructField) -> Column:
    source, target = df.schema[field.name].dataType, field.dataType
    column = F.col(field.name)
    if isinstance(source, (T.DoubleType, T.FloatType)):
        column = F.when(~F.isnan(column), column)
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType):
        text = F.lower(F.trim(column))
        return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
    if isinstance(target, T.LongType) and isinstance(source, T.StringType):
        column = column.try_cast("double")  # text such as "21.0" is an integer here
    if not field.nullable:
        broken = column.try_cast(target).isNull()
        return F.when(broken, F.raise_error(F.lit(f"{field.name} must be a non-null {target.simpleString()}"))).otherwise(
            column.try_cast(target)
        )
    return column.try_cast(target)


def coerce_types(df: DataFrame, contract: T.StructType = CELL) -> DataFrame:
    """Cast present contract columns: unreadable values become NULL, key columns raise instead."""
    present = set(df.columns)
    return df.withColumns({f.name: _coerced(df, f).alias(f.name) for f in contract if f.name in present})


def binary_label(column: Column | str, name: str = TARGET) -> Column:
    """0/1/NULL from a mixed boolean, number or text column; anything else raises when evaluated."""
    value = F.col(column) if isinstance(column, str) else column
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")
    return (
        F.when(value.isNull() | (text == "nan"), F.lit(None))
        .when(text.isin("0", "false") | (number == 0), F.lit(0))
        .when(text.isin("1", "true") | (number == 1), F.lit(1))
        .otherwise(F.raise_error(F.concat(F.lit(f"Target column {name} must be binary. Found: "), value.cast("string"))))
        .cast("int")
    )


def number_label(column: str) -> Column:
    """What ``binary_label`` gives for a number or boolean column, without a way through text."""
    number = F.col(column).cast("double")
    wrong = F.raise_error(F.concat(F.lit(f"Target column {column} must be binary. Found: "), F.col(column).cast("string")))
    return F.when(number == 0, F.lit(0)).when(number == 1, F.lit(1)).when(~(number.isNull() | F.isnan(number)), wrong).cast("int")


def require_binary(df: DataFrame, target: str = TARGET) -> None:
    """Raise listing up to 20 distinct non-binary values."""
    require_columns(df, [target])
    text = F.lower(F.trim(F.col(target).cast("string")))
    bad = df.filter(
        F.col(target).isNotNull()
        & ~F.coalesce(text.isin("0", "1", "true", "false", "nan"), F.lit(False))
        & ~F.coalesce(text.try_cast("double").isin(0.0, 1.0), F.lit(False))
    )
    found = sorted(r[0] for r in bad.select(F.col(target).cast("string")).distinct().limit(20).collect())
    if found:
        raise ValueError(f"Target column {target} may hold 0 and 1 only, but holds {', '.join(found)}")


def drop_unlabelled(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows with a label, label as 0/1 integer."""
    plain = isinstance(df.schema[target].dataType, T.NumericType | T.BooleanType)
    return df.withColumn(target, number_label(target) if plain else binary_label(target, target)).filter(F.col(target).isNotNull())
