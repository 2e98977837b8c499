"""Text columns: slugs, stems, run names, keys out of URLs, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: labels and patterns ----------------------------------------------------------
LAND_COVER_LABELS = {
    11: "Open Water",
    12: "Perennial Ice/Snow",
    21: "Developed, Open Space",
    22: "Developed, Low Intensity",
    23: "Developed, Medium Intensity",
    24: "Developed, High Intensity",
    31: "Barren Land",
    41: "Deciduous Forest",
    42: "Evergreen Forest",
    43: "Mixed Forest",
    52: "Shrub/Scrub",
    71: "Grassland/Herbaceous",
    81: "Pasture/Hay",
    82: "Cultivated Crops",
    90: "Woody Wetlands",
    95: "Emergent Herbaceous Wetlands",
}
CLIMATE_LABELS = {"hot_arid": "Hot arid", "hot_humid": "Hot humid", "mild_cool": "Mild cool"}
SCALE_LABELS = {150: "fine", 300: "medium", 600: "broad"}
SUCCESS_STATUSES = ["completed", "skipped_existing"]
INCOMPLETE_STATUSES = ["", "not_started", "submitted", "pending", "blocked_missing_credentials", "failed"]
TILE_KEY = r"(?i)([ns]\d{2}[ew]\d{3})"
BASIN_KEY = r"(?i)(\d{4})_HU4_"
BASIN_TITLE = r"(?i)HU\) 4 - (\d{4})"
MISSING_CATEGORY = "__MISSING__"
UNSEEN_CATEGORY = "__UNSEEN__"
# ------------------------------------------------------------------------------------------------

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(labels: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[key]


def slug(name: ColumnLike, empty: str = "") -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(name))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", F.lit(empty)).otherwise(made) if empty else made


def stem(city_id: ColumnLike, name: ColumnLike, state: ColumnLike) -> Column:
    """``<two-digit id>_<slug>_<state>``."""
    padded = F.format_string("%02d", _col(city_id).cast("long"))
    return F.concat_ws("_", padded, slug(name), F.lower(_col(state)))


def hyphen_token(value: ColumnLike) -> Column:
    lowered = F.regexp_replace(F.lower(F.trim(_col(value))), r"[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(lowered, r"-{2,}", "-"), r"^-+|-+$", "")


def run_label(value: ColumnLike, length: int = 24) -> Column:
    """Hyphen token cut to ``length``; NULL when nothing is left."""
    token = hyphen_token(value)
    return F.when(token != "", F.substring(token, 1, length))


def fold_scope(folds: ColumnLike) -> Column:
    """``f0-2_f4`` for an array of fold numbers; ``allfolds`` for NULL or empty."""
    ids = F.array_sort(F.array_distinct(F.transform(_col(folds), lambda x: x.cast("int"))))
    starts = F.filter(ids, lambda x: ~F.array_contains(ids, x - 1))
    ends = F.filter(ids, lambda x: ~F.array_contains(ids, x + 1))
    spans = F.zip_with(
        starts, ends,
        lambda a, b: F.when(a == b, F.concat(F.lit("f"), a.cast("string"))).otherwise(
            F.concat(F.lit("f"), a.cast("string"), F.lit("-"), b.cast("string"))
        ),
    )
    return F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, F.lit("allfolds")).otherwise(F.array_join(spans, "_"))


def sample_scope(rows: ColumnLike) -> Column:
    return F.coalesce(F.concat(F.lit("s"), _col(rows).cast("long").cast("string")), F.lit("fullrows"))


def run_name(preset: ColumnLike, folds: ColumnLike, rows: ColumnLike, label: ColumnLike, at: ColumnLike) -> Column:
    """``<preset>_<folds>_<sample>[_<label>]_<timestamp>``."""
    stamp = F.date_format(_col(at), "yyyy-MM-dd_HHmmss")
    token = F.coalesce(F.nullif(hyphen_token(F.coalesce(_col(preset), F.lit(""))), F.lit("")), F.lit("custom"))
    return F.concat_ws("_", token, fold_scope(folds), sample_scope(rows), run_label(label), stamp)


def _first_match(pattern: str, *values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(v, F.lit("")), pattern, 1), F.lit("")) for v in values])


def tile_key(url: ColumnLike, title: ColumnLike) -> Column:
    """Elevation tile key such as ``n34w113``, from the URL, else the title."""
    return F.lower(_first_match(TILE_KEY, _col(url), _col(title)))


def basin_key(url: ColumnLike, title: ColumnLike) -> Column:
    """Four-digit basin from the URL, else the title."""
    by_name = _first_match(BASIN_KEY, _col(url), _col(title))
    return F.coalesce(by_name, _first_match(BASIN_TITLE, _col(title)))


def scale_label(radius: ColumnLike) -> Column:
    rounded = F.rint(_col(radius)).cast("int")
    return F.coalesce(_lookup(SCALE_LABELS, rounded), F.concat(F.lit("r"), rounded.cast("string"), F.lit("m")))


def climate_label(value: ColumnLike) -> Column:
    text = _col(value)
    titled = F.array_join(
        F.transform(F.split(text, "_"), lambda part: F.initcap(part)), "-"
    )
    return F.coalesce(_lookup(CLIMATE_LABELS, text), titled)


def land_cover_label(code: ColumnLike) -> Column:
    value = _col(code).cast("int")
    named = F.coalesce(_lookup(LAND_COVER_LABELS, value), F.concat(F.lit("Class "), value.cast("string")))
    return F.coalesce(named, F.lit("Missing"))


def sample_label(rows: ColumnLike) -> Column:
    """``5k sampled`` for whole thousands, else the number with separators."""
    n = _col(rows).cast("long")
    thousands = F.concat((n / 1000).cast("long").cast("string"), F.lit("k sampled"))
    return F.when(n % 1000 == 0, thousands).otherwise(F.concat(F.format_number(n, 0), F.lit(" sampled")))


def category(value: ColumnLike, numeric: bool = False) -> Column:
    """Category text: numbers as rounded integers, blank or missing as a token."""
    column = _col(value)
    if numeric:
        text = F.rint(column.cast("double")).cast("long").cast("string")
    else:
        text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    return F.coalesce(text, F.lit(MISSING_CATEGORY))


def base_feature(encoded: ColumnLike, features: Sequence[str]) -> Column:
    """Raw feature behind an encoded name: the longest feature that is the name or its ``<feature>_`` prefix."""
    name = F.regexp_replace(_col(encoded), r"^(numeric|categorical|remainder)__", "")
    found = F.coalesce(
        *[F.when((name == f) | name.startswith(f"{f}_"), F.lit(f)) for f in sorted(features, key=len, reverse=True)]
    )
    return F.coalesce(found, name)


def status_text(value: ColumnLike) -> Column:
    return F.lower(F.trim(F.coalesce(_col(value), F.lit(""))))


def is_success(value: ColumnLike) -> Column:
    return status_text(value).isin(SUCCESS_STATUSES)


def is_incomplete(value: ColumnLike) -> Column:
    return status_text(value).isin(INCOMPLETE_STATUSES)


def remote_status(*candidates: ColumnLike) -> Column:
    """First non-blank of several status fields, lower case, else ``unknown``."""
    cleaned = [F.nullif(F.lower(F.trim(_col(c))), F.lit("")) for c in candidates]
    return F.coalesce(*cleaned, F.lit("unknown"))
