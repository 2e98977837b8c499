"""Profiles and audits of a cell table, for the whole table or per group in one job."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.text import land_cover_label
from latticework.operators.ordering import medians, quantiles
from latticework.schema import binary_label
from latticework.session import attach

ALL = "_all"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(1)), [ALL])


def _stacked(wide: DataFrame, keys: Sequence[str], names: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One row per listed name from columns called ``<name>__<field>``."""
    entries = F.array(*[
        F.struct(F.lit(n).alias(name), *[F.col(f"`{n}__{f}`").alias(f) for f in fields]) for n in names
    ])
    return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def missingness(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Present flag, counts, missing share and type per feature (and group); absent features count as missing.

    ``carry`` names columns constant within a group, kept as they are.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    counts = [F.count(F.col(c)).alias(f"{c}__have") for c in features if c in types]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c, True).alias(c) for c in carry], *counts)
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(c in types).alias("present_in_dataset"),
            (F.col(f"`{c}__have`") if c in types else F.lit(0).cast("long")).alias("non_missing_count"),
            F.lit(types.get(c, "")).alias("dtype"),
        )
        for c in features
    ])
    long = wide.select(*keys, *carry, "_n", F.explode(entries).alias("_e")).select(*keys, *carry, "_n", "_e.*")
    missing = F.col("_n") - F.col("non_missing_count")
    return long.select(
        *keys, *carry, "column", "present_in_dataset", "non_missing_count", missing.alias("missing_count"),
        F.coalesce(F.try_divide(missing, F.col("_n")), F.lit(0.0)).alias("missing_pct"), "dtype",
    )


def group_summary(
    df: DataFrame, group: str = "city_id", target: str = "hotspot_10pct", passes: str = "n_valid_ecostress_passes",
    carry: Sequence[str] = ("city_name", "climate_group"), slices: int | None = None,
) -> DataFrame:
    """Per group: rows, positives, labelled rows, prevalence and the spread of the pass count."""
    y = F.col("_y")
    labelled = df.withColumn("_y", binary_label(target, target))
    x = F.col(passes).cast("double")
    stats = labelled.groupBy(group).agg(
        *[F.first(c, True).alias(c) for c in carry if c in df.columns],
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(y), F.lit(0)).alias("hotspot_positive_count"),
        F.count(y).alias("hotspot_non_missing_count"),
        F.avg(y.cast("double")).alias("hotspot_prevalence"),
        F.count(x).alias(f"{passes}_non_missing_count"),
        F.min(x).alias(f"{passes}_min"),
        F.avg(x).alias(f"{passes}_mean"),
        F.max(x).alias(f"{passes}_max"),
    )
    return attach(stats, medians(df, [group], {f"{passes}_median": passes}, slices), group)


def dataset_audit(df: DataFrame, group: str = "city_id", target: str = "hotspot_10pct") -> DataFrame:
    """One row: rows, groups and label counts 0 / 1 / missing."""
    y = binary_label(target, target)
    per_group = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), F.count_if(y.isNull()).alias("nm")
    )
    return per_group.agg(
        F.sum("n").alias("row_count"), F.count(group).alias("group_count"), F.sum("n0").alias("label_0"),
        F.sum("n1").alias("label_1"), F.sum("nm").alias("label_missing"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """n, missing %, mean, median, std, min, p10, p90, max and bias-corrected skew per variable."""
    df, by = _keyed(df, keys)
    columns = [c for c in columns if c in df.columns]
    value = {c: F.col(c).cast("double") for c in columns}
    fields = ["n", "mean", "std", "min", "max", "skew"]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, v in value.items():
        aggs += [
            F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"),
            F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"), F.skewness(v).alias(f"{c}__skew"),
        ]
    wide = df.groupBy(*by).agg(*aggs)
    long = _stacked(wide, [*by, "_n"], columns, fields, "variable")
    melted = df.select(*by, F.explode(F.create_map(*[x for c, v in value.items() for x in (F.lit(c), v)])).alias("variable", "_x"))
    long = attach(long, quantiles(melted, [*by, "variable"], "_x", [0.1, 0.5, 0.9], "q", slices), [*by, "variable"])
    n = F.col("n").cast("double")
    corrected = F.when(n > 2, F.col("skew") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)).otherwise(F.lit(0.0))
    return long.filter(F.col("n") > 0).select(
        *[k for k in by if k != ALL], "variable", F.col("n").alias("n_non_missing"),
        (100.0 * (1.0 - F.col("n") / F.col("_n"))).alias("missing_pct"), "mean", F.col("q")[1].alias("median"),
        F.coalesce("std", F.lit(0.0)).alias("std"), "min", F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), "max",
        F.coalesce(F.when(~F.isnan(corrected), corrected), F.lit(0.0)).alias("skew"),
    )


def missing_percent(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return missingness(df, present, keys).select(
        *keys, F.col("column").alias("variable"), F.col("missing_count").alias("missing_n"),
        (100.0 * F.col("missing_pct")).alias("missing_pct"), F.col("non_missing_count").alias("non_missing_n"),
    )


def class_composition(df: DataFrame, klass: str = "land_cover_class", keys: Sequence[str] = (), label: bool = True) -> DataFrame:
    """Rows and share of the non-null rows per class."""
    counts = df.filter(F.col(klass).isNotNull()).groupBy(*keys, klass).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(*keys))  # one row per class from here on
    out = counts.withColumn("share_pct", 100.0 * F.col("n_rows") / total)
    return out.withColumn(f"{klass}_label", land_cover_label(klass)) if label else out


def label_composition(df: DataFrame, target: str = "hotspot_10pct", keys: Sequence[str] = ()) -> DataFrame:
    """Hotspot and non-hotspot shares of the labelled rows, missing share of all rows."""
    y = binary_label(target, target)
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("a"), F.count_if(y == 0).alias("b"), F.count_if(y.isNull()).alias("m")
    )
    known = F.col("a") + F.col("b")
    entry = lambda name, count, base: F.struct(
        F.lit(name).alias("category"), F.col(count).alias("n_rows"), (100.0 * F.try_divide(F.col(count), base)).alias("share_pct")
    )
    rows = F.array(entry("hotspot", "a", known), entry("non_hotspot", "b", known), entry("missing", "m", F.col("n")))
    return wide.select(*keys, F.explode(rows).alias("_e")).select(*keys, "_e.*")


def quadrant_shares(
    df: DataFrame, keys: Sequence[str] = (), lon: str = "centroid_lon", lat: str = "centroid_lat", target: str = "hotspot_10pct",
    slices: int | None = None,
) -> DataFrame:
    """Cells and hotspot share by quadrant around the medians; a value on the median is west/south."""
    df, by = _keyed(df, keys)
    mids = medians(df, by, {"_mlon": lon, "_mlat": lat}, slices)
    y = binary_label(target, target)
    name = F.concat(
        F.when(F.col(lat) <= F.col("_mlat"), "south").otherwise("north"), F.lit("_"),
        F.when(F.col(lon) <= F.col("_mlon"), "west").otherwise("east"),
    )
    return attach(df, mids, by).groupBy(*by, name.alias("quadrant")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(y == 1).alias("hotspot_n"),
        (100.0 * F.avg(y.cast("double"))).alias("hotspot_share_pct"),
    ).drop(ALL)


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlations, both orders of every pair, of columns with two or more values."""
    columns = [c for c in columns if c in df.columns]
    df, by = _keyed(df, keys)
    v = {c: F.col(c).cast("double") for c in columns}
    pairs = list(combinations_with_replacement(columns, 2))

    def pair_corr(a, b):
        both = v[a].isNotNull() & v[b].isNotNull()
        x, y = F.when(both, v[a]), F.when(both, v[b])
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, F.lit(1.0) if a == b else F.corr(x, y))

    wide = df.groupBy(*by).agg(
        *[F.count(v[c]).alias(f"n__{i}") for i, c in enumerate(columns)],
        *[pair_corr(a, b).alias(f"r__{i}") for i, (a, b) in enumerate(pairs)],
    )
    entries = []
    for i, (a, b) in enumerate(pairs):
        usable = (F.col(f"n__{columns.index(a)}") > 1) & (F.col(f"n__{columns.index(b)}") > 1)
        for left, right in {(a, b), (b, a)}:
            entries.append(F.struct(F.lit(left).alias("var_a"), F.lit(right).alias("var_b"), F.col(f"r__{i}").alias("corr"), usable.alias("ok")))
    long = wide.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")
    return long.filter("ok").drop("ok", ALL)


def strongest_correlation(corr: DataFrame, outcome: str, keys: Sequence[str] = ()) -> DataFrame:
    """Variable with the largest absolute correlation with the outcome."""
    others = corr.filter((F.col("var_a") == outcome) & (F.col("var_b") != outcome) & F.col("corr").isNotNull())
    best = F.max_by(F.struct(F.col("var_b").alias("variable"), "corr"), F.struct(F.abs("corr"), "var_b"))
    return others.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def largest_skew(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    best = F.max_by(F.struct("variable", "skew"), F.struct(F.abs("skew"), "variable"))
    return summary.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def filter_audit(
    unfiltered: DataFrame, filtered: DataFrame, keys: Sequence[str] = (), klass: str = "land_cover_class",
    value: str = "lst_median_may_aug", passes: str = "n_valid_ecostress_passes", core: str | None = None, water: int = 11, min_passes: int = 3,
) -> DataFrame:
    """Rows at each filtering stage and their share of the input; ``core`` adds the buffer-ring stage."""
    unfiltered, by = _keyed(unfiltered, keys)
    filtered, _ = _keyed(filtered, keys)
    is_water = F.coalesce(F.col(klass) == water, F.lit(False))
    low = (F.coalesce(F.col(passes), F.lit(0)) < min_passes) & ~is_water
    before = unfiltered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_water).alias("w"), F.count_if(low).alias("l"),
        F.max(F.col(value).isNotNull()).alias("v"),
        (F.count_if(~F.coalesce(F.col(core), F.lit(False))) if core else F.lit(None).cast("long")).alias("r"),
    )
    after = filtered.groupBy(*by).agg(F.count(F.lit(1)).alias("f"))
    both = attach(before, after, by)
    stages = [
        ("unfiltered_input_rows", F.col("n")), ("dropped_open_water_rows", F.col("w")),
        ("dropped_lt3_ecostress_pass_rows", F.when(F.col("v"), F.col("l")).otherwise(0)),
        *([("dropped_buffer_ring_rows", F.col("r"))] if core else []),
        ("final_filtered_rows", F.coalesce("f", F.lit(0))),
    ]
    entries = F.array(*[
        F.struct(F.lit(name).alias("stage"), n.cast("long").alias("n_rows"), (100.0 * n / F.col("n")).alias("share_of_unfiltered_pct"))
        for name, n in stages
    ])
    return both.select(*by, F.explode(entries).alias("_e")).select(*[k for k in by if k != ALL], "_e.*")


def count_consistency(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts of two outputs per group and whether they agree."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"), F.lit(0).cast("long").alias("right_rows"))
    b = right.groupBy(*keys).agg(F.lit(0).cast("long").alias("left_rows"), F.count(F.lit(1)).alias("right_rows"))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
    return both.withColumn("consistent", F.col("left_rows") == F.col("right_rows"))


def moments(df: DataFrame, numeric: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean and population std per numeric column (std 1 where it would be 0), as for scaling."""
    df, by = _keyed(df, keys)
    wide = df.groupBy(*by).agg(*[
        a for c in numeric for a in (
            F.count(F.col(c)).alias(f"{c}__count"), F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
            F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std"),
        )
    ])
    long = _stacked(wide, by, numeric, ["count", "mean", "std"], "feature")
    return long.select(
        *[k for k in by if k != ALL], "feature", "count", F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("std"),
    )


def profile_bundle(
    df: DataFrame, group: str, numeric: Sequence[str], extent: Sequence[str], path: str | None = None
) -> DataFrame:
    """One status row per group: observations, variables, extent text, strongest skew, chosen file."""
    x0, y0, x1, y1 = extent
    bounds = [F.min(x0), F.min(y0), F.max(x1), F.max(y1)]
    # halves go to the even number, as C's and Python's formatting does; Java's rounds them up
    text = F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string("%.0f", F.rint(b.cast("double"))) for b in bounds]), F.lit("]"))
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("observations"), text.alias("extent"))
    skews = largest_skew(numeric_summary(df, numeric, [group]), [group]).select(group, F.col("variable").alias("most_skewed"), "skew")
    return attach(base, skews, group).withColumns({
        "variables": F.lit(len(df.columns)), "dataset_path": F.lit(path).cast("string"), "status": F.lit("completed"),
    })
