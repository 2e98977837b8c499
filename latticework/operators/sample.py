"""Deterministic per-group samples and splits.

"Random" order is the order of a seeded hash of the row's keys, so a rerun, or a lost executor, gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.ordering import rank_in_group
from latticework.operators.rules import cap_cells
from latticework.session import attach, settle

_HASH_BITS = 53  # fits a double exactly
_BUCKET_BITS = 12


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """Non-negative 53-bit hash of the keys and the seed."""
    mixed = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return F.shiftrightunsigned(mixed, 64 - _HASH_BITS)


def allocate(rows: Column, positives: Column, wanted: int) -> dict[str, Column]:
    """How many rows of each class to take so the sample keeps the positive share.

    At least one row of each class is kept; what one class cannot supply the other refills.
    """
    negatives = rows - positives
    size = F.least(F.lit(wanted).cast("long"), rows)
    share = F.greatest(F.lit(1), F.bround(size * (F.try_divide(positives.cast("double"), rows))).cast("long"))
    squeezed = size - share <= 0
    first_pos = F.least(F.when(squeezed, size - 1).otherwise(share), positives)
    first_neg = F.least(F.when(squeezed, F.lit(1)).otherwise(size - share), negatives)
    left = F.greatest(F.lit(0), size - first_pos - first_neg)
    more_pos = F.least(left, positives - first_pos)
    more_neg = F.least(left - more_pos, negatives - first_neg)
    one_class = (positives <= 0) | (negatives <= 0)
    empty = size <= 0
    strategy = (
        F.when(empty, "empty").when(rows <= wanted, "all_rows").when(one_class, "uniform_single_class")
        .otherwise("target_rate_stratified")
    )
    whole = one_class | (rows <= wanted)
    return {
        "positive_take": F.when(empty, 0).when(whole, F.least(size, positives)).otherwise(first_pos + more_pos),
        "negative_take": F.when(empty, 0).when(whole, F.least(size, negatives)).otherwise(first_neg + more_neg),
        "sampling_strategy": strategy,
    }


def class_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(label).alias("full_row_count"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("full_positive_count")
    )


def sample_plan(df: DataFrame, wanted: int, group: str = "city_id", label: str = "hotspot_10pct") -> DataFrame:
    """Counts, takes and strategy per group, and the sampled rates (the sampling diagnostics)."""
    counts = class_counts(df, group, label)
    planned = counts.withColumns(allocate(F.col("full_row_count"), F.col("full_positive_count"), wanted))
    total = F.col("positive_take") + F.col("negative_take")
    return planned.withColumns({
        "sampled_row_count": total,
        "sampled_positive_count": F.col("positive_take"),
        "full_positive_rate": F.try_divide("full_positive_count", "full_row_count"),
        "sampled_positive_rate": F.try_divide(F.col("positive_take"), total),
    })


def take_smallest(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], take: str, slices: int | None = None
) -> DataFrame:
    """Rows with the ``take`` smallest hashes of their group.

    The hashes of each group are counted by their leading bits; only rows up to the bucket that reaches the take are
    ranked. The counts are exact, so no group comes out short.
    """
    wanted = df.filter(F.col(take) > 0).withColumn("_bucket", F.shiftright(F.col(order), _HASH_BITS - _BUCKET_BITS))
    counts = wanted.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.max(take).alias("_want"))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**_BUCKET_BITS rows a group
    needed = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(below), F.lit(0))).filter("_before < _want")
    last = needed.groupBy(*keys).agg(F.max("_bucket").alias("_last"))
    near = attach(wanted, last, list(keys)).filter("_bucket <= _last").drop("_bucket", "_last")
    ranked = rank_in_group(near, keys, [(order, True), *[(t, True) for t in tie]], "_r", slices)
    return ranked.filter(F.col("_r") <= F.col(take)).drop("_r")


def stratified_sample(
    df: DataFrame, wanted: int, group: str = "city_id", key: str = "cell_id", label: str = "hotspot_10pct", seed: int = 42,
    slices: int | None = None,
) -> DataFrame:
    """At most ``wanted`` labelled rows per group, class shares kept, as planned by ``sample_plan``."""
    labelled = df.filter(F.col(label).isNotNull())
    plan = settle(sample_plan(labelled, wanted, group, label))[0]
    takes = plan.select(
        group,
        F.explode(F.create_map(F.lit(1), F.col("positive_take"), F.lit(0), F.col("negative_take"))).alias("_y", "_t"),
    )
    keyed = labelled.withColumns({"_y": F.col(label).cast("int"), "_h": shuffle_key([group, key], seed)})
    sized = attach(keyed, takes, [group, "_y"])
    return take_smallest(sized, [group, "_y"], "_h", [key], "_t", slices).drop("_y", "_h", "_t")


def first_rows(df: DataFrame, limit: int, group: str = "city_id", key: str = "cell_id") -> DataFrame:
    """First ``limit`` rows of each group by key."""
    return cap_cells(df, limit, group, key)


def stratified_splits(
    df: DataFrame, repeats: int = 3, test_share: float = 0.2, group: str = "city_id", key: str = "cell_id",
    label: str = "hotspot_10pct", seed: int = 42, slices: int | None = None,
) -> DataFrame:
    """Each row once per repeat, marked test or train, with ``round(share * n)`` test rows per class."""
    labelled = df.filter(F.col(label).isNotNull())
    sizes = labelled.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(labelled, sizes, [group, label])
    repeated = sized.withColumn("repeat_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = repeated.withColumn("_h", shuffle_key([group, key, "repeat_id"], seed))
    ranked = rank_in_group(keyed, [group, label, "repeat_id"], [("_h", True), (key, True)], "_r", slices)
    wanted = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(test_share)).cast("long"))
    return ranked.withColumn("is_test", F.col("_r") <= wanted).drop("_h", "_r", "_n")
