"""Top-fraction label inside each group by an exact quantile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.ordering import quantiles
from latticework.session import attach


def label_top_share(
    df: DataFrame, group: str = "city_id", value: str = "lst_median_may_aug", label: str = "hotspot_10pct",
    prob: float = 0.9, threshold: str | None = None, slices: int | None = None,
) -> DataFrame:
    """``value >= quantile(prob)`` of its group; null where the value is null.

    The threshold is an aggregate joined back, so no group is sorted in one task.
    """
    cut = quantiles(df.filter(F.col(group).isNotNull()), [group], value, [prob], "_cut", slices)
    marked = attach(df.drop(label), cut.select(group, F.col("_cut")[0].alias("_cut")), group)
    out = marked.withColumn(label, F.col(value) >= F.col("_cut"))
    return out.withColumnRenamed("_cut", threshold) if threshold else out.drop("_cut")
