"""Exact ranks, running values and quantiles inside groups of any size, by one path.

Rows are range-partitioned by group and order columns, so Spark's own ordering (nulls, NaN, dates, text, big integers and
further columns behind ties) decides everything, once. A range is a slice: it holds whole small groups, or a part of a large
one. Work is done per group and slice; only groups that span slices carry totals forward, at most
two rows a slice. The sliced rows are stored, as each is read twice. More slices make smaller tasks; the
default is ``spark.sql.shuffle.partitions``. Only rows equal in all of these columns can't be told apart, and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import attach, materialize, settle

SLICE = "_slice"
Order = Sequence[tuple[str, bool]]


def order_columns(order: Order) -> list[Column]:
    """Sort columns for ``[(name, ascending), ...]``: nulls are smallest, NaN is largest."""
    return [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in order]


def slice_groups(df: DataFrame, keys: Sequence[str], order: Order, slices: int | None = None) -> DataFrame:
    """Stored rows with ``_slice``, increasing along ``order`` inside each group."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(k).asc() for k in keys], *order_columns(order))
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def _spanning(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of the groups that span slices; a slice has two such groups at most."""
    return totals.withColumn("_spans", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_spans > 1").drop("_spans")


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _local(keys: Sequence[str], order: Order):
    return Window.partitionBy(*keys, SLICE).orderBy(*order_columns(order))


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: Order, name: str = "rank", slices: int | None = None, size: str | None = None
) -> DataFrame:
    """Row number 1..n inside each group along ``order`` (give a unique last column to break ties).

    ``size`` also adds the row count of the group under that name.
    """
    keys = list(keys)
    sliced = slice_groups(df, keys, order, slices)
    counts = _spanning(sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows")), keys)
    carry = counts.select(
        *keys, SLICE, F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_earlier"),
        (F.sum("_rows").over(Window.partitionBy(*keys)) - F.col("_rows")).alias("_others"),
    )
    ranked = sliced.withColumn(name, F.row_number().over(_local(keys, order)).cast("long"))
    if size:
        ranked = ranked.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys, SLICE)))
    out = attach(ranked, carry, [*keys, SLICE]).withColumn(name, F.col(name) + F.coalesce("_earlier", F.lit(0)))
    if size:
        out = out.withColumn(size, F.col(size) + F.coalesce("_others", F.lit(0)))
    return out.drop(SLICE, "_earlier", "_others")


def rank_with_ties(
    df: DataFrame, keys: Sequence[str], order: Order, name: str, tied: str, size: str, slices: int | None = None
) -> DataFrame:
    """``rank_in_group`` with ``size``, and as ``tied`` the mean rank of the rows that are equal in the first column of ``order``, by the same sort.

    Equal values may span slices where later columns tell their rows apart. Only the first and the last value of a slice can, so they are counted apart.
    """
    keys, (value, ascending) = list(keys), order[0]
    sliced = slice_groups(df, keys, order, slices)
    low, high = F.min(value).alias("_low"), F.max(value).alias("_high")
    ends, _ = settle(sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"), low, high))  # a row for each slice and group
    spans = _spanning(ends, keys).withColumns({
        "_earlier": F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)), "_others": F.sum("_rows").over(Window.partitionBy(*keys)) - F.col("_rows"),
    })
    spans, _ = settle(spans)
    edge = attach(sliced.select(*keys, SLICE, value), spans, [*keys, SLICE], "inner").filter(F.col(value).eqNullSafe(F.col("_low")) | F.col(value).eqNullSafe(F.col("_high")))
    equal = edge.groupBy(*keys, SLICE, value, "_rows", "_earlier").agg(F.count(F.lit(1)).alias("_c"))
    start = F.min_by(F.col("_earlier") + F.col("_rows") - F.col("_c") + 1, SLICE)  # it ends the first slice that holds it
    whole = Window.partitionBy(*keys, value)
    cut = equal.withColumns({"_tied": start.over(whole) + (F.sum("_c").over(whole) - 1) / 2.0, "_parts": F.count(F.lit(1)).over(whole)}).filter("_parts > 1")
    local, peers = _local(keys, order), Window.partitionBy(*keys, SLICE).orderBy(*order_columns(order[:1]))
    ranked = sliced.withColumns({
        name: F.row_number().over(local).cast("long"), size: F.count(F.lit(1)).over(Window.partitionBy(*keys, SLICE)),
        tied: F.rank().over(peers) + (F.count(F.lit(1)).over(peers.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0,
    })
    out = attach(ranked, spans.drop("_rows", "_low", "_high"), [*keys, SLICE]).withColumns({
        name: F.col(name) + F.coalesce("_earlier", F.lit(0)), size: F.col(size) + F.coalesce("_others", F.lit(0)), tied: F.col(tied) + F.coalesce("_earlier", F.lit(0)),
    })
    out = attach(out, cut.select(*keys, SLICE, value, "_tied"), [*keys, SLICE, value]).withColumn(tied, F.coalesce("_tied", tied))
    return out.drop(SLICE, "_earlier", "_others", "_tied")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Order, sums: dict[str, str], slices: int | None = None) -> DataFrame:
    """Running sums (including the current row) of ``{new_name: column}`` along ``order``."""
    keys = list(keys)
    sliced = slice_groups(df, keys, order, slices)
    totals = _spanning(sliced.groupBy(*keys, SLICE).agg(*[F.sum(old).alias(f"_sum_{new}") for new, old in sums.items()]), keys)
    carry = totals.select(*keys, SLICE, *[F.sum(f"_sum_{new}").over(_before(keys)).alias(f"_before_{new}") for new in sums])
    running = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = attach(sliced.withColumns({new: F.sum(old).over(running) for new, old in sums.items()}), carry, [*keys, SLICE])
    return out.withColumns({new: F.col(new) + F.coalesce(f"_before_{new}", F.lit(0)) for new in sums}).drop(SLICE, *[f"_before_{new}" for new in sums])


def running_max_before(
    df: DataFrame, keys: Sequence[str], order: Order, value: Column, name: str, slices: int | None = None
) -> DataFrame:
    """Largest ``value`` among strictly earlier rows of the group, null when there is none."""
    keys = list(keys)
    sliced = slice_groups(df.withColumn("_value", value), keys, order, slices)
    totals = _spanning(sliced.groupBy(*keys, SLICE).agg(F.max("_value").alias("_m")), keys)
    carry = totals.select(*keys, SLICE, F.max("_m").over(_before(keys)).alias("_before"))
    out = sliced.withColumn(name, F.max("_value").over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1)))
    return attach(out, carry, [*keys, SLICE]).withColumn(name, F.greatest(name, "_before")).drop("_before", SLICE, "_value")


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Order, columns: dict[str, str], slices: int | None = None
) -> DataFrame:
    """Values of the previous row along ``order``, as ``{new_name: column}``."""
    keys = list(keys)
    sliced = slice_groups(df.withColumn("_now", F.struct(*dict.fromkeys(columns.values()))), keys, order, slices)
    local = _local(keys, order)
    spans = _spanning(sliced.select(*keys, SLICE).distinct(), keys)
    last = attach(sliced, spans.withColumn("_open", F.lit(True)), [*keys, SLICE]).filter("_open")
    last = last.withColumn("_r", F.row_number().over(_local(keys, [(n, not a) for n, a in order]))).filter("_r = 1")
    carry = last.select(*keys, SLICE, F.lag("_now").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_end"))
    out = sliced.withColumns({"_prev": F.lag("_now").over(local), "_first": F.row_number().over(local) == 1})
    out = attach(out, carry, [*keys, SLICE])
    before = F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_prev"))
    return out.withColumns({new: before.getField(old) for new, old in columns.items()}).drop(SLICE, "_now", "_prev", "_first", "_end")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q", slices: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of the non-null values, one array per group (one null-filled row without keys or rows).

    Equal values of a group are counted before they are sliced, so a value that many rows share is one row there and does not fill a task.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    order = [("_v", True)]
    sliced = slice_groups(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, order, slices)
    totals = _spanning(sliced.groupBy(*keys, SLICE).agg(F.sum("_c").alias("_rows")), keys)
    carry = totals.select(
        *keys, SLICE, F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_earlier"),
        (F.sum("_rows").over(Window.partitionBy(*keys)) - F.col("_rows")).alias("_others"),
    )
    running = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sliced.withColumns({"_to": F.sum("_c").over(running), "_n": F.sum("_c").over(Window.partitionBy(*keys, SLICE))})
    placed = attach(placed, carry, [*keys, SLICE]).withColumns({
        "_to": F.col("_to") + F.coalesce("_earlier", F.lit(0)), "_n": F.col("_n") + F.coalesce("_others", F.lit(0))
    })

    def holds(place: Column) -> Column:
        return (place >= F.col("_to") - F.col("_c")) & (place < F.col("_to"))

    ends = [[rounded(F.lit(float(p)) * (F.col("_n") - 1)) for rounded in (F.floor, F.ceil)] for p in probs]
    kept = placed.filter(F.exists(F.array(*[e for pair in ends for e in pair]), holds))

    def between(p: float, low: Column, high: Column) -> Column:
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        place = F.lit(float(p)) * (F.max("_n") - 1)
        return a + (b - a) * (place - F.floor(place))

    return kept.groupBy(*keys).agg(F.array(*[between(p, *pair) for p, pair in zip(probs, ends)]).alias(name))


def medians(df: DataFrame, keys: Sequence[str], columns: dict[str, str], slices: int | None = None) -> DataFrame:
    """Exact medians ``{new_name: column}`` per group, one row per group with any non-null value."""
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(new).alias("_m"), F.col(old).cast("double").alias("_x")) for new, old in columns.items()])
    melted = df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    found = quantiles(melted, [*keys, "_m"], "_x", [0.5], "_q", slices)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == new, F.col("_q")[0])).alias(new) for new in columns])
