"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.text import ColumnLike, _col

CLIP = 35.0


def sigmoid(value: ColumnLike) -> Column:
    """Logistic function of the value clipped to +-35."""
    x = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), _col(value)))
    return 1.0 / (1.0 + F.exp(-x))


def gini(positives: ColumnLike, rows: ColumnLike) -> Column:
    """Gini impurity of a two-class set given its counts; 0 for an empty one."""
    p = F.try_divide(_col(positives), _col(rows))
    return F.when(_col(rows) > 0, 1 - p * p - (1 - p) * (1 - p)).otherwise(F.lit(0.0))


def top_count(rows: ColumnLike, fraction: float) -> Column:
    """``max(1, ceil(rows * fraction))`` in double arithmetic."""
    return F.greatest(F.lit(1), F.ceil(_col(rows).cast("double") * F.lit(float(fraction)))).cast("long")


def scaled_valid(
    value: ColumnLike, scale: float = 1.0, offset: float = 0.0, low: float | None = None, high: float | None = None
) -> Column:
    """``value * scale + offset``, NULL outside ``[low, high]``."""
    x = _col(value) * F.lit(scale) + F.lit(offset) if (scale, offset) != (1.0, 0.0) else _col(value)
    if low is not None:
        x = F.when(x >= low, x)
    if high is not None:
        x = F.when(x <= high, x)
    return x


def without_nodata(value: ColumnLike, nodata: ColumnLike) -> Column:
    """NULL where the value is within float tolerance of the nodata marker."""
    x, marker = _col(value), _col(nodata)
    close = F.abs(x - marker) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(marker)
    return F.when(marker.isNull() | ~close, x)


def decile(rank: ColumnLike, rows: ColumnLike) -> Column:
    """``ceil(rank * 10 / rows)`` kept in 1..10 (not NTILE)."""
    raw = F.ceil(_col(rank).cast("double") * 10.0 / _col(rows).cast("double"))
    return F.greatest(F.lit(1), F.least(F.lit(10), raw)).cast("int")
