import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value of it very frequent, and nulls."""
    rng = np.random.default_rng(3)
    n = 900
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "b", "c")),
        "id": rng.permutation(n).astype("int64"),
        "score": np.where(rng.random(n) < 0.45, 0.5, np.round(rng.random(n), 2)),
        "w": rng.integers(0, 5, n),
    })
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("slices", [1, 12])
def test_rank_is_the_same_sliced_or_not(skewed, slices):
    frame, df = skewed
    got = ordering.rank_in_group(df, ["g"], [("score", False), ("id", True)], "r", slices, "n").toPandas()
    want = frame.sort_values(["g", "score", "id"], ascending=[True, False, True])
    want["r"] = want.groupby("g").cumcount() + 1
    want["n"] = want.groupby("g").id.transform("size")
    merged = got.merge(want, on="id")
    assert len(merged) == len(frame) and (merged.r_x == merged.r_y).all() and (merged.n_x == merged.n_y).all()


@pytest.mark.parametrize("slices", [1, 12])
def test_prefix_running_max_and_previous(skewed, slices):
    frame, df = skewed
    order = [("id", True)]
    out = ordering.prefix_sums(df, ["g"], order, {"cum": "w"}, slices)
    out = ordering.running_max_before(out, ["g"], order, out["score"], "best", slices)
    out = ordering.previous_values(out, ["g"], order, {"prev_w": "w"}, slices).toPandas()
    want = frame.sort_values(["g", "id"])
    want["cum"] = want.groupby("g").w.cumsum()
    want["best"] = want.groupby("g").score.transform(lambda s: s.cummax().shift())
    want["prev_w"] = want.groupby("g").w.shift()
    merged = out.merge(want, on="id", suffixes=("", "_want"))
    assert (merged.cum == merged.cum_want).all()
    pd.testing.assert_series_equal(merged.best, merged.best_want, check_names=False)
    pd.testing.assert_series_equal(merged.prev_w.astype(float), merged.prev_w_want, check_names=False)


@pytest.mark.parametrize("slices", [1, 12])
def test_quantiles_match_numpy(skewed, slices):
    frame, df = skewed
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in ordering.quantiles(df, ["g"], "score", probs, slices=slices).collect()}
    for group, part in frame.groupby("g"):
        assert np.allclose(got[group], np.quantile(part.score, probs), atol=1e-12)
    pooled = ordering.quantiles(df, [], "score", probs, slices=slices).first().q
    assert np.allclose(pooled, np.quantile(frame.score, probs), atol=1e-12)


def test_quantiles_slice_each_value_of_a_group_once(skewed, monkeypatch):
    """Rows that share a value can't be told apart by a range of values, so they must be counted before they are sliced."""
    frame, df = skewed
    rows, plain = [], ordering.slice_groups

    def counted(data, *rest):
        rows.append(data.count())
        return plain(data, *rest)

    monkeypatch.setattr(ordering, "slice_groups", counted)
    got = {r.g: r.q[0] for r in ordering.quantiles(df, ["g"], "score", [0.4], slices=5).collect()}
    assert all(np.isclose(got[g], np.quantile(part.score, 0.4)) for g, part in frame.groupby("g"))
    assert rows == [len(frame[["g", "score"]].drop_duplicates())]


def _values(kind, rng, n):
    if kind == "double":
        return [None if x < 0.1 else float("nan") if x < 0.3 else round(float(x), 1) for x in rng.random(n)]
    if kind == "date":
        return [None if x < 0.1 else datetime.date(2020, 1, 1) + datetime.timedelta(int(x * 9)) for x in rng.random(n)]
    if kind == "string":
        return [None if x < 0.1 else f"t{int(x * 6)}" for x in rng.random(n)]
    return [None if x < 0.1 else 2**60 + int(x * 4) for x in rng.random(n)]


@pytest.mark.parametrize("kind", ["double", "date", "string", "bigint"])
@pytest.mark.parametrize("ascending", [True, False])
def test_slices_follow_the_plain_window_for_every_type(spark, kind, ascending):
    rng = np.random.default_rng(5)
    n = 400
    rows = [(None if i % 50 == 0 else int(i % 7 == 0), i, v, float(i % 13)) for i, v in enumerate(_values(kind, rng, n))]
    df = spark.createDataFrame(rows, f"g int, id int, v {kind}, w double")
    order = [("v", ascending), ("id", True)]
    window = Window.partitionBy("g").orderBy(*ordering.order_columns(order))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "id", F.row_number().over(window).alias("r"), F.sum("w").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("w").over(before).alias("m"), F.lag("id").over(window).alias("p"),
    )
    out = ordering.rank_in_group(df, ["g"], order, "r", 9)
    out = ordering.prefix_sums(out, ["g"], order, {"s": "w"}, 9)
    out = ordering.running_max_before(out, ["g"], order, F.col("w"), "m", 9)
    out = ordering.previous_values(out, ["g"], order, {"p": "id"}, 9).select("id", "r", "s", "m", "p")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_mean_ranks_of_ties_that_span_slices(spark):
    """Ranks and mean ranks by one sort, for values that many rows share across slices, beside groups with few rows."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": rng.choice([1, 2, 3], 900, p=[0.9, 0.09, 0.01]), "v": rng.choice([0.0, 0.5, 0.5, 0.5, 1.0], 900), "i": np.arange(900)})
    frame.loc[frame.index % 9 == 0, "v"] = rng.normal(size=100).round(1)
    out = ordering.rank_with_ties(spark.createDataFrame(frame).repartition(5), ["g"], [("v", False), ("i", True)], "r", "t", "n", slices=7).toPandas().sort_values("i")
    by = frame.groupby("g")
    assert (out.t.to_numpy() == by.v.rank(ascending=False).to_numpy()).all() and (out.n.to_numpy() == by.v.transform("size").to_numpy()).all()
    placed = frame.sort_values(["g", "v", "i"], ascending=[True, False, True])
    assert (out.r.to_numpy() == (placed.groupby("g").cumcount() + 1).sort_index().to_numpy()).all()


def test_alignment_sorts_each_surface_once(spark, monkeypatch):
    """Top regions and rank correlation share a sort per surface; the third is that of the median distance."""
    from latticework.operators import align

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"city_id": 1, "smoothing_radius_m": 150.0, "row": np.arange(200) // 20, "col": np.arange(200) % 20, "observed": rng.choice([0.0, 1.0, 2.0], 200), "cell_m": 30.0})
    frame["predicted"], frame["x"], frame["y"] = frame.observed + rng.normal(size=200).round(1), 30.0 * frame.col, -30.0 * frame.row
    sorts, plain = [], ordering.slice_groups
    monkeypatch.setattr(ordering, "slice_groups", lambda *a: sorts.append(1) or plain(*a))
    got = align.alignment_metrics(spark.createDataFrame(frame), slices=6).first()
    assert got.spearman_surface_corr == pytest.approx(frame.observed.rank().corr(frame.predicted.rank())) and got.observed_top_cell_count == 20
    assert len(sorts) == 3
