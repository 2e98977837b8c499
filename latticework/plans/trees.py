"""Trees of many fits grown together from histograms: random forests, and gradient boosting with leaf limits.

A fit is one row of a table of fits (a city, repeat, candidate and inner fold, say) with its parameters. One aggregate over all training
rows makes the histograms of every open node of every tree of every fit, keyed by (fit, tree, node, feature, bin); the best split of a
node is found by running sums over its bins, and rows move to the children by a join. So the number of jobs follows the depth of the trees, not the
number of fits, and what is shuffled are sums.

One rule serves both families: a split's gain is ``a_l^2/(b_l + l2) + a_r^2/(b_r + l2) - a^2/(b + l2)``. With ``a`` positives and ``b``
weights that is half the decrease of summed Gini impurity, with gradients and Hessians the gain of boosting. Bins are numbers from 0 in the order
of the values (a category is its own bin), -1 is missing: both sides are tried for missing values, and where training rows have none they go with
the larger child. Categories are ordered by ``a/(b + l2)`` in the node, so a split sends any set of them to the left.

Node 1 is the root, nodes ``2i`` and ``2i + 1`` are the children of ``i``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.text import category
from latticework.operators.ordering import quantiles
from latticework.session import attach, materialize, settle

BINS = 32
BINS_COLUMN = "bins"
#: Number of rows that a counted row stands for.
ROWS = "_rows"
MIN_GAIN = 1e-12
#: Node numbers are 64-bit, so trees end at this depth at the latest.
DEEPEST = 60
#: Rows that meet the trees of a fit in one task when they are scored.
CHUNK_ROWS = 20_000
#: Shares of Poisson(1) weights up to 0, 1, 2, ...: the number of times a row is drawn.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
SPLIT = "feature int, bin int, left_set array<int>, missing_left boolean, gain double, la double, lb double, ra double, rb double"


# --- bins ------------------------------------------------------------------------------------------


def _edges_below(edges: str, x: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < x))


def binned(
    rows: DataFrame, train: Column | str, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], bins: int = BINS, impute: bool = False,
    ordinal: bool = False,
) -> DataFrame:
    """Rows with ``bins``: a number per feature, numbers first, by quantile edges and levels of the training rows of each key.

    Missing numbers and unknown categories are -1; with ``impute`` a missing number gets the bin of the training median. ``ordinal`` cuts the sorted
    levels of a category into at most ``bins`` bins of about equal rows, as if they were numbers; otherwise a level is a bin.
    """
    keys = list(keys)
    texts = [category(c, isinstance(rows.schema[c].dataType, T.NumericType)) for c in categorical]
    plain = rows.withColumns({f"_n{i}": F.nanvl(F.col(c).cast("double"), F.lit(None)) for i, c in enumerate(numeric)} | {f"_t{i}": t for i, t in enumerate(texts)})
    known = plain.filter(train)
    if categorical:
        levels = known.groupBy(*keys).agg(*[F.array_sort(F.collect_set(f"_t{i}")).alias(f"_l{i}") for i in range(len(texts))])
        plain = attach(plain, levels, keys)
        code = lambda i: F.array_position(f"_l{i}", F.col(f"_t{i}")).cast("int") - 1
        plain = plain.withColumns({f"_c{i}": F.coalesce(code(i), F.lit(-1)) for i in range(len(texts))}).drop(*[f"_{k}{i}" for k in "tl" for i in range(len(texts))])
        known = plain.filter(train)
    measured = [f"_n{i}" for i in range(len(numeric))] + ([f"_c{i}" for i in range(len(texts))] if ordinal else [])
    if measured:
        entries = F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_x")) for c in measured])
        melted = known.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
        inside = [i / bins for i in range(1, bins)]
        cuts = quantiles(melted, [*keys, "_m"], "_x", [*inside, 0.5], "_q")
        edges = F.array_sort(F.array_distinct(F.slice("_q", 1, bins - 1)))
        wide = cuts.groupBy(*keys).agg(*[
            F.max(F.when(F.col("_m") == c, value)).alias(f"{name}{c}") for c in measured for name, value in (("_e", edges), ("_d", F.element_at("_q", -1)))
        ])
        plain = attach(plain, wide, keys)
    parts = []
    for c in measured:
        x = F.coalesce(F.col(c), F.col(f"_d{c}")) if impute and c.startswith("_n") else F.col(c)
        parts.append(F.when(x.isNull() | F.col(f"_e{c}").isNull(), -1).otherwise(_edges_below(f"_e{c}", x)))
    parts += [] if ordinal else [F.col(f"_c{i}") for i in range(len(texts))]
    helpers = [c for c in plain.columns if c not in rows.columns]
    return plain.withColumn(BINS_COLUMN, F.array(*[p.cast("int") for p in parts])).drop(*helpers)


# --- splits ----------------------------------------------------------------------------------------


def histograms(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums ``a``, ``b`` and row counts ``c`` per node, used feature and bin."""
    rows = F.col("c") if "c" in members.columns else F.lit(1)  # a member may stand for several rows
    spread = members.select(*keys, "node", "a", "b", rows.alias("c"), BINS_COLUMN, F.explode("use").alias("feature"))
    return spread.groupBy(*keys, "node", "feature", F.get(BINS_COLUMN, F.col("feature")).alias("bin")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")
    )


def best_splits(hist: DataFrame, keys: Sequence[str], categorical: Sequence[int] = ()) -> DataFrame:
    """The best split of each node with a gain; ``hist`` also has ``l2`` and ``min_leaf``. Ties go to the first feature and the smallest bin."""
    node = [*keys, "node"]
    whole = Window.partitionBy(*node, "feature")
    by_set = F.col("feature").isin([int(i) for i in categorical]) if categorical else F.lit(False)
    there = F.col("bin") >= 0
    place = F.when(there, F.when(by_set, F.try_divide("a", F.col("b") + F.col("l2"))).otherwise(F.col("bin").cast("double")))
    along = whole.orderBy(place.asc_nulls_first(), "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = hist.select(
        *node, "feature", "bin", "l2", "min_leaf", F.row_number().over(whole.orderBy(place.asc_nulls_first(), "bin")).alias("pos"),
        *[F.sum(F.when(there, F.col(x)).otherwise(F.lit(0))).over(along).alias(f"l{x}") for x in "abc"],
        *[F.sum(F.when(there, F.lit(0)).otherwise(F.col(x))).over(whole).alias(f"m{x}") for x in "abc"],
        *[F.sum(x).over(whole).alias(f"t{x}") for x in "abc"], F.collect_list(F.when(by_set & there, F.col("bin"))).over(along).alias("_set"), by_set.alias("_by_set"),
    ).filter("bin >= 0")

    def option(with_missing: bool) -> Column:
        left = {x: F.col(f"l{x}") + F.col(f"m{x}") if with_missing else F.col(f"l{x}") for x in "abc"}
        right = {x: F.col(f"t{x}") - left[x] for x in "abc"}
        gain = sum((F.try_divide(s["a"] * s["a"], s["b"] + F.col("l2")) for s in (left, right)), F.lit(0.0)) - F.try_divide(F.col("ta") * F.col("ta"), F.col("tb") + F.col("l2"))
        side = F.lit(True) if with_missing else F.when(F.col("mc") == 0, left["c"] > right["c"]).otherwise(F.lit(False))
        entry = F.struct(
            gain.alias("gain"), side.alias("missing_left"), left["a"].cast("double").alias("la"), left["b"].cast("double").alias("lb"),
            right["a"].cast("double").alias("ra"), right["b"].cast("double").alias("rb"),
        )
        allowed = (left["c"] >= F.col("min_leaf")) & (right["c"] >= F.col("min_leaf")) & (right["c"] > 0) & (gain > MIN_GAIN)
        return F.when(allowed & (F.col("mc") > 0) if with_missing else allowed, entry)

    options = found.withColumn("_o", F.explode(F.filter(F.array(option(False), option(True)), lambda o: o.isNotNull())))
    rank = F.struct(F.round("_o.gain", 9), -F.col("feature"), -F.col("pos"), ~F.col("_o.missing_left"))
    entry = F.struct("feature", "bin", F.when(F.col("_by_set"), F.array_sort("_set")).alias("left_set"), "_o.missing_left", "_o.gain", "_o.la", "_o.lb", "_o.ra", "_o.rb")
    return options.groupBy(*node).agg(F.max_by(entry, rank).alias("_s")).select(*node, "_s.*")


def _goes_left(bins: str = BINS_COLUMN) -> Column:
    x = F.get(bins, F.col("feature"))
    inside = F.when(F.col("left_set").isNotNull(), F.array_contains("left_set", x)).otherwise(x <= F.col("bin"))
    return F.when(x < 0, F.col("missing_left")).otherwise(inside)


def _children(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    sides = [F.struct((F.col("node") * 2 + i).alias("node"), F.col(f"{s}a").alias("a"), F.col(f"{s}b").alias("b")) for i, s in enumerate("lr")]
    return splits.select(*keys, F.explode(F.array(*sides)).alias("_c")).select(*keys, "_c.*")


FIT = "_fit"


def _numbered(fits: DataFrame, keys: Sequence[str], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of fits with a number of their own, computed once, and the rows with the number of their fit; null keys match."""
    numbered, small = settle(fits.withColumn(FIT, F.monotonically_increasing_id()))
    placed = attach(rows, numbered.select(*keys, FIT), keys, "inner").drop(*keys)
    return F.broadcast(numbered) if small else numbered, placed


# --- forests ---------------------------------------------------------------------------------------


def _used(node: Column, keys: Sequence[str], seed: int, features: int) -> Column:
    """``n_features`` features of a node, by the smallest hashes."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.struct(F.xxhash64(F.lit(seed), *keys, node, f).alias("h"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(hashed), 1, F.col("n_features")), lambda s: s.f)


def grow_forest(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: int, label: str, row: str, categorical: Sequence[int] = (), seed: int = 42, bootstrap: bool = True,
) -> DataFrame:
    """All trees of all fits: ``keys, tree, node, value`` and the split of inner nodes.

    ``rows`` has the keys of its fit, ``row`` (a key of its own inside the fit), the label and ``bins``. ``fits`` has ``n_trees, max_depth`` (null: no
    limit), ``min_leaf`` and ``n_features`` per key. A row is drawn into a tree a Poisson(1) number of times, by a hash of its key.
    """
    keys, own = list(keys), [FIT, "tree"]
    params = ["max_depth", "min_leaf", "n_features", "l2"]
    slim = rows.select(*keys, F.col(row).alias("_row"), F.col(label).cast("double").alias("_y"), BINS_COLUMN)
    fits, placed = _numbered(fits.select(*keys, "n_trees", *params[:3], F.lit(0.0).alias("l2")), keys, slim)
    spread = placed.join(fits.select(FIT, "n_trees", *params), FIT).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("n_trees") - 1)))
    share = F.pmod(F.xxhash64(F.lit(seed), *own, "_row"), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.size(F.filter(F.array(*[F.lit(x) for x in _DRAWN]), lambda x: x <= share)) if bootstrap else F.lit(1)
    members = spread.withColumn("b", drawn.cast("double")).filter("b > 0").withColumns({"a": F.col("b") * F.col("_y"), "node": F.lit(1).cast("long")})
    members = materialize(members.select(*own, "node", "a", "b", BINS_COLUMN, "max_depth", "n_features"))
    nodes = [materialize(members.groupBy(*own, "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))]
    splits: list[DataFrame] = []
    members = members.withColumn("use", _used(F.col("node"), own, seed, features))
    for depth in range(DEEPEST):
        open_ = members.filter(F.col("max_depth").isNull() | (F.col("max_depth") > depth))
        best = best_splits(histograms(open_, own).join(fits.select(FIT, "l2", "min_leaf", "n_features"), FIT), own, categorical).join(fits.select(FIT, "n_features"), FIT)
        best = materialize(best.withColumns({f"_use{i}": _used(F.col("node") * 2 + i, own, seed, features) for i in (0, 1)}).drop("n_features"))
        if best.isEmpty():
            break
        splits.append(best.drop("_use0", "_use1"))
        nodes.append(_children(best, own))
        moved = open_.drop("use").join(best.drop("gain", "la", "lb", "ra", "rb"), [*own, "node"])
        left = _goes_left()
        members = materialize(moved.select(
            *own, F.when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"), "a", "b", BINS_COLUMN, "max_depth", "n_features",
            F.when(left, F.col("_use0")).otherwise(F.col("_use1")).alias("use")))
    return _table(nodes, splits, own, F.try_divide("a", "b")).join(fits.select(FIT, *keys), FIT).drop(FIT)


def _table(nodes: list[DataFrame], splits: list[DataFrame], own: Sequence[str], value: Column) -> DataFrame:
    """Nodes with their values, and the splits of those that have one."""
    every, cut = nodes[0], splits[0] if splits else None
    for more in nodes[1:]:
        every = every.unionByName(more)
    for more in splits[1:]:
        cut = cut.unionByName(more)
    every = every.select(*own, "node", "a", "b", value.alias("value"))
    if cut is None:
        kinds = T._parse_datatype_string(SPLIT).fields[:5]
        return every.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds})
    return materialize(every.join(cut.drop("la", "lb", "ra", "rb"), [*own, "node"], "left"))


def predict(rows: DataFrame, trees: DataFrame, keys: Sequence[str], row: str, name: str = "predicted_probability", combine: str = "mean") -> DataFrame:
    """``rows`` with the mean of their fit's trees (or the logistic of the sum, with ``combine="boosted"``); null without trees.

    Rows of a fit are dealt into chunks of about ``CHUNK_ROWS``, and each chunk meets the fit's trees in one task.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("_chunks"))
    dealt = attach(rows, sizes, keys).withColumn("_chunk", F.pmod(F.xxhash64(row), F.col("_chunks")).cast("int")).drop("_chunks")
    columns = [*keys, "tree", "node", "value", "feature", "bin", "left_set", "missing_left"]
    apart = trees.select(*[F.col(c).alias(c) for c in columns])  # trees may stem from the same rows: columns of their own tell them apart
    sent = attach(apart, sizes, keys, "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        out = left.drop_columns(["_chunk"])
        if not right.num_rows or not n:
            return out.append_column(name, pa.nulls(n, pa.float64()))
        bins = left[BINS_COLUMN].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        right = right.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node, value = (right[c].to_numpy() for c in ("tree", "node", "value"))
        feature = right["feature"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        cut = right["bin"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        missing = right["missing_left"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        sets = {i: np.array(s) for i, s in enumerate(right["left_set"].to_pylist()) if s is not None}
        has_set = np.zeros(len(node), bool)
        has_set[list(sets)] = True
        starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        total = np.zeros(n)
        for first, last in zip(starts, np.append(starts[1:], len(tree))):
            at = np.full(n, first)
            while True:
                going = np.flatnonzero(feature[at] >= 0)
                if not len(going):
                    break
                here = at[going]
                x = bins[going, feature[here]]
                goes = x <= cut[here]
                for i in np.unique(here[has_set[here]]).tolist():
                    mine = here == i
                    goes[mine] = np.isin(x[mine], sets[i])
                goes = np.where(x < 0, missing[here], goes)
                at[going] = first + np.searchsorted(node[first:last], 2 * node[here] + ~goes)
            total += value[at]
        scores = total / len(starts) if combine == "mean" else 1 / (1 + np.exp(-np.clip(total, -700, 700)))
        return out.append_column(name, pa.array(scores))

    return dealt.groupBy(*keys, "_chunk").cogroup(sent.groupBy(*keys, "_chunk")).applyInArrow(walk, schema)


# --- boosting --------------------------------------------------------------------------------------


def _choose(known: pd.DataFrame) -> pd.DataFrame:
    """Best-first growth of each fit's tree over the splits known so far: which are ``taken``, and which nodes' splits are ``wanted`` next."""
    limit = int(known["max_leaf_nodes"].iloc[0])
    gains = {int(n): (g if g == g else None) for n, g in zip(known["node"], known["gain"])}  # None: looked at, no split
    open_, taken, wanted = {1}, [], []
    while len(taken) + 1 < limit:
        best = max((n for n in open_ if gains.get(n) is not None), key=lambda n: (round(gains[n], 9), -n), default=None)
        if best is None:
            break
        taken.append(best)
        open_.remove(best)
        for child in (2 * best, 2 * best + 1):
            if child in gains:
                open_.add(child)
            elif len(taken) + 1 < limit:
                wanted.append(child)
    return pd.DataFrame({FIT: int(known[FIT].iloc[0]), "node": np.array(taken + wanted, np.int64), "wanted": [False] * len(taken) + [True] * len(wanted)})


def counted(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows that boosting can't tell apart, those of the same keys, label and bins, as one row with their number."""
    number = F.sum(ROWS) if ROWS in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*keys, label, BINS_COLUMN).agg(number.alias(ROWS))


def boost(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: int, label: str, row: str, categorical: Sequence[int] = (),
) -> DataFrame:
    """Boosted trees of all fits for the logistic loss: ``keys, tree, node, value`` and splits; tree -1 is the starting log-odds.

    ``fits`` has ``max_iter, learning_rate, max_leaf_nodes, min_leaf, l2`` per key. A round grows one tree of every fit, best leaf first: splits are
    looked up for the nodes that the growth so far has taken, level by level, until it no longer depends on an unknown one. Rows of the same bins
    and label are ``counted`` first (``rows`` may be so already), so a round reads as many rows as there are such sets; ``row`` is not needed.
    """
    keys, own = list(keys), [FIT, "node"]
    slim = counted(rows, keys, label).select(*keys, F.col(label).cast("double").alias("_y"), BINS_COLUMN, F.col(ROWS).alias("c"))
    wanted_params = [F.col("max_iter").cast("int").alias("max_iter"), "learning_rate", "max_leaf_nodes", "min_leaf", F.col("l2").cast("double").alias("l2")]
    fits, placed = _numbered(fits.select(*keys, *wanted_params), keys, slim)
    shares = placed.groupBy(FIT).agg((F.sum(F.col("c") * F.col("_y")) / F.sum("c")).alias("_p"))
    eps = 1e-15  # a fit with one class starts at its log-odds' limit
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("_p")))
    start = materialize(shares.select(FIT, F.lit(-1).alias("tree"), F.lit(1).cast("long").alias("node"), F.log(p / (1 - p)).alias("value")))
    data = placed.join(start.select(FIT, F.col("value").alias("_raw")), FIT).join(fits.select(FIT, "max_iter"), FIT)
    data = materialize(data)
    nothing = F.lit(None).cast("double")
    nodes, splits = [start.select(FIT, "tree", "node", nothing.alias("a"), nothing.alias("b"), "value")], []
    use = F.array(*[F.lit(i) for i in range(features)])
    for tree in range(fits.agg(F.max("max_iter")).first()[0] or 0):
        chance = 1 / (1 + F.exp(-F.col("_raw")))
        members = data.filter(F.col("max_iter") > tree).select(
            FIT, BINS_COLUMN, F.lit(1).cast("long").alias("node"), (F.col("c") * (F.col("_y") - chance)).alias("a"), (F.col("c") * chance * (1 - chance)).alias("b"), "c", use.alias("use"))
        root = materialize(members.groupBy(*own).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
        wanted, known = root.select(*own), None
        while True:
            looked = members if known is None else members.join(wanted, own, "left_semi")
            best = best_splits(histograms(looked, [FIT]).join(fits.select(FIT, "l2", "min_leaf"), FIT), [FIT], categorical)
            fresh = materialize(wanted.join(best, own, "left"))
            known = fresh if known is None else known.unionByName(fresh)
            asked = known.select(*own, "gain").join(fits.select(FIT, "max_leaf_nodes"), FIT)
            found = materialize(asked.groupBy(FIT).applyInPandas(_choose, f"{FIT} long, node long, wanted boolean"))
            wanted = found.filter("wanted").select(*own)
            if wanted.isEmpty():
                break
            cut = known.join(wanted.select(FIT, F.shiftright("node", 1).alias("node")).distinct(), own, "left_semi")
            moved = members.join(cut.select(*own, "feature", "bin", "left_set", "missing_left"), own, "left")
            to = F.when(F.col("feature").isNull(), F.col("node")).when(_goes_left(), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
            members = materialize(moved.withColumn("node", to).select(*members.columns))
        taken = materialize(known.join(found.filter("not wanted").select(*own), own, "left_semi").withColumn("tree", F.lit(tree)))
        splits.append(taken)
        made = root.withColumn("tree", F.lit(tree)).unionByName(_children(taken, [FIT, "tree"])).join(fits, FIT)
        leaf = F.coalesce(F.col("learning_rate") * F.try_divide("a", F.col("b") + F.col("l2")), F.lit(0.0))
        nodes.append(materialize(made.select(FIT, "tree", "node", "a", "b", leaf.alias("value"))))
        path = nodes[-1].join(taken.select(*own, "tree", "feature", "bin", "left_set", "missing_left"), [*own, "tree"], "left")
        entry = F.struct("node", F.struct("value", "feature", "bin", "left_set", "missing_left"))
        model = path.groupBy(FIT).agg(F.map_from_entries(F.collect_list(entry)).alias("_tree"), F.max("node").alias("_last"))  # a few dozen nodes
        data = materialize(_added(data, model))
    return _boosted_table(nodes, splits, [FIT, "tree"]).join(fits.select(FIT, *keys), FIT).drop(FIT)


def _added(data: DataFrame, model: DataFrame) -> DataFrame:
    """Raw scores with one more tree of at most a few dozen leaves, walked as a map of nodes."""
    def step(at: Column, _) -> Column:
        node = F.element_at(F.col("_tree"), at)
        x = F.get(BINS_COLUMN, node.feature)
        inside = F.when(node.left_set.isNotNull(), F.array_contains(node.left_set, x)).otherwise(x <= node.bin)
        left = F.when(x < 0, node.missing_left).otherwise(inside)
        return F.when(node.feature.isNull(), at).otherwise(at * 2 + F.when(left, 0).otherwise(1))

    met = data.join(model, FIT, "left")
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.col("_last") + 1)).cast("int")))
    leaf = F.aggregate(levels, F.lit(1).cast("long"), step)
    value = F.element_at(F.col("_tree"), F.col("_leaf")).value
    return met.withColumn("_leaf", F.when(F.col("_tree").isNotNull(), leaf)).withColumn("_raw", F.col("_raw") + F.coalesce(value, F.lit(0.0))).drop("_tree", "_last", "_leaf")


def _boosted_table(nodes: list[DataFrame], splits: list[DataFrame], own: Sequence[str]) -> DataFrame:
    values = nodes[0]
    for more in nodes[1:]:
        values = values.unionByName(more)
    table = _table([values.drop("value")], splits, own, F.lit(None).cast("double")).drop("value")
    return materialize(table.join(values.select(*own, "node", "value"), [*own, "node"]))
