"""Joins, comparisons, set operations and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog.base import CELLS, cells, rounded, table
from latticework.operators import compare, select

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def by_model(spark, folder, model, models=2):
    """One metrics row per customer and model; every order belongs to one model by its key."""
    orders = table(spark, folder, "orders").filter(F.col("o_orderkey") % models == model)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("city_id"), (F.col("c_nationkey") % 5).alias("outer_fold"), F.col("c_mktsegment").alias("climate_group"))
    stats = orders.groupBy(F.col("o_custkey").alias("city_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max("o_totalprice").alias("pr_auc"), F.min("o_totalprice").alias("recall_at_top_10pct"))
    return stats.join(customers, "city_id")


YEARLY = """y AS (SELECT o_custkey AS city_id, o_orderkey % 2 AS yr, count(*) AS row_count, max(o_totalprice) AS a, min(o_totalprice) AS r FROM orders GROUP BY ALL),
p AS (SELECT l.city_id, CAST(c_nationkey % 5 AS INT) AS outer_fold, c_mktsegment AS climate_group, l.row_count, l.a AS a1, q.a AS a2, l.r AS r1, q.r AS r2, q.a - l.a AS da, q.r - l.r AS dr,
 CASE WHEN q.a > l.a THEN 'next' WHEN q.a < l.a THEN 'first' ELSE 'tie' END AS wa, CASE WHEN q.r > l.r THEN 'next' WHEN q.r < l.r THEN 'first' ELSE 'tie' END AS wr
 FROM y l JOIN y q ON l.city_id = q.city_id AND l.yr = 0 AND q.yr = 1 JOIN customer ON c_custkey = l.city_id)"""
KEYS = ("outer_fold", "city_id", "climate_group")


def _paired(spark, folder):
    return compare.pair_metrics(by_model(spark, folder, 0), by_model(spark, folder, 1), "first", "next", "a", "b", KEYS, carry=("row_count",))


@query("j2_replace_columns", """WITH u AS (SELECT l_partkey AS p_partkey, max(l_extendedprice) AS p_retailprice, count(*) AS n_sold FROM lineitem GROUP BY 1)
SELECT part.p_partkey, p_name, u.p_retailprice, n_sold FROM part LEFT JOIN u USING (p_partkey)""")
def j2(spark, folder):
    update = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("p_retailprice"), F.count(F.lit(1)).alias("n_sold"))
    return compare.replace_columns(table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"), update, ["p_partkey"])


@query("j3_pair_metrics", f"""WITH {YEARLY} SELECT outer_fold, city_id, climate_group, row_count, a1 AS pr_auc_a, a2 AS pr_auc_b, r1 AS recall_at_top_10pct_a, r2 AS recall_at_top_10pct_b,
 round(da, 6) AS pr_auc_delta_b_minus_a, wa AS pr_auc_winner, round(dr, 6) AS recall_delta_b_minus_a, wr AS recall_winner FROM p""")
def j3(spark, folder):
    return rounded(_paired(spark, folder))


@query("j4_fold_comparison", """WITH f AS (SELECT c_nationkey AS outer_fold, c_mktsegment = 'BUILDING' AS b, count(DISTINCT c_custkey) AS cities, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT l.outer_fold, 5 AS folds, round_even(l.m, 2) AS m_x, round_even(r.m, 2) AS m_y, round_even(r.m - l.m, 2) AS m_delta FROM f l JOIN f r ON l.outer_fold = r.outer_fold AND NOT l.b AND r.b""")
def j4(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = lambda keep: joined.filter(keep).groupBy(F.col("c_nationkey").alias("outer_fold")).agg(F.avg("o_totalprice").alias("m")).withColumn("folds", F.lit(5))
    building = F.col("c_mktsegment") == "BUILDING"
    return compare.fold_comparison(side(~building), side(building), "x", "y", ["outer_fold"], ["folds"], ["m"], 2)


@query("j5_j6_reference_gaps", """WITH y AS (SELECT o_custkey AS city_id, o_orderkey % 3 AS yr, max(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT a.city_id, a.m AS spatial, b.m AS within_ref, c.m AS cross_ref, round(a.m - b.m, 6) AS gap_within, round(a.m - c.m, 6) AS gap_cross
FROM y a LEFT JOIN y b ON a.city_id = b.city_id AND b.yr = 1 LEFT JOIN y c ON a.city_id = c.city_id AND c.yr = 2 WHERE a.yr = 0""")
def j5_j6(spark, folder):
    best = lambda model, name: by_model(spark, folder, model, 3).select("city_id", F.col("pr_auc").alias(name))
    out = compare.reference_gaps(best(0, "spatial"), {"within": best(1, "within_ref"), "cross": best(2, "cross_ref")}, ["city_id"],
                                 {"gap_within": ("spatial", "within_ref"), "gap_cross": ("spatial", "cross_ref")})
    return rounded(out)


@query("j7_checked_lookup", "SELECT c_custkey, c_nationkey, n_name, n_nationkey AS nation_again FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j7(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_nationkey").alias("nation_again"))
    return compare.checked_lookup(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", {"c_nationkey": "nation_again"})


@query("a14_climate_summary", """WITH s AS (SELECT c_nationkey AS city_id, r_name AS climate_group, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS p, count(*) FILTER (o_totalprice > 1500) AS k, median(day(o_orderdate)) AS d
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
SELECT CASE climate_group WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(substr(climate_group, 1, 1)) || lower(substr(climate_group, 2)) END AS climate_group, count(DISTINCT city_id) AS city_count, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(p) AS BIGINT) AS hotspot_count,
 round_even(sum(p) / sum(k), 4) AS hotspot_prevalence, min(n) AS min_rows, CAST(round_even(median(n), 0) AS BIGINT) AS median_rows, max(n) AS max_rows, round_even(median(d), 1) AS median_valid_passes FROM s GROUP BY s.climate_group""")
def a14(spark, folder):
    joined = (table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
              .join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey")))
    per = joined.groupBy(F.col("c_nationkey").alias("city_id"), F.col("r_name").alias("climate_group")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("o_totalprice") > 300000).alias("hotspot_positive_count"),
        F.count_if(F.col("o_totalprice") > 1500).alias("hotspot_non_missing_count"), F.median(F.dayofmonth("o_orderdate")).alias("n_valid_ecostress_passes_median"))
    return compare.climate_summary(per)


@query("a15_group_deltas", f"""WITH {YEARLY} SELECT climate_group, count(city_id) AS city_count, count(*) FILTER (wa = 'next') AS next_wins, count(*) FILTER (wa = 'first') AS first_wins,
 count(*) FILTER (wr = 'next') AS next_recall_wins, round(avg(a1), 4) AS mean_pr_auc_a, round(avg(da), 4) AS mean_pr_auc_delta, round(median(da), 4) AS median_pr_auc_delta,
 round(avg(dr), 4) AS mean_recall_delta, round(median(dr), 4) AS median_recall_delta FROM p GROUP BY 1""")
def a15(spark, folder):
    out = compare.group_deltas(_paired(spark, folder), "climate_group", {"pr_auc": "pr_auc_delta_b_minus_a", "recall": "recall_delta_b_minus_a"},
                               {"pr_auc_winner": {"next_wins": "next", "first_wins": "first"}, "recall_winner": {"next_recall_wins": "next"}}, ["pr_auc_a"])
    return rounded(out, 4)


@query("a16_disparity", f"""WITH {YEARLY}, g AS (SELECT climate_group, avg(a1) AS x, avg(a2) AS z FROM p GROUP BY 1)
SELECT 'pr_auc' AS metric, round(max(x) - min(x), 4) AS baseline_range, round(max(z) - min(z), 4) AS candidate_range, round((max(z) - min(z)) - (max(x) - min(x)), 4) AS range_delta FROM g""")
def a16(spark, folder):
    groups = compare.group_deltas(_paired(spark, folder), "climate_group", {}, {}, ["pr_auc_a", "pr_auc_b"])
    return rounded(compare.disparity(groups, {"pr_auc": ("mean_pr_auc_a", "mean_pr_auc_b")}), 4)


@query("a17_paired_summary", f"""WITH {YEARLY}, d AS (SELECT 'ap' AS metric, da AS d FROM p UNION ALL SELECT 'recall', dr FROM p)
SELECT metric, round_even(avg(d), 2) AS mean_delta, round_even(median(d), 2) AS median_delta, round_even(stddev_samp(d), 2) AS sd_delta, round_even(min(d), 2) AS min_delta, round_even(max(d), 2) AS max_delta,
 count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM d GROUP BY 1""")
def a17(spark, folder):
    return compare.paired_summary(_paired(spark, folder), {"ap": "pr_auc_delta_b_minus_a", "recall": "recall_delta_b_minus_a"}, 2)


@query("a26_training_rows", f"""WITH {CELLS} SELECT city_id, climate_group, count(cell_id) AS row_count, CAST(sum(label) AS BIGINT) AS hotspot_positive_count, round(sum(label) / count(cell_id), 6) AS hotspot_prevalence FROM cells GROUP BY 1, 2""")
def a26(spark, folder):
    return rounded(compare.training_rows(cells(spark, folder), ("city_id", "climate_group"), "label"))


@query("a28_importance_summary", """WITH i AS (SELECT event_type AS feature_name, user_id % 6 AS fold, avg(value) - 48 AS v FROM events GROUP BY 1, 2),
r AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY v DESC) AS k FROM i)
SELECT feature_name, feature_name AS base_feature_name, count(*) AS fold_count, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v, median(k) AS median_rank, round(stddev_pop(k), 6) AS rank_std,
 round(avg(CAST(v > 0 AS INT)), 6) AS positive_share FROM r GROUP BY 1""")
def a28(spark, folder):
    per = table(spark, folder, "events").groupBy(F.col("event_type").alias("feature_name"), (F.col("user_id") % 6).alias("fold")).agg((F.avg("value") - 48).alias("v"))
    ranked = compare.ranked_importance(per.withColumn("base_feature_name", F.col("feature_name")), "v", "fold", "k")
    return rounded(compare.importance_summary(ranked, "v", "k"))


@query("a28_coefficient_summary", """WITH i AS (SELECT event_type AS feature_name, user_id % 6 AS fold, avg(value) - 49.3 AS v FROM events GROUP BY 1, 2),
r AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY abs(v) DESC) AS k FROM i), s AS (SELECT feature_name, count(*) AS n, median(v) AS m, median(abs(v)) AS ma, median(k) AS mk,
 count(*) FILTER (v > 0) AS p, count(*) FILTER (v < 0) AS g FROM r GROUP BY 1)
SELECT feature_name, feature_name AS base_feature_name, n AS fold_count, round(m, 6) AS median_coefficient, round(ma, 6) AS median_abs_coefficient, mk AS median_absolute_rank,
 CASE WHEN p > g THEN 'positive' ELSE 'negative' END AS majority_sign, round(greatest(p, g) / n, 6) AS sign_consistency FROM s""")
def a28_coefficients(spark, folder):
    per = table(spark, folder, "events").groupBy(F.col("event_type").alias("feature_name"), (F.col("user_id") % 6).alias("fold")).agg((F.avg("value") - 49.3).alias("coefficient"))
    sized = per.withColumns({"base_feature_name": F.col("feature_name"), "_size": F.abs("coefficient")})
    return rounded(compare.coefficient_summary(compare.ranked_importance(sized, "_size", "fold", "absolute_rank")))


@query("w11_dense_rank", """WITH i AS (SELECT event_type, user_id, round(avg(value), 4) AS v FROM events GROUP BY 1, 2) SELECT event_type, user_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY v DESC) AS INT) AS k FROM i""")
def w11(spark, folder):
    per = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 4).alias("v"))
    return compare.ranked_importance(per, "v", "user_id", "k").drop("v")


@query("a30_repeat_summary", """WITH s AS (SELECT user_id AS city_id, event_type AS model_name, day(ts) % 3 AS repeat_id, avg(value) AS pr_auc, count(*) AS rows_used FROM events GROUP BY ALL)
SELECT city_id, model_name, count(repeat_id) AS repeat_count, round(avg(pr_auc), 6) AS pr_auc_mean, round(coalesce(stddev_samp(pr_auc), 0), 6) AS pr_auc_std, round(avg(rows_used), 6) AS rows_used_mean FROM s GROUP BY 1, 2""")
def a30(spark, folder):
    return rounded(compare.repeat_summary(_splits(spark, folder), ("city_id", "model_name"), ("pr_auc",), (), ("rows_used",)))


def _splits(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("city_id"), F.col("event_type").alias("model_name"), (F.dayofmonth("ts") % 3).alias("repeat_id")).agg(
        F.avg("value").alias("pr_auc"), F.count(F.lit(1)).alias("rows_used"))


@query("a30_roll_up", """WITH s AS (SELECT user_id AS city_id, event_type AS model_name, day(ts) % 3 AS repeat_id, avg(value) AS pr_auc FROM events GROUP BY ALL),
c AS (SELECT city_id, model_name, avg(pr_auc) AS pr_auc_mean FROM s GROUP BY 1, 2)
SELECT model_name, count(DISTINCT city_id) AS city_count, round(avg(pr_auc_mean), 6) AS mean_pr_auc_mean, round(coalesce(stddev_samp(pr_auc_mean), 0), 6) AS std_pr_auc_mean FROM c GROUP BY 1""")
def a30_roll_up(spark, folder):
    by_city = compare.repeat_summary(_splits(spark, folder), ("city_id", "model_name"), ("pr_auc",))
    return rounded(compare.roll_up(by_city, ["model_name"], ["pr_auc_mean"], ["pr_auc_mean"]))


@query("a35_linear_fit", """SELECT l_returnflag, count(*) AS n, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem GROUP BY 1""")
def a35(spark, folder):
    return rounded(compare.linear_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("t1_t2_top_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 6")
def t1(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return compare.top_rows(rows, [("l_extendedprice", False), ("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True)], 6)


@query("t4_label_extremes", """WITH s AS (SELECT 'N' || c_nationkey AS name, avg(c_acctbal) AS a, max(c_acctbal) AS b FROM customer GROUP BY 1)
SELECT arg_max(name, a) AS name FROM s UNION SELECT arg_min(name, a) FROM s UNION SELECT arg_max(name, b) FROM s UNION SELECT arg_min(name, b) FROM s UNION SELECT name FROM s WHERE name IN ('N3', 'N99')""")
def t4(spark, folder):
    stats = table(spark, folder, "customer").groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("name")).agg(F.avg("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    return compare.label_extremes(stats, "name", ["a", "b"], ["N3", "N99"])


@query("u1_u2_union_tables", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def u1(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return compare.union_tables(a, b)


@query("u2_benchmark_report", """WITH b AS (SELECT event_type, round_even(avg(value) / 100, 4) AS p, round_even(max(value) / 1000, 4) AS c, round_even(min(value), 4) AS r FROM events GROUP BY 1)
SELECT 'no_skill_reference' AS run_label, 0.1 AS pooled_pr_auc, 0.1 AS mean_city_pr_auc, 0.1 AS pooled_recall_at_top_10pct, 0 AS position UNION ALL
SELECT event_type, p, c, r, 1 FROM b WHERE event_type IN ('click', 'view') UNION ALL SELECT 'tuned_' || event_type, p, c, r, 1 FROM b""")
def u2(spark, folder):
    stats = table(spark, folder, "events").groupBy("event_type").agg(
        (F.avg("value") / 100).alias("pooled_pr_auc"), (F.max("value") / 1000).alias("mean_city_pr_auc"), F.min("value").alias("pooled_recall_at_top_10pct"))
    tuned = stats.select(F.concat(F.lit("tuned_"), F.col("event_type")).alias("run_label"), F.lit("family").alias("model_family"), F.lit("full").alias("preset"),
                         F.lit(5000).alias("rows_per_city"), "pooled_pr_auc", "mean_city_pr_auc", "pooled_recall_at_top_10pct", F.lit("note").alias("notes"))
    rows = compare.benchmark_rows(stats.withColumnRenamed("event_type", "model_name"), tuned, ["click", "view"], {"click": "c", "view": "v"})
    return compare.benchmark_report(rows)


@query("u3_distinct_by_key", """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""")
def u3(spark, folder):
    return compare.distinct_by(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("u4_columns_to_rows", f"WITH {YEARLY} SELECT city_id, 'first' AS model_name, a1 AS ap, r1 AS recall FROM p UNION ALL SELECT city_id, 'next', a2, r2 FROM p")
def u4(spark, folder):
    return compare.model_columns_to_rows(_paired(spark, folder), ["city_id"], {
        "first": {"ap": "pr_auc_a", "recall": "recall_at_top_10pct_a"}, "next": {"ap": "pr_auc_b", "recall": "recall_at_top_10pct_b"}})


@query("u5_id_sets", "SELECT 'missing' AS kind, c_custkey AS id FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'shared', o FROM (SELECT o_custkey AS o FROM orders INTERSECT SELECT c_custkey FROM customer)")
def u5(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    buyers = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return compare.missing_ids(customers, buyers, "id").withColumn("kind", F.lit("missing")).unionByName(compare.shared_ids(buyers, customers, "id").withColumn("kind", F.lit("shared")))


@query("f13_rounded_report", """SELECT s_suppkey AS "Supplier", round_even(s_acctbal, 1) AS "Balance" FROM supplier""")
def f13(spark, folder):
    return compare.rounded_report(table(spark, folder, "supplier"), {"s_suppkey": "Supplier", "s_acctbal": "Balance"}, {"s_acctbal": 1})


@query("w12_nearest_to_median", """WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS med FROM customer GROUP BY 1)
SELECT c_custkey, c_mktsegment, c_acctbal, round(med, 6) AS group_median, round(abs(c_acctbal - med), 6) AS abs_distance FROM customer JOIN m USING (c_mktsegment)
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - med), c_acctbal, c_custkey) = 1""")
def w12(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(select.nearest_to_median(rows, "c_mktsegment", "c_acctbal", ["c_acctbal", "c_custkey"]))


@query("w12_three_per_group", """WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS med FROM customer GROUP BY 1) SELECT c_custkey, c_mktsegment FROM customer JOIN m USING (c_mktsegment)
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - med), c_name, c_custkey) <= 3""")
def w12_three(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    return select.nearest_to_median(rows, "c_mktsegment", "c_acctbal", ["c_name", "c_custkey"], 3).select("c_custkey", "c_mktsegment")


@query("w12_representatives_with_forced", """WITH s AS (SELECT n_nationkey AS city_id, n_name AS city_name, n_regionkey AS climate_group, avg(c_acctbal) AS pr_auc FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
m AS (SELECT climate_group, median(pr_auc) AS med FROM s GROUP BY 1), n AS (SELECT s.*, med FROM s JOIN m USING (climate_group) QUALIFY row_number() OVER (PARTITION BY climate_group ORDER BY abs(pr_auc - med), pr_auc, city_id) = 1)
SELECT city_id, 'climate_group_median_nearest' || CASE WHEN city_name = 'NATION_7' THEN ';forced_already_selected' ELSE '' END AS selection_reason FROM n
UNION ALL SELECT city_id, 'forced' FROM s WHERE city_name = 'NATION_7' AND city_id NOT IN (SELECT city_id FROM n)""")
def w12_forced(spark, folder):
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(
        F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("n_regionkey").alias("climate_group")).agg(F.avg("c_acctbal").alias("pr_auc"))
    return select.representatives(rows, forced="nation_7").select("city_id", "selection_reason")


@query("w13_latest_by_key", """SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_type DESC, lpad(CAST(event_id AS VARCHAR), 9, '0') DESC) = 1""")
def w13(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("url"))
    return select.latest_by_key(rows, F.col("user_id").cast("string"), "day", "event_type", "url").select("key", "event_id")


@query("s13_first_existing", """WITH c AS (SELECT c_custkey AS id, 1 AS priority, c_acctbal > 9000 AS e, 'own' AS path FROM customer UNION ALL SELECT c_custkey, 2, c_acctbal > 5000, 'shared' FROM customer)
SELECT id, arg_min(path, priority) FILTER (e) AS path FROM c GROUP BY id""")
def s13(spark, folder):
    rows = table(spark, folder, "customer")
    options = rows.select(F.col("c_custkey").alias("id"), F.explode(F.array(
        F.struct(F.lit(1).alias("priority"), (F.col("c_acctbal") > 9000).alias("exists"), F.lit("own").alias("path")),
        F.struct(F.lit(2).alias("priority"), (F.col("c_acctbal") > 5000).alias("exists"), F.lit("shared").alias("path")))).alias("c")).select("id", "c.*")
    return select.first_existing(options, ["id"], "priority", "exists").select("id", "path")
