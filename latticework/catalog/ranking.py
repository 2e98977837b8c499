"""Ranking metrics, top sets and rank correlations on scored line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog.base import SCORED, SCORED_TIES, rounded, scored, table
from latticework.operators import metrics
from latticework.operators.ordering import rank_in_group

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TIES = ", ".join(SCORED_TIES)


def metric_sql(keys: list[str], source: str = "scored", score: str = "score") -> str:
    """AP, AUC and recall at the top tenth by running counts over score groups."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    using = f"JOIN top USING ({k})" if keys else "CROSS JOIN top"
    by = f"GROUP BY {k}" if keys else ""
    return f""", g AS (SELECT {lead}{score} AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {lead}{score}),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER ({part}) AS pt, sum(n) OVER ({part}) AS nt FROM g WINDOW w AS ({part} ORDER BY s DESC)),
m AS (SELECT {lead}any_value(pt) AS pt, any_value(nt) AS nt, sum(p / pt * cp / cn) AS ap, sum((nt - cn + (n + 1) / 2) * p) AS ranks FROM c {by}),
r AS (SELECT {lead}label, row_number() OVER ({part} ORDER BY {score} DESC, {TIES}) AS rn, count(*) OVER ({part}) AS nn FROM {source}),
top AS (SELECT {lead}sum(label) FILTER (rn <= greatest(1, ceil(nn * CAST(0.1 AS DOUBLE)))) AS hits FROM r {by})
SELECT {lead}CAST(nt AS BIGINT) AS row_count, CAST(pt AS BIGINT) AS positive_count, round(pt / nt, 6) AS prevalence, round(ap, 6) AS pr_auc,
 round((ranks - pt * (pt + 1) / 2) / (pt * (nt - pt)), 6) AS roc_auc, round(hits / pt, 6) AS recall_at_top_10pct FROM m {using}"""


@query("a18_a20_prediction_metrics_by_group", f"WITH {SCORED}" + metric_sql(["city_id"]))
def by_group(spark, folder):
    return rounded(metrics.prediction_metrics(scored(spark, folder), ["city_id"], "label", "score", ties=SCORED_TIES))


@query("a18_a20_prediction_metrics_pooled", f"WITH {SCORED}" + metric_sql([]))
def pooled(spark, folder):
    return rounded(metrics.prediction_metrics(scored(spark, folder), [], "label", "score", ties=SCORED_TIES))


@query("a18_average_precision", f"""WITH {SCORED}, g AS (SELECT model_name, score AS s, CAST(sum(label) AS DOUBLE) AS p, count(*) AS n FROM scored GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model_name) AS pt FROM g WINDOW w AS (PARTITION BY model_name ORDER BY s DESC))
SELECT model_name, round(sum(p / pt * cp / cn), 6) AS pr_auc FROM c GROUP BY model_name""")
def ap(spark, folder):
    return rounded(metrics.average_precision(scored(spark, folder), ["model_name"], "label", "score"))


SUMMARY_PARTS = f"""WITH {SCORED}, f AS (SELECT *, l_suppkey % 5 AS fold FROM scored),
pooled AS (SELECT * FROM (WITH x AS (SELECT 1){metric_sql(['model_name'], 'f')})),
by_fold AS (SELECT * FROM (WITH x AS (SELECT 1){metric_sql(['model_name', 'fold'], 'f')})),
by_city AS (SELECT * FROM (WITH x AS (SELECT 1){metric_sql(['model_name', 'fold', 'city_id'], 'f')}))"""


@query("a21_run_summary", SUMMARY_PARTS + """
SELECT p.model_name, a.n AS outer_fold_count, b.n AS heldout_city_count, p.row_count AS heldout_row_count, p.positive_count AS heldout_positive_count,
 p.prevalence AS heldout_prevalence, p.pr_auc AS pooled_pr_auc, round(a.ap, 4) AS mean_fold_pr_auc, round(b.ap, 4) AS mean_city_pr_auc,
 p.recall_at_top_10pct AS pooled_recall_at_top_10pct, round(a.rc, 4) AS mean_fold_recall_at_top_10pct
FROM pooled p JOIN (SELECT model_name, count(DISTINCT fold) AS n, avg(pr_auc) AS ap, avg(recall_at_top_10pct) AS rc FROM by_fold GROUP BY 1) a USING (model_name)
JOIN (SELECT model_name, count(DISTINCT city_id) AS n, avg(pr_auc) AS ap FROM by_city GROUP BY 1) b USING (model_name)""")
def run_summary(spark, folder):
    rows = scored(spark, folder).withColumn("fold", F.col("l_suppkey") % 5)
    out = metrics.run_summary(rows, fold="fold", label="label", score="score", ties=SCORED_TIES)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("mean_fold_pr_auc", "mean_city_pr_auc", "mean_fold_recall_at_top_10pct")}))


@query("a22_weighted_means", """WITH f AS (SELECT event_type AS model_name, user_id % 7 AS fold, avg(value) AS metric, count(*) AS n FROM events GROUP BY ALL)
SELECT model_name, count(DISTINCT fold) AS n_folds, CAST(sum(n) AS BIGINT) AS total_rows, round(avg(metric), 6) AS mean_fold_metric, round(sum(metric * n) / sum(n), 6) AS weighted_mean_fold_metric FROM f GROUP BY 1""")
def weighted(spark, folder):
    folds = table(spark, folder, "events").groupBy(F.col("event_type").alias("model_name"), (F.col("user_id") % 7).alias("fold")).agg(
        F.avg("value").alias("metric"), F.count(F.lit(1)).alias("n"))
    return rounded(metrics.weighted_means(folds, "model_name", ["metric"], "n", "fold"))


@query("a23_calibration", f"""WITH {SCORED}, e AS (SELECT city_id, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored GROUP BY city_id),
b AS (SELECT city_id, len(list_filter(edges, lambda x: round(x, 9) < round(score, 9))) AS bin, score, label FROM scored JOIN e USING (city_id)),
p AS (SELECT city_id, bin, avg(score) AS a, avg(label) AS o FROM b GROUP BY ALL)
SELECT city_id, CAST(row_number() OVER (PARTITION BY city_id ORDER BY bin) - 1 AS INT) AS bin_index, round(a, 6) AS predicted_probability_mean, round(o, 6) AS observed_positive_rate FROM p""")
def calibration(spark, folder):
    return rounded(metrics.calibration(scored(spark, folder), ["city_id"], "label", "score"))


@query("w4_w5_top_flags", f"""WITH {SCORED} SELECT {TIES}, row_number() OVER (PARTITION BY city_id ORDER BY score DESC, {TIES}) <= greatest(1, ceil(count(*) OVER (PARTITION BY city_id) * CAST(0.07 AS DOUBLE))) AS in_top FROM scored""")
def top_flags(spark, folder):
    rows = scored(spark, folder).select("city_id", *SCORED_TIES, "score")
    return metrics.top_flags(rows, ["city_id"], "score", SCORED_TIES, 0.07).drop("city_id", "score")


@query("w6_prediction_labels", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS prediction_rank, count(*) OVER () AS n FROM events)
SELECT event_id, prediction_rank, prediction_rank <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) AS predicted_hotspot_10pct,
 CAST(least(10, greatest(1, ceil(CAST(prediction_rank AS DOUBLE) * 10.0 / n))) AS INT) AS prediction_decile FROM r""")
def labels(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    return metrics.prediction_labels(rows, (), "value", "event_id").drop("value")


MAPPED = """WITH m AS (SELECT user_id, event_id, value, CAST(event_type = 'error' AS INT) AS y,
 row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY user_id) * CAST(0.1 AS DOUBLE))) AS top FROM events),
l AS (SELECT *, CASE WHEN top AND y = 1 THEN 'true_positive' WHEN top THEN 'false_positive' WHEN y = 1 THEN 'false_negative' ELSE 'true_negative' END AS error_type FROM m)"""


def _mapped(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("y"))
    return metrics.map_labels(rows, "user_id", "y", "value", ("event_id",))


@query("w7_map_labels", MAPPED + " SELECT event_id, top AS predicted_hotspot_10pct, round(value - y, 6) AS prediction_residual, error_type FROM l")
def map_labels(spark, folder):
    return rounded(_mapped(spark, folder).drop("user_id", "value", "y"))


@query("a29_map_summary", MAPPED + """ SELECT user_id, count(*) AS row_count, count(*) FILTER (top) AS predicted_hotspot_count, CAST(sum(y) AS BIGINT) AS true_hotspot_count,
 count(*) FILTER (error_type = 'true_positive') AS true_positive_count, count(*) FILTER (error_type = 'false_positive') AS false_positive_count,
 count(*) FILTER (error_type = 'false_negative') AS false_negative_count, count(*) FILTER (error_type = 'true_negative') AS true_negative_count FROM l GROUP BY user_id""")
def map_summary(spark, folder):
    return metrics.map_summary(_mapped(spark, folder), ["user_id"], "y")


GAPS = """WITH e AS (SELECT event_id, event_type, value, CASE WHEN value > 5 THEN user_id END AS feature, row_number() OVER (ORDER BY value DESC, event_id) AS r, count(*) OVER () AS n FROM events),
p AS (SELECT *, r <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) AS top, CAST(least(10, greatest(1, ceil(CAST(r AS DOUBLE) * 10.0 / n))) AS INT) AS d FROM e)"""


def _labelled(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "value", F.when(F.col("value") > 5, F.col("user_id")).alias("feature"))
    return metrics.prediction_labels(rows, (), "value", "event_id")


@query("a24_prediction_overview", GAPS + """ SELECT count(*) AS row_count, count(*) FILTER (top) AS predicted_hotspot_count, round(avg(CAST(top AS INT)), 6) AS predicted_hotspot_fraction,
 min(value) AS predicted_probability_min, round(avg(value), 6) AS predicted_probability_mean, max(value) AS predicted_probability_max,
 min(value) FILTER (top) AS top_decile_probability_threshold, count(*) FILTER (feature IS NULL) AS rows_with_any_missing_features, round(median(value), 6) AS predicted_probability_median FROM p""")
def overview(spark, folder):
    return rounded(metrics.prediction_overview(_labelled(spark, folder), ["feature"], (), "value"))


@query("a25_decile_table", GAPS + """ SELECT d AS prediction_decile, count(event_id) AS row_count, min(value) AS predicted_probability_min, round(avg(value), 6) AS predicted_probability_mean,
 max(value) AS predicted_probability_max, count(*) FILTER (top) AS predicted_hotspot_count FROM p GROUP BY d""")
def deciles(spark, folder):
    return rounded(metrics.decile_table(_labelled(spark, folder), (), "value", "event_id"))


@query("a36_label_score_sanity", f"""WITH {SCORED}, both_ways AS (SELECT *, 'original' AS direction, score AS s2 FROM scored UNION ALL SELECT *, 'inverted', -score FROM scored),
m AS (SELECT * FROM (WITH x AS (SELECT 1){metric_sql(['direction'], 'both_ways', 's2')}))
SELECT direction, row_count AS "rows", prevalence AS positive_rate, pr_auc AS ap, roc_auc, round(recall_at_top_10pct * positive_count / ceil(row_count * CAST(0.1 AS DOUBLE)), 4) AS top_positive_rate FROM m""")
def sanity(spark, folder):
    out = metrics.label_score_sanity(scored(spark, folder), [], "label", "score", ties=SCORED_TIES)
    return rounded(out.withColumn("top_positive_rate", F.round("top_positive_rate", 4)))


@query("w19_spearman", """WITH v AS (SELECT l_linenumber, l_quantity, l_extendedprice FROM lineitem),
r AS (SELECT l_linenumber, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2.0 AS b FROM v)
SELECT l_linenumber, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark, folder):
    return rounded(metrics.spearman(table(spark, folder, "lineitem"), ["l_linenumber"], "l_quantity", "l_extendedprice"))


@query("g9_rank_in_group", f"WITH {SCORED} SELECT {TIES}, row_number() OVER (PARTITION BY model_name ORDER BY score DESC, {TIES}) AS rank FROM scored")
def sliced_rank(spark, folder):
    """The sliced path itself: groups far above the slice size set here."""
    rows = scored(spark, folder).select("model_name", *SCORED_TIES, "score")
    order = [("score", False), *[(c, True) for c in SCORED_TIES]]
    return rank_in_group(rows, ["model_name"], order, "rank", slices=16).drop("model_name", "score")
