"""Sources, rules, labels and profiles on the order cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework import schema
from latticework.catalog.base import CELLS, cells, rounded, scratch, table
from latticework.functions.numeric import scaled_valid, without_nodata
from latticework.operators import label, profile, rules
from latticework.session import attach
from latticework.sources import tables

QUERIES, SQL = {}, {}
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LABELLED = f"""WITH {CELLS}, cut AS (SELECT city_id, quantile_cont(lst, 0.9) AS t FROM cells GROUP BY city_id),
labelled AS (SELECT cells.*, lst >= t AS hotspot FROM cells JOIN cut USING (city_id))"""


@query("flagship_label_summary", LABELLED + """
SELECT city_id, count(*) AS row_count, CAST(sum(CAST(hotspot AS INT)) AS BIGINT) AS hotspot_positive_count, count(hotspot) AS hotspot_non_missing_count,
 round(avg(CAST(hotspot AS INT)), 6) AS hotspot_prevalence, count(passes) AS passes_non_missing_count, CAST(min(passes) AS DOUBLE) AS passes_min,
 round(avg(passes), 6) AS passes_mean, CAST(max(passes) AS DOUBLE) AS passes_max, round(median(passes), 6) AS passes_median
FROM labelled GROUP BY city_id""")
def flagship(spark, folder):
    marked = label.label_top_share(cells(spark, folder), "city_id", "lst", "hotspot")
    return rounded(profile.group_summary(marked, "city_id", "hotspot", "passes", ()))


@query("w1_label_top_share", LABELLED + " SELECT city_id, cell_id, lst, hotspot FROM labelled")
def w1(spark, folder):
    return label.label_top_share(cells(spark, folder).select("city_id", "cell_id", "lst"), "city_id", "lst", "hotspot")


@query("s2_pruned_scan", "SELECT c_custkey, c_acctbal FROM customer")
def s2(spark, folder):
    return tables.scan(spark, f"{folder}/customer.parquet", ["c_custkey", "c_acctbal", "c_custkey"])


@query("s3_id_filtered_scan", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 3, 7)")
def s3(spark, folder):
    return tables.keep_ids(tables.scan(spark, f"{folder}/customer.parquet", ["c_custkey", "c_nationkey"]), [1, 3, 7], "c_nationkey")


@query("s4_schema_and_row_counts", "SELECT 'orders' AS name, count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s4(spark, folder):
    names = ["orders", "lineitem"]
    parts = [table(spark, folder, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n in names]
    return parts[0].unionByName(parts[1])


@query("s6_preview", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25")
def s6(spark, folder):
    return tables.preview(tables.scan(spark, f"{folder}/events.parquet", ["event_id", "user_id"]), 25, ["event_id"])


@query("s7_read_many_add_missing_columns", """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INT) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def s7(spark, folder):
    from pyspark.sql import types as T

    contract = T.StructType([T.StructField("id", T.LongType()), T.StructField("balance", T.DoubleType()), T.StructField("segment", T.StringType()), T.StructField("nation", T.IntegerType())])
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return schema.complete_columns(a, contract).unionByName(schema.complete_columns(b, contract))


@query("s9_prediction_rows", """SELECT event_type AS model_name, CAST(user_id % 5 AS INT) AS outer_fold, user_id AS city_id, CAST(NULL AS VARCHAR) AS city_name,
event_id AS cell_id, CAST(value > 50 AS TINYINT) AS hotspot_10pct, round(CAST(CAST(value / 1000.0 AS FLOAT) AS DOUBLE), 5) AS predicted_probability FROM events""")
def s9(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("model_name"), (F.col("user_id") % 5).alias("outer_fold"), F.col("user_id").alias("city_id"), F.lit(None).alias("city_name"),
        F.col("event_id").alias("cell_id"), (F.col("value") > 50).cast("int").alias("hotspot_10pct"), (F.col("value") / 1000.0).alias("predicted_probability"))
    typed = tables.as_prediction_rows(rows)
    return typed.withColumn("predicted_probability", F.round(F.col("predicted_probability").cast("double"), 5))


@query("s14_provenance", """SELECT count(*) AS row_count, 3 AS column_count, (SELECT count(*) FROM lineitem) AS input_row_count, (SELECT count(*) FROM lineitem) - count(*) AS dropped_row_count,
'["l_orderkey", "l_quantity", "line"]' AS column_names, '{"l_orderkey": "bigint", "l_quantity": "double", "line": "bigint"}' AS dtypes FROM lineitem WHERE l_discount > 0""")
def s14(spark, folder):
    """Line items before and after a rule that drops those without a discount."""
    items = table(spark, folder, "lineitem")
    kept = items.filter("l_discount > 0").select(F.col("l_orderkey").cast("bigint"), F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("bigint").alias("line"))
    return tables.provenance(kept, items.count())


@query("p4_p5_complete_and_coerce", """SELECT doc_id AS city_id, lang AS city_name, CAST(NULL AS VARCHAR) AS climate_group, doc_id AS cell_id,
CAST(n_chars AS DOUBLE) AS impervious_pct, CAST(TRY_CAST(replace(source, 'src', '') AS DOUBLE) AS BIGINT) AS land_cover_class FROM documents""")
def p4_p5(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("city_id"), F.col("lang").alias("city_name"), F.col("doc_id").alias("cell_id"),
        F.col("n_chars").cast("string").alias("impervious_pct"), F.regexp_replace("source", "src", "").alias("land_cover_class"))
    return schema.coerce_types(schema.complete_columns(raw)).select("city_id", "city_name", "climate_group", "cell_id", "impervious_pct", "land_cover_class")


@query("p6_group_rules", f"WITH {CELLS} SELECT city_id, cell_id, klass, passes FROM cells WHERE klass <> 1 AND passes >= 3")
def p6(spark, folder):
    return rules.group_rules(cells(spark, folder).select("city_id", "cell_id", "klass", "passes", "lst"), "city_id", "klass", "lst", "passes", water=1).drop("lst")


@query("p7_final_rules", f"""WITH {CELLS}, c AS (SELECT city_id, cell_id, klass, passes, CASE WHEN lst > 250000 THEN lst END AS lst FROM cells)
SELECT * FROM c WHERE klass <> 1 AND (lst IS NULL OR passes >= 3)""")
def p7(spark, folder):
    rows = cells(spark, folder).select("city_id", "cell_id", "klass", "passes", F.when(F.col("lst") > 250000, F.col("lst")).alias("lst"))
    return rules.final_rules(rows, "city_id", "klass", "lst", "passes", water=1)


@query("p8_core_cell_filter", f"WITH {CELLS} SELECT city_id, cell_id FROM cells WHERE lon > 0")
def p8(spark, folder):
    flagged = cells(spark, folder).withColumn("is_core", F.col("lon") > 0)
    return rules.cell_filter(flagged, "core_city", "is_core", "city_id").select("city_id", "cell_id")


@query("p9_binary_label", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y FROM orders""")
def p9(spark, folder):
    mixed = F.when(F.col("o_orderstatus") == "F", F.lit(" True ")).when(F.col("o_orderstatus") == "O", F.lit("0.0"))
    return table(spark, folder, "orders").select("o_orderkey", schema.binary_label(mixed, "o_orderstatus").alias("y"))


@query("p14_preferred_codes", """WITH m AS (SELECT p_partkey, p_type, p_size, bool_or(p_size IN (1, 2, 3)) OVER (PARTITION BY p_type) AS hit FROM part)
SELECT p_partkey, p_type, p_size FROM m WHERE p_type NOT IN ('PROMO', 'SMALL') OR (p_type = 'PROMO' AND p_size IN (1, 2, 3)) OR (p_type = 'SMALL')""")
def p14(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    return rules.prefer_codes(parts, "p_type", "p_size", {"PROMO": [1, 2, 3], "SMALL": [999]})


@query("p17_cap_cells", f"WITH {CELLS} SELECT city_id, cell_id FROM cells QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY cell_id) <= 40")
def p17(spark, folder):
    return rules.cap_cells(cells(spark, folder).select("city_id", "cell_id"), 40)


@query("g7_g8_scaled_valid_and_nodata", """SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN l_quantity * 0.5 - 1 BETWEEN 2 AND 20 THEN l_quantity * 0.5 - 1 END, 6) AS scaled,
 CASE WHEN abs(l_discount - 0.1) > 1e-8 + 1e-5 * 0.1 THEN l_discount END AS clean FROM lineitem""")
def g7_g8(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.round(scaled_valid("l_quantity", 0.5, -1.0, 2.0, 20.0), 6).alias("scaled"), without_nodata("l_discount", F.lit(0.1)).alias("clean"))


MISSING = """WITH e AS (SELECT event_type, user_id, CASE WHEN value > 10 THEN value END AS value, CASE WHEN event_type <> 'error' THEN props END AS props FROM events)"""


def _gappy(spark, folder):
    return table(spark, folder, "events").select(
        "event_type", "user_id", F.when(F.col("value") > 10, F.col("value")).alias("value"), F.when(F.col("event_type") != "error", F.col("props")).alias("props"))


@query("a3_missingness", MISSING + """, s AS (
SELECT 'value' AS "column", true AS present_in_dataset, count(value) AS non_missing_count, count(*) AS n FROM e UNION ALL
SELECT 'props', true, count(props), count(*) FROM e UNION ALL SELECT 'absent', false, 0, count(*) FROM e)
SELECT "column", present_in_dataset, non_missing_count, n - non_missing_count AS missing_count, round((n - non_missing_count) / n, 6) AS missing_pct FROM s""")
def a3(spark, folder):
    return rounded(profile.missingness(_gappy(spark, folder), ["value", "props", "absent"]).drop("dtype"))


@query("a4_missingness_by_group", MISSING + """, s AS (
SELECT user_id, 'value' AS "column", count(value) AS non_missing_count, count(*) AS n FROM e GROUP BY user_id UNION ALL
SELECT user_id, 'props', count(props), count(*) FROM e GROUP BY user_id)
SELECT user_id, "column", non_missing_count, n - non_missing_count AS missing_count, round((n - non_missing_count) / n, 6) AS missing_pct FROM s""")
def a4(spark, folder):
    return rounded(profile.missingness(_gappy(spark, folder), ["value", "props"], ["user_id"]).drop("dtype", "present_in_dataset"))


@query("a5_dataset_audit", f"""WITH {CELLS} SELECT count(*) AS row_count, count(DISTINCT city_id) AS group_count, count(*) FILTER (label = 0) AS label_0,
 count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label IS NULL) AS label_missing FROM cells""")
def a5(spark, folder):
    return profile.dataset_audit(cells(spark, folder), "city_id", "label")


def _profile_sql(group: str | None) -> str:
    key, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    one = lambda c: f"""SELECT {key}'{c}' AS variable, count({c}) AS n_non_missing, round(100.0 * (1.0 - count({c}) / count(*)), 6) AS missing_pct, round(avg({c}), 6) AS mean,
 round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.9), 6) AS p90,
 round(max({c}), 6) AS "max", round(skewness({c}), 6) AS skew FROM lineitem{by}"""  # noqa: E731
    return " UNION ALL ".join(one(c) for c in NUMERIC)


@query("a6_numeric_summary", _profile_sql(None))
def a6(spark, folder):
    return rounded(profile.numeric_summary(table(spark, folder, "lineitem"), NUMERIC))


@query("a6_numeric_summary_by_group", _profile_sql("l_returnflag"))
def a6_group(spark, folder):
    return rounded(profile.numeric_summary(table(spark, folder, "lineitem"), NUMERIC, ["l_returnflag"]))


@query("a7_class_composition", """SELECT p_type, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM part GROUP BY p_type""")
def a7(spark, folder):
    return rounded(profile.class_composition(table(spark, folder, "part"), "p_type", label=False))


@query("a8_label_composition", """WITH e AS (SELECT event_type, CASE WHEN value > 90 THEN 1 WHEN value > 20 THEN 0 END AS y FROM events),
s AS (SELECT event_type, count(*) AS n, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b, count(*) FILTER (y IS NULL) AS m FROM e GROUP BY event_type)
SELECT event_type, 'hotspot' AS category, a AS n_rows, round(100.0 * a / (a + b), 6) AS share_pct FROM s UNION ALL
SELECT event_type, 'non_hotspot', b, round(100.0 * b / (a + b), 6) FROM s UNION ALL SELECT event_type, 'missing', m, round(100.0 * m / n, 6) FROM s""")
def a8(spark, folder):
    y = F.when(F.col("value") > 90, 1).when(F.col("value") > 20, 0)
    return rounded(profile.label_composition(table(spark, folder, "events").select("event_type", y.alias("y")), "y", ["event_type"]))


@query("a9_quadrant_shares", f"""WITH {CELLS}, m AS (SELECT city_id, median(lon) AS mx, median(lat) AS my FROM cells GROUP BY city_id)
SELECT city_id, CASE WHEN lat <= my THEN 'south' ELSE 'north' END || '_' || CASE WHEN lon <= mx THEN 'west' ELSE 'east' END AS quadrant, count(*) AS n_cells,
 count(*) FILTER (label = 1) AS hotspot_n, round(100.0 * avg(label), 6) AS hotspot_share_pct FROM cells JOIN m USING (city_id) GROUP BY ALL""")
def a9(spark, folder):
    return rounded(profile.quadrant_shares(cells(spark, folder), ["city_id"], "lon", "lat", "label"))


CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, round({'min(1.0)' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM lineitem" for a in NUMERIC for b in NUMERIC)


@query("a10_correlations", CORR)
def a10(spark, folder):
    return rounded(profile.correlations(table(spark, folder, "lineitem"), NUMERIC))


@query("a11_strongest_correlation", """WITH c AS (SELECT 'l_extendedprice' AS variable, corr(l_quantity, l_extendedprice) AS corr FROM lineitem UNION ALL
SELECT 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_quantity, l_tax) FROM lineitem)
SELECT variable, round(corr, 6) AS corr FROM c ORDER BY abs(corr) DESC LIMIT 1""")
def a11(spark, folder):
    return rounded(profile.strongest_correlation(profile.correlations(table(spark, folder, "lineitem"), NUMERIC), "l_quantity"))


@query("a12_filter_audit", f"""WITH {CELLS}, s AS (SELECT city_id, count(*) AS n, count(*) FILTER (klass = 1) AS w, count(*) FILTER (klass <> 1 AND passes < 3) AS l,
 count(*) FILTER (NOT lon > 0) AS r, count(*) FILTER (lon > 0 AND klass <> 1 AND passes >= 3) AS f FROM cells GROUP BY city_id)
SELECT city_id, stage, n_rows, round(100.0 * n_rows / n, 6) AS share_of_unfiltered_pct FROM (
 SELECT city_id, n, 'unfiltered_input_rows' AS stage, n AS n_rows FROM s UNION ALL SELECT city_id, n, 'dropped_open_water_rows', w FROM s UNION ALL
 SELECT city_id, n, 'dropped_lt3_ecostress_pass_rows', l FROM s UNION ALL SELECT city_id, n, 'dropped_buffer_ring_rows', r FROM s UNION ALL
 SELECT city_id, n, 'final_filtered_rows', f FROM s)""")
def a12(spark, folder):
    before = cells(spark, folder).withColumn("core", F.col("lon") > 0)
    after = rules.group_rules(rules.cell_filter(before, "core_city", "core"), "city_id", "klass", "lst", "passes", water=1)
    return rounded(profile.filter_audit(before, after, ["city_id"], "klass", "lst", "passes", "core", water=1))


@query("a13_count_consistency", """SELECT user_id, count(*) AS left_rows, count(*) FILTER (value > 1) AS right_rows, count(*) = count(*) FILTER (value > 1) AS consistent FROM events GROUP BY user_id""")
def a13(spark, folder):
    events = table(spark, folder, "events")
    return profile.count_consistency(events, events.filter("value > 1"), ["user_id"])


@query("a31_scaling_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem""" for c in NUMERIC))
def a31(spark, folder):
    return rounded(profile.moments(table(spark, folder, "lineitem"), NUMERIC))


@query("a37_profile_bundle", f"""WITH {CELLS}, k AS (SELECT city_id, 'lst' AS v, skewness(lst) AS s FROM cells GROUP BY city_id UNION ALL SELECT city_id, 'lon', skewness(lon) FROM cells GROUP BY city_id)
SELECT c.city_id, count(*) AS observations, '[' || printf('%.0f', min(lon)) || ', ' || printf('%.0f', min(lat)) || ', ' || printf('%.0f', max(lon)) || ', ' || printf('%.0f', max(lat)) || ']' AS extent,
 any_value(b.v) AS most_skewed, round(any_value(b.s), 6) AS skew, 'completed' AS status
FROM cells c JOIN (SELECT city_id, arg_max(v, abs(s)) AS v, arg_max(s, abs(s)) AS s FROM k GROUP BY city_id) b USING (city_id) GROUP BY c.city_id""")
def a37(spark, folder):
    return rounded(profile.profile_bundle(cells(spark, folder), "city_id", ["lst", "lon"], ("lon", "lat", "lon", "lat")).drop("variables", "dataset_path"))


@query("j1_fold_lookup", """SELECT event_id, user_id, CASE WHEN user_id < 120 THEN CAST(user_id % 5 AS INT) END AS outer_fold FROM events""")
def j1(spark, folder):
    from latticework.operators.folds import with_fold

    events = table(spark, folder, "events").select("event_id", "user_id")
    folds = events.select("user_id").distinct().filter("user_id < 120").withColumn("outer_fold", (F.col("user_id") % 5).cast("int"))
    return with_fold(events, folds, "user_id")


@query("f1_f7_text_functions", """SELECT n_nationkey, 'nation_' || n_nationkey AS slug, printf('%02d', n_nationkey) || '_nation_' || n_nationkey || '_' || lower(r_name) AS stem,
 CASE n_regionkey WHEN 0 THEN 'Missing' WHEN 1 THEN 'Open Water' WHEN 2 THEN 'Developed, Low Intensity' ELSE 'Class ' || n_regionkey * 11 END AS land_label,
 'r' || n_nationkey * 7 || 'm' AS scale FROM nation JOIN region ON n_regionkey = r_regionkey""")
def f1_f7(spark, folder):
    from latticework.functions import text

    joined = attach(table(spark, folder, "nation").withColumn("r_regionkey", F.col("n_regionkey")), table(spark, folder, "region"), "r_regionkey")
    code = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") * 11)
    return joined.select(
        "n_nationkey", text.slug("n_name").alias("slug"), text.stem("n_nationkey", "n_name", "r_name").alias("stem"),
        text.land_cover_label(code).alias("land_label"), text.scale_label(F.col("n_nationkey") * 7.0).alias("scale"))


@query("s1_city_dimension", "SELECT n_nationkey AS city_id, n_name AS city_name, 'S' || n_regionkey AS state, 'region_' || n_regionkey AS climate_group, n_nationkey * 1.5 AS lat, -n_nationkey * 2.0 AS lon FROM nation")
def s1(spark, folder):
    """Nations written as the city CSV, read back through the contract reader."""
    path = scratch(spark)
    n = table(spark, folder, "nation")
    n.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("state"), F.lit("x").alias("unused"),
             F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("climate_group"), (F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_nationkey") * -2.0).alias("lon")
             ).write.mode("overwrite").option("header", True).csv(f"{path}/cities")
    return tables.read_cities(spark, f"{path}/cities")


@query("s5_s8_parquet_and_csv_copies", f"WITH {CELLS} SELECT city_id, cell_id, round(lst, 6) AS elevation_m, klass AS land_cover_class, label = 1 AS hotspot_10pct FROM cells")
def s5_s8(spark, folder):
    """Cells stored as partitioned Parquet and as CSV; the CSV copy is read back with declared types."""
    path = scratch(spark)
    rows = cells(spark, folder).select(F.col("city_id").cast("long"), "cell_id", F.col("lst").alias("elevation_m"), F.col("klass").alias("land_cover_class"), (F.col("label") == 1).alias("hotspot_10pct"))
    tables.write_parquet_and_csv(rows, f"{path}/parquet", f"{path}/csv")
    return rounded(tables.scan_csv(spark, f"{path}/csv").select(*rows.columns))


@query("s10_run_registry_round_trip", "SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS model_type, CAST(CAST(value AS DOUBLE) AS DOUBLE) AS pooled_pr_auc, user_id % 5 AS fold FROM events")
def s10(spark, folder):
    from latticework.functions.params import as_number
    from latticework.sources import runs

    path = scratch(spark)
    rows = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("model_type"), F.array((F.col("user_id") % 5).cast("int")).alias("outer_folds_used"), F.col("value").alias("pooled_pr_auc"))
    runs.append_runs(runs.metrics_map(rows, ["pooled_pr_auc"]), f"{path}/runs")
    back = runs.read_runs(spark, f"{path}/runs")
    return back.select("run_id", "model_type", as_number(F.col("metrics")["pooled_pr_auc"]).alias("pooled_pr_auc"), F.col("outer_folds_used")[0].cast("long").alias("fold"))


@query("p10_p11_p12_p15_checked_inputs", f"""WITH {CELLS} SELECT (SELECT count(*) FROM cells WHERE label IN (0, 1)) AS binary_rows, (SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_4') AS city_id,
 (SELECT count(DISTINCT n_regionkey) FROM nation) AS fold_count, (SELECT count(DISTINCT cell_id) FROM cells) AS transfer_rows""")
def checked(spark, folder):
    """Value checks that raise on bad input, run over whole tables that pass them."""
    from latticework.operators.folds import requested_folds

    rows = cells(spark, folder)
    schema.require_binary(rows, "label")
    rules.require_transfer_input(rows.drop("city_id"), ["lst", "klass"])
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("n_regionkey").alias("outer_fold"))
    city = rules.city_record(nations, city_name="Nation_4").select("city_id")
    counts = rows.agg(F.count_if(F.col("label").isin(0, 1)).alias("binary_rows"), F.countDistinct("cell_id").alias("transfer_rows"))
    return counts.crossJoin(F.broadcast(city)).withColumn("fold_count", F.lit(len(requested_folds(nations))))


@query("g5_base_cells", "SELECT s_suppkey AS cell_id, 'NATION_' || s_nationkey AS city_name, round(-112 + s_suppkey / 10000.0, 8) AS centroid_lon, round(33 + s_acctbal / 100000, 8) AS centroid_lat FROM supplier")
def g5(spark, folder):
    """Cells placed by projection, then given back their centroid longitude and latitude."""
    from latticework.functions import crs
    from latticework.operators import lattice

    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("n_regionkey").alias("climate_group"))
    points = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("city_id"), F.col("s_suppkey").alias("cell_id"), (-112 + F.col("s_suppkey") / 10000.0).alias("lon"), (33 + F.col("s_acctbal") / 100000).alias("lat"), F.lit(32612).alias("epsg"))
    placed = crs.to_utm(points, "lon", "lat", "epsg").select("city_id", "cell_id", "epsg", (F.col("x_m") - 15.0).alias("x0"), (F.col("y_m") + 15.0).alias("y1"))
    return rounded(lattice.base_cells(placed, nations).select("cell_id", "city_name", "centroid_lon", "centroid_lat"), 8)
