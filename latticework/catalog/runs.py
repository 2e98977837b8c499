"""Run history, parameters, status tables and inventories built from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog.base import rounded, table
from latticework.functions import params, text
from latticework.operators import compare, history, status
from latticework.sources import inventory

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("w8_frontier", """WITH e AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
SELECT event_id, best AS prior_best, round(value - best, 6) AS delta_vs_prior_best, CASE WHEN event_type <> 'error' THEN best IS NULL OR value > best END AS moved_frontier FROM e""")
def frontier(spark, folder):
    runs = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = history.frontier(runs, "user_id", ("ts", "event_id"), "value", "event_type <> 'error'")
    return rounded(out.select("event_id", "prior_best", "delta_vs_prior_best", "moved_frontier"))


@query("w9_previous_run", """WITH e AS (SELECT *, lag(event_id) OVER w AS pid, lag(event_type) OVER w AS ptype, lag(props) OVER w AS pprops FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, pid AS previous_run_id, CASE WHEN pid IS NOT NULL THEN event_type <> ptype END AS contract_changed, CASE WHEN pid IS NOT NULL THEN props <> pprops END AS comparison_changed FROM e""")
def previous(spark, folder):
    runs = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "props")
    out = history.previous_run(runs, "user_id", ("ts", "event_id"), "event_id", "event_type", "props")
    return out.select("event_id", "previous_run_id", "contract_changed", "comparison_changed")


@query("w10_run_order", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS run_order, strftime(ts, '%Y-%m-%d') AS run_date, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts FROM events")
def order(spark, folder):
    return history.run_order(table(spark, folder, "events").select("event_id", "ts"), "ts", "event_id")


@query("j8_annotations", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderstatus END AS manual FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.o_orderkey, o_orderpriority AS auto, a.manual, CASE WHEN trim(coalesce(a.manual, '')) <> '' THEN a.manual ELSE o_orderpriority END AS label FROM orders o LEFT JOIN a USING (o_orderkey)""")
def annotations(spark, folder):
    orders = table(spark, folder, "orders")
    notes = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderstatus")).alias("manual"))
    return history.annotate(orders.select("o_orderkey", F.col("o_orderpriority").alias("auto")), notes, "o_orderkey", {"label": ("manual", "auto")})


@query("a27_consensus_parameters", """SELECT '{"k":' || json_extract_string(props, '$.k') || '}' AS params, count(*) AS fold_count, round(avg(value), 6) AS mean_score, min(event_id) AS outer_fold_min FROM events GROUP BY 1""")
def consensus(spark, folder):
    return rounded(compare.consensus_parameters(table(spark, folder, "events"), "props", "value", "event_id"))


@query("a27_consensus_choice", """SELECT '{"k":' || json_extract_string(props, '$.k') || '}' AS params, count(*) AS fold_count FROM events GROUP BY 1 ORDER BY 2 DESC, avg(value) DESC, 1 LIMIT 1""")
def choice(spark, folder):
    return compare.consensus_choice(compare.consensus_parameters(table(spark, folder, "events"), "props", "value", "event_id")).select("params", "fold_count")


@query("s11_f3_f5_nested_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, substr(sha1('{"k":' || json_extract_string(props, '$.k') || '}'), 1, 12) AS signature,
 'k=' || json_extract_string(props, '$.k') AS summary FROM events""")
def nested(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", params.as_int(F.get_json_object("props", "$.k")).alias("k"), params.signature("props").alias("signature"), params.best_params_text("props").alias("summary"))


@query("f2_run_scopes", """WITH g AS (SELECT user_id, list_sort(list_distinct(list(day(ts)))) AS d FROM events GROUP BY user_id),
s AS (SELECT user_id, list_filter(d, lambda x: NOT list_contains(d, x - 1)) AS a, list_filter(d, lambda x: NOT list_contains(d, x + 1)) AS b FROM g)
SELECT user_id, array_to_string(list_transform(a, lambda x, i: 'f' || x || CASE WHEN b[i] = x THEN '' ELSE '-' || b[i] END), '_') AS scope, 's' || user_id * 10 AS sample FROM s""")
def scopes(spark, folder):
    days = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set(F.dayofmonth("ts")).alias("days"))  # at most 31 each
    return days.select("user_id", text.fold_scope("days").alias("scope"), text.sample_scope(F.col("user_id") * 10).alias("sample"))


@query("f8_f9_categories_and_sigmoid", """SELECT event_id, CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) AS number_text, CASE WHEN event_type = 'view' THEN '__MISSING__' ELSE event_type END AS word,
 round(1 / (1 + exp(-greatest(-35, least(35, value - 50)))), 6) AS p FROM events""")
def categories(spark, folder):
    from latticework.functions import numeric

    word = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return rounded(table(spark, folder, "events").select(
        "event_id", text.category("value", True).alias("number_text"), text.category(word).alias("word"), numeric.sigmoid(F.col("value") - 50).alias("p")))


@query("f10_base_feature", """SELECT DISTINCT source, CASE WHEN source IN ('src1', 'src2') THEN source WHEN source = 'src10' THEN 'src10' ELSE source || '_lvl' END AS base FROM documents""")
def base_feature(spark, folder):
    return table(spark, folder, "documents").select("source").distinct().select(
        "source", text.base_feature(F.concat(F.lit("categorical__"), F.col("source"), F.lit("_lvl")), ["src1", "src10", "src2"]).alias("base"))


@query("f6_keys_from_urls", """SELECT page_id, nullif(lower(regexp_extract(url, '(?i)([ns]\\d{2}[ew]\\d{3})', 1)), '') AS tile, regexp_extract(url || '/' || (1000 + page_id) || '_HU4_', '(?i)(\\d{4})_HU4_', 1) AS basin FROM pages""")
def keys(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    tagged = F.concat("url", F.lit("/"), (1000 + F.col("page_id")).cast("string"), F.lit("_HU4_"))
    return pages.select("page_id", text.tile_key("url", F.lit("")).alias("tile"), text.basin_key(tagged, F.lit("")).alias("basin"))


STATUS = """CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'skipped_existing' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'odd' END"""


def _statuses(spark, folder):
    words = {"click": " Completed", "view": "skipped_existing", "error": "FAILED", "signup": "pending", "purchase": "odd"}
    named = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("event_type")]
    stage = F.element_at(F.array(*[F.lit(s) for s in status.STAGES]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, folder, "events").select(F.col("user_id").alias("city_id"), stage.alias("stage"), named.alias("status"), "event_id")


@query("a32_overall_status", f"""WITH s AS (SELECT user_id AS city_id, event_id % 5 AS k, CASE {STATUS} WHEN 'pending' THEN 'not_started' WHEN 'odd' THEN 'failed' ELSE {STATUS} END AS st FROM events),
g AS (SELECT city_id, bool_and(st IN ('completed', 'skipped_existing')) AS ok, bool_or(st = 'failed') AS bad, min(k) FILTER (st = 'failed') AS f, min(k) FILTER (st NOT IN ('completed', 'skipped_existing')) AS o FROM s GROUP BY 1)
SELECT city_id, CASE WHEN ok THEN 'completed' WHEN bad THEN 'failed' ELSE 'not_started' END AS overall_status,
 ['raw_support_acquisition', 'support_layer_prep', 'appeears_ndvi', 'appeears_ecostress', 'feature_assembly'][coalesce(f, o) + 1] AS primary_stage FROM g""")
def overall(spark, folder):
    return status.overall_status(_statuses(spark, folder))


@query("a32_dataset_roll_up", """WITH s AS (SELECT o_custkey AS city_id, o_orderpriority AS dataset, CASE WHEN max(o_totalprice) > 490000 THEN 'failed' WHEN max(o_totalprice) > 480000 THEN 'blocked' WHEN max(o_totalprice) < 200000 THEN 'skipped_existing' ELSE 'completed' END AS st FROM orders GROUP BY 1, 2),
g AS (SELECT city_id, bool_or(st = 'failed') AS f, bool_or(st = 'blocked') AS b, bool_and(st = 'skipped_existing') AS k, string_agg(dataset || '=' || st, '; ' ORDER BY dataset) AS message, string_agg('bad ' || dataset, '; ' ORDER BY dataset) FILTER (st = 'failed') AS errs FROM s GROUP BY 1)
SELECT city_id, CASE WHEN f OR b THEN 'failed' WHEN k THEN 'skipped_existing' ELSE 'completed' END AS status, CASE WHEN f THEN errs WHEN b THEN 'raw support acquisition blocked' ELSE '' END AS error, message FROM g""")
def roll_up(spark, folder):
    top = F.max("o_totalprice")
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("city_id"), F.col("o_orderpriority").alias("dataset")).agg(
        F.when(top > 490000, "failed").when(top > 480000, "blocked").when(top < 200000, "skipped_existing").otherwise("completed").alias("status"))
    return status.roll_up_datasets(rows.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("bad "), F.col("dataset")))))


@query("a33_status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def counts(spark, folder):
    rows = _statuses(spark, folder)
    return status.status_counts(rows.withColumn("status", text.status_text("status")))


@query("a33_blocked_stages", "SELECT DISTINCT unnest(string_split(lower(c_mktsegment) || '_' || c_nationkey % 3 || ';' || 'n' || c_nationkey, ';')) AS stage FROM customer")
def stages(spark, folder):
    joined = F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("c_nationkey") % 3).cast("string"), F.lit("; n"), F.col("c_nationkey").cast("string"), F.lit(";"))
    return status.split_stages(table(spark, folder, "customer").select(joined.alias("blocked_stages")))


@query("p16_retry_and_missing", """WITH r AS (SELECT s_suppkey AS city_id, CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 3000 THEN 'pending' ELSE 'completed' END AS st FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT s_suppkey AS city_id, 'retry' AS reason FROM supplier LEFT JOIN r ON s_suppkey = city_id WHERE coalesce(st, '') IN ('', 'failed', 'pending')
UNION ALL SELECT s_suppkey, 'missing' FROM supplier WHERE NOT (s_acctbal > 1000 AND s_nationkey > 3)""")
def retry(spark, folder):
    cities = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("city_id"), "s_acctbal", "s_nationkey")
    records = cities.filter("city_id % 4 <> 0").select("city_id", F.when(F.col("s_acctbal") < 0, "Failed").when(F.col("s_acctbal") < 3000, " pending").otherwise("completed").alias("status"))
    flags = cities.select("city_id", (F.col("s_acctbal") > 1000).alias("a"), (F.col("s_nationkey") > 3).alias("b"))
    retried = status.needing_retry(cities.select("city_id"), records).withColumn("reason", F.lit("retry"))
    return retried.unionByName(status.missing_any(cities.select("city_id"), flags, ["a", "b"]).withColumn("reason", F.lit("missing")))


@query("p18_readiness", """WITH f AS (SELECT c_custkey AS city_id, c_acctbal > 0 AS a, c_nationkey > 5 AS b, c_mktsegment = 'BUILDING' AS c FROM customer)
SELECT city_id, a AND b AS support_prep_ready, b OR c AS feature_extraction_ready, array_to_string(list_filter([CASE WHEN NOT a THEN 'a_missing' END, CASE WHEN NOT b THEN 'b_missing' END], lambda x: x IS NOT NULL), ';') AS prep_blocking_reasons,
 CASE WHEN b OR c THEN '' ELSE 'bc_missing' END AS feature_blocking_reasons, array_to_string(list_sort(list_filter([CASE WHEN NOT a THEN 'a_missing' END, CASE WHEN NOT b THEN 'b_missing' END, CASE WHEN NOT (b OR c) THEN 'bc_missing' END], lambda x: x IS NOT NULL)), ';') AS blocking_reasons FROM f""")
def ready(spark, folder):
    flags = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("city_id"), (F.col("c_acctbal") > 0).alias("a"), (F.col("c_nationkey") > 5).alias("b"), (F.col("c_mktsegment") == "BUILDING").alias("c"))
    return status.readiness(flags, {"a": "a_missing", "b": "b_missing"}, {"bc": (["b", "c"], "bc_missing")})


FILES = """f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'dem/tiles/' WHEN 1 THEN 'nlcd/bundles/' WHEN 2 THEN 'nlcd/extracted/' WHEN 3 THEN 'hydro/packages/' WHEN 4 THEN 'hydro/extracted/' ELSE 'other/' END
 || lang || doc_id // 12 || CASE WHEN doc_id % 6 IN (1, 3) THEN '.zip' WHEN doc_id % 6 = 5 THEN '.part' ELSE '.tif' END AS rel, n_chars, 720 - doc_id % 720 AS age FROM documents)"""


def _files(spark, folder):
    k = F.col("doc_id") % 6
    base = F.when(k == 0, "dem/tiles/").when(k == 1, "nlcd/bundles/").when(k == 2, "nlcd/extracted/").when(k == 3, "hydro/packages/").when(k == 4, "hydro/extracted/").otherwise("other/")
    tail = F.when(k.isin(1, 3), ".zip").when(k == 5, ".part").otherwise(".tif")
    path = F.concat(F.lit("/data/cache/"), base, F.col("lang"), F.floor(F.col("doc_id") / 12).cast("string"), tail)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    made = F.timestamp_seconds(start.cast("long") + (F.col("doc_id") % 720) * 3600)
    return table(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("length"), made.alias("modificationTime"))


@query("a34_storage_report", f"""WITH {FILES}, c AS (SELECT *, CASE WHEN rel LIKE '%.part' THEN 'partial_download' WHEN rel LIKE 'dem/%' THEN 'dem_tile' WHEN rel LIKE 'nlcd/b%' THEN 'nlcd_bundle' WHEN rel LIKE 'nlcd/e%' THEN 'nlcd_extracted'
 WHEN rel LIKE 'hydro/p%' THEN 'hydro_package' WHEN rel LIKE 'hydro/e%' THEN 'hydro_extracted' ELSE 'unknown' END AS category, regexp_extract(rel, '([^/]*)\\.[a-z]*$', 1) AS stem FROM f),
z AS (SELECT DISTINCT stem FROM c WHERE category = 'hydro_package'),
r AS (SELECT c.*, CASE WHEN category NOT IN ('partial_download', 'nlcd_extracted', 'hydro_extracted') THEN 'mode_excluded' WHEN age < 24 THEN 'recent_file_under_24_hours'
 WHEN category = 'hydro_extracted' AND z.stem IS NULL THEN 'missing_source_package' ELSE '' END AS reason FROM c LEFT JOIN z ON c.stem = z.stem)
SELECT category, prune_block_reason, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS size_bytes FROM (SELECT category, reason AS prune_block_reason, n_chars FROM r) GROUP BY 1, 2""")
def storage(spark, folder):
    now = F.lit("2024-01-31 00:00:00")
    report = inventory.cache_report(_files(spark, folder), "/data/cache", now)
    return inventory.storage_summary(report, ["category", "prune_block_reason"]).select("category", "prune_block_reason", "file_count", "size_bytes")


@query("s12_value_layers", """SELECT doc_id, (lang IN ('en', 'fr')) AND source NOT IN ('src1', 'src2') AS is_value FROM documents""")
def layers(spark, folder):
    kind = F.when(F.col("lang").isin("en", "fr"), "NDVI").otherwise("EVI")
    note = F.when(F.col("source") == "src1", "_quality").when(F.col("source") == "src2", "-QA").otherwise("")
    name = F.concat(F.lit("/raw/ndvi/phoenix/MOD13A1.061_"), kind, note, F.lit("_doy2023"), F.col("doc_id").cast("string"), F.lit("_aid0001.tif"))
    return table(spark, folder, "documents").select("doc_id", inventory.is_value_layer(name, "ndvi").alias("is_value"))
