"""Samples, folds and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.catalog.base import CELLS, cells, rounded, table
from latticework.operators import encode, folds, sample

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PLAN = f"""WITH {CELLS}, k AS (SELECT city_id, count(label) AS n, CAST(sum(label) AS BIGINT) AS p, least(100, count(label)) AS s FROM cells GROUP BY city_id),
a AS (SELECT *, n - p AS q, greatest(1, CAST(round_even(s * (CAST(p AS DOUBLE) / n), 0) AS BIGINT)) AS share FROM k),
b AS (SELECT *, least(CASE WHEN s - share <= 0 THEN s - 1 ELSE share END, p) AS fp, least(CASE WHEN s - share <= 0 THEN 1 ELSE s - share END, q) AS fn FROM a),
c AS (SELECT *, least(greatest(0, s - fp - fn), p - fp) AS mp FROM b),
plan AS (SELECT city_id, n, p, q, CASE WHEN n <= 100 OR p = 0 OR q = 0 THEN least(s, p) ELSE fp + mp END AS pt,
 CASE WHEN n <= 100 OR p = 0 OR q = 0 THEN least(s, q) ELSE fn + least(greatest(0, s - fp - fn) - mp, q - fn) END AS nt FROM c)"""


@query("w14_sample_plan", PLAN + """ SELECT city_id, n AS full_row_count, p AS full_positive_count, pt AS positive_take, nt AS negative_take,
 CASE WHEN n <= 100 THEN 'all_rows' WHEN p = 0 OR q = 0 THEN 'uniform_single_class' ELSE 'target_rate_stratified' END AS sampling_strategy,
 pt + nt AS sampled_row_count, pt AS sampled_positive_count, round(p / n, 6) AS full_positive_rate, round(pt / (pt + nt), 6) AS sampled_positive_rate FROM plan""")
def plan(spark, folder):
    return rounded(sample.sample_plan(cells(spark, folder), 100, "city_id", "label"))


@query("w14_stratified_sample_counts", PLAN + " SELECT city_id, 1 AS label, pt AS n FROM plan UNION ALL SELECT city_id, 0, nt FROM plan")
def drawn(spark, folder):
    out = sample.stratified_sample(cells(spark, folder), 100, "city_id", "cell_id", "label")
    return out.groupBy("city_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("w15_first_rows", f"WITH {CELLS} SELECT city_id, cell_id FROM cells QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY cell_id) <= 25")
def first_rows(spark, folder):
    return sample.first_rows(cells(spark, folder).select("city_id", "cell_id"), 25)


@query("w18_stratified_split_counts", f"""WITH {CELLS}, s AS (SELECT city_id, label, count(*) AS n FROM cells GROUP BY ALL),
t AS (SELECT *, greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS k FROM s)
SELECT city_id, label, CAST(r AS INT) AS repeat_id, k AS test_rows, n - k AS train_rows FROM t, range(3) g(r)""")
def splits(spark, folder):
    out = sample.stratified_splits(cells(spark, folder).select("city_id", "cell_id", "label"), 3, 0.2, "city_id", "cell_id", "label")
    return out.groupBy("city_id", "label", "repeat_id").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


FOLDS = f"""WITH RECURSIVE {CELLS}, s AS (SELECT city_id, count(*) AS row_count, row_number() OVER (ORDER BY count(*) DESC, city_id) AS i FROM cells GROUP BY city_id),
walk AS (SELECT 0 AS i, -1 AS city_id, 0 AS row_count, -1 AS pick, [0, 0, 0, 0, 0]::BIGINT[] AS t, [0, 0, 0, 0, 0]::BIGINT[] AS c
 UNION ALL SELECT n.i, n.city_id, n.row_count, n.pick, list_transform(w.t, lambda v, j: CASE WHEN j = n.pick + 1 THEN v + n.row_count ELSE v END),
  list_transform(w.c, lambda v, j: CASE WHEN j = n.pick + 1 THEN v + 1 ELSE v END)
 FROM walk w JOIN LATERAL (SELECT s.i, s.city_id, s.row_count, (SELECT arg_min(f, (w.t[f + 1], w.c[f + 1], f)) FROM range(5) r(f)) AS pick FROM s WHERE s.i = w.i + 1) n ON true)
SELECT city_id, row_count, CAST(pick AS INT) AS outer_fold FROM walk WHERE i > 0"""


@query("w16_balanced_folds", FOLDS)
def balanced(spark, folder):
    sizes = cells(spark, folder).groupBy("city_id").agg(F.count(F.lit(1)).alias("row_count"))
    return folds.balanced_folds(sizes, 5)


@query("w17_spatial_blocks", f"""WITH {CELLS}, m AS (SELECT city_id, median(lon) AS mx, median(lat) AS my FROM cells GROUP BY city_id)
SELECT cell_id, CASE WHEN lat >= my THEN 'north' ELSE 'south' END || CASE WHEN lon >= mx THEN 'east' ELSE 'west' END AS block FROM cells JOIN m USING (city_id)""")
def blocks(spark, folder):
    return folds.spatial_blocks(cells(spark, folder), "city_id", "lon", "lat", "block").select("cell_id", "block")


@query("w17_block_split_counts", f"""WITH {CELLS}, m AS (SELECT city_id, median(lon) AS mx, median(lat) AS my FROM cells GROUP BY city_id),
b AS (SELECT city_id, CASE WHEN lat >= my THEN 'north' ELSE 'south' END || CASE WHEN lon >= mx THEN 'east' ELSE 'west' END AS block FROM cells JOIN m USING (city_id)),
k AS (SELECT city_id, block, count(*) AS n FROM b GROUP BY ALL)
SELECT city_id, block AS held_out_block, n AS test_rows, CAST(sum(n) OVER (PARTITION BY city_id) - n AS BIGINT) AS train_rows FROM k""")
def block_counts(spark, folder):
    placed = folds.spatial_blocks(cells(spark, folder), "city_id", "lon", "lat", "block").select("city_id", "cell_id", "block")
    out = folds.block_splits(placed, "city_id", "block")
    return out.groupBy("city_id", "held_out_block").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


@query("p13_fold_contract", "SELECT count(*) AS groups, count(DISTINCT n_regionkey) AS folds FROM nation")
def contract(spark, folder):
    table_ = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_regionkey").alias("outer_fold"))
    return folds.check_folds(table_).agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("outer_fold").alias("folds"))


@query("j9_train_test_split", f"""WITH {CELLS} SELECT city_id % 5 = 2 AS is_test, count(*) AS n, count(DISTINCT city_id) AS cities FROM cells GROUP BY 1""")
def split(spark, folder):
    rows = cells(spark, folder).select("city_id", "cell_id")
    table_ = table(spark, folder, "nation").select(F.col("n_nationkey").alias("city_id"), (F.col("n_nationkey") % 5).alias("outer_fold"))
    train, test = folds.train_test(rows, table_, 2)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("city_id").alias("cities"))


@query("j10_category_means", """WITH j AS (SELECT doc_id, source, lang, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT * FROM j WHERE lang = 'en'),
m AS (SELECT source, avg(quality) AS m FROM t GROUP BY source) SELECT doc_id, round(coalesce(m, (SELECT avg(quality) FROM t)), 6) AS encoded FROM j LEFT JOIN m USING (source)""")
def category(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels"), "doc_id")
    return rounded(encode.encode_category(rows, rows.filter("lang = 'en'"), "source", "quality").select("doc_id", "encoded"))


EDGES = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


@query("j11_quantile_bin_means", f"""WITH {CELLS}, t AS (SELECT * FROM cells WHERE city_id < 15), e AS (SELECT list_sort(list_distinct(quantile_cont(lst, {EDGES}))) AS raw FROM t),
e2 AS (SELECT list_transform(raw, lambda v, i: CASE WHEN i = 1 THEN v - 1e-9 WHEN i = len(raw) THEN v + 1e-9 ELSE v END) AS edges FROM e),
b AS (SELECT cell_id, city_id, label, CASE WHEN lst >= edges[1] AND lst <= edges[-1] THEN greatest(0, len(list_filter(edges, lambda v: v < lst)) - 1) END AS bin FROM cells, e2),
m AS (SELECT bin, avg(label) AS m FROM b WHERE city_id < 15 AND bin IS NOT NULL GROUP BY bin)
SELECT cell_id, round(coalesce(m, (SELECT avg(label) FROM t)), 6) AS encoded FROM b LEFT JOIN m USING (bin)""")
def binned(spark, folder):
    rows = cells(spark, folder)
    return rounded(encode.encode_bins(rows, rows.filter("city_id < 15"), "lst", "label").select("cell_id", "encoded"))


@query("m7_fold_baselines", f"""WITH {CELLS}, r AS (SELECT cell_id, city_id % 4 AS fold, klass, climate_group, lst, CAST(label AS DOUBLE) AS y FROM cells),
f AS (SELECT DISTINCT fold AS fold FROM r), x AS (SELECT f.fold AS hold, r.* FROM f JOIN r ON r.fold <> f.fold),
g AS (SELECT hold, avg(y) AS m FROM x GROUP BY 1), k AS (SELECT hold, klass, avg(y) AS m FROM x GROUP BY 1, 2), l AS (SELECT hold, climate_group, avg(y) AS m FROM x GROUP BY 1, 2),
e AS (SELECT hold, list_sort(list_distinct(quantile_cont(lst, {EDGES}))) AS raw FROM x GROUP BY hold),
e2 AS (SELECT hold, list_transform(raw, lambda v, i: CASE WHEN i = 1 THEN v - 1e-9 WHEN i = len(raw) THEN v + 1e-9 ELSE v END) AS edges FROM e),
bx AS (SELECT x.hold, y, CASE WHEN lst >= edges[1] AND lst <= edges[-1] THEN greatest(0, len(list_filter(edges, lambda v: v < lst)) - 1) END AS bin FROM x JOIN e2 ON x.hold = e2.hold),
bm AS (SELECT hold, bin, avg(y) AS m FROM bx WHERE bin IS NOT NULL GROUP BY 1, 2),
br AS (SELECT cell_id, fold, CASE WHEN lst >= edges[1] AND lst <= edges[-1] THEN greatest(0, len(list_filter(edges, lambda v: v < lst)) - 1) END AS bin FROM r JOIN e2 ON fold = hold)
SELECT cell_id, 'global' AS model_name, round(g.m, 6) AS predicted_probability FROM r JOIN g ON fold = g.hold UNION ALL
SELECT cell_id, 'class', round(coalesce(k.m, g.m), 6) FROM r JOIN g ON fold = g.hold LEFT JOIN k ON fold = k.hold AND r.klass = k.klass UNION ALL
SELECT cell_id, 'climate', round(coalesce(l.m, g.m), 6) FROM r JOIN g ON fold = g.hold LEFT JOIN l ON fold = l.hold AND r.climate_group = l.climate_group UNION ALL
SELECT cell_id, 'value_bin', round(coalesce(bm.m, g.m), 6) FROM br JOIN g ON fold = g.hold LEFT JOIN bm ON fold = bm.hold AND br.bin = bm.bin""")
def baselines(spark, folder):
    rows = cells(spark, folder).select("cell_id", (F.col("city_id") % 4).alias("outer_fold"), "klass", "climate_group", "lst", "label")
    out = encode.fold_baselines(rows, "label", {"class": "klass", "climate": "climate_group"}, {"value_bin": "lst"}, global_name="global")
    return rounded(out.select("cell_id", "model_name", "predicted_probability"))
