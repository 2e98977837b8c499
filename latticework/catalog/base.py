"""Shared inputs of the registered queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that the order of additions does not show."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as cells of their customer's nation."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("city_id"),
        F.col("o_orderkey").alias("cell_id"),
        F.col("o_totalprice").alias("lst"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("klass"),
        (F.dayofmonth("o_orderdate") % 7).cast("bigint").alias("passes"),
        F.col("c_acctbal").alias("lon"),
        (F.col("o_totalprice") / 1000.0).alias("lat"),
        F.col("c_mktsegment").alias("climate_group"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


CELLS = """cells AS (SELECT c_nationkey AS city_id, o_orderkey AS cell_id, o_totalprice AS lst,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS klass, CAST(day(o_orderdate) % 7 AS BIGINT) AS passes,
  c_acctbal AS lon, o_totalprice / 1000.0 AS lat, c_mktsegment AS climate_group,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as labelled scores: many tied scores, groups by line number."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("city_id"), "l_orderkey", "l_partkey", "l_suppkey",
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_discount") + F.col("l_quantity") / 100.0, 4).alias("score"),
        F.col("l_linestatus").alias("model_name"),
    )


SCORED_TIES = ("l_orderkey", "l_partkey", "l_suppkey")
SCORED = """scored AS (SELECT l_linenumber AS city_id, l_orderkey, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(l_discount + l_quantity / 100.0, 4) AS score, l_linestatus AS model_name
  FROM lineitem)"""


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier x month lattice per return flag, from line items."""
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return items.groupBy(F.col("l_returnflag").alias("city_id"), F.col("l_suppkey").cast("int").alias("row"), month.cast("int").alias("col")).agg(
        F.floor(F.max("l_extendedprice")).cast("double").alias("v"), F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")
    )


SHIPMENTS = """ship AS (SELECT l_returnflag AS city_id, CAST(l_suppkey AS INTEGER) AS "row",
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS col, floor(max(l_extendedprice)) AS v, max(l_quantity) AS q, count(*) AS n
  FROM lineitem GROUP BY ALL)"""


def scratch(spark: SparkSession) -> str:
    """A new folder for tables a query writes and reads back: shared on a cluster, temporary in local mode."""
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="spark-")
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
