"""Readers and writers for the city, cell, fold and prediction tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework import schema

#: More ids than this go through a semi join instead of an IN list.
MAX_IN_LIST = 1_000


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """City dimension from CSV, checked for its columns, in contract order."""
    header = spark.read.option("header", True).csv(path).columns
    schema.require_columns(header, [f.name for f in schema.CITY], "City table")
    types = {f.name: f for f in schema.CITY}
    declared = T.StructType([types.get(name, T.StructField(name, T.StringType())) for name in header])
    return spark.read.option("header", True).schema(declared).csv(path).select(*types)


def _existing(columns: Iterable[str] | None) -> list[str] | None:
    return None if columns is None else list(dict.fromkeys(columns))


def scan(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan of the named columns (repeats dropped)."""
    df = spark.read.parquet(path)
    wanted = _existing(columns)
    return schema.nan_to_null(df if wanted is None else df.select(*wanted))


def keep_ids(df: DataFrame, ids: Sequence, column: str = schema.GROUP) -> DataFrame:
    """Rows whose id is listed: a pushed-down IN filter, or a semi join for long lists."""
    ids = list(dict.fromkeys(ids))
    if len(ids) <= MAX_IN_LIST:
        return df.filter(F.col(column).isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([df.schema[column]]))
    return df.join(wanted, column, "left_semi")


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the file footer."""
    return spark.read.parquet(path).columns


def row_count(spark: SparkSession, path: str) -> int:
    """Row count, answered from Parquet footers."""
    return spark.read.parquet(path).count()


def scan_csv(
    spark: SparkSession, path: str, contract: T.StructType = schema.CELL, columns: Iterable[str] | None = None
) -> DataFrame:
    """CSV copy of a contract table: read as text by header, then coerced, never inferred."""
    raw = spark.read.option("header", True).csv(path)
    types = {f.name: f for f in contract}
    wanted = _existing(columns) or raw.columns
    typed = raw.select(*wanted)
    return schema.coerce_types(typed, T.StructType([types[c] for c in wanted if c in types]))


def preview(df: DataFrame, rows: int, order: Sequence[str] = ()) -> DataFrame:
    """First ``rows`` rows, in the given order if any (a top-k, not a full sort)."""
    return (df.orderBy(*order) if order else df).limit(rows)


def read_feature_files(
    spark: SparkSession, paths: str | Sequence[str], contract: T.StructType = schema.CELL, with_source: bool = False
) -> DataFrame:
    """Many per-group Parquet files as one contract table with absent columns as NULL."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    if with_source:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    extra = [*schema.CONTEXT_FLAGS, *(["source_file"] if with_source else [])]
    return schema.coerce_types(schema.complete_columns(df, contract, extra), contract)


def _replace(spark: SparkSession, staged: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    aside = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.previous")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(aside):
            fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"Could not move {target} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"Could not move {staged} to {target}")
    fs.delete(aside, True)


def write_replacing(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), order_by: Sequence[str] = (), **options) -> None:
    """Write beside the target, then swap by two renames; ``order_by`` fixes the order of the written rows.

    Readers never see a half-written table. Between the renames the table is at ``<path>.previous`` for a moment,
    and it is moved back if the second one fails.
    """
    staged = f"{path.rstrip('/')}.staged"
    ordered = [*partition_by, *[c for c in order_by if c not in partition_by]]
    if order_by:
        df = df.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staged)
    _replace(df.sparkSession, staged, path)


def write_parquet_and_csv(df: DataFrame, parquet_path: str, csv_path: str, partition_by: Sequence[str] = (schema.GROUP,), order_by: Sequence[str] = ()) -> DataFrame:
    """The same rows as partitioned Parquet and as CSV; the CSV is written from the Parquet just stored."""
    write_replacing(df, parquet_path, partition_by=partition_by, order_by=order_by)
    stored = df.sparkSession.read.parquet(parquet_path).select(*df.columns)
    write_replacing(stored, csv_path, "csv", order_by=[*partition_by, *order_by] if order_by else (), header=True)
    return stored


def as_prediction_rows(df: DataFrame) -> DataFrame:
    """Prediction table with its fixed types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.PREDICTION])


def write_predictions(df: DataFrame, path: str, order_by: Sequence[str] = ("city_id", "cell_id")) -> None:
    """Predictions under ``model_name=/outer_fold=``, in a fixed order; only the partitions present are replaced."""
    ordered = ["model_name", "outer_fold", *[c for c in order_by if c in df.columns]]
    (
        df.repartitionByRange(*ordered).sortWithinPartitions(*ordered).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_name", "outer_fold")
        .parquet(path)
    )


def per_group_counts(df: DataFrame, group: str = schema.GROUP) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("row_count"))


def source_files(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows per source file."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("row_count"))


def provenance(df: DataFrame, input_rows: int | None = None, source: str | None = None) -> DataFrame:
    """One row: row, column and dropped counts, column names and types, number of source files."""
    counts = [F.count(F.lit(1)).alias("row_count"), *([F.countDistinct(source).alias("source_file_count")] if source else [])]
    return df.agg(*counts).withColumns({
        "column_count": F.lit(len(df.columns)),
        "input_row_count": F.lit(input_rows).cast("long"),
        "dropped_row_count": F.lit(input_rows).cast("long") - F.col("row_count"),
        "column_names": F.lit(json.dumps(df.columns)),
        "dtypes": F.lit(json.dumps({f.name: f.dataType.simpleString() for f in df.schema})),
    })
