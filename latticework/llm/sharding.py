"""Sharding by extendible hashing, with DataFrame operations only.

Method. A row's hash is 60 bits of the MD5 of its id and text. A bucket is a prefix of these bits; the bucket
of depth 0 holds everything, and a bucket over the byte limit is split on its next bit, until every bucket
fits. Bytes are summed per slot of ``ROUND_BITS`` bits and rolled up to all shorter prefixes, so one
aggregation decides up to ``ROUND_BITS`` splits; only rows of buckets still too large go on to the next round.
The directory has an entry per slot that names its bucket; rows find their bucket by a join with it.

A bucket of one single hash can't be split: one row above the limit, or wholly equal rows. It is a shard of its
own, with ``fits`` false if it is above the limit. Ids alone may repeat freely, as the text is hashed too.

Edge cases. Null ids and texts hash as their own kind; a null or empty text has 0 bytes. An empty table gives
no rows and an empty directory. Extra columns are kept; columns named like the new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.session import attach, materialize

HASH_BITS = 60
ROUND_BITS = 10
#: Most bytes of text in a shard.
SHARD_BYTES = 1 << 20


def row_hash(id_col: str, text_col: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")


def _prefix(hashed: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits as a number."""
    return F.call_function("shiftright", hashed, (F.lit(HASH_BITS) - (F.lit(depth) if isinstance(depth, int) else depth)).cast("int"))


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def directory(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[DataFrame]:
    """Directory tables, one per round: ``slot`` (the first ``10, 20, ...`` bits), ``shard``, ``depth``, ``shard_bytes``, ``fits``.

    A slot whose bucket needs more bits has null in the other columns; its rows are in the next table.
    """
    rows = materialize(docs.select(row_hash(id_col, text_col).alias("hash"), text_bytes(text_col).alias("bytes")))
    tables = []
    for low in range(0, HASH_BITS, ROUND_BITS):
        high = low + ROUND_BITS
        slots = rows.groupBy(_prefix(F.col("hash"), high).alias("slot")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("least"), F.max("hash").alias("most")
        )
        depths = slots.withColumn("depth", F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high))))
        paths = depths.withColumn("prefix", _prefix(F.col("least"), F.col("depth")))
        buckets = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
        closed = buckets.filter((F.col("bytes") <= shard_bytes) | (F.col("least") == F.col("most"))).select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
        found = paths.select("slot", "depth", "prefix").join(closed, ["depth", "prefix"]).groupBy("slot").agg(
            F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("bucket")
        )
        entries = slots.select("slot").join(found, "slot", "left").select(
            "slot", _bits(F.col("bucket.prefix"), F.col("bucket.depth")).alias("shard"), F.col("bucket.depth").alias("depth"),
            F.col("bucket.shard_bytes").alias("shard_bytes"), (F.col("bucket.shard_bytes") <= shard_bytes).alias("fits"),
        )
        table = materialize(entries)
        tables.append(table)
        still = table.filter("depth is null").select("slot")
        if still.isEmpty():
            break
        rows = attach(rows.withColumn("slot", _prefix(F.col("hash"), high)), still, "slot", "left_semi").drop("slot")
    return tables


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (its hash prefix as bits), ``depth``, ``shard_bytes`` and ``fits``."""
    names = ["shard", "depth", "shard_bytes", "fits"]
    out = docs.drop(*[n for n in names if n not in (id_col, text_col)]).withColumn("_hash", row_hash(id_col, text_col))
    tables = directory(docs, id_col, text_col, shard_bytes)
    for i, table in enumerate(tables):
        renamed = table.select(F.col("slot").alias(f"_slot{i}"), F.struct(*names).alias(f"_found{i}"))
        out = attach(out.withColumn(f"_slot{i}", _prefix(F.col("_hash"), ROUND_BITS * (i + 1))), renamed, f"_slot{i}")
    deepest = reduce(lambda a, b: F.when(b["depth"].isNotNull(), b).otherwise(a), [F.col(f"_found{i}") for i in range(len(tables))])
    done = out.withColumn("_bucket", deepest)
    done = done.select(*[c for c in docs.columns if c not in names], *[F.col("_bucket")[n].alias(n) for n in names])
    return done


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write the rows below ``path/shard=b<bits>`` (the letter keeps readers from taking bits as numbers), each shard by one task."""
    named = assign(docs, id_col, text_col, shard_bytes).withColumn("shard", F.concat(F.lit("b"), "shard"))
    named.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
