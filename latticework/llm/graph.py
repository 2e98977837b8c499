"""Connected components of an edge table, by rounds of smallest labels and pointer jumping."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.sidecar import shared_folder


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A table written and read back. A checkpoint would keep the constraints of its plan, which grow from round to round."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``: the smallest node reachable from it.

    Each round takes the smallest label among the neighbours, combined before the shuffle, and then the label's own label; chains
    halve, so the number of rounds is logarithmic. An empty table gives no rows.
    """
    folder = f"{shared_folder(edges.sparkSession)}/components"
    both = _stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), folder, "edges")
    labels = _stored(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label")), folder, "0")
    for turn in itertools.count(1):
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = _stored(nearer.join(target, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), folder, str(turn))
        labels = fresh.select("node", "label")
        if fresh.filter("label <> old").isEmpty():
            return labels
