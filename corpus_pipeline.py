"""A training corpus from raw documents: rules, near duplicates, benchmark leaks, then token ids.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``. Rows with a null id or text are judged like
others; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, partenum, pieces, quality, sidecar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules or the line labels reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = quality.train(docs, labels)
    return quality.judge(docs, chain).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; documents without words stay."""
    return partenum.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, copied or edited."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left; ``n_tokens`` counts the ids."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.read_model(), keep_text=False)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: No SQL form: the line labels, the alignment and the token ids have none. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = sidecar.shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/stage{i}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
