"""The registered queries of this subpackage, each over the whole of its table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import chat, counts, decontaminate, katz, licences, linededup, oracles, order, partenum, periodic, pieces, quality, sharding, sidecar, trie


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.join(table(spark, folder, "documents"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.report(table(spark, folder, "documents"), pieces.read_model())


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))


def op4_training_order(spark: SparkSession, folder: str) -> DataFrame:
    shards = order.write(table(spark, folder, "documents"), f"{sidecar.shared_folder(spark)}/shards", order.read_vocabulary())
    return order.report(shards)


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    trap = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.expand(rows.unionByName(spark.createDataFrame(trap, rows.schema))))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op9_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("edits", counts.sample_edits())
    return counts.count_edited(docs, order.read_vocabulary()).drop("text", "edits")


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), licences.known_licences(spark))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.build(*trie.replant(trie.digests(table(spark, folder, "conversations"))))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.drop_common_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.report(periodic.find_runs(periodic.make_periodic(table(spark, folder, "documents"))))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_training_order": op4_training_order,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_edit_aware_counts": op9_edit_aware_counts,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op5_chat_formatting": oracles.CHAT,
    "op7_sharding": oracles.SHARDS,
    "op10_license_scan": oracles.LICENCES,
    "op11_conversation_trie": oracles.TRIE,
    "op12_line_dedup": oracles.LINES,
}
