"""Every operator of this subpackage over its whole table, under the names the driver knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm import chat_format, decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, pii, quality_rules, simhash, source_audit, toxicity, vector_codes
from tastegrid.llm.registry import ORACLES, QUERIES, query, table


@query("op1_source_mixing", mixing.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_spans(table(spark, sf_dir, "documents"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_line_dedup", line_dedup.SQL.format(docs="documents"))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op10_chat_formatting")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = chat_format.expand(chat_format.with_probe(table(spark, sf_dir, "conversations")))
    return chat_format.read_back(examples)


@query("op11_source_divergence", source_audit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op13_vector_codes", vector_codes.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


__all__ = ["ORACLES", "QUERIES"]
