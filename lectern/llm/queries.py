"""Queries of the text problems: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import defects, leaks, lookalikes, packing, reading, scans, sentences, splitting


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Narrations and checked sentences as field_name, record_id, doc, text; a run is a document."""
    sections = _read(spark, d, "script_sections").select(F.lit("narration").alias("field_name"), F.col("section_id").alias("record_id"), F.col("run_id").alias("doc"), F.col("narration").alias("text"))
    checks = _read(spark, d, "sentence_checks").select(F.lit("sentence").alias("field_name"), F.col("check_id").alias("record_id"), F.col("run_id").alias("doc"), F.col("sentence").alias("text"))
    return sections.unionByName(checks)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(p1_records(spark, d))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """Block texts, narrations and quotes as field_name, record_id, text."""
    blocks = _read(spark, d, "rag_document_blocks").select(F.lit("block_text").alias("field_name"), F.col("block_id").alias("record_id"), "text")
    sections = _read(spark, d, "script_sections").select(F.lit("narration").alias("field_name"), F.col("section_id").cast("string").alias("record_id"), F.col("narration").alias("text"))
    quotes = _read(spark, d, "sentence_checks").select(F.lit("quote").alias("field_name"), F.col("check_id").cast("string").alias("record_id"), F.col("quote").alias("text"))
    return blocks.unionByName(sections).unionByName(quotes)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.variants(p4_records(spark, d))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unified(p4_records(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(_read(spark, d, "rag_document_blocks"), _read(spark, d, "rag_document_chunks"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_read(spark, d, "rag_document_blocks"), _read(spark, d, "rag_document_chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(*(_read(spark, d, t) for t in ("rag_document_chunks", "chunk_limits", "rag_chunk_source_blocks", "rag_document_blocks")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(p3_pieces(spark, d))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(_read(spark, d, "documents")), _read(spark, d, "pack_containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p6_packed(spark, d), _read(spark, d, "pack_containers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_read(spark, d, "documents"), _read(spark, d, "reading_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(p8_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(_read(spark, d, "llm_calls"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_repaired, p3_found, p3_pieces, p4_found, p4_unified, p5_found, p6_packed, p6_fill, p7_found, p8_found, p8_profile,
    )
}
SQL: dict[str, str] = {
    "p3_found": """
        select distinct limit_name, chunk_id from rag_document_chunks c join chunk_limits l
        on octet_length(encode(c.text)) > 4 * l.max_tokens""",
}
