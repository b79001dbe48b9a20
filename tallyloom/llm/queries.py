"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import audit, beside, chat, decontam, hmm, langid, licences, mixing, ngram_join, pii, quality, resampling, sharding, warc
from tallyloom.llm.kit import bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    return {
        "op1_pii": lambda spark, d: pii.op1_pii(_table(spark, d, "documents")),
        "op2_ngram_join": lambda spark, d: ngram_join.op2_ngram_join(_table(spark, d, "documents")),
        "op3_quality_rules": lambda spark, d: quality.op3_quality_rules(_table(spark, d, "documents")),
        "op4_language_id": lambda spark, d: langid.op4_language_id(_table(spark, d, "documents")),
        "op5_decontaminate": lambda spark, d: decontam.op5_decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
        "op6_sharding": lambda spark, d: sharding.op6_sharding(_table(spark, d, "documents")),
        "op7_warc": lambda spark, d: warc.op7_warc(_table(spark, d, "pages")),
        "op8_chat_format": lambda spark, d: chat.op8_chat_format(_table(spark, d, "conversations")),
        "op9_mixing": lambda spark, d: mixing.op9_mixing(_table(spark, d, "documents")),
        "op10_lm_score": lambda spark, d: hmm.op10_lm_score(_table(spark, d, "documents")),
        "op11_filter_audit": lambda spark, d: audit.op11_filter_audit(_table(spark, d, "documents"), _table(spark, d, "labels")),
        "op12_license_scan": lambda spark, d: licences.op12_license_scan(_table(spark, d, "documents")),
        "op13_importance_resampling": lambda spark, d: resampling.op13_importance_resampling(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
        "layouts_to_turns": lambda spark, d: chat.layouts_to_turns(_table(spark, d, "conversations")),
        **{name: lambda spark, d, part=part: part(_table(spark, d, "documents")) for name, (part, _) in beside.QUERIES.items()},
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.OP2_SQL, "op3_quality_rules": quality.OP3_SQL, "op6_sharding": sharding.OP6_SQL, "op7_warc": warc.OP7_SQL, "op8_chat_format": chat.OP8_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_license_scan": licences.OP12_SQL, "op13_importance_resampling": resampling.OP13_SQL, "layouts_to_turns": chat.LAYOUTS_SQL, **{name: sql for name, (_, sql) in beside.QUERIES.items()}}
