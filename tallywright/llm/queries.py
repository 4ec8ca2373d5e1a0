"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import entry_match, leaks, lookalike, mixing, name_groups, reading_level
from tallywright.sources.tables import table


def _comparable(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.comparable_records(table(spark, d, "pdf_assets"), table(spark, d, "table_columns"), table(spark, d, "numeric_tokens"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.equal_looking_pairs(_comparable(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_canonical(_comparable(spark, d)).select("source_field", "record_id", "canonical")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    fields = entry_match.typed_fields(table(spark, d, "captures"), table(spark, d, "table_columns"), table(spark, d, "metric_aliases"), table(spark, d, "header_labels"))
    return entry_match.match_records(*fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("source_field", "record_id", "ref_id")


def p3_misses(spark: SparkSession, d: str) -> DataFrame:
    """Texts that mean no entry, with the number of records."""
    return _matched(spark, d).where(f"ref_id = '{entry_match.UNMATCHED}'").groupBy("source_field", "text").count()


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return name_groups.group_names(table(spark, d, "pdf_assets"), table(spark, d, "captures"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_groups.same_organisation(_grouped(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d)


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p6_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(_leaked(spark, d))


def _report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    filled, _, sized = mixing.plan_mixes(table(spark, d, "documents"), targets)
    return mixing.share_report(filled, sized, targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the filled schedule leaves short."""
    return _report(spark, d).where("reached_tokens < target_tokens").select("mix_id", "source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    filled, blocked, _ = mixing.plan_mixes(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.mixture(filled, blocked)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return reading_level.reading_levels(documents, reading_level.fit_model(documents, table(spark, d, "reading_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p3_found, p3_misses, p4_found, p4_groups, p6_found, p6_removals, p7_found, p7_shares, p7_mixture, p8_found, p8_levels)}
SQL: dict[str, str] = {}
