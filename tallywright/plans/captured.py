"""Registered queries of the capture-level operators, over nested results rebuilt from the flat test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schemas
from tallywright.operators import long_form as lf
from tallywright.operators.observations import latest_delivery
from tallywright.sources.tables import table


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Capture results with columns and cells as arrays, in the stored schema."""
    o = latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")
    cells = o.groupBy(F.col("capture_run_id").alias("capture_id"), "row_order").agg(
        F.min("page").alias("page"), F.min("raw_item").alias("raw_item"), F.min("normalized_item").alias("normalized_item"), F.min("physical_segment_id").alias("physical_segment_id"),
        F.sort_array(F.collect_list(F.struct("column_ordinal", F.col("value").alias("parsed_number"), F.col("unit").alias("unit_original")))).alias("cs"),
    )
    cell = F.transform("cs", lambda c: F.struct(*(c[f.name].alias(f.name) if f.name in ("column_ordinal", "parsed_number", "unit_original") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CELL)))
    known = {"row_order", "page", "raw_item", "normalized_item", "physical_segment_id"}
    row = F.struct(*(F.col(f.name) if f.name in known else cell.alias("cells") if f.name == "cells" else (F.pmod("row_order", F.lit(11)) == 10).alias(f.name) if f.name == "excluded_from_table_logic" else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ROW))
    rows = cells.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("row_order", row.alias("r")))).alias("x")).select("capture_id", F.transform("x", lambda v: v["r"]).alias("rows"))
    t = table(spark, d, "table_columns").groupBy("capture_id", "ordinal").agg(F.min("header_raw").alias("header_raw"), F.min("data_year").alias("year"), F.min("statement_scope").alias("scope"), F.bool_or("restated").alias("restated"))
    column = F.struct(*(F.col(f.name) if f.name in ("ordinal", "header_raw", "year", "scope", "restated") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.COLUMN))
    columns = t.groupBy("capture_id").agg(F.array_sort(F.collect_list(column), lambda a, b: a["ordinal"] - b["ordinal"]).alias("columns"))
    return rows.join(columns, "capture_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast(schemas.CAPTURE_RESULT["columns"].dataType))).withColumn("unit", F.lit("元")).withColumn("pdf_name", F.lit(None).cast("string"))


def capture_long(spark: SparkSession, d: str) -> DataFrame:
    return lf.to_long(_nested(spark, d)).select("capture_run_id", "row_order", "column_ordinal", "value", "unit", "currency_unit", "data_year", "statement_scope", "restated_flag")


def column_names(spark: SparkSession, d: str) -> DataFrame:
    return lf.column_names(table(spark, d, "table_columns"))


def column_issues(spark: SparkSession, d: str) -> DataFrame:
    return lf.column_issues(table(spark, d, "table_columns"))


def capture_wide(spark: SparkSession, d: str) -> DataFrame:
    return lf.capture_wide(latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at"), range(1, 6))


QUERIES = {f.__name__: f for f in (capture_long, column_names, column_issues, capture_wide)}

_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
SQL = {
    "capture_long": f"""WITH {_O}, c AS (SELECT capture_id, ordinal, min(data_year) AS y, min(statement_scope) AS s, bool_or(restated) AS r FROM table_columns GROUP BY 1, 2)
SELECT capture_run_id, row_order, column_ordinal, value, coalesce(unit, '元') AS unit, CASE coalesce(unit, '元') WHEN '元' THEN 'CNY' WHEN '千元' THEN 'CNY_THOUSAND' WHEN '万元' THEN 'CNY_TEN_THOUSAND' WHEN '百万元' THEN 'CNY_MILLION' WHEN '亿元' THEN 'CNY_HUNDRED_MILLION' WHEN '%' THEN 'PERCENT' END AS currency_unit,
 c.y AS data_year, c.s AS statement_scope, coalesce(c.r, false) AS restated_flag FROM o LEFT JOIN c ON c.capture_id = o.capture_run_id AND c.ordinal = o.column_ordinal WHERE o.row_order % 11 <> 10""",
    "column_names": f"""WITH b AS (SELECT capture_id, ordinal, concat_ws(' ', nullif({_ID.format('data_year')}, ''), nullif({_ID.format('statement_scope')}, ''), CASE WHEN restated THEN '已重述' END) AS p, header_raw FROM table_columns),
m AS (SELECT capture_id, ordinal, min(CASE WHEN coalesce(p, '') <> '' THEN p ELSE coalesce(header_raw, '') END) AS base FROM b GROUP BY 1, 2)
SELECT capture_id, ordinal, base, CASE WHEN count(*) OVER (PARTITION BY capture_id, base) > 1 OR base = '' THEN base || '[col' || ordinal || ']' ELSE base END AS name FROM m""",
    "column_issues": """WITH m AS (SELECT capture_id, ordinal, min(data_year) AS y, min(statement_scope) AS s, bool_or(coalesce(restated, false)) AS r FROM table_columns GROUP BY 1, 2),
x AS (SELECT *, count(*) OVER (PARTITION BY capture_id, y) AS sy, count(*) OVER (PARTITION BY capture_id, y, s, r) AS sk, lag(y) OVER (PARTITION BY capture_id ORDER BY ordinal) AS b FROM m)
SELECT capture_id, count(*) AS n_columns, count(*) FILTER (y IS NOT NULL AND s IS NULL AND sy > 1) AS year_without_scope, count(*) FILTER (y IS NULL) AS missing_period, count(*) FILTER (y IS NOT NULL AND sk > 1) AS key_collisions, count(*) FILTER (b < y) AS rising_years FROM x GROUP BY 1""",
    "capture_wide": f"WITH {_O}, w AS (SELECT capture_run_id, row_order, min(normalized_item) AS item, list_sort(list_distinct(list(CASE WHEN {_ID.format('unit')} <> '' THEN {_ID.format('unit')} END))) AS u, " + ", ".join(f"arg_min(value, observation_id) FILTER (column_ordinal = {k} AND value IS NOT NULL) AS col_{k}" for k in range(1, 6)) + ", count(*) FILTER (value IS NOT NULL AND (column_ordinal IS NULL OR column_ordinal NOT BETWEEN 1 AND 5)) AS n_unlabelled FROM o GROUP BY 1, 2) SELECT capture_run_id, row_order, item, coalesce(CASE WHEN len(u) = 0 THEN '' WHEN len(u) = 1 THEN u[1] ELSE 'REVIEW_REQUIRED[' || array_to_string(u, '|') || ']' END, '') AS unit, n_unlabelled, col_1, col_2, col_3, col_4, col_5 FROM w",
}
