"""Nested capture results to long observations and capture-level wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.numbers import currency_unit
from tallywright.functions.text import identity_text
from tallywright.operators.observations import canonical_scope, units_sorted


def to_long(results: DataFrame) -> DataFrame:
    """PR1, PV5, PR2, PR3, FI20: one row per (row, cell) of every capture result; a row without cells gives one row with a null value,
    rows excluded from the table give none. Column fields come from the result's own column list by ordinal, inside the row (no join, no shuffle)."""
    r = results.select("capture_id", "pdf_name", "unit", "columns", F.explode(F.filter("rows", lambda x: ~F.coalesce(x["excluded_from_table_logic"], F.lit(False)))).alias("r"))
    c = r.select("*", F.explode_outer("r.cells").alias("c"))
    head = F.try_element_at(F.filter("columns", lambda x: x["ordinal"] == F.col("c.column_ordinal")), F.lit(1))
    x = c.withColumn("h", head).withColumn("u", F.coalesce("c.unit_original", "unit"))
    return x.select(
        F.col("capture_id").alias("capture_run_id"), "pdf_name", F.col("r.row_order").alias("row_order"), F.col("r.page").alias("page"), F.col("r.row_type").alias("row_type"), F.col("r.row_level").alias("row_level"),
        F.col("r.parent_section").alias("parent_section"), F.col("r.raw_item").alias("raw_item"), F.col("r.normalized_item").alias("normalized_item"), F.col("c.column_ordinal").alias("column_ordinal"),
        F.col("h.header_raw").alias("header_raw"), F.col("h.year").alias("data_year"), canonical_scope(F.col("h.scope")).alias("statement_scope"), F.coalesce("h.restated", F.lit(False)).alias("restated_flag"),
        F.col("h.measure").alias("measure"), F.col("u").alias("unit"), currency_unit(F.col("u")).alias("currency_unit"), F.col("c.raw").alias("value_raw"), F.col("c.parsed_number").alias("value"),
        F.col("c.value_yuan").alias("value_yuan"), F.col("c.cell_role").alias("cell_role"), F.col("r.derived_status").alias("derived_status"), F.col("r.physical_segment_id").alias("physical_segment_id"),
    )


def column_names(columns: DataFrame) -> DataFrame:
    """PR4, PR5: display name of each column: year, scope, measure and restatement mark, else its header; equal names of one capture get their
    ordinal. Columns: capture_id, ordinal, header_raw, data_year, statement_scope, restated."""
    parts = F.concat_ws(" ", F.nullif(identity_text("data_year"), F.lit("")), F.nullif(identity_text("statement_scope"), F.lit("")), F.when(F.col("restated"), "已重述"))
    one = columns.groupBy("capture_id", "ordinal").agg(F.min(F.when(parts != "", parts).otherwise(F.coalesce("header_raw", F.lit("")))).alias("base"))
    n = F.count("*").over(Window.partitionBy("capture_id", "base"))
    return one.withColumn("name", F.when((n > 1) | (F.col("base") == ""), F.concat("base", F.lit("[col"), F.col("ordinal").cast("string"), F.lit("]"))).otherwise(F.col("base")))


def column_issues(columns: DataFrame) -> DataFrame:
    """AG14: per capture: columns, repeated years without scope, columns without a period, equal dimension keys, falling year order broken."""
    one = columns.groupBy("capture_id", "ordinal").agg(F.min("data_year").alias("y"), F.min("statement_scope").alias("s"), F.bool_or(F.coalesce("restated", F.lit(False))).alias("r"))
    year = Window.partitionBy("capture_id", "y")
    key = Window.partitionBy("capture_id", "y", "s", "r")
    order = Window.partitionBy("capture_id").orderBy("ordinal")
    x = one.withColumn("same_year", F.count("*").over(year)).withColumn("same_key", F.count("*").over(key)).withColumn("before", F.lag("y").over(order))
    return x.groupBy("capture_id").agg(
        F.count("*").alias("n_columns"),
        F.count_if(F.col("y").isNotNull() & F.col("s").isNull() & (F.col("same_year") > 1)).alias("year_without_scope"),
        F.count_if(F.col("y").isNull()).alias("missing_period"),
        F.count_if(F.col("y").isNotNull() & (F.col("same_key") > 1)).alias("key_collisions"),
        F.count_if(F.col("before") < F.col("y")).alias("rising_years"),
    )


def capture_wide(long: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    """JO5, PV2: one row per source row with its units and one column per ordinal, in one aggregate; ``n_unlabelled`` counts the values of other ordinals."""
    cells = [F.min_by(F.when(F.col("column_ordinal") == k, F.col("value")), F.when((F.col("column_ordinal") == k) & F.col("value").isNotNull(), F.col("observation_id"))).alias(f"col_{k}") for k in ordinals]
    return long.groupBy("capture_run_id", "row_order").agg(F.min("normalized_item").alias("item"), units_sorted("unit").alias("unit"), F.count_if(F.col("value").isNotNull() & ~F.coalesce(F.col("column_ordinal").isin(*ordinals), F.lit(False))).alias("n_unlabelled"), *cells)


def column_review(values: DataFrame, columns: DataFrame) -> DataFrame:
    """PR29: issues of the final columns of each capture, as codes in order: VALUE_COLUMN_COUNT_MISMATCH (a row with another number of values than there are columns),
    NUMERIC_TOKEN_ORIGIN_AMBIGUOUS (a whole value that reads like a year), PERIOD_COLUMN_SWAP_RISK (years of the columns not falling), LAST_COLUMN_SPARSE (the last column filled in under
    half of the rows). Values: capture_id, row_order, column_ordinal, value, is_derived; derived rows take no part. Columns: capture_id, ordinal, data_year."""
    v = values.where("value IS NOT NULL AND NOT coalesce(is_derived, false)").groupBy("capture_id", "row_order", "column_ordinal").agg(F.max("value").alias("value"))
    one = columns.groupBy("capture_id", "ordinal").agg(F.min("data_year").alias("y"))
    w = Window.partitionBy("capture_id").orderBy("ordinal")
    c = one.withColumn("before", F.lag("y").over(w)).groupBy("capture_id").agg(F.count("*").alias("n_columns"), F.max("ordinal").alias("last"), F.count_if(F.col("before") < F.col("y")).alias("rising"))
    rows = v.groupBy("capture_id", "row_order").agg(F.count("*").alias("n"), F.max(((F.col("value") == F.floor("value")) & F.col("value").between(2000, 2099)).cast("int")).alias("year_like"), F.max("column_ordinal").alias("top"))
    j = rows.join(c, "capture_id").groupBy("capture_id").agg(
        F.max((F.col("n") != F.col("n_columns")).cast("int")).alias("count_off"), F.max("year_like").alias("year_like"), F.max("rising").alias("rising"), (F.count_if(F.col("top") >= F.col("last")) * 2 < F.count("*")).alias("sparse")
    )
    codes = F.array(
        F.when(F.col("count_off") == 1, "VALUE_COLUMN_COUNT_MISMATCH"), F.when(F.col("year_like") == 1, "NUMERIC_TOKEN_ORIGIN_AMBIGUOUS"), F.when(F.col("rising") > 0, "PERIOD_COLUMN_SWAP_RISK"), F.when(F.col("sparse"), "LAST_COLUMN_SPARSE")
    )
    return j.select("capture_id", F.array_join(F.filter(codes, lambda x: x.isNotNull()), "|").alias("issues"))
