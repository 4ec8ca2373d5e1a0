"""Registered queries of metric resolution, ranks, period binding and the smaller row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import notes, periods, text
from tallywright.functions.numbers import UNIT_FACTORS, value_type_adjustment
from tallywright.operators import inbox as ib
from tallywright.operators import observations as ob
from tallywright.operators import registry as rg
from tallywright.operators import resolution as rs
from tallywright.operators import retrieval as rt
from tallywright.operators import sequences as sq
from tallywright.operators import structure as st
from tallywright.plans.scalars import sql_kind, sql_norm, sql_year
from tallywright.sources.tables import table

YEAR = "2020"


def _c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures")


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return ob.latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the observations as candidates for their item: values of all columns, score by how the raw label reads against the item."""
    o = _obs(spark, d).where("row_order IS NOT NULL")
    value = F.struct(F.col("value").alias("parsed"), F.coalesce("period_type", F.lit("")).alias("header"), periods.period_score("data_year").alias("period_score"), F.col("unit").alias("unit"))
    rows = o.groupBy("capture_run_id", "row_order").agg(
        F.min("normalized_item").alias("item"), F.min("raw_item").alias("raw"), F.min("page").alias("page"), F.min("measure").alias("measure"),
        F.transform(F.sort_array(F.collect_list(F.struct("observation_id", value.alias("v")))), lambda x: x["v"]).alias("all"),
    )
    rows = rows.withColumn("values", F.filter("all", lambda v: v["parsed"].isNotNull()))
    kind = F.when(F.col("measure") == "RATIO", "percentage").otherwise("monetary")
    quality = rs.evidence_quality(F.col("values"), kind, F.when(F.col("row_order") >= 5000, "coordinate_rows").otherwise("pdfplumber_table"), F.lit("资产负债表"), F.lit(None).cast("int"))
    n, i = text.normalize_text("raw"), text.normalize_text("item")
    cls = F.when(n == i, 50).when(n.contains(i), 25).otherwise(15)
    score = F.when(cls == 50, 0.985).when(cls == 25, 0.74).otherwise(0.5)
    x = rows.select("capture_run_id", "item", "row_order", "page", "raw", "values", kind.alias("value_type"), quality.alias("quality"), cls.alias("match_class"), score.alias("score"))
    return x.withColumns({"candidate_id": F.concat_ws(":", "capture_run_id", "row_order"), "qualified": text.qualified_variant_penalty(text.normalize_text("raw"), text.normalize_text("item")) < 0, "arbitration": rs.arbitration(F.col("score"), F.col("quality")), "source_quality": rs.source_quality(F.when(F.col("row_order") >= 5000, "coordinate_rows").otherwise("pdfplumber_table")), "n_values": F.size("values")})


def candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """RK3, RK4, SO4: evidence and arbitration of every row."""
    return _candidates(spark, d).select("candidate_id", "match_class", "n_values", "quality", "arbitration")


def metric_picks(spark: SparkSession, d: str) -> DataFrame:
    """RK5, RK7: one row for each item of each capture, with the value type guard on its first unit."""
    c = _candidates(spark, d)
    p = rs.pick(c, ["capture_run_id", "item"])
    unit = c.select("candidate_id", "value_type", F.try_element_at("values", F.lit(1))["unit"].alias("unit"))
    g = rs.value_type_guard(F.col("status"), F.col("value_type"), F.col("unit"))
    return p.join(unit, "candidate_id", "left").select("capture_run_id", "item", "candidate_id", "confidence", "pick_reason", g["status"].alias("status"), g["conflict"].alias("conflict"))


def standard_metrics(spark: SparkSession, d: str) -> DataFrame:
    """RK7 on typed queries (no SQL: difflib ratio)."""
    q = _c(spark, d).where("table_query IS NOT NULL").select(F.col("table_query").alias("input")).distinct()
    m = table(spark, d, "metric_aliases")
    return rs.standard_metric(q, m, ib.metric_candidates(q.withColumnRenamed("input", "query"), rt.search_terms(m)))


def bound_headers(spark: SparkSession, d: str) -> DataFrame:
    """WI11, WI12: headers of the columns of a capture stand in its rows 0 and 39; every row of the structure binds its columns to the nearest of them."""
    t = table(spark, d, "table_columns").groupBy("capture_id", "ordinal").agg(F.min("header_raw").alias("h"))
    cells = t.groupBy("capture_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("h", F.lit("")).alias("h")))), lambda x: x["h"]).alias("cells"))
    heads = cells.select(F.col("capture_id").alias("block_id"), F.explode(F.array(F.lit(0), F.lit(39))).alias("row"), "cells", F.array().cast("array<int>").alias("value_cols"))
    o = _obs(spark, d).where("row_order < 5000").groupBy(F.col("capture_run_id").alias("block_id"), (F.col("row_order") * 3 + 1).alias("row")).agg(F.array_sort(F.collect_set(F.col("column_ordinal") - 1)).alias("value_cols"))
    rows = heads.unionByName(o.select("block_id", "row", F.array(F.lit("")).alias("cells"), F.col("value_cols").cast("array<int>").alias("value_cols")))
    x = rs.snippets(rs.period_headers(rows)).where(F.size("value_cols") > 0)
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k.cast("string"), F.lit("="), F.element_at("headers", k))), "|")
    return x.select("block_id", "row", shown.alias("headers"), F.size("snippet").alias("snippet_rows"))


def certified_ranks(spark: SparkSession, d: str) -> DataFrame:
    """RK19, RK20: segments of live captures ranked against the captures that are ready to merge, over four of their fields."""
    levels = ["company", "document_year", "table_family_id", "batch_id"]
    c = _c(spark, d)
    contexts = c.where("is_trashed = 0").select(F.col("capture_id").alias("context_id"), *levels)
    examples = c.where("merge_ready = 1 AND is_trashed = 1").select(*levels, F.lit("ACCEPT").alias("label"))
    s = table(spark, d, "table_segments").groupBy(F.col("capture_id").alias("context_id"), F.col("segment_id").alias("candidate_id")).agg(F.max(F.when(F.col("confidence") == "HIGH", 0.95).when(F.col("confidence") == "MEDIUM", 0.75).otherwise(0.45)).alias("confidence"))
    return rs.certified_rank(s, contexts, examples, levels)


def template_ranks(spark: SparkSession, d: str) -> DataFrame:
    """RK21, SO12: rows of every capture against one template for each family, its smallest capture (no SQL: difflib ratio)."""
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("normalized_item").alias("i"))
    paths = e.groupBy("capture_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_order", "i"))), lambda x: F.coalesce(x["i"], F.lit(""))).alias("row_paths"))
    c = _c(spark, d).select("capture_id", "company", F.col("table_family_id").alias("table_id")).join(paths, "capture_id")
    templates = c.where("table_id IS NOT NULL").groupBy("table_id").agg(F.min_by(F.struct("capture_id", "company", "row_paths"), "capture_id").alias("m")).select(F.col("m.capture_id").alias("template_id"), "m.company", "table_id", "m.row_paths")
    return rs.template_rank(c.withColumnRenamed("capture_id", "query_id"), templates)


def template_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d).select("company", "table_family_id", F.col("lifecycle_status").alias("status"), F.col("merge_ready").alias("success_count"), F.col("is_trashed").alias("rejection_count"))
    return rs.template_stats(c, ["company", "table_family_id"])


def tiered_children(spark: SparkSession, d: str) -> DataFrame:
    """RK12: segments of a pdf by the tier of their confidence, HIGH first, scored by page."""
    s = table(spark, d, "table_segments").where("pdf_id IS NOT NULL").select("pdf_id", F.when(F.col("confidence") == "HIGH", 1).when(F.col("confidence") == "MEDIUM", 2).otherwise(3).alias("tier"), F.col("segment_id").alias("candidate_id"), (1000.0 - F.coalesce("pdf_page_number", F.lit(0))).alias("score"))
    return rs.tiered(s, ["pdf_id"]).select("pdf_id", "tier", "candidate_id", "place")


def full_anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    """RK9: every capture as an anchor; its segments are the children, those of high confidence carry note references."""
    c = _c(spark, d)
    s = table(spark, d, "table_segments").groupBy("capture_id").agg(F.count("*").alias("n_children"), F.count_if(F.col("confidence") == "HIGH").alias("note_rows"), F.count_if(F.col("unit") != "").alias("value_rows"), F.max("unit").alias("unit"))
    y = table(spark, d, "table_columns").groupBy("capture_id").agg(F.countDistinct("data_year").alias("n_periods"), F.max("statement_scope").alias("scope"))
    j = c.join(s, "capture_id", "left").join(y, "capture_id", "left").withColumns(
        {
            "wanted_scope": F.when(F.col("merge_ready") == 1, "CONSOLIDATED"), "statement_type": F.when(F.col("note_number").isNotNull(), "NOTE_SECTION").otherwise("BALANCE_SHEET"), "title": F.col("table_query"), "parent_text": F.col("table_query"),
            "display_name": F.col("table_query"), "valid_notes": F.col("note_rows"), "formal_region": F.col("boundary_status") == "COMPLETE", "summary_page": F.col("is_trashed") == 1, "period_header": F.col("header_dimension_status") == "OK",
            "columns_aligned": F.col("header_dimension_status") == "OK", "history": F.col("merge_ready") == 1, "definition": F.col("table_family_id").isNotNull(), "ocr_only": F.col("boundary_status") == "UNCERTAIN", "bbox_verified": F.lit(None).cast("boolean"),
        }
    )
    s_ = rt.anchor_score()
    return j.select("capture_id", s_["score"].alias("score"), s_["passed"].alias("passed"), s_["failed"].alias("failed"), s_["tier"].alias("tier"))


def taxonomy_queue(spark: SparkSession, d: str) -> DataFrame:
    """AG10, JO25: mapping queue with a taxonomy that lists the keys of the rulebook's names and of items that hold 合计."""
    o = _obs(spark, d).withColumn("normalized_item", F.trim(F.coalesce("normalized_item", F.lit("")))).withColumn("parent_section", F.coalesce("table_family", F.lit("")))
    names = table(spark, d, "metric_aliases").select(F.concat(F.lit("UNIQUE||"), "canonical_name").alias("source_key"), F.lit("RULEBOOK").alias("canonical_section"), F.col("canonical_name").alias("canonical_item"), F.lit("METRIC").alias("category"))
    items = o.where(F.col("normalized_item").contains("合计")).select(F.concat(F.lit("UNIQUE||"), "normalized_item").alias("source_key"), F.lit("TOTALS").alias("canonical_section"), F.lit("合计").alias("canonical_item"), F.lit("TOTAL").alias("category")).distinct()
    return ob.mapping_queue(o, ob.source_keys(o), names.unionByName(items)).select("row_key", "companies", "canonical_section", "canonical_item", "category", "mapping_status")


def reference_year_order(spark: SparkSession, d: str) -> DataFrame:
    """HI5: items of each family by the notes of the captures of one year; a capture's query is its member."""
    c = _c(spark, d).where("table_family_id IS NOT NULL")
    sources = c.select(F.col("table_family_id").alias("table_id"), F.col("capture_id").alias("source"), periods.absolute_year("document_year").alias("document_year"), F.col("table_query").alias("member"), F.length("table_query").alias("member_order"), notes.note_ordinal("note_number").alias("note_ordinal"), (F.col("merge_ready") == 1).alias("is_reference"))
    e = table(spark, d, "structure_edges").groupBy(F.col("capture_id").alias("source"), "row_order").agg(F.min("normalized_item").alias("key"))
    rows = e.join(sources.select("table_id", "source", "member"), "source")
    return sq.reference_year_order(rows, sources, YEAR)


def latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    """WI3: captures of one pdf and family as attempts; each reruns the one created before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("pdf_id", "table_family_id").orderBy("created_at", "capture_id")
    jobs = _c(spark, d).where("pdf_id IS NOT NULL AND table_family_id IS NOT NULL").select(
        "pdf_id", "table_family_id", F.col("capture_id").alias("job_id"), F.lag("capture_id").over(w).alias("rerun_of"), F.when(F.col("boundary_status") == "COMPLETE", "SUCCESS").otherwise("FAILED").alias("status"), "merge_ready", F.col("created_at").alias("at")
    )
    return ib.latest_attempts(jobs, ["pdf_id", "table_family_id"])


def semantic_tree(spark: SparkSession, d: str) -> DataFrame:
    """HI3, RE5: roles and parents of the structure rows and the sums they suggest."""
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("row_path").alias("p"), F.min("normalized_item").alias("raw_item"))
    has = _obs(spark, d).where("value IS NOT NULL").select(F.col("capture_run_id").alias("capture_id"), "row_order", F.lit(True).alias("h")).distinct()
    rows = e.join(has, ["capture_id", "row_order"], "left").select("capture_id", "row_order", st.level_of(F.col("p")).alias("row_level"), "raw_item", F.lit("").alias("row_type"), F.coalesce("h", F.lit(False)).alias("has_value"))
    tree = ib.semantic_rows(rows)
    return tree.join(ib.sum_relations(tree), ["capture_id", "row_order"], "left").select("capture_id", "row_order", "row_id", "row_role", "parent_row_order", "relationship", "n_children")


def repaired_periods(spark: SparkSession, d: str) -> DataFrame:
    """PR11: column labels as stored periods, repaired with the year of their capture."""
    t = table(spark, d, "table_columns").select("column_id", F.col("capture_id").alias("capture_run_id"), F.lit(None).cast("string").alias("document_year"), F.col("header_raw").alias("data_year"))
    return ib.repaired_periods(t, _c(spark, d).select(F.col("capture_id").alias("capture_run_id"), "document_year")).select("column_id", "document_year", "data_year")


def capture_metadata(spark: SparkSession, d: str) -> DataFrame:
    return ib.capture_metadata(_c(spark, d), table(spark, d, "table_columns"))


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """FI32, FI38: captures of a batch in order of creation, and the live ones of each family in order of their notes."""
    c = _c(spark, d)
    s = ib.ordered_sources(c.where("batch_id IS NOT NULL").select(F.col("batch_id").alias("merge_id"), F.col("created_at").alias("source_order"), "capture_id")).select(F.lit("MERGE").alias("part"), F.col("merge_id").alias("group_id"), "place", F.col("capture_id").alias("id"))
    m = ib.active_members(c.where("table_family_id IS NOT NULL").select(F.col("table_family_id").alias("family_id"), F.col("capture_id").alias("member_id"), F.col("lifecycle_status").alias("status"), notes.note_ordinal("note_number").alias("canonical_order")))
    return s.unionByName(m.select(F.lit("FAMILY").alias("part"), F.col("family_id").alias("group_id"), "place", F.col("member_id").alias("id")))


def fn_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN33, FN49, FN21-FN24 of titles and scopes, FN47: keys and predicates on captures."""
    k = notes.note_reference_key("note_number")
    key = text.page_cache_key(F.lit("auto"), F.coalesce("producer_version", F.lit("-")), F.lit(200), F.lit(0.6), F.col("merge_ready"), F.array(F.lit(12), F.lit(3)))
    return _c(spark, d).select(
        "capture_id", k["normalized"].alias("normalized"), k["section"].alias("section"), k["item"].alias("item"), key.alias("cache_key"), text.title_compatible("table_query", F.lit("保险合同负债")).alias("title_ok"),
        text.scope_compatible(F.col("header_dimension_status"), F.lit("OK")).alias("scope_ok"), text.list_to_json(F.array("batch_id", "capture_id")).alias("listed"), F.element_at(text.json_to_list(text.list_to_json(F.array("batch_id", "capture_id"))), 2).alias("second"),
    )


def fn_labels(spark: SparkSession, d: str) -> DataFrame:
    """FN20, FN40, FN44, FN50, FN51, FN57 on titles and queries."""
    c = _c(spark, d)
    return c.select(
        "capture_id", text.classify_non_data_text("table_query", F.lit(0), F.lit(2)).alias("non_data"), text.review_reason(F.concat_ws(":", "boundary_status", "header_dimension_status")).alias("reason"), text.download_name("pdf_name", "csv").alias("file"),
        ib.company_key("company").alias("company_key"), text.printed_page("document_year").alias("page"),
    )


def fn_values(spark: SparkSession, d: str) -> DataFrame:
    """FN16, FN39, FN40, FN41 on readings and observations."""
    from tallywright.functions.numbers import values_close, whole_amount

    n = table(spark, d, "numeric_tokens").select("token_id", F.array_join("raw_numeric_tokens", "").alias("raw"), "parsed_decimal_value")
    regime = F.when(F.col("parsed_decimal_value") > 1000, text.REGIMES[1]).otherwise(text.REGIMES[0])
    return n.select(
        "token_id", whole_amount("raw").alias("whole"), values_close(F.col("parsed_decimal_value"), F.round("parsed_decimal_value", -2), F.lit("元"), F.lit(3), F.lit(True)).alias("close"),
        text.member_period_status(regime, F.lit(text.REGIMES[2]), F.col("raw"), F.col("parsed_decimal_value") < 0).alias("status"), value_type_adjustment(F.lit("percentage"), F.array(F.when(F.col("raw").contains("%"), "%").otherwise("元"))).alias("typed"),
    )


def page_contexts(spark: SparkSession, d: str) -> DataFrame:
    """JO29: currency declared on a page or inherited from the page right before."""
    c = table(spark, d, "document_contexts").groupBy("pdf_id", "page").agg(F.max("currency").alias("currency"))
    return sq.page_context(c, "currency").select("pdf_id", "page", "inherited")


def united_rows(spark: SparkSession, d: str) -> DataFrame:
    """SE1, SE2, FI5, FI6, PR16: observations of two families with family identity and different columns united; rows of notes leave as noise."""
    o = _obs(spark, d).select("observation_id", "table_family", "row_order", "row_path", "normalized_item", "value")
    a = ib.with_family(o.where("table_family = '投资资产'"), "INVEST", "投资", "投资资产表")
    b = o.where("table_family = '保险合同'").drop("row_path")
    both = ob.union_captures([a, b.withColumnRenamed("value", "value")])
    official, excluded = ib.move_noise(both, both.limit(0), both.where("row_order >= 5000").select("observation_id"), ["observation_id"])
    return official.withColumn("reason", F.lit(None).cast("string")).unionByName(excluded, allowMissingColumns=True).select("observation_id", "table_family", "member_table", "row_path", "reason")


def effective_years(spark: SparkSession, d: str) -> DataFrame:
    """PR21, PR25, PR26: year of a value from its own header, else from its document."""
    o = _obs(spark, d).select("observation_id", F.col("data_year").alias("value_year"), "document_year", "company")
    return ib.batch_long(o).select("observation_id", "effective_year", "year_source", "company")


def merged_rules(spark: SparkSession, d: str) -> DataFrame:
    """SE9, SE10, GV17, GV21: aliases of the rulebook united with the soft ones as a second rule table that lacks every other metric's hint."""
    m = table(spark, d, "metric_aliases")
    b = m.select("metric_id", F.col("soft_aliases").alias("aliases"), F.lit("middle").alias("position_hint"))
    return rg.merge_lists(m.select("metric_id", "aliases", "position_hint"), b, ["metric_id"], ["aliases"], ["position_hint"]).select("metric_id", F.array_join("aliases", "|").alias("aliases"), "position_hint")


def given_order(spark: SparkSession, d: str) -> DataFrame:
    """FI12: assets of every capture in the order of the captures."""
    ids = _c(spark, d).where("pdf_id IS NOT NULL").select(F.col("pdf_id").alias("id"), F.col("capture_id").alias("pos"))
    return rg.in_given_order(table(spark, d, "pdf_assets").select("pdf_id", "filename"), "pdf_id", ids).select("pos", "pdf_id", "filename")


def primary_values(spark: SparkSession, d: str) -> DataFrame:
    """RK6: the value of every row for its document's year."""
    o = _obs(spark, d).where("value IS NOT NULL AND row_order IS NOT NULL")
    v = F.struct(F.col("data_year").alias("year"), F.coalesce(periods.period_score("data_year"), F.lit(0.0)).alias("period_score"), F.col("column_ordinal").alias("column_index"), "value")
    g = o.groupBy("capture_run_id", "row_order").agg(F.transform(F.sort_array(F.collect_list(F.struct("column_ordinal", "observation_id", v.alias("v")))), lambda x: x["v"]).alias("vs"), F.min("document_year").alias("y"))
    return g.select("capture_run_id", "row_order", rt.choose_primary(F.col("vs"), periods.absolute_year("y"))["value"].alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        candidate_evidence, metric_picks, standard_metrics, bound_headers, certified_ranks, template_ranks, template_stats, tiered_children, full_anchor_scores, taxonomy_queue, reference_year_order, latest_attempts, semantic_tree,
        repaired_periods, capture_metadata, merge_sources, fn_keys, fn_labels, fn_values, page_contexts, united_rows, effective_years, merged_rules, given_order, primary_values,
    )
}

_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_UNITS = ", ".join(f"'{u}'" for u in UNIT_FACTORS)
_SCORE = rf"coalesce((list_max(list_transform(regexp_extract_all(coalesce(data_year, ''), '(20\d{{2}})', 1), lambda y: y::INT)) - 2000)::DOUBLE, 0.0) + CASE WHEN regexp_matches({sql_norm('data_year')}, '本期|本年|期末|年末|本报告期') THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches({sql_norm('data_year')}, '上期|上年|期初|年初') THEN 0.15 ELSE 0 END"
_QUALIFIED = " OR ".join(f"(contains(nr, '{q}') AND NOT contains(ni, '{q}'))" for q in text.QUALIFIERS)
_CAND = f"""{_O}, v AS (SELECT *, {_SCORE} AS ps FROM o WHERE row_order IS NOT NULL),
g AS (SELECT capture_run_id, row_order, min(normalized_item) AS item, min(raw_item) AS raw, min(page) AS page, min(measure) AS measure, count(value) AS n, count(*) FILTER (value IS NOT NULL AND trim(coalesce(period_type, '')) <> '') AS nh,
 count(*) FILTER (value IS NOT NULL AND ps >= 0.7) AS ns, count(*) FILTER (value IS NOT NULL AND trim(coalesce(unit, '')) <> '') AS nu, count(*) FILTER (value IS NOT NULL AND unit = '%') AS np, count(*) FILTER (value IS NOT NULL AND unit IN ({_UNITS})) AS nm,
 (list(unit ORDER BY observation_id) FILTER (value IS NOT NULL))[1] AS unit FROM v GROUP BY 1, 2),
h AS (SELECT *, capture_run_id || ':' || row_order AS candidate_id, {sql_norm('raw')} AS nr, {sql_norm('item')} AS ni, CASE WHEN row_order >= 5000 THEN 0.70 ELSE 1.0 END::DOUBLE AS sq, CASE WHEN measure = 'RATIO' THEN 'percentage' ELSE 'monetary' END AS vt FROM g),
q AS (SELECT *, CASE WHEN nr = ni THEN 50 WHEN contains(nr, ni) THEN 25 ELSE 15 END AS cls, round(least(1.0::DOUBLE, CASE WHEN n > 0 THEN 0.2::DOUBLE + 0.08::DOUBLE + 0.1::DOUBLE * nh / n + 0.1::DOUBLE * ns / n + 0.1::DOUBLE * nu / n + 0.15::DOUBLE * CASE WHEN vt = 'percentage' THEN np ELSE nm END / n ELSE 0 END + 0.12::DOUBLE * sq + 0.05::DOUBLE + CASE WHEN nh > 0 THEN 0.04 ELSE 0 END::DOUBLE), 6) AS quality FROM h),
c AS (SELECT *, CASE cls WHEN 50 THEN 0.985 WHEN 25 THEN 0.74 ELSE 0.5 END::DOUBLE AS score, cls <> 99 AND ({_QUALIFIED}) AS qualified FROM q), cand AS (SELECT *, round(0.72::DOUBLE * score + 0.28::DOUBLE * quality, 6) AS arb FROM c)"""
_NUM = r"""CASE WHEN regexp_matches({x}, '^\d+$') THEN try_cast({x} AS INT) WHEN contains({x}, '十') THEN (CASE WHEN split_part({x}, '十', 1) = '' THEN 1 ELSE coalesce(try_cast(translate(split_part({x}, '十', 1), '零〇一二三四五六七八九', '00123456789') AS INT), 1) END) * 10
 + (CASE WHEN split_part({x}, '十', 2) = '' THEN 0 ELSE coalesce(try_cast(translate(split_part({x}, '十', 2), '零〇一二三四五六七八九', '00123456789') AS INT), 0) END) WHEN {x} IS NOT NULL THEN try_cast(translate({x}, '零〇一二三四五六七八九', '00123456789') AS INT) END"""
_ORD = _NUM.format(x=r"list_extract(regexp_extract_all(regexp_extract(trim(coalesce(note_number, '')), '([^-—–/]*)$', 1), '(\d{1,3}|[零〇一二三四五六七八九十百]{1,5})', 1), -1)")
_SK = """first AS (SELECT capture_run_id, row_order, trim(coalesce(arg_min(normalized_item, observation_id), '')) AS normalized_item, coalesce(arg_min_null(row_path, observation_id), '') AS row_path FROM o WHERE row_order IS NOT NULL GROUP BY 1, 2),
nk AS (SELECT *, count(*) OVER (PARTITION BY capture_run_id, normalized_item) AS n, row_number() OVER (PARTITION BY capture_run_id, normalized_item ORDER BY row_order) AS k FROM first),
keys AS (SELECT capture_run_id, row_order, normalized_item, CASE WHEN normalized_item = '' THEN 'LEGACY||' WHEN n = 1 THEN 'UNIQUE||' || normalized_item ELSE 'CONTEXT_PATH||' || normalized_item || '||' || row_path || '||OCC' || k END AS row_key FROM nk),
keyed AS (SELECT o.*, keys.row_key FROM o JOIN keys ON keys.capture_run_id = o.capture_run_id AND keys.row_order = o.row_order AND keys.normalized_item = trim(coalesce(o.normalized_item, '')) WHERE value IS NOT NULL)"""
_NI = "regexp_replace(trim(coalesce(raw_item, '')), '\\s+', '', 'g')"
_ROLE = f"""CASE WHEN trim(coalesce(raw_item, '')) = '' AND has_value THEN 'ANONYMOUS_NUMERIC_ROW' WHEN regexp_matches({_NI}, '注：|说明|其中：') THEN CASE WHEN has_value THEN 'NOTE_TEXT' ELSE 'MEMO_TEXT' END
 WHEN {_NI} IN ('总计', '总额') OR {_NI} LIKE '%合计' THEN 'TOTAL' WHEN regexp_matches({_NI}, '^(小计|其中|减：|加：)') THEN CASE WHEN contains({_NI}, '计') THEN 'SUBTOTAL' ELSE 'ADJUSTMENT' END WHEN {_NI} LIKE '减%' OR contains({_NI}, '减：') THEN 'ADJUSTMENT'
 WHEN contains({_NI}, '净额') OR {_NI} LIKE '净%' THEN 'NET_VALUE' WHEN contains({_NI}, '原值') OR contains({_NI}, '账面余额') THEN 'GROSS_VALUE' WHEN NOT has_value AND trim(coalesce(raw_item, '')) LIKE '%：' THEN 'SECTION' ELSE 'DETAIL' END"""
_HEAD = r"CASE WHEN lower(trim(regexp_replace(coalesce({0}, ''), '[\s\x{{3000}}]+', ' ', 'g'))) = 'none' THEN '' ELSE trim(regexp_replace(coalesce({0}, ''), '[\s\x{{3000}}]+', ' ', 'g')) END"
_IS_PERIOD = rf"(x <> '' AND (regexp_matches(x, '20\d{{2}}') OR regexp_matches({sql_norm('x')}, '{'|'.join(periods.HEADER_WORDS)}')))"
_REASONS = " ".join(f"WHEN regexp_matches(t, '{k}') THEN '{v}'" for k, v in text.REASON_RULES.items())
SQL: dict[str, str] = {
    "candidate_evidence": f"WITH {_CAND} SELECT candidate_id, cls AS match_class, n AS n_values, quality, arb AS arbitration FROM cand",
    "metric_picks": f"""WITH {_CAND}, f AS (SELECT *, max((cls IN (50, 45) AND n > 0)::INT) OVER w AS ex, max((cls IN (50, 45) AND n = 0)::INT) OVER w AS bare, max(CASE WHEN cls IN (50, 45) THEN score END) OVER w AS es FROM cand WINDOW w AS (PARTITION BY capture_run_id, item)),
i AS (SELECT *, n > 0 AND (cls IN (50, 45) OR ex = 0) AS inn FROM f),
r AS (SELECT *, row_number() OVER w AS place, lead(CASE WHEN inn THEN arb END) OVER w AS nx FROM i WINDOW w AS (PARTITION BY capture_run_id, item ORDER BY inn DESC, cls DESC, quality DESC, arb DESC, sq DESC, n > 0 DESC, score DESC, n DESC, page NULLS FIRST, candidate_id)),
d AS (SELECT *, CASE WHEN ex = 1 THEN 'EXACT_LABEL' WHEN bare = 1 THEN 'EXACT_LABEL_WITHOUT_NUMBER' WHEN NOT inn THEN 'NO_NUMERIC_CANDIDATE' WHEN qualified THEN 'QUALIFIED_VARIANT' WHEN arb >= 0.86 THEN 'HIGH_SCORE' WHEN arb >= 0.72 AND round(arb - coalesce(nx, 0), 9) >= 0.1 THEN 'MEDIUM_SCORE_WITH_MARGIN' ELSE 'AMBIGUOUS' END AS pick_reason FROM r WHERE place = 1),
e AS (SELECT *, pick_reason IN ('EXACT_LABEL', 'HIGH_SCORE', 'MEDIUM_SCORE_WITH_MARGIN') AS chosen FROM d), z AS (SELECT *, chosen AND ((vt = 'percentage' AND unit IN ({_UNITS})) OR (vt = 'monetary' AND unit = '%')) AS bad FROM e)
SELECT capture_run_id, item, CASE WHEN chosen THEN candidate_id END AS candidate_id, CASE pick_reason WHEN 'EXACT_LABEL_WITHOUT_NUMBER' THEN es WHEN 'NO_NUMERIC_CANDIDATE' THEN score ELSE arb END AS confidence, pick_reason,
 CASE WHEN chosen AND NOT coalesce(bad, false) THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN bad THEN 'VALUE_TYPE_CONFLICT' END AS conflict FROM z""",
    "bound_headers": f"""WITH {_O}, t AS (SELECT capture_id, ordinal, min(header_raw) AS h FROM table_columns GROUP BY 1, 2), u AS (SELECT capture_id AS block_id, row_number() OVER (PARTITION BY capture_id ORDER BY ordinal) - 1 AS col, {_HEAD.format('h')} AS x FROM t),
hp AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY col) AS j, count(*) OVER (PARTITION BY block_id) AS nh FROM u WHERE {_IS_PERIOD}),
rw AS (SELECT capture_run_id AS block_id, row_order * 3 + 1 AS row, column_ordinal - 1 AS vc FROM o WHERE row_order < 5000 AND column_ordinal IS NOT NULL GROUP BY 1, 2, 3),
vs AS (SELECT *, row_number() OVER (PARTITION BY block_id, row ORDER BY vc) AS i, count(*) OVER (PARTITION BY block_id, row) AS nv FROM rw), rr AS (SELECT DISTINCT block_id, row, nv FROM vs),
near AS (SELECT rr.*, (SELECT max(nh) FROM hp WHERE hp.block_id = rr.block_id AND rr.row <= 89) AS nh FROM rr),
direct AS (SELECT v.block_id, v.row, v.vc, hp.x FROM vs v JOIN near n USING (block_id, row) JOIN hp ON hp.block_id = v.block_id AND hp.col = v.vc WHERE n.nh IS NOT NULL AND n.nh <> n.nv),
oc AS (SELECT v.block_id, v.row, v.vc, row_number() OVER (PARTITION BY v.block_id, v.row ORDER BY v.vc) AS k FROM vs v JOIN near n USING (block_id, row) LEFT JOIN direct d USING (block_id, row, vc) WHERE n.nh IS NOT NULL AND n.nh <> n.nv AND d.vc IS NULL),
ot AS (SELECT n.block_id, n.row, hp.x, row_number() OVER (PARTITION BY n.block_id, n.row ORDER BY hp.col) AS k FROM near n JOIN hp USING (block_id) WHERE n.nh <> n.nv AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.block_id = n.block_id AND d.row = n.row AND d.x = hp.x)),
b AS (SELECT v.block_id, v.row, v.vc, hp.x FROM vs v JOIN near n USING (block_id, row) JOIN hp ON hp.block_id = v.block_id AND hp.j = v.i WHERE n.nh = n.nv UNION ALL SELECT * FROM direct UNION ALL SELECT oc.block_id, oc.row, oc.vc, ot.x FROM oc JOIN ot USING (block_id, row, k)),
al AS (SELECT DISTINCT block_id, 0 AS row FROM u UNION ALL SELECT DISTINCT block_id, 39 FROM u UNION ALL SELECT block_id, row FROM rr),
sn AS (SELECT *, 1 + (lag(row) OVER w IS NOT NULL)::INT + (lead(row) OVER w IS NOT NULL)::INT AS snippet_rows FROM al WINDOW w AS (PARTITION BY block_id ORDER BY row))
SELECT rr.block_id, rr.row, coalesce(string_agg(b.vc || '=' || b.x, '|' ORDER BY b.vc), '') AS headers, any_value(sn.snippet_rows) AS snippet_rows FROM rr LEFT JOIN b USING (block_id, row) JOIN sn USING (block_id, row) GROUP BY 1, 2""",
    "certified_ranks": """WITH x AS (SELECT DISTINCT company, document_year, table_family_id, batch_id FROM captures WHERE merge_ready = 1 AND is_trashed = 1),
m AS (SELECT c.capture_id, coalesce(max(coalesce((c.company = x.company AND c.company <> '')::INT, 0) + coalesce((c.document_year = x.document_year AND c.document_year <> '')::INT, 0) + coalesce((c.table_family_id = x.table_family_id AND c.table_family_id <> '')::INT, 0) + coalesce((c.batch_id = x.batch_id AND c.batch_id <> '')::INT, 0)), 0) AS matched FROM captures c LEFT JOIN x ON true WHERE c.is_trashed = 0 GROUP BY 1),
s AS (SELECT capture_id, segment_id, max(CASE confidence WHEN 'HIGH' THEN 0.95 WHEN 'MEDIUM' THEN 0.75 ELSE 0.45 END)::DOUBLE AS cf FROM table_segments GROUP BY 1, 2),
r AS (SELECT capture_id AS context_id, segment_id AS candidate_id, round(least(1.0::DOUBLE, cf * 0.75::DOUBLE + matched / 4.0::DOUBLE * 0.25::DOUBLE), 9) AS rank_score FROM s JOIN m USING (capture_id)), p AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY rank_score DESC, candidate_id) AS place FROM r)
SELECT *, CASE WHEN place > 1 THEN 'CANDIDATE' WHEN rank_score >= 0.7 THEN 'RANKED' ELSE 'ABSTAIN' END AS status FROM p""",
    "template_stats": "SELECT company, table_family_id, sum(CASE WHEN lifecycle_status = 'ACTIVE' THEN merge_ready ELSE 0 END)::BIGINT AS accepted, sum(is_trashed)::BIGINT AS rejected, count(*) AS templates FROM captures GROUP BY 1, 2",
    "tiered_children": """WITH s AS (SELECT pdf_id, segment_id AS candidate_id, min((CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, -(1000.0 - coalesce(pdf_page_number, 0)))) AS m FROM table_segments WHERE pdf_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT pdf_id, m[1] AS tier, candidate_id, row_number() OVER (PARTITION BY pdf_id, m[1] ORDER BY m[2], candidate_id) AS place FROM s) SELECT * FROM r WHERE place <= CASE tier WHEN 1 THEN 3 ELSE 8 END""",
    "taxonomy_queue": f"""WITH {_O}, {_SK}, tx AS (SELECT 'UNIQUE||' || canonical_name AS row_key, ('RULEBOOK', canonical_name, 'METRIC') AS t FROM metric_aliases UNION ALL SELECT DISTINCT 'UNIQUE||' || trim(normalized_item), ('TOTALS', '合计', 'TOTAL') FROM o WHERE contains(normalized_item, '合计')),
tt AS (SELECT row_key, min(t) AS t FROM tx GROUP BY 1), g AS (SELECT row_key, count(DISTINCT capture_run_id) AS cc, coalesce(string_agg(DISTINCT company, ' | ' ORDER BY company) FILTER (trim(company) <> ''), '') AS companies, arg_min(coalesce(table_family, ''), observation_id) AS sec, arg_min(trim(coalesce(normalized_item, '')), observation_id) AS item FROM keyed GROUP BY 1)
SELECT g.row_key, companies, coalesce(t[1], sec) AS canonical_section, coalesce(t[2], item) AS canonical_item, coalesce(t[3], '') AS category, CASE WHEN t IS NOT NULL THEN 'AUTO_TAXONOMY' WHEN cc >= 2 THEN 'AUTO_EXACT_IDENTITY' ELSE 'UNMAPPED_PRESERVED' END AS mapping_status FROM g LEFT JOIN tt USING (row_key)""",
    "reference_year_order": f"""WITH s AS (SELECT table_family_id AS table_id, capture_id AS source, {sql_year('document_year')} AS y, table_query AS member, length(table_query) AS mo, {_ORD} AS no, merge_ready = 1 AS rf FROM captures WHERE table_family_id IS NOT NULL),
e AS (SELECT capture_id AS source, row_order, min(normalized_item) AS key FROM structure_edges GROUP BY 1, 2), hint AS (SELECT table_id, member, min(no) AS no, min(mo) AS mo FROM s WHERE y = '{YEAR}' GROUP BY 1, 2),
p AS (SELECT table_id, key, min(member) AS member, coalesce(min(row_order) FILTER (y = '{YEAR}'), 1000000000) AS a, coalesce(min(row_order) FILTER (rf), 1000000000) AS b, min(row_order) AS c FROM e JOIN s USING (source) WHERE key IS NOT NULL AND trim(member) <> '' GROUP BY 1, 2)
SELECT p.table_id, p.key, row_number() OVER (PARTITION BY p.table_id ORDER BY no NULLS LAST, coalesce(mo, 0), member, a, b, c, key) AS base_order, no AS note_ordinal FROM p LEFT JOIN hint USING (table_id, member) WHERE p.table_id IN (SELECT table_id FROM s WHERE y = '{YEAR}')""",
    "latest_attempts": """WITH j AS (SELECT pdf_id, table_family_id, capture_id AS job_id, lag(capture_id) OVER w AS rerun_of, CASE WHEN boundary_status = 'COMPLETE' THEN 'SUCCESS' ELSE 'FAILED' END AS status, merge_ready, created_at AS t FROM captures WHERE pdf_id IS NOT NULL AND table_family_id IS NOT NULL WINDOW w AS (PARTITION BY pdf_id, table_family_id ORDER BY created_at, capture_id)),
l AS (SELECT *, rerun_of IS NOT NULL AND NOT coalesce(status = 'SUCCESS' AND merge_ready = 1, false) AS bad FROM j WHERE job_id NOT IN (SELECT rerun_of FROM j WHERE rerun_of IS NOT NULL AND status = 'SUCCESS' AND merge_ready = 1)),
c AS (SELECT pdf_id, table_family_id, job_id, status FROM l QUALIFY row_number() OVER (PARTITION BY pdf_id, table_family_id ORDER BY bad, t DESC NULLS LAST, job_id DESC) = 1)
SELECT c.*, h.attempts, h.history FROM c JOIN (SELECT pdf_id, table_family_id, count(*) AS attempts, string_agg(status, '>' ORDER BY t NULLS FIRST, job_id) AS history FROM j GROUP BY 1, 2) h USING (pdf_id, table_family_id)""",
    "semantic_tree": f"""WITH {_O}, e AS (SELECT capture_id, row_order, min(row_path) AS p, min(normalized_item) AS raw_item FROM structure_edges GROUP BY 1, 2), hv AS (SELECT DISTINCT capture_run_id AS capture_id, row_order FROM o WHERE value IS NOT NULL),
x AS (SELECT e.*, coalesce(len(string_split(p, ' / ')) - 1, 0) AS level, hv.row_order IS NOT NULL AS has_value FROM e LEFT JOIN hv USING (capture_id, row_order)), r AS (SELECT *, {_ROLE} AS row_role FROM x), r2 AS (SELECT *, NOT (row_role IN ('SECTION', 'DETAIL') AND coalesce(raw_item, '') <> '') AS closed FROM r),
par AS (SELECT c.*, (SELECT max(p.row_order) FROM r2 p WHERE p.capture_id = c.capture_id AND p.row_order < c.row_order AND p.level < c.level AND NOT p.closed AND NOT EXISTS (SELECT 1 FROM r2 q WHERE q.capture_id = c.capture_id AND q.row_order > p.row_order AND q.row_order < c.row_order AND q.level <= p.level)) AS parent_row_order FROM r2 c),
k AS (SELECT capture_id, parent_row_order AS row_order, count(*) AS n FROM par WHERE has_value AND parent_row_order IS NOT NULL GROUP BY 1, 2)
SELECT par.capture_id, par.row_order, 'ROW_' || substr(sha256(par.capture_id || chr(31) || par.row_order), 1, 20) AS row_id, row_role, parent_row_order, CASE WHEN k.n IS NOT NULL AND row_role IN ('TOTAL', 'NET_VALUE') THEN CASE row_role WHEN 'NET_VALUE' THEN 'GROSS_MINUS_ADJUSTMENT' ELSE 'SUM_CHILDREN' END END AS relationship,
 CASE WHEN row_role IN ('TOTAL', 'NET_VALUE') THEN k.n END AS n_children FROM par LEFT JOIN k USING (capture_id, row_order)""",
    "repaired_periods": f"""WITH y AS (SELECT capture_id, min({sql_year('document_year')}) AS doc FROM captures GROUP BY 1) SELECT column_id, doc AS document_year, coalesce({sql_year('header_raw')}, CASE WHEN doc IS NOT NULL THEN CASE {sql_kind('header_raw')} WHEN 'CURRENT' THEN doc WHEN 'PRIOR' THEN (doc::INT - 1)::VARCHAR END END, header_raw) AS data_year FROM table_columns LEFT JOIN y USING (capture_id)""",
    "capture_metadata": rf"""WITH l AS (SELECT capture_id, max(greatest(list_max(regexp_extract_all(coalesce(data_year, ''), '(20\d{{2}})', 1)), list_max(regexp_extract_all(coalesce(period_label, ''), '(20\d{{2}})', 1)), list_max(regexp_extract_all(coalesce(header_raw, ''), '(20\d{{2}})', 1)))) AS y FROM table_columns GROUP BY 1),
f AS (SELECT capture_id, pdf_name, regexp_replace(regexp_replace(coalesce(pdf_name, ''), '^[0-9a-fA-F]{{12}}_', ''), '\.[^.]*$', '') AS stem, nullif(regexp_extract(regexp_replace(coalesce(pdf_name, ''), '^[0-9a-fA-F]{{12}}_', ''), '(20\d{{2}})', 1), '') AS fy FROM captures),
z AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '20\d{{2}}', '', 'g'), '{text.REPORT_ENDINGS}', ''), '[_\-\s]+', ' ', 'g'), '^[ _-]+|[ _-]+$', '', 'g') AS c FROM f)
SELECT z.capture_id, pdf_name, CASE WHEN c <> '' THEN c ELSE stem END AS company, coalesce(greatest(y, fy), '') AS document_year FROM z LEFT JOIN l USING (capture_id)""",
    "merge_sources": f"""SELECT 'MERGE' AS part, batch_id AS group_id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at NULLS FIRST, capture_id) AS place, capture_id AS id FROM captures WHERE batch_id IS NOT NULL
UNION ALL SELECT 'FAMILY', table_family_id, row_number() OVER (PARTITION BY table_family_id ORDER BY {_ORD} NULLS LAST, capture_id), capture_id FROM captures WHERE table_family_id IS NOT NULL AND lifecycle_status = 'ACTIVE'""",
    "fn_keys": rf"""WITH a AS (SELECT *, list_filter(list_transform(regexp_extract_all(trim(translate(coalesce(note_number, ''), '（）－０１２３４５６７８９', '()-0123456789')), '([一二三四五六七八九十百]+|\d+)', 1), lambda x: {_NUM.format(x='x')}), lambda n: n > 0) AS ns FROM captures), b AS (SELECT *, list_extract(ns, -1) AS item, CASE WHEN len(ns) > 1 THEN list_extract(ns, -2) END AS section FROM a)
SELECT capture_id, CASE WHEN section IS NOT NULL THEN '附注' || section || '-' || item WHEN item IS NOT NULL THEN '附注' || item ELSE '' END AS normalized, section, item, substr(sha1('auto_' || coalesce(producer_version, '-') || '_200_fq0.6_mn' || coalesce(merge_ready::VARCHAR, 'na') || '_3-12'), 1, 12) AS cache_key,
 regexp_replace(coalesce(table_query, ''), '\s+', '', 'g') <> '' AND (contains(regexp_replace(coalesce(table_query, ''), '\s+', '', 'g'), '保险合同负债') OR (contains('保险合同负债', regexp_replace(coalesce(table_query, ''), '\s+', '', 'g')) AND length(regexp_replace(coalesce(table_query, ''), '\s+', '', 'g')) >= 4)) AS title_ok,
 coalesce(header_dimension_status, '') IN ('', 'UNKNOWN', 'OK') AS scope_ok, '[' || CASE WHEN batch_id IS NULL THEN 'null' ELSE '"' || batch_id || '"' END || ',"' || capture_id || '"]' AS listed, capture_id AS second FROM b""",
    "fn_labels": rf"""WITH a AS (SELECT *, regexp_replace(coalesce(table_query, ''), '\s+', '', 'g') AS s, upper(concat_ws(':', boundary_status, header_dimension_status)) AS t, regexp_replace(trim(coalesce(pdf_name, '')), '[\\/:*?"<>|\s]+', '_', 'g') AS f FROM captures)
SELECT capture_id, CASE WHEN s <> '' AND regexp_matches(s, '^(注|说明)[：:]') THEN 'NOTE_TEXT' WHEN s <> '' AND regexp_matches(s, '以下名称|以下简称|截至|包括|上述|不构成|请见附注') AND (length(s) >= 12 OR regexp_matches(s, '[，。；：]')) THEN 'MEMO_TEXT' WHEN starts_with(s, '其中') AND length(s) >= 12 THEN 'MEMO_TEXT' END AS non_data,
 CASE {_REASONS} WHEN t IN ({", ".join(f"'{r}'" for r in text.REASONS)}) THEN t ELSE 'ROW_STRUCTURE_AMBIGUOUS' END AS reason, CASE WHEN f <> '' THEN f ELSE 'export' END || '.csv' AS file,
 lower(regexp_replace(regexp_replace(coalesce(company, ''), '[（(].*?[)）]', '', 'g'), '\s+', '', 'g')) AS company_key, nullif(regexp_extract(coalesce(document_year, ''), '(?m)^[-—\s]*(\d{{1,4}})[-—\s]*$', 1), '') AS page FROM a""",
    "fn_values": rf"""WITH a AS (SELECT token_id, array_to_string(raw_numeric_tokens, '') AS raw, parsed_decimal_value AS v FROM numeric_tokens), b AS (SELECT *, regexp_replace(coalesce(raw, ''), '[,，\s]', '', 'g') AS s FROM a)
SELECT token_id, CASE WHEN regexp_matches(s, '^\(.*\)$') THEN -CASE WHEN regexp_matches(s, '^\([+-]?\d+\)$') THEN try_cast(regexp_extract(s, '^\((.*)\)$', 1) AS BIGINT) END WHEN regexp_matches(s, '^[+-]?\d+$') THEN try_cast(s AS BIGINT) END AS whole, abs(v - round(v, -2)) <= 4 AS close,
 CASE WHEN coalesce(v < 0, false) THEN 'OUTSIDE_FAMILY' WHEN NOT coalesce(v > 1000, false) AND trim(coalesce(raw, '')) IN ('', '-', '—', '–', '－', 'N/A', 'n/a') THEN 'COMPARATIVE_ONLY_LEGACY_MEMBER' WHEN trim(coalesce(raw, '')) NOT IN ('', '-', '—', '–', '－') THEN 'ACTIVE_CURRENT_PERIOD' ELSE 'UNRESOLVED' END AS status,
 CASE WHEN contains(raw, '%') THEN 0.055 ELSE -0.22 END::DOUBLE AS typed FROM b""",
    "page_contexts": "WITH c AS (SELECT pdf_id, page, max(currency) AS currency FROM document_contexts GROUP BY 1, 2) SELECT a.pdf_id, a.page, coalesce(a.currency, b.currency) AS inherited FROM c a LEFT JOIN c b ON b.pdf_id = a.pdf_id AND b.page = a.page - 1",
    "united_rows": f"""WITH {_O} SELECT observation_id, CASE WHEN table_family = '投资资产' THEN 'INVEST' ELSE table_family END AS table_family, CASE WHEN table_family = '投资资产' THEN '投资' END AS member_table, CASE WHEN table_family = '投资资产' THEN CASE WHEN starts_with(coalesce(row_path, normalized_item, ''), '投资 / ') THEN coalesce(row_path, normalized_item, '') ELSE '投资 / ' || coalesce(row_path, normalized_item, '') END END AS row_path,
 CASE WHEN row_order >= 5000 THEN 'HUMAN_LAYOUT_NOISE' END AS reason FROM o WHERE table_family IN ('投资资产', '保险合同')""",
    "effective_years": rf"""WITH {_O}, x AS (SELECT *, nullif(regexp_extract({_ID.format('data_year')}, '(20\d{{2}})', 1), '') AS own, nullif(regexp_extract({_ID.format('document_year')}, '(20\d{{2}})', 1), '') AS doc FROM o) SELECT observation_id, coalesce(own, doc) AS effective_year, CASE WHEN own IS NOT NULL THEN 'table_header' ELSE 'document_fallback' END AS year_source, coalesce(nullif({_ID.format('company')}, ''), 'UNKNOWN') AS company FROM x""",
    "merged_rules": "SELECT metric_id, array_to_string(list_concat(coalesce(aliases, []), list_filter(coalesce(soft_aliases, []), lambda x: NOT list_contains(coalesce(aliases, []), x))), '|') AS aliases, coalesce(position_hint, 'middle') AS position_hint FROM metric_aliases",
    "given_order": "SELECT c.capture_id AS pos, p.pdf_id, p.filename FROM captures c JOIN pdf_assets p USING (pdf_id)",
    "primary_values": f"""WITH {_O}, v AS (SELECT capture_run_id, row_order, value, data_year AS y, {_SCORE} AS ps, column_ordinal AS ci, observation_id, min(document_year) OVER (PARTITION BY capture_run_id, row_order) AS dy FROM o WHERE value IS NOT NULL AND row_order IS NOT NULL),
w AS (SELECT *, {sql_year('dy')} AS ty, row_number() OVER a AS k, lead(ps) OVER a AS nps, count(*) OVER (PARTITION BY capture_run_id, row_order) AS n FROM v WINDOW a AS (PARTITION BY capture_run_id, row_order ORDER BY ps DESC, ci, observation_id))
SELECT capture_run_id, row_order, CASE WHEN count(*) FILTER (y = ty) = 1 THEN any_value(value) FILTER (y = ty) WHEN max(n) = 1 OR max(CASE WHEN k = 1 THEN ps END) > max(CASE WHEN k = 1 THEN nps END) + 0.1 THEN max(value) FILTER (k = 1) ELSE arg_min(value, (ci, observation_id)) END AS value FROM w GROUP BY 1, 2""",
}

SQL["full_anchor_scores"] = f"""WITH s AS (SELECT capture_id, count(*) AS n, count(*) FILTER (confidence = 'HIGH') AS nr, count(*) FILTER (unit <> '') AS vr, max(unit) AS unit FROM table_segments GROUP BY 1), y AS (SELECT capture_id, count(DISTINCT data_year) AS np, max(statement_scope) AS sc FROM table_columns GROUP BY 1),
x AS (SELECT c.*, coalesce(s.n, 0) AS n, coalesce(s.nr, 0) AS nr, coalesce(s.vr, 0) AS vr, coalesce(s.unit, '') AS unit, coalesce(np, 0) AS np, coalesce(nullif(y.sc, ''), 'UNKNOWN') AS sc, CASE WHEN merge_ready = 1 THEN 'CONSOLIDATED' ELSE '' END AS wanted, {sql_norm('table_query')} AS pt,
 note_number IS NOT NULL AS is_note, coalesce(regexp_matches(table_query, '{"|".join(rt.FORMAL_TITLES)}'), false) OR coalesce(boundary_status = 'COMPLETE', false) AS formal, coalesce(regexp_matches(table_query, '{"|".join(rt.SUMMARY_TITLES)}'), false) OR coalesce(is_trashed = 1, false) AS summary,
 coalesce(header_dimension_status = 'OK', false) AS hd, coalesce(boundary_status = 'UNCERTAIN', false) AS ocr FROM captures c LEFT JOIN s USING (capture_id) LEFT JOIN y USING (capture_id)),
z AS (SELECT *, wanted <> '' AND sc <> 'UNKNOWN' AND sc <> wanted AS conflict FROM x),
t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round((CASE WHEN pt <> '' THEN 0.22 ELSE 0 END + CASE WHEN formal THEN 0.13 ELSE 0 END + CASE WHEN NOT is_note THEN 0.06 ELSE 0 END + CASE WHEN wanted <> '' AND sc = wanted THEN 0.05 WHEN sc <> 'UNKNOWN' THEN 0.03 ELSE 0 END)::DOUBLE + 0.1::DOUBLE * least(n / 4.0::DOUBLE, 1)
  + CASE WHEN n > 0 THEN 0.12::DOUBLE * nr / n + 0.05::DOUBLE * nr / n + 0.09::DOUBLE * vr / n ELSE 0 END + (CASE WHEN np >= 2 OR hd THEN 0.07 ELSE 0 END + CASE WHEN unit <> '' THEN 0.04 ELSE 0 END + CASE WHEN sc <> 'UNKNOWN' THEN 0.03 ELSE 0 END + CASE WHEN hd THEN 0.04 ELSE 0 END + CASE WHEN merge_ready = 1 THEN 0.03 ELSE 0 END
  + CASE WHEN table_family_id IS NOT NULL THEN 0.02 ELSE 0 END - CASE WHEN summary THEN 0.28 ELSE 0 END - CASE WHEN is_note THEN 0.22 ELSE 0 END - CASE WHEN n = 0 THEN 0.18 ELSE 0 END - CASE WHEN conflict THEN 0.18 ELSE 0 END - CASE WHEN ocr THEN 0.12 ELSE 0 END)::DOUBLE, 4))) AS score,
 coalesce(concat_ws('|', CASE WHEN coalesce(pdf_id, '') = '' THEN 'source_pdf_identity' END, CASE WHEN conflict THEN 'scope_compatible' END, CASE WHEN pt = '' THEN 'target_parent_exists' END, CASE WHEN vr = 0 THEN 'amount_columns_present' END, CASE WHEN np = 0 AND NOT hd THEN 'period_recognized' END,
  CASE WHEN is_note OR summary THEN 'formal_statement_not_note' END, CASE WHEN summary THEN 'not_toc_or_summary' END, CASE WHEN ocr THEN 'ocr_evidence_sufficient' END), '') AS failed FROM z)
SELECT capture_id, score, failed = '' AS passed, failed, CASE WHEN failed = '' AND score >= 0.7 THEN 'QUALIFIED' ELSE 'LOW_CONFIDENCE' END AS tier FROM t"""
