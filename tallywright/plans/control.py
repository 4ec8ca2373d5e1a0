"""Registered queries of the control-plane operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.notes import note_ordinal
from tallywright.operators import registry as rg
from tallywright.operators.hierarchy import resolve_paths
from tallywright.operators.units import declarations_in_force
from tallywright.plans.records import _sql_currency, _sql_scale
from tallywright.sources.tables import table

T = "yyyy-MM-dd HH:mm:ss"
TERMINAL = ("ACTIVE", "INVALIDATED", "TRASHED")


def _c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures")


def _v(spark: SparkSession, d: str) -> DataFrame:
    return rg.versions(_c(spark, d))


def capture_list(spark: SparkSession, d: str) -> DataFrame:
    """FI9, SO10: second page of live captures on 余额 tables, newest first."""
    rows = rg.filter_captures(_c(spark, d), query_contains="余额", lifecycle="ACTIVE")
    return rg.page(rows, [F.coalesce("created_at", "updated_at").desc_nulls_last(), F.col("capture_id")], 50, 2).select("capture_id", "table_query", "company")


def capture_counts(spark: SparkSession, d: str) -> DataFrame:
    """FI10, FI29: live and trashed captures by family."""
    live, trash = rg.filter_captures(_c(spark, d)), rg.filter_captures(_c(spark, d), only_trash=True)
    return live.groupBy("table_family_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("LIVE")).unionByName(trash.groupBy("table_family_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("TRASH")))


def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    """JO20, JO22: captures of batches that hold a trashed capture."""
    return rg.filter_captures(_c(spark, d), include_trash=True, in_batches=rg.filter_captures(_c(spark, d), only_trash=True)).select("capture_id", "batch_id")


def not_exists_anti(spark: SparkSession, d: str) -> DataFrame:
    """FI16, JO23: pdfs without a capture."""
    return rg.not_in(table(spark, d, "pdf_assets").select("pdf_id", "filename"), _c(spark, d), "pdf_id")


def scd2_versions(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d)


def asset_search_page(spark: SparkSession, d: str) -> DataFrame:
    """FI13, JO9, SO8: current versions joined with capture and pdf, one facet and free text, one page."""
    c = _c(spark, d).select("capture_id", "company", "document_year", "table_family_id", "table_query", "pdf_id", "pdf_name", "lifecycle_status")
    p = table(spark, d, "pdf_assets").select("pdf_id", "path")
    rows = _v(spark, d).where("is_current").join(c, "capture_id").join(p, "pdf_id", "left")
    hits = rg.search(rows, {"lifecycle_status": "ACTIVE"}, ("保险", ["company", "table_query", "pdf_name"]))
    return rg.page(hits, [F.col("company"), F.col("document_year").desc_nulls_last(), F.col("capture_id")], 100, 1).select("capture_id", "company", "document_year", "table_query", "path", "capture_version")


def merge_eligible(spark: SparkSession, d: str) -> DataFrame:
    return rg.merge_ready(_c(spark, d), _v(spark, d)).select("capture_id", "company", "table_family_id")


def latest_review(spark: SparkSession, d: str) -> DataFrame:
    """WI1, WI20: newest capture of each pdf and family."""
    return rg.top_per_key(_c(spark, d).where("pdf_id IS NOT NULL"), ["pdf_id", "table_family_id"], [F.col("created_at").desc(), F.col("capture_id").desc()]).select("pdf_id", "table_family_id", "capture_id")


def latest_attempt_list(spark: SparkSession, d: str) -> DataFrame:
    """WI3, SO7: three newest captures of each batch."""
    return rg.top_per_key(_c(spark, d), ["batch_id"], [F.coalesce("updated_at", "created_at").desc_nulls_last(), F.col("capture_id")], 3).select("batch_id", "capture_id")


def review_queue_latest(spark: SparkSession, d: str) -> DataFrame:
    """JO14: every pdf with its latest capture decision; pdfs without one stay."""
    c = _c(spark, d).where("pdf_id IS NOT NULL").select("pdf_id", "capture_id", "created_at", "boundary_status")
    return rg.with_latest(table(spark, d, "pdf_assets").select("pdf_id", "filename"), c, "pdf_id", [F.col("created_at").desc(), F.col("capture_id").desc()]).select("pdf_id", "capture_id", "boundary_status")


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return rg.batch_summary(_c(spark, d)).withColumn("first_created", F.date_format("first_created", T)).withColumn("last_created", F.date_format("last_created", T))


def job_monitor(spark: SparkSession, d: str) -> DataFrame:
    jobs = _c(spark, d).select("batch_id", "updated_at", F.when(F.col("merge_ready") == 1, F.col("lifecycle_status")).otherwise("RUNNING").alias("status"))
    return rg.job_monitor(jobs, TERMINAL).withColumn("last_update", F.date_format("last_update", T))


def facets(spark: SparkSession, d: str) -> DataFrame:
    return rg.facet_values(_c(spark, d), ["document_year", "table_family_id", "lifecycle_status", "boundary_status", "header_dimension_status", "producer_version"])


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG21, AG18: captures by status, all rows."""
    return _c(spark, d).groupBy("lifecycle_status", "boundary_status", "merge_ready").agg(F.count("*").alias("n"), F.sum("is_trashed").alias("trashed"), F.date_format(F.max("updated_at"), T).alias("last_update"))


def core_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return rg.table_counts({t: table(spark, d, t) for t in ("pdf_assets", "captures", "table_columns", "table_segments", "structure_edges", "long_observations")})


def pdf_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return rg.reference_counts(table(spark, d, "pdf_assets"), _c(spark, d))


def bulk_review_groups(spark: SparkSession, d: str) -> DataFrame:
    return rg.homogeneous(_c(spark, d), "batch_id", "boundary_status", F.col("header_dimension_status") == "OK", F.col("is_trashed") == 1)


def bundle_validation(spark: SparkSession, d: str) -> DataFrame:
    """JO35: pieces of a capture in page order from its first page."""
    s = table(spark, d, "table_segments").groupBy("capture_id", "segment_id").agg(F.min("pdf_page_number").alias("page"), F.max("confidence").alias("confidence"))
    first = s.groupBy("capture_id").agg(F.min("page").alias("start"))
    return rg.bundle_check(s.join(first, "capture_id").withColumn("child_order", F.col("page") - F.col("start")), "capture_id", "child_order", F.col("confidence") == "HIGH")


def stale_propagation(spark: SparkSession, d: str) -> DataFrame:
    """GV9: merges of one batch each over all captures that have observations."""
    s = table(spark, d, "long_observations").select("capture_run_id").distinct().select(F.col("capture_run_id").alias("capture_id"))
    merges = s.join(_c(spark, d).select("capture_id", "batch_id"), "capture_id", "left").select(F.coalesce("batch_id", F.lit("-")).alias("merge_id"), "capture_id")
    return rg.dependency_status(merges, _c(spark, d))


def lifecycle_after(spark: SparkSession, d: str) -> DataFrame:
    """GV7: trash, then restore transitions of every third capture."""
    c = _c(spark, d)
    n = F.substring("capture_id", 5, 20).cast("int")
    t = c.where(n % 3 == 0).select("capture_id", F.lit("TRASHED").alias("new_status"), F.col("created_at").alias("at"), F.lit(1).alias("seq"))
    back = c.where(n % 6 == 0).select("capture_id", F.lit("ACTIVE").alias("new_status"), F.col("created_at").alias("at"), F.lit(2).alias("seq"))
    return rg.lifecycle_after(c, t.unionByName(back)).select("capture_id", "lifecycle_status")


def upsert_pdfs(spark: SparkSession, d: str) -> DataFrame:
    """GV1: assets with a null size get the size of the largest copy of the same file."""
    p = table(spark, d, "pdf_assets").select("pdf_id", "sha256", "size_bytes")
    best = p.groupBy("sha256").agg(F.max("size_bytes").alias("b"))
    new = p.where("size_bytes IS NULL").join(best, "sha256").select("pdf_id", "sha256", F.col("b").alias("size_bytes"))
    return rg.upsert(p, new, ["pdf_id"])


def identity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """GV16: missing company of a capture from its asset."""
    return rg.fill_missing(_c(spark, d).select("capture_id", "pdf_id", "company"), table(spark, d, "pdf_assets").where("company IS NOT NULL").select("pdf_id", "company"), "pdf_id", ["company"]).select("capture_id", "company")


def issue_state(spark: SparkSession, d: str) -> DataFrame:
    """GV15: open boundary issues against header issues found now."""
    c = _c(spark, d)
    old = c.where("boundary_status <> 'COMPLETE'").select("capture_id", F.when(F.col("merge_ready") == 1, "RESOLVED").otherwise("OPEN").alias("status"))
    return rg.issue_state(old, c.where("header_dimension_status <> 'OK'").select("capture_id"), ["capture_id"])


def selection_algebra(spark: SparkSession, d: str) -> DataFrame:
    c = _c(spark, d)
    return rg.selection(
        c.where("document_year LIKE '%2020%'").select("capture_id"), c.where("table_family_id = 'FAM-01'").select("capture_id"), c.where("merge_ready = 1").select("capture_id"), c.where("is_trashed = 0").select("capture_id")
    )


def adjudicated_values(spark: SparkSession, d: str) -> DataFrame:
    """PR20: readings as machine results, second readings as reviews in file order."""
    n = table(spark, d, "numeric_tokens")
    key = ["capture_id", "row_order", "column_ordinal"]
    first = n.where("reading = 1").groupBy(*key).agg(F.min("parsed_decimal_value").alias("value"), F.when(F.max("parsing_confidence") >= 0.9, "RESOLVED").otherwise("REVIEW_REQUIRED").alias("status"))
    line = F.substring("token_id", 5, 20).cast("int")
    reviews = n.where("reading = 2").select(*key, line.alias("line"), F.when(F.col("parsed_decimal_value").isNull(), "REJECTED").when(F.col("parsing_confidence") < 0.9, "CONFIRMED_OVERRIDE").otherwise("CONFIRMED_AUTO").alias("review_status"), F.col("parsed_decimal_value").alias("override_value"))
    return rg.adjudicated(first, reviews, key)


def expected_members(spark: SparkSession, d: str) -> DataFrame:
    return rg.expected_members(table(spark, d, "long_observations").select("company", "document_year", "table_family").distinct(), ["投资资产", "保险合同"], ["其他"], ["company", "document_year"], "table_family")


def golden_compare(spark: SparkSession, d: str) -> DataFrame:
    """JO33: first readings as golden facts, second readings as observations."""
    n, key = table(spark, d, "numeric_tokens"), ["capture_id", "row_order", "column_ordinal"]
    e = n.where("reading = 1 AND parsed_decimal_value IS NOT NULL").select(*key, F.col("parsed_decimal_value").alias("expected_value"))
    return rg.golden_compare(e, n.where("reading = 2").select(*key, F.col("parsed_decimal_value").alias("value")), key).select(*key, "result")


def capture_readiness(spark: SparkSession, d: str) -> DataFrame:
    return rg.readiness(_c(spark, d), table(spark, d, "table_columns"), table(spark, d, "table_segments"))


def continuation_roots(spark: SparkSession, d: str) -> DataFrame:
    """HI11: first piece of every continued table, by pointer doubling over the continuation links (numbers of the segment ids)."""
    number = lambda c: F.substring(c, 5, 20).cast("long")
    s = table(spark, d, "table_segments").select(F.lit("all").alias("capture_id"), number("segment_id").alias("row_order"), number("continuation_of_segment_id").alias("parent_row_order"), F.lit("").alias("normalized_item"))
    return resolve_paths(s).select(F.col("row_order").alias("segment"), F.col("root").alias("root_segment"), F.col("depth").alias("pieces_before"))


def document_context(spark: SparkSession, d: str) -> DataFrame:
    """WI17: scale and currency in force on the page of every segment."""
    pages = table(spark, d, "table_segments").where("pdf_id IS NOT NULL AND pdf_page_number IS NOT NULL").select("pdf_id", F.col("pdf_page_number").alias("page")).distinct()
    return declarations_in_force(table(spark, d, "document_contexts"), pages)


def next_peer_note(spark: SparkSession, d: str) -> DataFrame:
    """WI16, HI19: for every numbered capture the next one of its pdf with the following note number."""
    c = _c(spark, d).where("pdf_id IS NOT NULL").select("pdf_id", "capture_id", note_ordinal("note_number").alias("n")).where("n IS NOT NULL")
    following = c.groupBy("pdf_id", (F.col("n") - 1).alias("n")).agg(F.min("capture_id").alias("next_capture"))
    return c.join(following, ["pdf_id", "n"], "left").select("capture_id", "n", "next_capture")


QUERIES = {
    f.__name__: f
    for f in (
        capture_list, capture_counts, exists_semi, not_exists_anti, scd2_versions, asset_search_page, merge_eligible, latest_review, latest_attempt_list, review_queue_latest, batch_summary, job_monitor,
        facets, status_counts, core_table_counts, pdf_reference_counts, bulk_review_groups, bundle_validation, stale_propagation, lifecycle_after, upsert_pdfs, identity_backfill, issue_state,
        selection_algebra, adjudicated_values, expected_members, golden_compare, capture_readiness, continuation_roots, document_context, next_peer_note,
    )
}

_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_V = "v AS (SELECT logical_asset_id, capture_id, row_number() OVER w AS capture_version, lead(capture_id) OVER w IS NULL AS is_current, lag(capture_id) OVER w AS supersedes, lead(capture_id) OVER w AS superseded_by FROM (SELECT *, sha256(concat_ws(chr(31), " + ", ".join(_ID.format(x) for x in rg.IDENTITY) + ")) AS logical_asset_id FROM captures) WINDOW w AS (PARTITION BY logical_asset_id ORDER BY created_at, capture_id))"
_LIVE = "is_trashed = 0 AND lifecycle_status <> 'TRASHED'"
_TRASH = "(is_trashed = 1 OR lifecycle_status = 'TRASHED')"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_NO = "[零〇一二三四五六七八九十百]{1,5}"
SQL = {
    "capture_list": f"SELECT capture_id, table_query, company FROM captures WHERE {_LIVE} AND lifecycle_status = 'ACTIVE' AND contains(lower(coalesce(table_query, '')), '余额') ORDER BY coalesce(created_at, updated_at) DESC NULLS LAST, capture_id LIMIT 50 OFFSET 50",
    "capture_counts": f"SELECT table_family_id, count(*) AS n, 'LIVE' AS part FROM captures WHERE {_LIVE} GROUP BY 1 UNION ALL SELECT table_family_id, count(*), 'TRASH' FROM captures WHERE {_TRASH} GROUP BY 1",
    "exists_semi": f"SELECT capture_id, batch_id FROM captures WHERE batch_id IN (SELECT batch_id FROM captures WHERE {_TRASH} AND batch_id IS NOT NULL)",
    "not_exists_anti": "SELECT pdf_id, filename FROM pdf_assets p WHERE NOT EXISTS (SELECT 1 FROM captures c WHERE c.pdf_id = p.pdf_id)",
    "scd2_versions": f"WITH {_V} SELECT * FROM v",
    "asset_search_page": f"WITH {_V} SELECT v.capture_id, c.company, c.document_year, c.table_query, p.path, v.capture_version FROM v JOIN captures c USING (capture_id) LEFT JOIN pdf_assets p ON p.pdf_id = c.pdf_id WHERE v.is_current AND c.lifecycle_status = 'ACTIVE' AND (contains(coalesce(c.company, ''), '保险') OR contains(coalesce(c.table_query, ''), '保险') OR contains(coalesce(c.pdf_name, ''), '保险')) ORDER BY c.company NULLS FIRST, c.document_year DESC NULLS LAST, v.capture_id LIMIT 100",
    "merge_eligible": f"WITH {_V} SELECT capture_id, company, table_family_id FROM captures JOIN v USING (capture_id) WHERE is_current AND merge_ready = 1 AND is_trashed = 0 AND lifecycle_status = 'ACTIVE' AND {_ID.format('table_family_id')} <> '' AND {_ID.format('company')} <> ''",
    "latest_review": "SELECT pdf_id, table_family_id, capture_id FROM captures WHERE pdf_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_id, table_family_id ORDER BY created_at DESC, capture_id DESC) = 1",
    "latest_attempt_list": "SELECT batch_id, capture_id FROM captures QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, capture_id) <= 3",
    "review_queue_latest": "WITH l AS (SELECT * FROM captures WHERE pdf_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_id ORDER BY created_at DESC, capture_id DESC) = 1) SELECT p.pdf_id, l.capture_id, l.boundary_status FROM pdf_assets p LEFT JOIN l USING (pdf_id)",
    "batch_summary": f"""WITH g AS (SELECT batch_id, count(*) AS capture_count, count(*) FILTER (lifecycle_status = 'ACTIVE' AND is_trashed = 0) AS active_count, count(*) FILTER (lifecycle_status = 'INVALIDATED' AND is_trashed = 0) AS invalidated_count, count(*) FILTER {_TRASH} AS trashed_count,
 {_TS.format('min(created_at)')} AS first_created, {_TS.format('max(created_at)')} AS last_created, string_agg(DISTINCT producer_version, ',' ORDER BY producer_version) AS producer_versions FROM captures WHERE {_ID.format('batch_id')} <> '' GROUP BY 1)
SELECT *, CASE WHEN active_count + invalidated_count = 0 AND trashed_count > 0 THEN 'TRASHED' WHEN active_count > 0 AND invalidated_count > 0 THEN 'PARTIALLY_INVALIDATED' WHEN active_count = 0 AND invalidated_count > 0 THEN 'FULLY_INVALIDATED' ELSE 'ACTIVE' END || CASE WHEN trashed_count > 0 AND active_count + invalidated_count > 0 THEN '_WITH_TRASHED_ITEMS' ELSE '' END AS batch_status FROM g""",
    "job_monitor": f"WITH j AS (SELECT batch_id, updated_at, CASE WHEN merge_ready = 1 THEN lifecycle_status ELSE 'RUNNING' END AS status FROM captures), g AS (SELECT batch_id, count(*) AS jobs, count(*) FILTER (status IN ('ACTIVE', 'INVALIDATED', 'TRASHED')) AS finished, {_TS.format('max(updated_at)')} AS last_update FROM j GROUP BY 1) SELECT *, finished::DOUBLE / jobs AS ratio, finished < jobs AS is_running FROM g",
    "facets": " UNION ALL ".join(f"SELECT '{c}' AS facet, {_ID.format(c)} AS value, count(*) AS n FROM captures WHERE {_ID.format(c)} <> '' GROUP BY 2" for c in ("document_year", "table_family_id", "lifecycle_status", "boundary_status", "header_dimension_status", "producer_version")),
    "status_counts": f"SELECT lifecycle_status, boundary_status, merge_ready, count(*) AS n, sum(is_trashed)::BIGINT AS trashed, {_TS.format('max(updated_at)')} AS last_update FROM captures GROUP BY 1, 2, 3",
    "core_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("pdf_assets", "captures", "table_columns", "table_segments", "structure_edges", "long_observations")),
    "pdf_reference_counts": "SELECT p.pdf_id, p.filename, count(c.capture_id) AS n_captures, count(DISTINCT c.batch_id) AS n_batches, min(c.capture_id) AS first_capture FROM pdf_assets p LEFT JOIN captures c USING (pdf_id) GROUP BY 1, 2",
    "bulk_review_groups": "WITH g AS (SELECT batch_id, count(DISTINCT boundary_status) AS reasons, bool_and(header_dimension_status = 'OK') AS complete, bool_or(is_trashed = 1) AS conflict FROM captures GROUP BY 1) SELECT *, reasons = 1 AND complete AND NOT conflict AS allowed FROM g",
    "bundle_validation": "WITH s AS (SELECT capture_id, segment_id, min(pdf_page_number) AS page, max(confidence) AS confidence FROM table_segments GROUP BY 1, 2), f AS (SELECT *, page - min(page) OVER (PARTITION BY capture_id) AS o FROM s), g AS (SELECT capture_id, count(*) AS n, count(*) = count(DISTINCT o) AND min(o) = 0 AND max(o) = count(*) - 1 AS order_ok, bool_and(confidence = 'HIGH') AS a, bool_or(confidence = 'HIGH') AS b FROM f GROUP BY 1) SELECT capture_id, n, coalesce(order_ok, false) AS order_ok, CASE WHEN a THEN 'READY' WHEN b THEN 'PARTIALLY_REVIEW_REQUIRED' ELSE 'REVIEW_REQUIRED' END AS bundle_status FROM g",
    "stale_propagation": "WITH j AS (SELECT coalesce(k.batch_id, '-') AS merge_id, k.lifecycle_status IS NULL AS missing, coalesce(k.lifecycle_status <> 'ACTIVE' OR k.is_trashed = 1, false) AS bad FROM (SELECT DISTINCT capture_run_id AS capture_id FROM long_observations) s LEFT JOIN captures k USING (capture_id)), g AS (SELECT merge_id, count(*) AS n_sources, count(*) FILTER (bad) AS n_bad, count(*) FILTER (missing) AS n_missing FROM j GROUP BY 1) SELECT *, CASE WHEN n_bad > 0 THEN 'STALE_SOURCE_INVALIDATED' WHEN n_missing > 0 THEN 'STALE_SOURCE_MISSING' ELSE 'CURRENT' END AS dependency_status FROM g",
    "lifecycle_after": "SELECT capture_id, CASE WHEN substr(capture_id, 5)::INT % 6 = 0 THEN 'ACTIVE' WHEN substr(capture_id, 5)::INT % 3 = 0 THEN 'TRASHED' ELSE lifecycle_status END AS lifecycle_status FROM captures",
    "upsert_pdfs": "SELECT pdf_id, sha256, coalesce(size_bytes, max(size_bytes) OVER (PARTITION BY sha256)) AS size_bytes FROM pdf_assets",
    "identity_backfill": f"SELECT c.capture_id, CASE WHEN {_ID.format('c.company')} <> '' THEN c.company ELSE p.company END AS company FROM captures c LEFT JOIN (SELECT pdf_id, min(company) AS company FROM pdf_assets WHERE company IS NOT NULL GROUP BY 1) p USING (pdf_id)",
    "issue_state": "WITH o AS (SELECT capture_id, CASE WHEN merge_ready = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS old FROM captures WHERE boundary_status <> 'COMPLETE'), f AS (SELECT capture_id, true AS now FROM captures WHERE header_dimension_status <> 'OK') SELECT capture_id, CASE WHEN old = 'RESOLVED' THEN 'RESOLVED' WHEN old IS NULL THEN 'OPENED' WHEN now THEN 'KEPT' ELSE 'AUTO_RESOLVED' END AS status FROM o FULL OUTER JOIN f USING (capture_id)",
    "selection_algebra": "SELECT capture_id FROM captures WHERE is_trashed = 0 AND ((document_year LIKE '%2020%' AND coalesce(table_family_id, '') <> 'FAM-01') OR (merge_ready = 1 AND table_family_id = 'FAM-01'))",
    "adjudicated_values": """WITH m AS (SELECT capture_id, row_order, column_ordinal, min(parsed_decimal_value) AS value, CASE WHEN max(parsing_confidence) >= 0.9 THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status FROM numeric_tokens WHERE reading = 1 GROUP BY 1, 2, 3),
r AS (SELECT capture_id, row_order, column_ordinal, CASE WHEN parsed_decimal_value IS NULL THEN 'REJECTED' WHEN parsing_confidence < 0.9 THEN 'CONFIRMED_OVERRIDE' ELSE 'CONFIRMED_AUTO' END AS rs, parsed_decimal_value AS ov FROM numeric_tokens WHERE reading = 2 QUALIFY row_number() OVER (PARTITION BY capture_id, row_order, column_ordinal ORDER BY substr(token_id, 5)::INT DESC) = 1)
SELECT capture_id, row_order, column_ordinal, rs AS review_status, CASE WHEN rs = 'CONFIRMED_OVERRIDE' THEN ov WHEN rs = 'REJECTED' THEN NULL WHEN rs = 'CONFIRMED_AUTO' OR (rs IS NULL AND status = 'RESOLVED') THEN value END AS final_value,
 CASE WHEN rs IN ('CONFIRMED_AUTO', 'CONFIRMED_OVERRIDE') THEN 'ADJUDICATED' WHEN rs = 'REJECTED' THEN 'REJECTED' WHEN status = 'RESOLVED' THEN 'MACHINE_RESOLVED' ELSE 'UNRESOLVED' END AS final_status FROM m LEFT JOIN r USING (capture_id, row_order, column_ordinal)""",
    "expected_members": "WITH h AS (SELECT company, document_year, list(DISTINCT table_family) FILTER (table_family IS NOT NULL) AS hv FROM long_observations GROUP BY 1, 2) SELECT company, document_year, array_to_string(list_sort(list_filter(['投资资产', '保险合同'], lambda x: NOT list_contains(coalesce(hv, []), x))), ',') AS missing, array_to_string(list_sort(list_filter(coalesce(hv, []), lambda x: NOT list_contains(['投资资产', '保险合同', '其他'], x))), ',') AS unexpected, round(len(list_filter(['投资资产', '保险合同'], lambda x: list_contains(coalesce(hv, []), x))) / 2.0, 6)::DOUBLE AS coverage FROM h",
    "golden_compare": "WITH a AS (SELECT capture_id, row_order, column_ordinal, count(DISTINCT parsed_decimal_value) AS n, min(parsed_decimal_value) AS seen FROM numeric_tokens WHERE reading = 2 GROUP BY 1, 2, 3) SELECT e.capture_id, e.row_order, e.column_ordinal, CASE WHEN n IS NULL OR n = 0 THEN 'NO_OBSERVATION' WHEN n = 1 AND seen = e.parsed_decimal_value THEN 'MATCH' ELSE 'MISMATCH' END AS result FROM numeric_tokens e LEFT JOIN a USING (capture_id, row_order, column_ordinal) WHERE e.reading = 1 AND e.parsed_decimal_value IS NOT NULL",
    "capture_readiness": """WITH c AS (SELECT capture_id, count(*) AS n FROM table_columns GROUP BY 1), s AS (SELECT capture_id, count(*) AS n, count(*) FILTER (confidence = 'LOW') AS low FROM table_segments GROUP BY 1),
x AS (SELECT k.capture_id, concat_ws('|', CASE WHEN lifecycle_status <> 'ACTIVE' THEN 'LIFECYCLE_NOT_ACTIVE' END, CASE WHEN is_trashed = 1 THEN 'TRASHED' END, CASE WHEN coalesce(boundary_status, '') <> 'COMPLETE' THEN 'BOUNDARY_NOT_COMPLETE' END,
 CASE WHEN coalesce(header_dimension_status, '') <> 'OK' THEN 'HEADER_NOT_OK' END, CASE WHEN c.n IS NULL THEN 'NO_COLUMNS' END, CASE WHEN s.n IS NULL THEN 'NO_SEGMENTS' END, CASE WHEN coalesce(s.low, 0) > 0 THEN 'LOW_CONFIDENCE_SEGMENT' END) AS blockers FROM captures k LEFT JOIN c USING (capture_id) LEFT JOIN s USING (capture_id))
SELECT capture_id, coalesce(blockers, '') AS blockers, coalesce(blockers, '') = '' AS is_ready FROM x""",
    "continuation_roots": "WITH RECURSIVE s AS (SELECT DISTINCT substr(segment_id, 5)::BIGINT AS id, substr(continuation_of_segment_id, 5)::BIGINT AS p FROM table_segments), k AS (SELECT s.id, q.id AS p FROM s LEFT JOIN s q ON q.id = s.p), t AS (SELECT id, id AS root, 0 AS depth FROM k WHERE p IS NULL UNION ALL SELECT k.id, t.root, t.depth + 1 FROM k JOIN t ON k.p = t.id) SELECT k.id AS segment, t.root AS root_segment, t.depth AS pieces_before FROM k LEFT JOIN t USING (id)",
    "next_peer_note": rf"""WITH p AS (SELECT pdf_id, capture_id, list_extract(regexp_extract_all(regexp_extract(trim(coalesce(note_number, '')), '([^-—–/]*)$', 1), '(\d{{1,3}}|{_NO})', 1), -1) AS x FROM captures WHERE pdf_id IS NOT NULL),
c AS (SELECT pdf_id, capture_id, CASE WHEN regexp_matches(x, '^\d+$') THEN x::INT WHEN contains(x, '十') THEN (CASE WHEN split_part(x, '十', 1) = '' THEN 1 ELSE try_cast(translate(split_part(x, '十', 1), '零〇一二三四五六七八九', '00123456789') AS INT) END) * 10 + (CASE WHEN split_part(x, '十', 2) = '' THEN 0 ELSE try_cast(translate(split_part(x, '十', 2), '零〇一二三四五六七八九', '00123456789') AS INT) END)
 WHEN x IS NOT NULL THEN try_cast(translate(x, '零〇一二三四五六七八九', '00123456789') AS INT) END AS n FROM p) SELECT a.capture_id, a.n, min(b.capture_id) AS next_capture FROM c a LEFT JOIN c b ON b.pdf_id = a.pdf_id AND b.n = a.n + 1 WHERE a.n IS NOT NULL GROUP BY 1, 2""",
}
SQL["document_context"] = f"""WITH c AS (SELECT pdf_id, page, coalesce({_sql_scale("unit")}, {_sql_scale("unit_source_text")}) AS sc, coalesce({_sql_currency("currency")}, {_sql_currency("unit")}, {_sql_currency("unit_source_text")}) AS cu FROM document_contexts),
p AS (SELECT DISTINCT pdf_id, pdf_page_number AS page FROM table_segments WHERE pdf_id IS NOT NULL AND pdf_page_number IS NOT NULL)
SELECT pdf_id, page, (SELECT arg_max(sc, c.page) FROM c WHERE c.pdf_id = p.pdf_id AND c.page <= p.page AND sc IS NOT NULL) AS d_scale, (SELECT arg_max(cu, c.page) FROM c WHERE c.pdf_id = p.pdf_id AND c.page <= p.page AND cu IS NOT NULL) AS d_currency FROM p"""
