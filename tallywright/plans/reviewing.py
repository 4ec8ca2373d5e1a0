"""Registered queries of the page, inbox and research-batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import text
from tallywright.operators import inbox as ib
from tallywright.operators import pages as pg
from tallywright.operators import registry as rg
from tallywright.operators import retrieval as rt
from tallywright.operators.observations import latest_delivery
from tallywright.plans.scalars import sql_norm
from tallywright.sources.tables import table

ITEMS = ("租赁负债", "使用权资产", "投资合同负债", "保险合同", "递延所得税资产", "未到期责任准备金")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")


def _c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures")


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")


def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", pg.is_contents_page(F.col("text")).alias("is_contents"), F.round(pg.statement_score(F.col("text"), "INCOME"), 4).alias("income_score"))


def note_references(spark: SparkSession, d: str) -> DataFrame:
    return pg.note_references(_pages(spark, d), ITEMS)


def located_notes(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return pg.locate_notes(p, pg.note_references(p, ITEMS).select("item", "note"))


def statement_member_rows(spark: SparkSession, d: str) -> DataFrame:
    return pg.statement_rows(_pages(spark, d), ITEMS)


def review_inbox(spark: SparkSession, d: str) -> DataFrame:
    """JO10, SO9: reviews of captures that are not complete, most severe first, one page."""
    c, v = _c(spark, d), rg.versions(_c(spark, d))
    assets = v.select("logical_asset_id").distinct()
    severity = F.when(F.col("boundary_status") == "TRUNCATED", "CRITICAL").when(F.col("boundary_status") == "UNCERTAIN", "HIGH").otherwise("LOW")
    reviews = c.where("boundary_status <> 'COMPLETE' OR header_dimension_status <> 'OK'").select(F.concat(F.lit("R-"), "capture_id").alias("review_item_id"), "capture_id", rg.logical_id().alias("logical_asset_id"), severity.alias("severity"), "updated_at")
    rows = ib.inbox(reviews, assets, v, c, table(spark, d, "pdf_assets"))
    return rg.page(rows, ib.inbox_order(), 40, 1).select("review_item_id", "severity", "capture_version", "table_query", "filename")


def recent_captures(spark: SparkSession, d: str) -> DataFrame:
    """FI14: captures touched in the 30 days before the newest one."""
    c = _c(spark, d)
    newest = c.agg(F.max("updated_at")).first()[0]
    return ib.recent(c, "updated_at", 30, F.lit(newest)).select("capture_id")


def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    jobs = _c(spark, d).select("batch_id", "capture_id", F.when(F.col("merge_ready") == 1, "SUCCESS").otherwise("FAILED").alias("status"))
    return ib.batch_progress(jobs, _c(spark, d).select("batch_id", F.col("table_family_id").alias("research_batch_id")))


def rerun_candidates(spark: SparkSession, d: str) -> DataFrame:
    plans = _c(spark, d).where("pdf_id IS NOT NULL AND table_family_id IS NOT NULL").groupBy("pdf_id", "table_family_id").agg(F.max("note_number").alias("target")).withColumn("role", F.lit("NOTE_DETAIL"))
    latest = rg.top_per_key(_c(spark, d).where("merge_ready = 1 OR is_trashed = 0").withColumn("status", F.when(F.col("merge_ready") == 1, "SUCCESS").otherwise("FAILED")), ["pdf_id", "table_family_id"], [F.col("created_at").desc(), F.col("capture_id").desc()])
    return ib.rerun_candidates(plans, latest, ["pdf_id", "table_family_id"])


def capture_usage(spark: SparkSession, d: str) -> DataFrame:
    return ib.usage(_c(spark, d).where("is_trashed = 1"), {"SEGMENT": table(spark, d, "table_segments"), "COLUMN": table(spark, d, "table_columns"), "READING": table(spark, d, "numeric_tokens")})


def schema_variants(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("table_family_id") == "FAM-01", "LEGACY_COMBINED").when(F.col("table_family_id") == "FAM-02", "INVESTMENT_COMPONENT").when(F.col("table_family_id") == "FAM-03", "INTEREST_COMPONENT").otherwise("OTHER")
    return ib.schema_variant(_c(spark, d).select("pdf_id", role.alias("role"), F.when(F.col("merge_ready") == 1, "SUCCESS").otherwise("FAILED").alias("status")), ["pdf_id"])


def capture_plans(spark: SparkSession, d: str) -> DataFrame:
    p = ib.plans_from_links(_c(spark, d).where("pdf_id IS NOT NULL"), ["pdf_id", "table_family_id"], ["note_number", "table_query"])
    return p.select("pdf_id", "table_family_id", "n_members", F.array_join(F.transform("members", lambda m: F.concat_ws("~", m["note_number"], m["table_query"])), "|").alias("members"))


def source_provenance(spark: SparkSession, d: str) -> DataFrame:
    """AG4: every source, 50 to a row."""
    return ib.provenance(_obs(spark, d), ["source_key"], "observation_id").select("source_key", "chunk", "n_sources", "source_rows")


def ordered_rows(spark: SparkSession, d: str) -> DataFrame:
    """JO3, SO1: observations with the first row order of their item."""
    order = table(spark, d, "structure_edges").groupBy("normalized_item").agg(F.min("row_order").alias("canonical_order"))
    return ib.in_canonical_order(_obs(spark, d).select("observation_id", "normalized_item", "company"), order, "normalized_item", ["company", "observation_id"]).select("observation_id", "canonical_order")


def null_safe_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """JO7: column dimensions numbered, then joined back with missing equal to missing."""
    keys = ["data_year", "statement_scope", "restated_flag", "period_type"]
    o = _obs(spark, d)
    dims = o.groupBy(*keys).agg(F.min("observation_id").alias("first_id"))
    return ib.join_null_safe(o.select("observation_id", *keys), dims, keys).select("observation_id", "first_id")


def metric_candidates(spark: SparkSession, d: str) -> DataFrame:
    """SO11 (no SQL: difflib ratio)."""
    q = _c(spark, d).select(F.col("table_query").alias("query"))
    return ib.metric_candidates(q, rt.search_terms(table(spark, d, "metric_aliases")))


def recovered_values(spark: SparkSession, d: str) -> DataFrame:
    """RK8 over every column of each capture, every fifth value removed and every seventh label blank."""
    r = _obs(spark, d).groupBy(F.col("capture_run_id").alias("page_id"), "column_ordinal", F.col("row_order").alias("row")).agg(F.min("normalized_item").alias("label"), F.min("value").alias("value"))
    return ib.recover_values(r.select("page_id", "column_ordinal", "row", F.when(F.pmod("row", F.lit(7)) == 0, "").otherwise(F.coalesce("label", F.lit(""))).alias("label"), F.when(F.pmod("row", F.lit(5)) != 0, F.col("value")).alias("value")), ["page_id", "column_ordinal"])


def section_parents(spark: SparkSession, d: str) -> DataFrame:
    """WI19: the last part but one of the stored path names the section."""
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("normalized_item").alias("label"), F.min("row_path").alias("p"))
    section = F.try_element_at(F.split("p", " / "), F.lit(-2))
    return ib.nearest_section_parent(e.select("capture_id", "row_order", "label", section.alias("parent_section"))).select("capture_id", "row_order", "parent")


def segment_classes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "table_segments").groupBy("capture_id", "segment_id").agg(F.min("pdf_page_number").alias("page"), F.min("note_identity").alias("header"))
    return ib.segment_class(s)


def block_topology(spark: SparkSession, d: str) -> DataFrame:
    n = _obs(spark, d).groupBy(F.col("capture_run_id").alias("capture_id"), F.col("member_table_order").alias("block_order"), "row_order").agg(F.countDistinct("column_ordinal").alias("n_cells"))
    return ib.topology(n)


def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    return ib.selection_summary(_c(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        contents_pages, note_references, located_notes, statement_member_rows, review_inbox, recent_captures, batch_progress, rerun_candidates, capture_usage, schema_variants, capture_plans,
        source_provenance, ordered_rows, null_safe_dimensions, metric_candidates, recovered_values, section_parents, segment_classes, block_topology, selection_summary,
    )
}

_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_V = "v AS (SELECT logical_asset_id, capture_id, row_number() OVER (PARTITION BY logical_asset_id ORDER BY created_at, capture_id) AS capture_version FROM (SELECT *, sha256(concat_ws(chr(31), " + ", ".join(_ID.format(x) for x in rg.IDENTITY) + ")) AS logical_asset_id FROM captures))"
_LONGEST = "CASE " + " ".join(f"WHEN contains(content, '{i}') THEN '{i}'" for i in sorted(ITEMS, key=lambda x: (len(x), x), reverse=True)) + " END"
_LINES = "ln AS (SELECT doc_id AS page_id, unnest(range(len(s))) AS line, trim(unnest(s)) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))"
_REFS = rf"{_LINES}, it AS (SELECT *, {_LONGEST} AS item FROM ln), rf AS (SELECT *, regexp_extract(substr(content, strpos(content, item) + length(item)), '(?:附注\s*)?(\d{{1,2}})(?:\D|$)', 1) AS n FROM it WHERE item IS NOT NULL), refs AS (SELECT page_id, line, item, n::INT AS note FROM rf WHERE n <> '')"
SQL = {
    "note_references": f"WITH {_REFS} SELECT page_id, line, item, note FROM refs",
    "review_inbox": f"WITH {_V}, r AS (SELECT 'R-' || capture_id AS review_item_id, *, CASE boundary_status WHEN 'TRUNCATED' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 3 END AS k FROM captures WHERE boundary_status <> 'COMPLETE' OR header_dimension_status <> 'OK') SELECT review_item_id, CASE k WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity, v.capture_version, r.table_query, p.filename FROM r JOIN v USING (capture_id) LEFT JOIN pdf_assets p ON p.pdf_id = r.pdf_id ORDER BY k, r.updated_at DESC NULLS LAST, review_item_id LIMIT 40",
    "recent_captures": "SELECT capture_id FROM captures WHERE updated_at >= (SELECT max(updated_at) FROM captures) - INTERVAL 30 DAY",
    "batch_progress": "SELECT batch_id, count(*) AS jobs, count(DISTINCT capture_id) AS assets, count(*) FILTER (coalesce(merge_ready, 0) <> 1) AS failed, count(DISTINCT table_family_id) AS research_batches FROM captures WHERE batch_id IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT capture_id), count(*) FILTER (coalesce(merge_ready, 0) <> 1), 0 FROM captures WHERE batch_id IS NULL HAVING count(*) > 0",
    "rerun_candidates": "WITH p AS (SELECT pdf_id, table_family_id FROM captures WHERE pdf_id IS NOT NULL AND table_family_id IS NOT NULL GROUP BY 1, 2 HAVING max(note_number) IS NOT NULL), l AS (SELECT pdf_id, table_family_id, CASE WHEN merge_ready = 1 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM captures WHERE merge_ready = 1 OR is_trashed = 0 QUALIFY row_number() OVER (PARTITION BY pdf_id, table_family_id ORDER BY created_at DESC, capture_id DESC) = 1) SELECT p.*, coalesce(l.status, 'NOT_RUN') AS status FROM p LEFT JOIN l USING (pdf_id, table_family_id) WHERE l.status IS NULL OR l.status = 'FAILED'",
    "capture_usage": " UNION ALL ".join(f"SELECT capture_id, '{k}' AS kind, count(*) AS n FROM {t} WHERE capture_id IN (SELECT capture_id FROM captures WHERE is_trashed = 1) GROUP BY 1" for k, t in (("SEGMENT", "table_segments"), ("COLUMN", "table_columns"), ("READING", "numeric_tokens"))),
    "schema_variants": "WITH r AS (SELECT pdf_id, CASE WHEN merge_ready = 1 THEN CASE table_family_id WHEN 'FAM-01' THEN 'L' WHEN 'FAM-02' THEN 'V' WHEN 'FAM-03' THEN 'I' ELSE 'O' END END AS k FROM captures), g AS (SELECT pdf_id, count(*) FILTER (k = 'L') > 0 AS l, count(*) FILTER (k = 'V') > 0 AS v, count(*) FILTER (k = 'I') > 0 AS i, count(*) FILTER (k <> 'L') > 0 AS n FROM r GROUP BY 1) SELECT pdf_id, CASE WHEN NOT l AND NOT n THEN 'NO_MATCH' WHEN l AND NOT n THEN 'LEGACY_COMBINED' WHEN l THEN 'MIXED_REVIEW_REQUIRED' WHEN v AND i THEN 'SPLIT_COMPONENTS' ELSE 'PARTIAL_COMPONENTS_REVIEW_REQUIRED' END AS variant FROM g",
    "capture_plans": "WITH x AS (SELECT DISTINCT pdf_id, table_family_id, note_number, table_query FROM captures WHERE pdf_id IS NOT NULL) SELECT pdf_id, table_family_id, count(*) AS n_members, string_agg(concat_ws('~', note_number, table_query), '|' ORDER BY note_number NULLS FIRST, table_query NULLS FIRST) AS members FROM x GROUP BY 1, 2",
    "source_provenance": f"WITH {_O}, k AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY observation_id) AS k, count(*) OVER (PARTITION BY source_key) AS n FROM o) SELECT source_key, ((k - 1) // 50)::INT AS chunk, max(n) AS n_sources, string_agg(concat_ws(':', capture_run_id, 'p' || page, raw_item), ' | ' ORDER BY k) AS source_rows FROM k GROUP BY 1, 2",
    "ordered_rows": f"WITH {_O} SELECT observation_id, e.canonical_order FROM o LEFT JOIN (SELECT normalized_item, min(row_order) AS canonical_order FROM structure_edges GROUP BY 1) e USING (normalized_item)",
    "null_safe_dimensions": f"WITH {_O} SELECT observation_id, min(observation_id) OVER (PARTITION BY data_year, statement_scope, restated_flag, period_type) AS first_id FROM o",
    "recovered_values": f"""WITH {_O}, r0 AS (SELECT capture_run_id AS page_id, column_ordinal, row_order AS row, min(normalized_item) AS l, min(value) AS v FROM o GROUP BY 1, 2, 3), r AS (SELECT page_id, column_ordinal, row, CASE WHEN row % 7 = 0 THEN '' ELSE coalesce(l, '') END AS label, CASE WHEN row % 5 <> 0 THEN v END AS value FROM r0),
n AS (SELECT *, coalesce(CASE WHEN lead(label, 1) OVER w = '' THEN lead(value, 1) OVER w END, CASE WHEN lag(label, 1) OVER w = '' THEN lag(value, 1) OVER w END, CASE WHEN lead(label, 2) OVER w = '' THEN lead(value, 2) OVER w END, CASE WHEN lag(label, 2) OVER w = '' THEN lag(value, 2) OVER w END) AS near FROM r WINDOW w AS (PARTITION BY page_id, column_ordinal ORDER BY row)),
s AS (SELECT page_id, column_ordinal, label, arg_min(value, row) AS same FROM r WHERE label <> '' AND value IS NOT NULL GROUP BY 1, 2, 3) SELECT n.page_id, n.column_ordinal, n.row, n.label, coalesce(value, near, same) AS value, CASE WHEN value IS NOT NULL THEN 'OWN' WHEN near IS NOT NULL THEN 'NEIGHBOUR' WHEN same IS NOT NULL THEN 'SAME_LABEL' ELSE 'NONE' END AS value_source FROM n LEFT JOIN s USING (page_id, column_ordinal, label) WHERE n.label <> ''""",
    "section_parents": f"WITH e AS (SELECT capture_id, row_order, min(normalized_item) AS label, min(row_path) AS p FROM structure_edges GROUP BY 1, 2), x AS (SELECT *, list_extract(string_split(p, ' / '), -2) AS sec FROM e) SELECT x.capture_id, x.row_order, max(q.row_order) AS parent FROM x LEFT JOIN e q ON q.capture_id = x.capture_id AND q.label = x.sec AND q.row_order < x.row_order AND {_ID.format('x.sec')} <> '' GROUP BY 1, 2",
    "segment_classes": "WITH s AS (SELECT capture_id, segment_id, min(pdf_page_number) AS page, min(note_identity) AS header FROM table_segments GROUP BY 1, 2), x AS (SELECT *, lag(header) OVER w AS b, lag(page) OVER w AS pb, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY capture_id ORDER BY page, segment_id)) SELECT capture_id, segment_id, CASE WHEN k = 1 THEN 'PRIMARY' WHEN header = b IS NULL THEN 'UNRESOLVED' WHEN header = b AND page = pb + 1 THEN 'CONTINUATION' WHEN header = b THEN 'PEER' ELSE 'SUPPLEMENTARY' END AS segment_class FROM x",
    "block_topology": f"WITH {_O}, n AS (SELECT capture_run_id AS capture_id, member_table_order AS block_order, row_order, count(DISTINCT column_ordinal) AS c FROM o GROUP BY 1, 2, 3) SELECT capture_id, block_order, min(c) AS least, max(c) AS most, count(*) AS n_rows, min(c) = max(c) AS consistent FROM n GROUP BY 1, 2",
    "selection_summary": f"SELECT count(*) AS n, count(DISTINCT company) AS companies, count(DISTINCT document_year) AS years, count(*) FILTER ({_ID.format('company')} = '' OR {_ID.format('table_family_id')} = '') AS incomplete, count(*) FILTER (merge_ready = 1) AS ready FROM captures",
}
SQL["contents_pages"] = rf"""WITH x AS (SELECT doc_id AS page_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1:36] AS ls, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS c FROM documents),
y AS (SELECT *, lower(regexp_replace(array_to_string(ls, ''), '\s+', '', 'g')) AS head FROM x)
SELECT page_id, contains(head, '目录') OR contains(head, 'contents') OR (len(list_filter(ls, lambda l: regexp_matches(l, '[.．·…]{{3,}}'))) >= 2 AND len(list_filter(ls, lambda l: regexp_matches(trim(l), '\d{{1,4}}$'))) >= 3) AS is_contents,
 CASE WHEN {" OR ".join(f"contains(c, '{w}')" for w in pg.STATEMENTS["INCOME"])} THEN round(least(0.99::DOUBLE, 0.58::DOUBLE + least(0.22::DOUBLE, ({" + ".join(f"contains(c, '{w}')::INT" for w in pg.STRUCTURE_WORDS)}) * 0.04::DOUBLE)
  + CASE WHEN regexp_matches(c, '20\d{{2}}年|年\d{{1,2}}月\d{{1,2}}日|期末|期初') THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(c, '人民币[元万千]|单位[:：]?(?:元|万元|千元|百万元)') THEN 0.06 ELSE 0 END::DOUBLE), 4) ELSE 0.0 END::DOUBLE AS income_score FROM y"""


def _sql_number(x: str) -> str:
    """0 to 999 from digits or Chinese numerals."""

    def digit(t: str, missing: int) -> str:
        return f"CASE WHEN regexp_matches({t}, '^[零〇一二三四五六七八九]$') THEN try_cast(translate({t}, '零〇一二三四五六七八九', '00123456789') AS INT) ELSE {missing} END"

    def below(t: str) -> str:
        left, right = f"split_part({t}, '十', 1)", f"regexp_replace({t}, '^[^十]*十', '')"
        tens = f"(CASE WHEN {left} = '' THEN 1 ELSE {digit(left, 1)} END) * 10 + (CASE WHEN {right} = '' THEN 0 ELSE {digit(right, 0)} END)"
        return f"CASE WHEN regexp_matches({t}, '^\\d+$') THEN try_cast({t} AS INT) WHEN contains({t}, '十') THEN {tens} WHEN regexp_matches({t}, '^[零〇一二三四五六七八九]+$') THEN try_cast(translate({t}, '零〇一二三四五六七八九', '00123456789') AS INT) END"

    rest = f"regexp_replace({x}, '^[^百]*百', '')"
    hundreds = digit(f"split_part({x}, '百', 1)", 1)
    return f"CASE WHEN contains({x}, '百') THEN {hundreds} * 100 + coalesce(CASE WHEN {rest} = '' THEN 0 ELSE {below(rest)} END, 0) ELSE {below(x)} END"


_HEADING = r"^[（(]?(\d{1,3}|[零〇一二三四五六七八九十百]{1,5})[）)]?(?:[.．、:：])?(.+?)$"
_HEADS = rf"""hl AS (SELECT doc_id AS page_id, unnest(range(len(s))) AS line, regexp_replace(unnest(s), '\s+', '', 'g') AS c FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
hx AS (SELECT *, regexp_extract(c, '{_HEADING}', 1) AS num, regexp_extract(c, '{_HEADING}', 2) AS title FROM hl WHERE regexp_matches(c, '{_HEADING}') AND NOT regexp_matches(c, '^\d+(?:个)?(?:月|日|天|年)(?:至|到|以上|以内|以下|—|–|-)')),
hd AS (SELECT page_id, line, {_sql_number('num')} AS ordinal, title FROM hx), heads AS (SELECT * FROM hd WHERE ordinal IS NOT NULL AND regexp_matches(title, '[A-Za-z\x{{4E00}}-\x{{9FFF}}]') AND NOT regexp_matches(title, '(?i)^[+\-−(（]?\d|^(?:人民币|RMB|USD)\d'))"""
SQL["note_heading_lines"] = f"WITH {_HEADS} SELECT page_id, line, ordinal, title FROM heads"
SQL["located_notes"] = rf"""WITH {_REFS}, {_HEADS}, w AS (SELECT DISTINCT item, note, {sql_norm('item')} AS n FROM refs), h AS (SELECT *, {sql_norm('title')} AS t FROM heads),
f AS (SELECT item, note, page_id, line, 0.98 AS c, CASE WHEN t = n THEN 0.28 WHEN starts_with(t, n) THEN 0.24 ELSE 0.14 END AS g FROM w JOIN h ON h.ordinal = w.note AND contains(t, n) UNION ALL SELECT item, note, page_id, line, 0.90, 0.28 FROM w JOIN h ON t = n),
b AS (SELECT item, note, min((-c, -g, page_id, line)) AS m FROM f GROUP BY 1, 2) SELECT w.item, w.note, m[3] AS page_id, m[4] AS line, coalesce(-m[1], 0)::DOUBLE AS confidence FROM w LEFT JOIN b USING (item, note)"""
_MEMBER = "CASE " + " ".join(f"WHEN starts_with(content, '{i}') THEN '{i}'" for i in sorted(ITEMS, key=lambda x: (len(x), x), reverse=True)) + " END"
SQL["statement_member_rows"] = rf"""WITH {_LINES}, m AS (SELECT *, {_MEMBER} AS member, len(regexp_extract_all(content, '(\d[\d,]*(?:\.\d+)?)', 1)) AS n FROM ln),
g AS (SELECT page_id, count(DISTINCT member) AS members, min(line) AS first_line, sum(n)::BIGINT AS amounts, string_agg(DISTINCT member, '|' ORDER BY member) AS labels FROM m WHERE member IS NOT NULL GROUP BY 1),
r AS (SELECT *, regexp_matches(labels, '{"|".join(text.NEW_REGIME)}') AS a, regexp_matches(labels, '{"|".join(text.LEGACY_REGIME)}') AS b FROM g)
SELECT page_id, members, first_line, amounts, labels, CASE WHEN a AND b THEN '{text.REGIMES[0]}' WHEN a THEN '{text.REGIMES[1]}' WHEN b THEN '{text.REGIMES[2]}' ELSE 'UNKNOWN' END AS regime FROM r"""
