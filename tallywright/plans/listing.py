"""Registered queries of lists, resynchronisation, append-only layers and multi-table review builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.operators import inbox as ib
from tallywright.operators import long_form as lf
from tallywright.operators import pages as pg
from tallywright.operators import registry as rg
from tallywright.operators import structure as st
from tallywright.operators.observations import latest_delivery
from tallywright.plans.reviewing import _HEADS, _REFS, ITEMS
from tallywright.plans.scalars import sql_norm
from tallywright.sources.tables import table


def _c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captures")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")


def control_lists(spark: SparkSession, d: str) -> DataFrame:
    """SC13, SC14, FI28-FI31, FI36: newest batches that are not all trashed, captures of the newest batch, newest jobs of a status, merges by trash flag, reviews of one capture's pdf."""
    c = _c(spark, d)
    b = rg.batch_summary(c).where("batch_status <> 'TRASHED'").select(F.col("batch_id").alias("id"), F.col("last_created").alias("at"))
    jobs = c.where("merge_ready = 0").select(F.col("capture_id").alias("id"), F.col("updated_at").alias("at"))
    merges = rg.filter_captures(c, only_trash=True).groupBy(F.col("table_family_id").alias("id")).agg(F.max("created_at").alias("at")).where("id IS NOT NULL")
    reviews = c.where("boundary_status <> 'COMPLETE'").select(F.col("capture_id").alias("id"), F.coalesce("updated_at", "created_at").alias("at"))
    out = None
    for name, rows in (("BATCH", b), ("JOB", jobs), ("MERGE", merges), ("REVIEW", reviews)):
        one = rg.newest(rows, "at", "id", 30).select(F.lit(name).alias("list"), "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))
        out = one if out is None else out.unionByName(one)
    return out


def pdf_resync(spark: SparkSession, d: str) -> DataFrame:
    """SC18: the stored table holds every file but the newest of each content; the scan sees those of known size."""
    p = table(spark, d, "pdf_assets").select("pdf_id", "filename", "size_bytes", "sha256")
    newest = Window.partitionBy("sha256").orderBy(F.desc("pdf_id"))
    stored = p.withColumn("k", F.row_number().over(newest)).where("k > 1").drop("k", "sha256")
    seen = p.where("size_bytes IS NOT NULL").drop("sha256").withColumn("size_bytes", F.when(F.col("size_bytes") > 5_000_000, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return rg.resync(stored, seen, ["pdf_id"])


def appended_discoveries(spark: SparkSession, d: str) -> DataFrame:
    """GV12-GV14: segments of the first page of a table are stored; all segments arrive, the stored ones unchanged."""
    s = table(spark, d, "table_segments").groupBy("segment_id").agg(F.min("capture_id").alias("capture_id"), F.min("confidence").alias("confidence"), F.min("continuation_of_segment_id").alias("before"))
    return rg.append_once(s.where("before IS NULL").drop("before"), s.drop("before"), ["segment_id"])


def stale_merges(spark: SparkSession, d: str) -> DataFrame:
    """GV8: merges of one family each over its captures; truncated captures have changed."""
    c = _c(spark, d).where("table_family_id IS NOT NULL")
    s = c.select(F.col("table_family_id").alias("merge_id"), "capture_id")
    return rg.stale_merges(s.select("merge_id").distinct().withColumn("status", F.lit("CURRENT")), s, c.where("boundary_status = 'TRUNCATED'"))


def archived_children(spark: SparkSession, d: str) -> DataFrame:
    """GV10: segments of trashed captures."""
    return rg.cascade_archive(table(spark, d, "table_segments").select("segment_id", "capture_id"), _c(spark, d).where("is_trashed = 1"), "capture_id").select("segment_id", "parent_archived")


def replaced_sources(spark: SparkSession, d: str) -> DataFrame:
    """GV4: merges by batch; batches with a trashed capture are merged anew from their live captures."""
    w = Window.partitionBy("batch_id").orderBy("created_at", "capture_id")
    c = _c(spark, d).where("batch_id IS NOT NULL")
    cols = lambda x: x.select(F.col("batch_id").alias("merge_id"), F.row_number().over(w).alias("source_order"), "capture_id")
    hit = c.where("is_trashed = 1").select("batch_id").distinct()
    return rg.replaced_sources(cols(c), cols(c.where("is_trashed = 0").join(hit, "batch_id", "left_semi")))


def persisted_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """GV17: the rulebook as a taxonomy with its aliases; typed queries that equal a name are confirmed."""
    m = table(spark, d, "metric_aliases")
    tax = m.select(F.lit("S").alias("section"), F.col("canonical_name").alias("item"), F.col("aliases").alias("source_keys"))
    q = _c(spark, d).where("table_query IS NOT NULL").select(F.lit("S").alias("canonical_section"), F.col("table_query").alias("canonical_item"), F.concat(F.lit("UNIQUE||"), "table_query").alias("row_key"), F.when(F.col("merge_ready") == 1, "CONFIRMED").otherwise("PENDING").alias("mapping_status"))
    return rg.persisted_taxonomy(tax, q).select("section", "item", F.array_join("source_keys", "|").alias("source_keys"))


def dedup_anchors(spark: SparkSession, d: str) -> DataFrame:
    """AG29: captures of one pdf and query as anchor candidates; their segments are the children, the program version is the strategy."""
    n = table(spark, d, "table_segments").groupBy("capture_id").agg(F.count("*").alias("n_children"))
    c = _c(spark, d).join(n, "capture_id", "left").select("pdf_id", "table_query", F.col("capture_id").alias("candidate_id"), "n_children", F.col("producer_version").alias("strategy"))
    return rg.dedup_anchors(c, ["pdf_id", "table_query"])


def batch_tables(spark: SparkSession, d: str) -> DataFrame:
    return rg.table_names(_c(spark, d))


def column_review(spark: SparkSession, d: str) -> DataFrame:
    """PR29: totals count as derived."""
    o = latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at").where("row_order < 5000")
    return lf.column_review(o.select(F.col("capture_run_id").alias("capture_id"), "row_order", "column_ordinal", "value", st.is_total(F.col("normalized_item")).alias("is_derived")), table(spark, d, "table_columns"))


def review_build(spark: SparkSession, d: str) -> DataFrame:
    """JO13, JO11: distinct reviews of a batch over captures, versions, segments, columns and pdfs."""
    c, v = _c(spark, d), rg.versions(_c(spark, d))
    r = c.where("boundary_status <> 'COMPLETE'").select("capture_id", "batch_id", "pdf_id", "boundary_status")
    s = table(spark, d, "table_segments").where("confidence = 'LOW'").select("capture_id").distinct()
    t = table(spark, d, "table_columns").where("data_year IS NULL").select("capture_id").distinct()
    j = r.join(v.where("is_current").select("capture_id", "logical_asset_id"), "capture_id").join(s, "capture_id").join(t, "capture_id").join(table(spark, d, "pdf_assets").select("pdf_id", "filename"), "pdf_id")
    return j.select("logical_asset_id", "batch_id", "filename", "boundary_status").distinct()


def mapping_workspace(spark: SparkSession, d: str) -> DataFrame:
    """JO15, JO17: every pdf with the newest capture of each of its families and that capture's best segment; pdfs and captures without one stay."""
    newest = rg.top_per_key(_c(spark, d).where("pdf_id IS NOT NULL"), ["pdf_id", "table_family_id"], [F.col("created_at").desc(), F.col("capture_id").desc()]).select("pdf_id", "table_family_id", "capture_id", "merge_ready")
    best = table(spark, d, "table_segments").groupBy("capture_id").agg(F.min(F.struct(F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2).alias("k"), "segment_id")).alias("m")).select("capture_id", F.col("m.segment_id").alias("segment_id"))
    j = table(spark, d, "pdf_assets").select("pdf_id").join(newest, "pdf_id", "left").join(best, "capture_id", "left")
    return j.select("pdf_id", "table_family_id", "capture_id", "segment_id", F.when(F.col("capture_id").isNull(), "NO_CAPTURE").when(F.col("segment_id").isNull(), "NO_CANDIDATE").when(F.col("merge_ready") == 1, "READY").otherwise("REVIEW").alias("state"))


def plan_view(spark: SparkSession, d: str) -> DataFrame:
    """JO21: captures of a batch as members with the role PLAN, joined to the plan of their pdf and family."""
    plans = ib.plans_from_links(_c(spark, d).where("pdf_id IS NOT NULL"), ["pdf_id", "table_family_id"], ["note_number", "table_query"]).select("pdf_id", "table_family_id", "n_members")
    members = _c(spark, d).where("batch_id IS NOT NULL AND merge_ready = 1").select("batch_id", "capture_id", "pdf_id", "table_family_id")
    return members.join(plans, ["pdf_id", "table_family_id"]).select("batch_id", "capture_id", "n_members")


def rows_with_structure(spark: SparkSession, d: str) -> DataFrame:
    """JO8: every observation with the parent and confidence of its row; rows without structure stay."""
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("row_path").alias("row_path"), F.min("normalized_item").alias("label"))
    tree = st.parents_by_level(e.select("capture_id", "row_order", st.level_of(F.col("row_path")).alias("level"), st.is_total(F.col("label")).alias("is_total"), "label")).select(F.col("capture_id").alias("capture_run_id"), "row_order", "parent_row_order", "confidence")
    o = latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at").select("observation_id", "capture_run_id", "row_order")
    return o.join(tree, ["capture_run_id", "row_order"], "left").select("observation_id", "parent_row_order", "confidence")


def statement_note_edges(spark: SparkSession, d: str) -> DataFrame:
    """RK17: edges from a statement line to the heading of the note it refers to; lines whose note is not found have none."""
    refs = pg.note_references(_docs(spark, d), ITEMS)
    found = pg.locate_notes(_docs(spark, d), refs.select("item", "note")).where("page_id IS NOT NULL").select("item", "note", F.col("page_id").alias("note_page"), F.col("line").alias("note_line"), "confidence")
    return refs.join(found, ["item", "note"]).select("page_id", "line", "item", "note", "note_page", "note_line", "confidence")


def statement_pages(spark: SparkSession, d: str) -> DataFrame:
    """RK14, RK15: pages that name a statement in their head, by title where any is."""
    return pg.primary_pages(pg.section_pages(_docs(spark, d), pg.STATEMENTS))


def note_index(spark: SparkSession, d: str) -> DataFrame:
    """RK28: numbered headings of every page with their place on it."""
    from tallywright.operators.retrieval import note_lines

    return note_lines(_docs(spark, d)).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("line"))).select("page_id", "place", "line", "ordinal", "title")


def trimmed_wide(spark: SparkSession, d: str) -> DataFrame:
    """PR14: the wide table of captures cut to item, unit and value columns."""
    o = latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")
    w = lf.capture_wide(o, range(1, 6))
    return w.select(F.col("capture_run_id").alias("member"), "row_order", "item", "unit", *(c for c in w.columns if c.startswith("col_")))


QUERIES = {
    f.__name__: f
    for f in (
        control_lists, pdf_resync, appended_discoveries, stale_merges, archived_children, replaced_sources, persisted_taxonomy, dedup_anchors, batch_tables, column_review, review_build, mapping_workspace, plan_view,
        rows_with_structure, statement_note_edges, statement_pages, note_index, trimmed_wide,
    )
}

_TRASH = "(is_trashed = 1 OR lifecycle_status = 'TRASHED')"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_TOTAL = "coalesce(regexp_matches({0}, '合计|总计|小计|总额'), false)"
_ASSET = "sha256(concat_ws(chr(31), " + ", ".join(_ID.format(x) for x in rg.IDENTITY) + "))"


def _listed(name: str, source: str) -> str:
    return f"(SELECT '{name}' AS list, id, {_TS.format('at_')} AS at FROM ({source}) ORDER BY at_ DESC NULLS LAST, id LIMIT 30)"


SQL = {
    "control_lists": " UNION ALL ".join(
        (
            _listed("BATCH", f"SELECT batch_id AS id, max(created_at) AS at_ FROM captures WHERE {_ID.format('batch_id')} <> '' GROUP BY 1 HAVING count(*) FILTER (lifecycle_status IN ('ACTIVE', 'INVALIDATED') AND is_trashed = 0) > 0 OR count(*) FILTER {_TRASH} = 0"),
            _listed("JOB", "SELECT capture_id AS id, updated_at AS at_ FROM captures WHERE merge_ready = 0"),
            _listed("MERGE", f"SELECT table_family_id AS id, max(created_at) AS at_ FROM captures WHERE {_TRASH} AND table_family_id IS NOT NULL GROUP BY 1"),
            _listed("REVIEW", "SELECT capture_id AS id, coalesce(updated_at, created_at) AS at_ FROM captures WHERE boundary_status <> 'COMPLETE'"),
        )
    ),
    "pdf_resync": """WITH a AS (SELECT pdf_id, filename, size_bytes FROM pdf_assets QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY pdf_id DESC) > 1), b AS (SELECT pdf_id, filename, CASE WHEN size_bytes > 5000000 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM pdf_assets WHERE size_bytes IS NOT NULL)
SELECT pdf_id, CASE WHEN b.filename IS NULL THEN a.filename ELSE b.filename END AS filename, CASE WHEN b.filename IS NULL THEN a.size_bytes ELSE b.size_bytes END AS size_bytes,
 CASE WHEN b.filename IS NULL THEN 'REMOVED' WHEN a.filename IS NULL THEN 'ADDED' WHEN a.filename = b.filename AND a.size_bytes IS NOT DISTINCT FROM b.size_bytes THEN 'UNCHANGED' ELSE 'CHANGED' END AS sync_state FROM a FULL OUTER JOIN b USING (pdf_id)""",
    "appended_discoveries": "SELECT segment_id, min(capture_id) AS capture_id, min(confidence) AS confidence FROM table_segments GROUP BY 1 HAVING min(continuation_of_segment_id) IS NOT NULL",
    "stale_merges": "SELECT table_family_id AS merge_id, CASE WHEN count(*) FILTER (boundary_status = 'TRUNCATED') > 0 THEN 'STALE' ELSE 'CURRENT' END AS status, count(*) FILTER (boundary_status = 'TRUNCATED') AS n_changed FROM captures WHERE table_family_id IS NOT NULL GROUP BY 1",
    "archived_children": "SELECT s.segment_id, coalesce(c.is_trashed = 1, false) AS parent_archived FROM table_segments s LEFT JOIN captures c USING (capture_id)",
    "replaced_sources": """WITH hit AS (SELECT DISTINCT batch_id FROM captures WHERE is_trashed = 1 AND batch_id IS NOT NULL AND batch_id IN (SELECT batch_id FROM captures WHERE is_trashed = 0))
SELECT batch_id AS merge_id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at NULLS FIRST, capture_id) AS source_order, capture_id FROM captures WHERE batch_id IS NOT NULL AND (batch_id NOT IN (SELECT batch_id FROM hit) OR is_trashed = 0)""",
    "persisted_taxonomy": """WITH k AS (SELECT 'S' AS section, canonical_name AS item, unnest(CASE WHEN len(coalesce(aliases, [])) = 0 THEN [NULL] ELSE aliases END) AS key FROM metric_aliases UNION ALL SELECT 'S', table_query, 'UNIQUE||' || table_query FROM captures WHERE table_query IS NOT NULL AND merge_ready = 1)
SELECT section, item, coalesce(string_agg(DISTINCT key, '|' ORDER BY key), '') AS source_keys FROM k GROUP BY 1, 2""",
    "dedup_anchors": """WITH n AS (SELECT capture_id, count(*) AS n FROM table_segments GROUP BY 1), c AS (SELECT captures.*, n.n FROM captures LEFT JOIN n USING (capture_id))
SELECT pdf_id, table_query, arg_min(capture_id, (-coalesce(n, 0), capture_id)) AS candidate_id, (list(n ORDER BY -coalesce(n, 0), capture_id))[1] AS n_children, coalesce(string_agg(DISTINCT producer_version, '|' ORDER BY producer_version), '') AS strategies, count(*) AS duplicate_count FROM c GROUP BY 1, 2""",
    "batch_tables": f"""WITH x AS (SELECT CASE WHEN {_ID.format('batch_id')} <> '' THEN batch_id ELSE 'LEGACY_SINGLE::' || capture_id END AS batch, coalesce(lifecycle_status, 'UNKNOWN') AS status, table_query FROM captures), s AS (SELECT batch, status, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT batch, table_query, row_number() OVER (PARTITION BY batch ORDER BY table_query) AS k FROM (SELECT DISTINCT batch, table_query FROM x WHERE table_query IS NOT NULL))
SELECT s.batch, sum(n)::BIGINT AS captures, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS statuses, any_value(l.tables) AS tables FROM s LEFT JOIN (SELECT batch, string_agg(table_query, '|' ORDER BY k) AS tables FROM t WHERE k <= 3 GROUP BY 1) l USING (batch) GROUP BY 1""",
    "column_review": f"""WITH {_O}, v AS (SELECT capture_run_id AS capture_id, row_order, column_ordinal, max(value) AS value FROM o WHERE row_order < 5000 AND value IS NOT NULL AND NOT {_TOTAL.format('normalized_item')} GROUP BY 1, 2, 3),
one AS (SELECT capture_id, ordinal, min(data_year) AS y FROM table_columns GROUP BY 1, 2), w AS (SELECT *, lag(y) OVER (PARTITION BY capture_id ORDER BY ordinal) AS b FROM one), c AS (SELECT capture_id, count(*) AS nc, max(ordinal) AS last, count(*) FILTER (b < y) AS rising FROM w GROUP BY 1),
r AS (SELECT capture_id, row_order, count(*) AS n, max((value = floor(value) AND value BETWEEN 2000 AND 2099)::INT) AS yl, max(column_ordinal) AS top FROM v GROUP BY 1, 2),
j AS (SELECT capture_id, max((n <> nc)::INT) AS co, max(yl) AS yl, max(rising) AS rising, count(*) FILTER (top >= last) * 2 < count(*) AS sparse FROM r JOIN c USING (capture_id) GROUP BY 1)
SELECT capture_id, coalesce(concat_ws('|', CASE WHEN co = 1 THEN 'VALUE_COLUMN_COUNT_MISMATCH' END, CASE WHEN yl = 1 THEN 'NUMERIC_TOKEN_ORIGIN_AMBIGUOUS' END, CASE WHEN rising > 0 THEN 'PERIOD_COLUMN_SWAP_RISK' END, CASE WHEN sparse THEN 'LAST_COLUMN_SPARSE' END), '') AS issues FROM j""",
    "review_build": f"""WITH v AS (SELECT capture_id, {_ASSET} AS logical_asset_id FROM captures QUALIFY row_number() OVER (PARTITION BY {_ASSET} ORDER BY created_at DESC NULLS LAST, capture_id DESC) = 1)
SELECT DISTINCT v.logical_asset_id, c.batch_id, p.filename, c.boundary_status FROM captures c JOIN v USING (capture_id) JOIN pdf_assets p ON p.pdf_id = c.pdf_id WHERE c.boundary_status <> 'COMPLETE' AND c.capture_id IN (SELECT capture_id FROM table_segments WHERE confidence = 'LOW') AND c.capture_id IN (SELECT capture_id FROM table_columns WHERE data_year IS NULL)""",
    "mapping_workspace": """WITH n AS (SELECT pdf_id, table_family_id, capture_id, merge_ready FROM captures WHERE pdf_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_id, table_family_id ORDER BY created_at DESC, capture_id DESC) = 1),
b AS (SELECT capture_id, arg_min(segment_id, (CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, segment_id)) AS segment_id FROM table_segments GROUP BY 1)
SELECT p.pdf_id, table_family_id, n.capture_id, segment_id, CASE WHEN n.capture_id IS NULL THEN 'NO_CAPTURE' WHEN segment_id IS NULL THEN 'NO_CANDIDATE' WHEN merge_ready = 1 THEN 'READY' ELSE 'REVIEW' END AS state FROM pdf_assets p LEFT JOIN n ON n.pdf_id = p.pdf_id LEFT JOIN b ON b.capture_id = n.capture_id""",
    "plan_view": "WITH p AS (SELECT pdf_id, table_family_id, count(*) AS n_members FROM (SELECT DISTINCT pdf_id, table_family_id, note_number, table_query FROM captures WHERE pdf_id IS NOT NULL) GROUP BY 1, 2) SELECT batch_id, capture_id, n_members FROM captures JOIN p USING (pdf_id, table_family_id) WHERE batch_id IS NOT NULL AND merge_ready = 1",
    "rows_with_structure": f"""WITH {_O}, r AS (SELECT capture_id, row_order, coalesce(len(string_split(min(row_path), ' / ')) - 1, 0) AS level, {_TOTAL.format('min(normalized_item)')} AS is_total FROM structure_edges GROUP BY 1, 2),
p AS (SELECT c.*, (SELECT max(p.row_order) FROM r p WHERE p.capture_id = c.capture_id AND p.row_order < c.row_order AND p.level < c.level AND NOT p.is_total AND NOT EXISTS (SELECT 1 FROM r q WHERE q.capture_id = c.capture_id AND q.row_order > p.row_order AND q.row_order < c.row_order AND q.level <= p.level)) AS pr FROM r c)
SELECT observation_id, pr AS parent_row_order, CASE WHEN p.row_order IS NULL THEN NULL WHEN is_total THEN 0.72 WHEN level > 0 AND pr IS NOT NULL THEN 0.66 ELSE 0.35 END::DOUBLE AS confidence FROM o LEFT JOIN p ON p.capture_id = o.capture_run_id AND p.row_order = o.row_order""",
    "statement_note_edges": rf"""WITH {_REFS}, {_HEADS}, w AS (SELECT DISTINCT item, note, {sql_norm('item')} AS n FROM refs), h AS (SELECT *, {sql_norm('title')} AS t FROM heads),
f AS (SELECT item, note, page_id, line, 0.98 AS c, CASE WHEN t = n THEN 0.28 WHEN starts_with(t, n) THEN 0.24 ELSE 0.14 END AS g FROM w JOIN h ON h.ordinal = w.note AND contains(t, n) UNION ALL SELECT item, note, page_id, line, 0.90, 0.28 FROM w JOIN h ON t = n),
b AS (SELECT item, note, min((-c, -g, page_id, line)) AS m FROM f GROUP BY 1, 2) SELECT refs.page_id, refs.line, refs.item, refs.note, m[3] AS note_page, m[4] AS note_line, (-m[1])::DOUBLE AS confidence FROM refs JOIN b USING (item, note)""",
    "statement_pages": r"WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{'|'.join(w)}')" for k, w in pg.STATEMENTS.items()) + r""") t(kind, words)), f AS (SELECT kind, doc_id AS page_id, regexp_matches(array_to_string(string_split(text, chr(10))[1:32], chr(10)), '(?m)(' || words || ')\s*(?:[(（][^\n]*[)）])?[:：]?\s*$') AS titled FROM documents, k WHERE regexp_matches(left(coalesce(text, ''), 2500), words))
SELECT kind, page_id FROM f WHERE titled OR NOT (SELECT bool_or(g.titled) FROM f g WHERE g.kind = f.kind)""",
    "note_index": f"WITH {_HEADS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line) AS place, line, ordinal, title FROM heads",
    "trimmed_wide": f"WITH {_O}, w AS (SELECT capture_run_id, row_order, min(normalized_item) AS item, list_sort(list_distinct(list(CASE WHEN {_ID.format('unit')} <> '' THEN {_ID.format('unit')} END))) AS u, " + ", ".join(f"arg_min(value, observation_id) FILTER (column_ordinal = {k} AND value IS NOT NULL) AS col_{k}" for k in range(1, 6)) + " FROM o GROUP BY 1, 2) SELECT capture_run_id AS member, row_order, item, coalesce(CASE WHEN len(u) = 0 THEN '' WHEN len(u) = 1 THEN u[1] ELSE 'REVIEW_REQUIRED[' || array_to_string(u, '|') || ']' END, '') AS unit, col_1, col_2, col_3, col_4, col_5 FROM w",
}
