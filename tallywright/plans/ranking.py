"""Registered queries of retrieval, ranking and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import retrieval as rt
from tallywright.operators import sequences as sq
from tallywright.plans.scalars import sql_norm
from tallywright.session import small
from tallywright.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")


def page_retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    return rt.top_pages(rt.score_pages(_pages(spark, d), rt.search_terms(table(spark, d, "metric_aliases"))))


def page_neighbours(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    last = p.agg(F.max("page_id").alias("last"))
    return rt.with_neighbours(page_retrieval_topk(spark, d).join(F.broadcast(last)), F.col("last"))  # one row


def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """RK2: every distinct query against every metric of the rulebook (no SQL: difflib ratio)."""
    q = table(spark, d, "captures").where("table_query IS NOT NULL").groupBy(F.col("table_query").alias("label")).agg(F.count("*").alias("n_values")).withColumn("row", F.lit(3)).withColumn("rows", F.lit(20))
    m = table(spark, d, "metric_aliases").select("metric_id", "canonical_name", "aliases", "soft_aliases", "exclude", "position_hint")
    return rt.score_labels(q.crossJoin(small(m))).select("label", "metric_id", "score", "match_class")


def label_rank_margin(spark: SparkSession, d: str) -> DataFrame:
    """WI9: segments of a capture ranked by a score of confidence and evidence."""
    s = table(spark, d, "table_segments").groupBy("capture_id", "segment_id").agg(F.max("confidence").alias("c"), F.max(F.size("reason_codes")).alias("n"))
    score = F.when(F.col("c") == "HIGH", 0.9).when(F.col("c") == "MEDIUM", 0.8).otherwise(0.5) + F.least(F.lit(0.1), F.coalesce("n", F.lit(0)) * 0.05)
    return rt.rank_with_margin(s.withColumn("score", score), ["capture_id"], "score", "segment_id").select("capture_id", "segment_id", "place", F.round("margin", 6).alias("margin"), "selection")


def anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    """RK9: weighted components and hard gates of every capture as an anchor."""
    c = table(spark, d, "captures")
    parts = {
        "boundary": F.when(F.col("boundary_status") == "COMPLETE", 0.4).otherwise(0.0), "header": F.when(F.col("header_dimension_status") == "OK", 0.3).otherwise(0.0),
        "note": F.when(F.col("note_number").isNotNull(), 0.2).otherwise(0.0), "family": F.when(F.col("table_family_id").isNotNull(), 0.1).otherwise(-0.2),
    }
    gates = {"pdf": F.col("pdf_id").isNotNull(), "live": F.col("is_trashed") == 0, "company": F.col("company").isNotNull()}
    return c.select("capture_id", rt.weighted_score(parts, gates).alias("s")).select("capture_id", F.col("s.score").alias("score"), F.col("s.passed").alias("passed"), F.col("s.failed").alias("failed"))


def evidence_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "structure_edges").withColumn("row_order", F.col("row_order").cast("long"))
    return rt.evidence_clusters(e, ["normalized_item", "evidence"], "confidence", "capture_id", ["capture_id"]).select("normalized_item", "evidence", "capture_id", "confidence", "evidence_count")


def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """RK11: rows of a capture (children) take the segments of the capture (candidates), best score first."""
    s = table(spark, d, "table_segments").select("capture_id", "segment_id", "confidence").distinct()
    o = table(spark, d, "long_observations").select(F.col("capture_run_id").alias("capture_id"), "row_order", F.col("physical_segment_id").alias("own")).distinct()
    links = o.join(s, "capture_id").select(
        F.col("capture_id").alias("anchor"), F.col("row_order").alias("child_order"), F.concat_ws(":", "row_order", "own").alias("child"), F.col("segment_id").alias("candidate"),
        F.when(F.col("own") == F.col("segment_id"), 0.9).otherwise(0.4).alias("score"),
    )
    return rt.assign_greedily(links)


def label_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """JO26: labels of a single capture (those of several are aligned by identity and need no suggestion) against all labels and the names of the rulebook."""
    q = table(spark, d, "captures").where("table_query IS NOT NULL").groupBy(F.col("table_query").alias("label")).agg(F.count("*").alias("n"))
    names = table(spark, d, "metric_aliases").select(F.col("canonical_name").alias("label"))
    return rt.suggest_labels(q.where("n = 1").select("label"), q.select("label").unionByName(names))


def note_heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return rt.note_lines(_pages(spark, d))


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("normalized_item").alias("key"))
    c = table(spark, d, "captures").where("table_family_id IS NOT NULL").select("capture_id", F.col("table_family_id").alias("table_id"))
    return e.where("key IS NOT NULL").join(c, "capture_id").select("table_id", F.col("capture_id").alias("source"), "key", F.col("row_order").alias("pos"))


def order_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """WI6: against the order of first mean position over all captures."""
    s = _sequence(spark, d)
    first, _ = sq.first_positions(s)
    mean = first.groupBy("key").agg(F.floor(F.sum("pos") * 1000 / F.count("*")).alias("ref_pos"))
    return sq.order_conflicts(first, mean)


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return sq.first_positions(_sequence(spark, d))[1]


def structural_order(spark: SparkSession, d: str) -> DataFrame:
    """HI4: order of all row labels of a family over its captures, oldest capture first (sequential fold, tested against fixtures)."""
    s = _sequence(spark, d)
    return sq.structural_order(s.select("table_id", F.substring("source", 5, 20).cast("long").alias("source_order"), "key", "pos"))


QUERIES = {
    f.__name__: f
    for f in (
        page_retrieval_topk, page_neighbours, label_scores, label_rank_margin, anchor_scores, evidence_clusters, greedy_assignment, label_suggestions, note_heading_lines, order_conflicts,
        duplicate_keys, structural_order,
    )
}

_PAGES = f"""tr AS (SELECT metric_id, unnest(list_concat([{{'t': canonical_name, 'w': 8.0}}], list_concat(list_transform(coalesce(aliases, []), lambda x: {{'t': x, 'w': 5.0}}), list_transform(coalesce(soft_aliases, []), lambda x: {{'t': x, 'w': 1.0}})))) AS x FROM metric_aliases),
terms AS (SELECT metric_id, {sql_norm("x.t")} AS term, sum(x.w)::DOUBLE AS weight FROM tr GROUP BY 1, 2), pg AS (SELECT doc_id AS page_id, {sql_norm("text")} AS n FROM documents),
sc AS (SELECT page_id, metric_id, sum(weight) AS score FROM pg JOIN terms ON term <> '' AND contains(n, term) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY score DESC, page_id) AS place FROM sc WHERE score >= 0.5 QUALIFY place <= 8)"""
_SEQ = "sq AS (SELECT c.table_family_id AS table_id, e.capture_id AS source, e.key, e.pos FROM (SELECT capture_id, row_order AS pos, min(normalized_item) AS key FROM structure_edges GROUP BY 1, 2) e JOIN captures c USING (capture_id) WHERE e.key IS NOT NULL AND c.table_family_id IS NOT NULL), fp AS (SELECT source, key, min(pos) AS pos FROM sq GROUP BY 1, 2)"
SQL = {
    "page_retrieval_topk": f"WITH {_PAGES} SELECT * FROM top",
    "page_neighbours": f"WITH {_PAGES} SELECT DISTINCT unnest(range(greatest(1, page_id - 1), least((SELECT max(doc_id) FROM documents), page_id + 1) + 1)) AS page_id FROM top",
    "label_rank_margin": """WITH s AS (SELECT capture_id, segment_id, CASE max(confidence) WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.8 ELSE 0.5 END::DOUBLE + least(0.1::DOUBLE, coalesce(max(len(reason_codes)), 0) * 0.05::DOUBLE) AS score FROM table_segments GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER o AS place, round(score - lead(score) OVER o, 9) AS margin FROM s WINDOW o AS (PARTITION BY capture_id ORDER BY score DESC, segment_id))
SELECT capture_id, segment_id, place, round(margin, 6) AS margin, CASE WHEN place > 1 THEN 'CANDIDATE' WHEN score >= 0.85 AND (margin IS NULL OR margin >= 0.1) THEN 'PRESELECTED' WHEN margin <= 0.03 THEN 'MULTIPLE_VALID' ELSE 'REVIEW' END AS selection FROM w""",
    "anchor_scores": "SELECT capture_id, greatest(0, least(1, round(CASE WHEN boundary_status = 'COMPLETE' THEN 0.4 ELSE 0 END + CASE WHEN header_dimension_status = 'OK' THEN 0.3 ELSE 0 END + CASE WHEN note_number IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN table_family_id IS NOT NULL THEN 0.1 ELSE -0.2 END, 4)))::DOUBLE AS score, pdf_id IS NOT NULL AND coalesce(is_trashed = 0, false) AND company IS NOT NULL AS passed, coalesce(concat_ws('|', CASE WHEN pdf_id IS NULL THEN 'pdf' END, CASE WHEN NOT coalesce(is_trashed = 0, false) THEN 'live' END, CASE WHEN company IS NULL THEN 'company' END), '') AS failed FROM captures",
    "evidence_clusters": "SELECT normalized_item, evidence, max_by(capture_id, (coalesce(confidence, 0.0), capture_id)) AS capture_id, max(confidence) AS confidence, count(*) AS evidence_count FROM structure_edges GROUP BY 1, 2",
    "order_conflicts": f"WITH {_SEQ}, m AS (SELECT key, floor(sum(pos) * 1000 / count(*))::BIGINT AS ref_pos FROM fp GROUP BY 1), x AS (SELECT fp.source, fp.key, m.ref_pos, max((m.ref_pos, fp.key)) OVER (PARTITION BY fp.source ORDER BY fp.pos, fp.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fp JOIN m USING (key)) SELECT source, key, top[2] AS predecessor FROM x WHERE ref_pos < top[1]",
    "duplicate_keys": f"WITH {_SEQ} SELECT s.source, s.key, fp.pos AS first_pos, s.pos AS duplicate_pos FROM sq s JOIN fp USING (source, key) WHERE s.pos > fp.pos",
}
SQL["greedy_assignment"] = """WITH RECURSIVE s AS (SELECT DISTINCT capture_id, segment_id FROM table_segments), ob AS (SELECT DISTINCT capture_run_id AS capture_id, row_order, physical_segment_id AS own FROM long_observations),
lk AS (SELECT capture_id AS anchor, row_order AS child_order, concat_ws(':', row_order, own) AS child, segment_id AS candidate, CASE WHEN own = segment_id THEN 0.9 ELSE 0.4 END AS score FROM ob JOIN s USING (capture_id)),
kid AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY child_order NULLS FIRST, child) AS k FROM (SELECT DISTINCT anchor, child_order, child FROM lk)),
walk AS (SELECT DISTINCT anchor, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS child, NULL::VARCHAR AS candidate, NULL::DOUBLE AS score FROM lk
 UNION ALL SELECT anchor, k, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.c) END, child, m.c, -m.s FROM (SELECT w.anchor, w.k + 1 AS k, w.used, kid.child, min(CASE WHEN lk.candidate IS NOT NULL THEN {'s': -lk.score::DOUBLE, 'c': lk.candidate} END) AS m
  FROM walk w JOIN kid ON kid.anchor = w.anchor AND kid.k = w.k + 1 LEFT JOIN lk ON lk.anchor = w.anchor AND lk.child = kid.child AND NOT list_contains(w.used, lk.candidate) GROUP BY 1, 2, 3, 4))
SELECT anchor, child, candidate, score, CASE WHEN candidate IS NULL THEN 'CONFLICT' ELSE 'ASSIGNED' END AS status FROM walk WHERE k > 0"""
