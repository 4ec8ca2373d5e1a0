"""Registered queries of the merge operators over long observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import observations as ob
from tallywright.sources.tables import table

YEARS = tuple(str(y) for y in range(2013, 2026))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return ob.latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")


def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    return _obs(spark, d).select("observation_id", "capture_run_id", "row_order", "value", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


def resolve_observations(spark: SparkSession, d: str) -> DataFrame:
    return ob.resolve(_obs(spark, d))


def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """AG3: conflicts among readings that differ only in table position: identity without the row path."""
    dims = [x for x in ob.DIMENSIONS if x not in ("row_path", "member_table_role", "unit", "currency")]
    out = ob.resolve(_obs(spark, d).withColumn("member_table_role", F.coalesce("member_table_role", F.lit(""))), [*dims, "member_table_role"])
    return out.where("conflict_status <> 'OK'").select(*dims, "member_table_role", "source_count", "value_count", "conflict_status", "conflict_severity")


def research_wide(spark: SparkSession, d: str) -> DataFrame:
    return ob.wide_by_key(ob.resolve(_obs(spark, d)), ["table_family", "row_path", "normalized_item"], "document_year", YEARS, "y", ["company", "data_year", "statement_scope", "first_value"])


def metric_wide_outer(spark: SparkSession, d: str) -> DataFrame:
    return ob.metric_wide(_obs(spark, d), YEARS)


def family_merge(spark: SparkSession, d: str) -> DataFrame:
    return ob.family_merge(_obs(spark, d), ["company", "document_year", "table_family", "row_path", "data_year", "statement_scope", "restated_flag", "period_type", "unit"], "observation_id")


def cross_family_guard(spark: SparkSession, d: str) -> DataFrame:
    return ob.cross_family_guard(_obs(spark, d))


def source_keys(spark: SparkSession, d: str) -> DataFrame:
    return ob.source_keys(_obs(spark, d))


def mapping_queue_status(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("normalized_item", F.trim(F.coalesce("normalized_item", F.lit(""))))
    q = ob.mapping_queue(o, ob.source_keys(o))
    return q.select("row_key", "occurrences", "capture_count", "company_count", "first_company", "examples", "mapping_status")  # the other columns: taxonomy_queue


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("normalized_item", F.trim(F.coalesce("normalized_item", F.lit(""))))
    keys = ob.source_keys(o)
    queue = ob.mapping_queue(o, keys).select("row_key", "mapping_status")
    return ob.apply_mapping(o.join(keys, ["capture_run_id", "row_order", "normalized_item"], "left"), queue, "row_key", ["mapping_status"])


def apply_mapping_left(spark: SparkSession, d: str) -> DataFrame:
    m = _mapped(spark, d)
    key = ob.canonical_key(F.coalesce("mapping_status", F.lit("UNMAPPED_PRESERVED")), F.lit("T"), F.col("table_family"), F.col("member_table_role"), F.col("capture_run_id"), F.lit(""), F.col("normalized_item"), F.col("row_path"))
    return m.select("observation_id", F.coalesce("mapping_status", F.lit("UNMAPPED_PRESERVED")).alias("mapping_status"), key.alias("canonical_key"))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return ob.coverage(_mapped(spark, d))


def identity_qa(spark: SparkSession, d: str) -> DataFrame:
    return ob.identity_qa(_obs(spark, d))


def column_codes(spark: SparkSession, d: str) -> DataFrame:
    return ob.column_codes(_obs(spark, d)).select("code", "label", "company", "document_year", "data_year")


def column_role_policy(spark: SparkSession, d: str) -> DataFrame:
    return ob.header_policy(_obs(spark, d))


def item_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return ob.item_dictionary(_obs(spark, d))


def cutoff_split(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff of a capture: its last row that has a structure row."""
    o = _obs(spark, d)
    cut = table(spark, d, "structure_edges").groupBy(F.col("capture_id").alias("capture_run_id")).agg(F.max("row_order").alias("cutoff"))
    return ob.cutoff_split(o, cut).groupBy("capture_run_id", "part").agg(F.count("*").alias("n"))


def orphan_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    return ob.orphan_numbers(o.withColumn("raw_item", F.when(F.pmod("row_order", F.lit(7)) == 3, "").otherwise(F.col("raw_item"))))


QUERIES = {
    f.__name__: f
    for f in (
        latest_delivery, resolve_observations, value_conflicts, research_wide, metric_wide_outer, family_merge, cross_family_guard, source_keys, mapping_queue_status,
        apply_mapping_left, coverage_report, identity_qa, column_codes, column_role_policy, item_dictionary, cutoff_split, orphan_numbers,
    )
}

_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_DISTINCT = "list_reduce(list_transform({v}, lambda z: [z]), lambda acc, z: CASE WHEN len(list_filter(acc, lambda u: abs(z[1] - u) <= greatest(1e-8, abs(u) * 1e-10))) > 0 THEN acc ELSE list_concat(acc, z) END)"


def _resolved(dims) -> str:
    cols = ", ".join(dims)
    return f"""g AS (SELECT {cols}, count(*) AS source_count, count(DISTINCT capture_run_id) AS capture_count, min(column_ordinal) AS lo, max(column_ordinal) AS hi, list(value ORDER BY observation_id) AS vs
 FROM o WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY {cols}),
v AS (SELECT *, {_DISTINCT.format(v="vs")} AS uniq, {_ID.format("table_family")} = '' OR {_ID.format("member_table_role")} = '' AS im, {_ID.format("data_year")} = '' OR {_ID.format("statement_scope")} = '' AS dm FROM g),
s AS (SELECT *, CASE WHEN im THEN 'REVIEW_REQUIRED_SOURCE_IDENTITY' WHEN len(uniq) > 1 AND lo <> hi AND dm THEN 'REVIEW_REQUIRED_DIMENSION_AMBIGUITY' WHEN len(uniq) > 1 THEN 'VALUE_CONFLICT' ELSE 'OK' END AS conflict_status FROM v),
r AS (SELECT {cols}, source_count, capture_count, len(uniq) AS value_count, uniq[1] AS first_value, uniq[-1] AS last_value, conflict_status,
 CASE conflict_status WHEN 'OK' THEN 'OK' WHEN 'VALUE_CONFLICT' THEN 'BLOCKING' ELSE 'WARNING' END AS conflict_severity, CASE WHEN conflict_status = 'OK' AND len(uniq) = 1 THEN uniq[1] END AS final_value FROM s)"""


_UNITS = "coalesce(CASE WHEN len({u}) = 0 THEN '' WHEN len({u}) = 1 THEN {u}[1] ELSE 'REVIEW_REQUIRED[' || array_to_string({u}, '|') || ']' END, '')"
_SK = f"""first AS (SELECT capture_run_id, row_order, trim(coalesce(arg_min(normalized_item, observation_id), '')) AS normalized_item, coalesce(arg_min_null(row_path, observation_id), '') AS row_path FROM o WHERE row_order IS NOT NULL GROUP BY 1, 2),
nk AS (SELECT *, count(*) OVER (PARTITION BY capture_run_id, normalized_item) AS n, row_number() OVER (PARTITION BY capture_run_id, normalized_item ORDER BY row_order) AS k FROM first),
keys AS (SELECT capture_run_id, row_order, normalized_item, CASE WHEN normalized_item = '' THEN 'LEGACY||' WHEN n = 1 THEN 'UNIQUE||' || normalized_item ELSE 'CONTEXT_PATH||' || normalized_item || '||' || row_path || '||OCC' || k END AS row_key FROM nk)"""
_QUEUE = """keyed AS (SELECT o.*, keys.row_key FROM o JOIN keys ON keys.capture_run_id = o.capture_run_id AND keys.row_order = o.row_order AND keys.normalized_item = trim(coalesce(o.normalized_item, ''))),
queue AS (SELECT row_key, count(*) AS occurrences, count(DISTINCT capture_run_id) AS capture_count, count(DISTINCT company) AS company_count, min(company) AS first_company FROM keyed WHERE value IS NOT NULL GROUP BY 1),
raws AS (SELECT row_key, raw_item, row_number() OVER (PARTITION BY row_key ORDER BY min(observation_id), raw_item) AS k FROM keyed WHERE value IS NOT NULL AND raw_item IS NOT NULL GROUP BY 1, 2),
six AS (SELECT row_key, string_agg(raw_item, ' | ' ORDER BY k) AS examples FROM raws WHERE k <= 6 GROUP BY 1)"""
_MAPPED_SQL = f"""{_O}, {_SK}, {_QUEUE}, mapped AS (SELECT o.*, CASE WHEN q.row_key IS NULL THEN NULL WHEN q.capture_count >= 2 THEN 'AUTO_EXACT_IDENTITY' ELSE 'UNMAPPED_PRESERVED' END AS mapping_status
 FROM o LEFT JOIN keys k ON k.capture_run_id = o.capture_run_id AND k.row_order = o.row_order AND k.normalized_item = trim(coalesce(o.normalized_item, '')) LEFT JOIN queue q USING (row_key))"""
_LABEL = "concat_ws(' | ', " + ", ".join(
    f"'{f}=' || CASE WHEN {f} THEN 'TRUE' ELSE 'FALSE' END" if f == "restated_flag" else f"CASE WHEN {_ID.format(f)} <> '' THEN '{f}=' || {_ID.format(f)} END" for f in ob.LABEL_FIELDS
) + ")"
_LISTED = ", ".join(f"'{y}'" for y in YEARS)
_CONFLICT_DIMS = [x for x in ob.DIMENSIONS if x not in ("row_path", "member_table_role", "unit", "currency")]
SQL = {
    "latest_delivery": f"WITH {_O} SELECT observation_id, capture_run_id, row_order, value, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded FROM o",
    "resolve_observations": f"WITH {_O}, {_resolved(ob.DIMENSIONS)} SELECT * FROM r",
    "value_conflicts": f"WITH o AS (SELECT * REPLACE (coalesce(member_table_role, '') AS member_table_role) FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1), {_resolved([*_CONFLICT_DIMS, 'member_table_role'])} SELECT {', '.join(_CONFLICT_DIMS)}, member_table_role, source_count, value_count, conflict_status, conflict_severity FROM r WHERE conflict_status <> 'OK'",
    "research_wide": f"WITH {_O}, {_resolved(ob.DIMENSIONS)}, w AS (SELECT table_family, row_path, normalized_item, list_sort(list_distinct(list(CASE WHEN {_ID.format('unit')} <> '' THEN {_ID.format('unit')} END))) AS us, "
    + ", ".join(f"(list(final_value ORDER BY company NULLS FIRST, data_year NULLS FIRST, statement_scope NULLS FIRST, first_value) FILTER (document_year = '{y}'))[1] AS y{y}" for y in YEARS)
    + f", count(*) FILTER (document_year IS NULL OR document_year NOT IN ({_LISTED})) AS n_unlabelled FROM r WHERE conflict_status = 'OK' AND final_value IS NOT NULL GROUP BY 1, 2, 3) SELECT table_family, row_path, normalized_item, n_unlabelled, {_UNITS.format(u='us')} AS unit, " + ", ".join(f"y{y}" for y in YEARS) + " FROM w",
    "metric_wide_outer": f"WITH {_O}, seen AS (SELECT normalized_item, unit, min(observation_id) AS first FROM o GROUP BY 1, 2), us AS (SELECT normalized_item, list(unit ORDER BY first) FILTER ({_ID.format('unit')} <> '') AS u FROM seen GROUP BY 1), "
    + "w AS (SELECT normalized_item, min(observation_id) AS first_seen, " + ", ".join(f"arg_min(value, observation_id) FILTER (document_year = '{y}') AS y{y}" for y in YEARS)
    + f", count(*) FILTER (document_year IS NULL OR document_year NOT IN ({_LISTED})) AS n_unlabelled FROM o WHERE value IS NOT NULL GROUP BY 1) SELECT normalized_item, {_UNITS.format(u='u')} AS unit, first_seen, n_unlabelled, " + ", ".join(f"y{y}" for y in YEARS) + " FROM us FULL OUTER JOIN w USING (normalized_item)",
    "family_merge": f"WITH {_O} SELECT company, document_year, table_family, row_path, data_year, statement_scope, restated_flag, period_type, unit, count(DISTINCT value) AS n_values, count(*) AS n_rows, CASE WHEN count(DISTINCT value) > 1 THEN 'VALUE_CONFLICT' ELSE 'OK' END AS conflict_status, CASE WHEN count(DISTINCT value) <= 1 THEN arg_min_null(value, observation_id) END AS value FROM o GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9",
    "cross_family_guard": f"WITH {_O} SELECT normalized_item, string_agg(DISTINCT table_family, '|' ORDER BY table_family) AS families FROM o GROUP BY 1 HAVING count(DISTINCT table_family) > 1",
    "source_keys": f"WITH {_O}, {_SK} SELECT * FROM keys",
    "mapping_queue_status": f"WITH {_O}, {_SK}, {_QUEUE} SELECT q.*, six.examples, CASE WHEN capture_count >= 2 THEN 'AUTO_EXACT_IDENTITY' ELSE 'UNMAPPED_PRESERVED' END AS mapping_status FROM queue q LEFT JOIN six USING (row_key)",
    "apply_mapping_left": f"WITH {_MAPPED_SQL} SELECT observation_id, coalesce(mapping_status, 'UNMAPPED_PRESERVED') AS mapping_status, CASE WHEN mapping_status = 'AUTO_EXACT_IDENTITY' THEN 'CANON' ELSE 'RAW' END || '::T::' || CASE WHEN {_ID.format('table_family')} = '' OR {_ID.format('member_table_role')} = '' THEN 'MISSING_SOURCE::' || CASE WHEN {_ID.format('capture_run_id')} = '' THEN 'UNKNOWN' ELSE {_ID.format('capture_run_id')} END ELSE 'FAMILY::' || {_ID.format('table_family')} || '::ROLE::' || {_ID.format('member_table_role')} END || '::::' || trim(coalesce(normalized_item, '')) || '::' || coalesce(row_path, '') AS canonical_key FROM mapped",
    "coverage_report": f"WITH {_MAPPED_SQL} SELECT capture_run_id, count(*) AS numeric_rows, count(*) FILTER (mapping_status = 'AUTO_EXACT_IDENTITY') AS mapped_rows, count(*) FILTER (mapping_status = 'UNMAPPED_PRESERVED') AS preserved_rows, (count(*) FILTER (mapping_status = 'AUTO_EXACT_IDENTITY'))::DOUBLE / count(*) AS coverage FROM mapped WHERE value IS NOT NULL GROUP BY 1",
    "identity_qa": f"WITH {_O}, f AS (SELECT capture_run_id, arg_min_null(table_family, observation_id) AS table_family, arg_min_null(member_table_role, observation_id) AS member_table_role, arg_min_null(source_pdf, observation_id) AS source_pdf, count(DISTINCT row_path) AS path_count FROM o GROUP BY 1) SELECT *, coalesce(concat_ws('|', " + ", ".join(f"CASE WHEN {_ID.format(x)} = '' THEN '{x}' END" for x in ("table_family", "member_table_role", "source_pdf")) + "), '') AS missing_fields FROM f",
    "column_codes": f"WITH {_O}, l AS (SELECT {_LABEL} AS label, min(company) AS company, min(document_year) AS document_year, min(data_year) AS data_year FROM o GROUP BY 1) SELECT 'COL_' || lpad((row_number() OVER (ORDER BY label))::VARCHAR, 5, '0') AS code, label, company, document_year, data_year FROM l",
    "column_role_policy": f"WITH {_O}, c AS (SELECT " + ", ".join(f"count(DISTINCT nullif({_ID.format(f)}, '')) AS {f}" for f in ob.LABEL_FIELDS) + " FROM o), sp AS (SELECT max(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS splits FROM (SELECT min(coalesce(restated_flag, false)) AS lo, max(coalesce(restated_flag, false)) AS hi FROM o GROUP BY " + ", ".join(f for f in ob.LABEL_FIELDS if f != "restated_flag") + ")), u AS (UNPIVOT c ON " + ", ".join(ob.LABEL_FIELDS) + " INTO NAME field VALUE n_values) SELECT field, n_values, CASE WHEN field IN ('document_year', 'data_year') THEN 'VISIBLE' WHEN field = 'restated_flag' THEN CASE WHEN splits = 1 THEN 'VISIBLE' ELSE 'METADATA' END WHEN n_values > 1 THEN 'VISIBLE' ELSE 'METADATA' END AS role FROM u, sp",
    "item_dictionary": f"WITH {_O} SELECT capture_run_id, normalized_item, (list(raw_item ORDER BY row_order, observation_id))[1] AS first_raw, min(row_order) AS first_row FROM o WHERE {_ID.format('normalized_item')} <> '' GROUP BY 1, 2",
    "cutoff_split": f"WITH {_O}, c AS (SELECT capture_id AS capture_run_id, max(row_order) AS cutoff FROM structure_edges GROUP BY 1) SELECT capture_run_id, CASE WHEN row_order IS NULL THEN 'UNPLACED' WHEN cutoff IS NULL OR row_order <= cutoff THEN 'OFFICIAL' ELSE 'EXCLUDED' END AS part, count(*) AS n FROM o LEFT JOIN c USING (capture_run_id) GROUP BY 1, 2",
    "orphan_numbers": f"WITH {_O}, one AS (SELECT capture_run_id, row_order, max(CASE WHEN row_order % 7 = 3 OR {_ID.format('raw_item')} = '' THEN 1 ELSE 0 END) AS blank, count(value) AS n FROM o WHERE row_order IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, lag(blank) OVER (PARTITION BY capture_run_id ORDER BY row_order) AS b, lead(blank) OVER (PARTITION BY capture_run_id ORDER BY row_order) AS a FROM one) SELECT capture_run_id, row_order FROM w WHERE blank = 1 AND n > 0 AND coalesce(b, 0) = 0 AND coalesce(a, 0) = 0",
}
