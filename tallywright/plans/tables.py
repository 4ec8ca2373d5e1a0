"""Registered queries of the table structure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.numbers import note_tolerance
from tallywright.operators import inbox as ib
from tallywright.operators import structure as st
from tallywright.operators.observations import latest_delivery
from tallywright.sources.tables import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "structure_edges").groupBy("capture_id", "row_order").agg(F.min("row_path").alias("row_path"), F.min("normalized_item").alias("normalized_item"))
    return e.select("capture_id", "row_order", "row_path", "normalized_item", st.level_of(F.col("row_path")).alias("level"), st.is_total(F.col("normalized_item")).alias("is_total"))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")


def infer_structure(spark: SparkSession, d: str) -> DataFrame:
    return st.parents_by_level(_rows(spark, d)).select("capture_id", "row_order", "parent_row_order", "confidence", "evidence")


def ensured_paths(spark: SparkSession, d: str) -> DataFrame:
    return st.ensure_paths(_rows(spark, d))


def subtotal_tree(spark: SparkSession, d: str) -> DataFrame:
    return st.subtotal_checks(_obs(spark, d)).select("observation_id", "row_order", "n_children", F.round("children_sum", 3).alias("children_sum"), "status")


def running_block_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return st.running_totals(_obs(spark, d)).select("observation_id", F.round("above", 3).alias("above"), "status")


def _formula_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Structure rows with headings: rows without any value in their capture are section headings; some of them deduct and some add."""
    o = _obs(spark, d).select(F.col("capture_run_id").alias("capture_id"), "row_order", "column_ordinal", "value", "unit")
    has = o.where("value IS NOT NULL").select("capture_id", "row_order", F.lit(True).alias("has")).distinct()
    rows = _rows(spark, d).join(has, ["capture_id", "row_order"], "left").withColumn("is_section", F.col("has").isNull() & ~F.col("is_total"))
    return o, rows.withColumn("operator", F.when(F.col("is_section") & (F.pmod("row_order", F.lit(9)) == 4), -1).when(F.col("is_section") & (F.pmod("row_order", F.lit(9)) == 7), 1)).drop("has")


def formula_patterns(spark: SparkSession, d: str) -> DataFrame:
    return st.formulas(_formula_rows(spark, d)[1]).select("capture_id", "row_order", "pattern", "base_order", "operator")


def reconciliation_totals(spark: SparkSession, d: str) -> DataFrame:
    values, rows = _formula_rows(spark, d)
    return st.audit_totals(values, rows).select("capture_id", "row_order", "column_ordinal", "pattern", "n_members", "status")


def implicit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals made blank: the labels of all but every seventh total row are hidden, then recovered from the rows above; columns by themselves."""
    o = _obs(spark, d).groupBy(F.col("capture_run_id").alias("capture_id"), "column_ordinal", "row_order").agg(F.min("value").alias("value"), F.min("normalized_item").alias("raw_item"))
    return st.implicit_totals(o.withColumn("raw_item", F.when(st.is_total(F.col("raw_item")) & (F.pmod("row_order", F.lit(7)) != 3), "").otherwise(F.col("raw_item"))), 5.0, ["capture_id", "column_ordinal"])


def note_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """RE6: primary readings against supplementary ones of the same quantity and unit."""
    o = _obs(spark, d).where("value IS NOT NULL AND unit IS NOT NULL")
    a = o.where("member_table_role = 'PRIMARY'").select("observation_id", "source_key", "unit", "value")
    b = o.where("member_table_role <> 'PRIMARY'").select("source_key", "unit", "value")
    return st.note_reconciliation(a, b, ["source_key", "unit"], note_tolerance(F.col("unit"), F.col("value"))).select("observation_id", "note_value", "status")


def numeric_parents(spark: SparkSession, d: str) -> DataFrame:
    """HI10, RE18: structure rows with the values of their capture; a level is 12 points of indent, the page is that of the observations."""
    o = _obs(spark, d).where("value IS NOT NULL").groupBy(F.col("capture_run_id").alias("capture_id"), "row_order", "column_ordinal").agg(F.min("value").alias("v"), F.min("page").alias("page"))
    cells = o.groupBy("capture_id", "row_order").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_ordinal", "v")))).alias("values"), F.min("page").alias("page"))
    r = _rows(spark, d).join(cells, ["capture_id", "row_order"], "left")
    return ib.numeric_parents(r.select("capture_id", "row_order", (F.col("level") * 12.0).alias("indent"), F.when(F.col("is_total"), "TOTAL").alias("row_type"), F.col("normalized_item").alias("label"), "page", "values"))


def section_tree(spark: SparkSession, d: str) -> DataFrame:
    """HI1, HI3 with stated sections: the last part but one of the stored path is a row's section; a third of the rows state none."""
    r = _rows(spark, d).withColumnRenamed("normalized_item", "label")
    section = F.when(F.pmod("row_order", F.lit(3)) != 0, F.try_element_at(F.split("row_path", " / "), F.lit(-2)))
    return st.parents_by_level(r.withColumn("parent_section", section)).select("capture_id", "row_order", "parent_row_order", "confidence", "evidence")


def block_segments(spark: SparkSession, d: str) -> DataFrame:
    """HI6: a new block begins at every top row."""
    return st.blocks(_rows(spark, d), F.col("level") == 0).select("capture_id", "row_order", "block_order")


QUERIES = {
    f.__name__: f for f in (infer_structure, ensured_paths, subtotal_tree, running_block_reconcile, formula_patterns, reconciliation_totals, implicit_totals, note_reconciliation, block_segments, numeric_parents, section_tree)
}

_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_ID = "CASE WHEN lower(trim(coalesce({0}::VARCHAR, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({0}::VARCHAR, '')) END"
_T = "coalesce(regexp_matches({0}, '合计|总计|小计|总额'), false)"
_R = f"rw AS (SELECT capture_id, row_order, min(row_path) AS row_path, min(normalized_item) AS normalized_item FROM structure_edges GROUP BY 1, 2), r AS (SELECT *, coalesce(len(string_split(row_path, ' / ')) - 1, 0) AS level, {_T.format('normalized_item')} AS is_total FROM rw)"
_PARENT = """par AS (SELECT c.*, (SELECT max(p.row_order) FROM r p WHERE p.capture_id = c.capture_id AND p.row_order < c.row_order AND p.level < c.level AND NOT p.is_total
   AND NOT EXISTS (SELECT 1 FROM r q WHERE q.capture_id = c.capture_id AND q.is_total AND q.row_order > p.row_order AND q.row_order < c.row_order AND q.level <= p.level)) AS parent_row_order FROM r c)"""
_FR = f"""{_O}, {_R}, h AS (SELECT DISTINCT capture_run_id AS capture_id, row_order FROM o WHERE value IS NOT NULL),
fr0 AS (SELECT r.*, h.row_order IS NULL AND NOT r.is_total AS is_section FROM r LEFT JOIN h USING (capture_id, row_order)),
fr AS (SELECT *, CASE WHEN is_section AND row_order % 9 = 4 THEN -1 WHEN is_section AND row_order % 9 = 7 THEN 1 END AS operator FROM fr0),
fb AS (SELECT *, coalesce(sum(CASE WHEN is_total OR is_section THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block,
  max(CASE WHEN is_total THEN row_order END) OVER (PARTITION BY capture_id ORDER BY row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_total,
  max(CASE WHEN operator IS NOT NULL THEN row_order END) OVER (PARTITION BY capture_id ORDER BY row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_op,
  arg_max(operator, row_order) FILTER (operator IS NOT NULL) OVER (PARTITION BY capture_id ORDER BY row_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sign,
  lead(level) OVER (PARTITION BY capture_id ORDER BY row_order) AS next_level FROM fr),
fc AS (SELECT *, sum(CASE WHEN is_total OR is_section THEN 0 ELSE 1 END) OVER (PARTITION BY capture_id, block) AS in_block FROM fb),
f0 AS (SELECT *, coalesce(next_level > level, false) AS leads, last_op IS NOT NULL AND last_total IS NOT NULL AND last_op > last_total AND in_block > 0 AS based FROM fc WHERE is_total),
f AS (SELECT capture_id, row_order, level, block, CASE WHEN leads THEN 'LEADING_PARENT_TOTAL' WHEN based AND last_sign = -1 THEN 'BASE_MINUS_COMPONENTS' WHEN based THEN 'BASE_PLUS_COMPONENTS' WHEN in_block > 0 THEN 'TRAILING_TOTAL' ELSE 'UNKNOWN' END AS pattern,
  CASE WHEN based AND NOT leads THEN last_total END AS base_order, CASE WHEN based AND NOT leads THEN last_sign ELSE 1 END AS operator FROM f0)"""
SQL = {
    "infer_structure": f"WITH {_R}, {_PARENT}, x AS (SELECT *, level > 0 AND parent_row_order IS NOT NULL AS lv FROM par) SELECT capture_id, row_order, parent_row_order, CASE WHEN is_total THEN greatest(CASE WHEN lv THEN 0.66 ELSE 0.35 END, 0.72) WHEN lv THEN 0.66 ELSE 0.35 END::DOUBLE AS confidence, CASE WHEN lv THEN 'ROW_LEVEL+' ELSE '' END || 'ORDER' || CASE WHEN is_total THEN '+TOTAL_SUBTOTAL_CUE' ELSE '' END AS evidence FROM x",
    "ensured_paths": f"""WITH RECURSIVE {_R}, {_PARENT}, whole AS (SELECT capture_id, bool_and(row_path IS NOT NULL) AS complete FROM r GROUP BY 1),
tree AS (SELECT capture_id, row_order, coalesce(normalized_item, '') AS row_path FROM par WHERE parent_row_order IS NULL
 UNION ALL SELECT c.capture_id, c.row_order, t.row_path || ' / ' || coalesce(c.normalized_item, '') FROM par c JOIN tree t ON t.capture_id = c.capture_id AND t.row_order = c.parent_row_order)
SELECT r.capture_id, r.row_order, CASE WHEN complete THEN r.row_path ELSE t.row_path END AS row_path FROM r JOIN whole USING (capture_id) JOIN tree t USING (capture_id, row_order)""",
    "subtotal_tree": f"""WITH {_O}, x AS (SELECT *, regexp_replace(row_path, ' / [^/]*$', '') AS pp FROM o WHERE value IS NOT NULL AND row_path IS NOT NULL),
c AS (SELECT capture_run_id, pp, column_ordinal, data_year, statement_scope, restated_flag, sum(value) AS cs, count(*) AS n FROM x WHERE contains(row_path, ' / ') GROUP BY ALL HAVING count(DISTINCT row_order) >= 2),
j AS (SELECT p.*, c.cs, c.n FROM x p JOIN c ON p.capture_run_id = c.capture_run_id AND p.row_path = c.pp AND p.column_ordinal IS NOT DISTINCT FROM c.column_ordinal AND p.data_year IS NOT DISTINCT FROM c.data_year
 AND p.statement_scope IS NOT DISTINCT FROM c.statement_scope AND p.restated_flag IS NOT DISTINCT FROM c.restated_flag WHERE NOT {_T.format('p.normalized_item')})
SELECT observation_id, row_order, n AS n_children, round(cs, 3) AS children_sum, CASE WHEN abs(value - cs) <= greatest(1e-8, abs(value) * 1e-10) THEN 'PASS'
 WHEN abs(value - cs) <= CASE WHEN unit = '元' THEN n + 1 ELSE greatest(1e-8, n + 1) END THEN 'PASS_WITH_ROUNDING' ELSE 'WARNING' END AS status FROM j""",
    "running_block_reconcile": f"""WITH {_O}, x AS (SELECT *, sum(value) OVER (PARTITION BY capture_run_id, column_ordinal ORDER BY row_order, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM o WHERE value IS NOT NULL AND row_order IS NOT NULL)
SELECT observation_id, round(above, 3) AS above, CASE WHEN above IS NULL THEN 'NOT_TESTABLE' WHEN abs(value - above) <= greatest(1.0, abs(value) * 0.005) THEN 'PASS' ELSE 'MISMATCH' END AS status FROM x WHERE {_T.format('normalized_item')}""",
    "formula_patterns": f"WITH {_FR} SELECT capture_id, row_order, pattern, base_order, operator FROM f",
    "reconciliation_totals": f"""WITH {_FR}, cells AS (SELECT capture_run_id AS capture_id, row_order, column_ordinal, min(value) AS lo, max(value) AS hi, min(unit) AS unit FROM o WHERE value IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT f.capture_id, f.row_order, fb.row_order AS member, f.operator, false AS nested FROM f JOIN fb USING (capture_id, block) WHERE f.pattern NOT IN ('UNKNOWN', 'LEADING_PARENT_TOTAL') AND NOT fb.is_total AND NOT fb.is_section
 UNION ALL SELECT capture_id, row_order, base_order, 1, false FROM f WHERE base_order IS NOT NULL
 UNION ALL SELECT f.capture_id, f.row_order, x.row_order, 1, x.is_total FROM f JOIN fr x ON x.capture_id = f.capture_id AND x.row_order > f.row_order AND NOT x.is_section AND f.pattern = 'LEADING_PARENT_TOTAL'
  AND x.row_order < coalesce((SELECT min(e.row_order) FROM fr e WHERE e.capture_id = f.capture_id AND e.row_order > f.row_order AND e.level <= f.level), 2147483647)),
t AS (SELECT f.capture_id, f.row_order, f.pattern, c.column_ordinal, c.lo AS reported, c.unit FROM f JOIN cells c USING (capture_id, row_order) WHERE c.lo = c.hi),
s AS (SELECT t.capture_id, t.row_order, t.column_ordinal, sum(m.operator * c.lo) AS calc, count(*) AS n, max(CASE WHEN c.lo IS NULL OR c.lo <> c.hi OR m.nested OR (t.unit IS NOT NULL AND c.unit IS NOT NULL AND t.unit <> c.unit) THEN 1 ELSE 0 END) AS unclear
 FROM t JOIN m USING (capture_id, row_order) LEFT JOIN cells c ON c.capture_id = t.capture_id AND c.row_order = m.member AND c.column_ordinal = t.column_ordinal GROUP BY 1, 2, 3)
SELECT t.capture_id, t.row_order, t.column_ordinal, t.pattern, s.n AS n_members, CASE WHEN s.n IS NULL THEN 'NOT_TESTABLE_NO_CONFIDENT_CHILD_SET' WHEN unclear = 1 THEN 'WARNING_COMPONENT_SCOPE_AMBIGUOUS'
 WHEN abs(calc - reported) <= greatest(1e-8, abs(reported) * 1e-12) THEN 'PASS_EXACT' WHEN abs(calc - reported) <= greatest(0.02, abs(reported) * 1e-8) THEN 'PASS_ROUNDING' ELSE 'WARNING_SUM_MISMATCH' END AS status
FROM t LEFT JOIN s USING (capture_id, row_order, column_ordinal)""",
    "implicit_totals": f"""WITH {_O}, b AS (SELECT capture_run_id AS capture_id, column_ordinal, row_order, min(value) AS value, min(normalized_item) AS ni FROM o GROUP BY 1, 2, 3),
n0 AS (SELECT *, {_T.format('ni')} AND row_order % 7 = 3 AS shown_total, {_T.format('ni')} AND row_order % 7 <> 3 AS hidden FROM b), n AS (SELECT *, NOT hidden AND trim(coalesce(ni, '')) <> '' AS named FROM n0),
l AS (SELECT *, max(shown_total::INT) OVER (PARTITION BY capture_id, column_ordinal ORDER BY row_order ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_total, {", ".join(f"CASE WHEN lag(named, {k}) OVER w THEN lag(value, {k}) OVER w END AS v{k}" for k in range(1, 5))} FROM n WINDOW w AS (PARTITION BY capture_id, column_ordinal ORDER BY row_order)),
k AS (SELECT *, CASE WHEN abs(v1 + v2 - value) <= 5 THEN 2 WHEN abs(v1 + v2 + v3 - value) <= 5 THEN 3 WHEN abs(v1 + v2 + v3 + v4 - value) <= 5 THEN 4 END AS children FROM l WHERE NOT named AND value IS NOT NULL)
SELECT capture_id, column_ordinal, row_order, value, children, CASE WHEN near_total = 1 THEN 'SUPPRESSED_BY_EXPLICIT_TOTAL' ELSE 'DERIVED_REJECTED_NON_BLOCKING' END AS derived_status FROM k WHERE children IS NOT NULL""",
    "note_reconciliation": f"""WITH {_O}, p AS (SELECT * FROM o WHERE value IS NOT NULL AND unit IS NOT NULL), b AS (SELECT source_key, unit, min(value) AS note_value FROM p WHERE member_table_role <> 'PRIMARY' GROUP BY 1, 2)
SELECT a.observation_id, b.note_value, CASE WHEN b.note_value IS NULL THEN 'MISSING_NOTE' WHEN abs(a.value - b.note_value) <= greatest(CASE a.unit WHEN '千元' THEN 1e3 WHEN '万元' THEN 1e4 WHEN '百万元' THEN 1e6 WHEN '亿元' THEN 1e8 ELSE 1 END, abs(a.value) * 1e-8) THEN 'PASS' ELSE 'MISMATCH' END AS status
FROM p a LEFT JOIN b USING (source_key, unit) WHERE a.member_table_role = 'PRIMARY'""",
    "block_segments": f"WITH {_R} SELECT capture_id, row_order, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY row_order)::BIGINT AS block_order FROM r",
}
# Every ancestor by brute force: earlier rows of a smaller level with no row of their level or less in between.
_UPS = """ups AS (SELECT c.capture_id, c.row_order, p.row_order AS up, p.normalized_item AS name FROM r c JOIN r p ON p.capture_id = c.capture_id AND p.row_order < c.row_order AND p.level < c.level AND NOT p.is_total
 WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.capture_id = c.capture_id AND q.row_order > p.row_order AND q.row_order < c.row_order AND q.level <= p.level))"""
SQL["section_tree"] = f"""WITH {_R}, {_UPS}, s AS (SELECT *, CASE WHEN row_order % 3 <> 0 THEN {_ID.format("list_extract(string_split(row_path, ' / '), -2)")} ELSE '' END AS sec FROM r),
u AS (SELECT s.capture_id, s.row_order, s.level, s.is_total, s.sec, max(up) AS near, max(up) FILTER (name = sec) AS named FROM s LEFT JOIN ups USING (capture_id, row_order) GROUP BY ALL),
x AS (SELECT *, coalesce(CASE WHEN sec <> '' THEN named END, near) AS parent_row_order, CASE WHEN sec <> '' AND named IS NOT NULL THEN 0.82 WHEN sec <> '' THEN 0.58 WHEN level > 0 AND near IS NOT NULL THEN 0.66 ELSE 0.35 END AS c,
 CASE WHEN sec <> '' AND named IS NOT NULL THEN 'EXPLICIT_PARENT_SECTION+' WHEN sec <> '' THEN 'PARENT_SECTION_UNMATCHED+' WHEN level > 0 AND near IS NOT NULL THEN 'ROW_LEVEL+' ELSE '' END AS e FROM u)
SELECT capture_id, row_order, parent_row_order, CASE WHEN is_total THEN greatest(c, 0.72) ELSE c END::DOUBLE AS confidence, e || 'ORDER' || CASE WHEN is_total THEN '+TOTAL_SUBTOTAL_CUE' ELSE '' END AS evidence FROM x"""
SQL["numeric_parents"] = f"""WITH RECURSIVE {_O}, {_R}, cell AS (SELECT capture_run_id AS capture_id, row_order, column_ordinal, min(value) AS v, min(page) AS page FROM o WHERE value IS NOT NULL GROUP BY 1, 2, 3),
pg AS (SELECT capture_id, row_order, min(page) AS page FROM cell GROUP BY 1, 2),
x AS (SELECT r.*, r.level * 12.0 AS ind, pg.page, pg.row_order IS NULL OR trim(coalesce(r.normalized_item, '')) = '' AS barred FROM r LEFT JOIN pg USING (capture_id, row_order)),
y AS (SELECT *, CASE WHEN barred OR coalesce(lag(barred) OVER w, true) OR page IS DISTINCT FROM lag(page) OVER w THEN 1 ELSE 0 END AS cut FROM x WINDOW w AS (PARTITION BY capture_id ORDER BY row_order)),
z AS (SELECT * FROM (SELECT *, sum(cut) OVER (PARTITION BY capture_id ORDER BY row_order) AS stretch FROM y) WHERE NOT barred),
run AS (SELECT p.capture_id, p.row_order, (SELECT min(q.row_order) FROM z q WHERE q.capture_id = p.capture_id AND q.stretch = p.stretch AND q.row_order > p.row_order AND (q.ind - p.ind < 6 OR q.ind - p.ind > 72)) AS stop, p.stretch FROM z p WHERE NOT p.is_total),
kid AS (SELECT run.capture_id, run.row_order, c.row_order AS child FROM run JOIN z c ON c.capture_id = run.capture_id AND c.stretch = run.stretch AND c.row_order > run.row_order AND c.row_order < coalesce(stop, 2147483647)),
size AS (SELECT capture_id, row_order, count(*) AS n, max(child) AS last_child FROM kid GROUP BY 1, 2 HAVING count(*) >= 2),
sums AS (SELECT k.capture_id, k.row_order, pc.column_ordinal, any_value(pc.v) AS v, sum(cc.v) AS s, count(cc.v) AS filled FROM kid k JOIN cell pc ON pc.capture_id = k.capture_id AND pc.row_order = k.row_order LEFT JOIN cell cc ON cc.capture_id = k.capture_id AND cc.row_order = k.child AND cc.column_ordinal = pc.column_ordinal GROUP BY 1, 2, 3),
cand AS (SELECT capture_id, row_order, n, last_child FROM size JOIN sums USING (capture_id, row_order) GROUP BY ALL HAVING bool_and(filled = n AND abs(v - s) <= greatest(2, n))),
nxt AS (SELECT *, (SELECT min(d.row_order) FROM cand d WHERE d.capture_id = c.capture_id AND d.row_order > c.last_child) AS nx FROM cand c),
acc AS (SELECT * FROM (SELECT * FROM nxt QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY row_order) = 1) UNION ALL SELECT n.* FROM acc a JOIN nxt n ON n.capture_id = a.capture_id AND n.row_order = a.nx)
SELECT capture_id, row_order::BIGINT AS row_order, n AS n_children FROM acc"""
