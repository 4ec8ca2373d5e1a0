"""Registered queries of the general record operators: common units (p2) and hierarchies (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import hierarchy, units
from tallywright.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found_agreements(table(spark, d, "long_observations"), table(spark, d, "table_segments"), table(spark, d, "document_contexts"), table(spark, d, "fx_rates"))


def p2_common_units(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(
        table(spark, d, "long_observations"), table(spark, d, "table_segments"), table(spark, d, "document_contexts"), table(spark, d, "fx_rates")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.rows_on_cycles(table(spark, d, "structure_edges"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_paths(table(spark, d, "structure_edges")).select("capture_id", "row_order", "depth", "root", "full_path", "status")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_paths(table(spark, d, "structure_edges")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(hierarchy.resolve_paths(table(spark, d, "structure_edges"))).select("capture_id", "row_order", "n_below", "status")


QUERIES = {f.__name__: f for f in (p2_found, p2_common_units, p5_found, p5_paths, p5_descendants, p5_counts)}

_NODES = """
n0 AS (SELECT capture_id, row_order::BIGINT AS row_order, min(parent_row_order::BIGINT) AS p, any_value(normalized_item) AS item
       FROM structure_edges GROUP BY 1, 2),
nodes AS (SELECT n0.capture_id, n0.row_order, k.row_order AS parent, n0.p IS NOT NULL AND k.row_order IS NULL AS orphan, coalesce(n0.item, '') AS item
          FROM n0 LEFT JOIN n0 k ON k.capture_id = n0.capture_id AND k.row_order = n0.p)"""
_TREE = (
    _NODES
    + """,
tree AS (SELECT capture_id, row_order, 0 AS depth, row_order AS root, item AS full_path, CASE WHEN orphan THEN 'ORPHAN_TOP' ELSE 'TOP' END AS status
         FROM nodes WHERE parent IS NULL
         UNION ALL
         SELECT c.capture_id, c.row_order, t.depth + 1, t.root, t.full_path || ' / ' || c.item, 'CHILD'
         FROM nodes c JOIN tree t ON t.capture_id = c.capture_id AND t.row_order = c.parent)"""
)
_CLOSURE = """,
closure AS (SELECT capture_id, parent AS ancestor, row_order AS descendant, 1 AS distance FROM nodes JOIN tree USING (capture_id, row_order) WHERE parent IS NOT NULL
            UNION ALL
            SELECT c.capture_id, n.parent, c.descendant, c.distance + 1 FROM closure c JOIN nodes n ON n.capture_id = c.capture_id AND n.row_order = c.ancestor
            WHERE n.parent IS NOT NULL)"""

SQL = {
    "p5_paths": f"""WITH RECURSIVE {_TREE}
SELECT n.capture_id, n.row_order, t.depth, t.root, t.full_path, coalesce(t.status, 'CYCLE') AS status FROM nodes n LEFT JOIN tree t USING (capture_id, row_order)""",
    "p5_found": f"""WITH RECURSIVE {_TREE},
walk AS (SELECT n.capture_id, n.row_order AS start, n.parent AS pos, 1 AS steps FROM nodes n LEFT JOIN tree t USING (capture_id, row_order) WHERE t.row_order IS NULL
         UNION ALL
         SELECT w.capture_id, w.start, n.parent, w.steps + 1 FROM walk w JOIN nodes n ON n.capture_id = w.capture_id AND n.row_order = w.pos
         WHERE w.pos <> w.start AND w.steps < 500)
SELECT DISTINCT capture_id, start AS row_order FROM walk WHERE pos = start""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}{_CLOSURE}
SELECT capture_id, ancestor, descendant, distance FROM closure""",
    "p5_counts": f"""WITH RECURSIVE {_TREE}{_CLOSURE}
SELECT n.capture_id, n.row_order, CASE WHEN t.row_order IS NOT NULL THEN (SELECT count(*) FROM closure c WHERE c.capture_id = n.capture_id AND c.ancestor = n.row_order) END AS n_below,
       coalesce(t.status, 'CYCLE') AS status FROM nodes n LEFT JOIN tree t USING (capture_id, row_order)""",
}

# Fixed patterns of the SQL check of unit texts (scale and currency by regular expressions instead of the grammar).
_T = "replace(replace(replace(replace(lower(coalesce({c}, '')), '萬', '万'), '億', '亿'), '圓', '元'), '圆', '元')"


def _sql_scale(c: str) -> str:
    t = _T.format(c=c)
    return f"""CASE
 WHEN regexp_matches({t}, '十亿|billion|\\bbn\\b') THEN 1e9
 WHEN regexp_matches({t}, '亿|hundreds? (of )?millions?|100 million') THEN 1e8
 WHEN regexp_matches({t}, '百万|million|\\bmn\\b') THEN 1e6
 WHEN regexp_matches({t}, '万|10k|tens? (of )?thousands?') THEN 1e4
 WHEN regexp_matches({t}, '千|仟|thousand|''000') THEN 1e3
 WHEN regexp_matches({t}, '元|人民币|港币|rmb|cny|hkd|hk\\$|usd|us\\$|units') THEN 1.0 END"""


def _sql_currency(c: str) -> str:
    t = _T.format(c=c)
    return f"CASE WHEN regexp_matches({t}, '人民币|rmb|cny') THEN 'CNY' WHEN regexp_matches({t}, '港币|港元|hkd|hk\\$') THEN 'HKD' WHEN regexp_matches({t}, '美元|usd|us\\$') THEN 'USD' END"


_CONVERTED = f"""
ctx AS (SELECT pdf_id, page, coalesce({_sql_scale("unit")}, {_sql_scale("unit_source_text")}) AS sc,
        coalesce({_sql_currency("currency")}, {_sql_currency("unit")}, {_sql_currency("unit_source_text")}) AS cu FROM document_contexts),
o AS (SELECT l.observation_id, l.source_key, l.measure, l.value, l.data_year,
       CASE WHEN measure = 'RATIO' THEN CASE WHEN lower(l.unit) IN ('%', '％', '百分比', 'percent') THEN 0.01 WHEN lower(l.unit) IN ('‰', '千分比') THEN 0.001
            WHEN lower(l.unit) IN ('bp', 'bps', '基点') THEN 0.0001 WHEN lower(l.unit) IN ('x', 'times', '倍') THEN 1.0 END
       ELSE coalesce({_sql_scale("l.unit")}, {_sql_scale("s.unit")},
            (SELECT arg_max(c.sc, c.page) FROM ctx c WHERE c.pdf_id = l.source_pdf AND c.page <= l.page AND c.sc IS NOT NULL)) END AS scale,
       CASE WHEN measure <> 'RATIO' THEN coalesce({_sql_currency("l.currency")}, {_sql_currency("l.unit")}, {_sql_currency("s.unit")},
            (SELECT arg_max(c.cu, c.page) FROM ctx c WHERE c.pdf_id = l.source_pdf AND c.page <= l.page AND c.cu IS NOT NULL), 'CNY') END AS currency
      FROM long_observations l LEFT JOIN table_segments s ON s.segment_id = l.physical_segment_id),
conv AS (SELECT o.*, o.value * o.scale * CASE WHEN o.measure = 'RATIO' OR o.currency = 'CNY' THEN 1.0 ELSE f.cny_per_unit END AS common_value
         FROM o LEFT JOIN fx_rates f ON f.currency = o.currency AND f.rate_year = o.data_year)"""
SQL["p2_found"] = f"""WITH {_CONVERTED}
SELECT DISTINCT a.observation_id AS observation_a, b.observation_id AS observation_b
FROM conv a JOIN conv b ON a.source_key = b.source_key AND a.measure = b.measure AND a.observation_id < b.observation_id
WHERE (a.scale <> b.scale OR coalesce(a.currency, '-') <> coalesce(b.currency, '-'))
  AND abs(a.common_value - b.common_value) <= 0.001 * greatest(abs(a.common_value), abs(b.common_value))"""

SQL["p2_common_units"] = f"""WITH {_CONVERTED}
SELECT observation_id, source_key, measure, value, scale, currency, common_value,
       CASE WHEN value IS NULL THEN 'NO_VALUE' WHEN scale IS NULL THEN 'NO_SCALE' WHEN common_value IS NULL THEN 'NO_RATE' ELSE 'CONVERTED' END AS unit_status FROM conv"""
