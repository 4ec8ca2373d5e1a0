"""Registered queries of cell, page and geometry operators; geometry is laid out from rows and columns of the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import numbers, periods, text
from tallywright.operators import capture as cp
from tallywright.operators import inbox as ib
from tallywright.operators import observations as ob
from tallywright.operators import pages as pg
from tallywright.operators import registry as rg
from tallywright.operators import sequences as sq
from tallywright.plans.reviewing import _HEADS, _LINES
from tallywright.plans.scalars import sql_norm
from tallywright.sources.documents import taxonomy_lookup
from tallywright.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return ob.latest_delivery(table(spark, d, "long_observations"), ["observation_id"], "loaded_at")


def fn_pages(spark: SparkSession, d: str) -> DataFrame:
    """FN10, FN13, FN36, FN54 on whole texts."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select(
        "page_id", text.infer_table_type("text").alias("table_type"), F.sha2(t, 256).alias("sha"), pg.page_modality(F.length(t), F.pmod("page_id", F.lit(3)), F.pmod("page_id", F.lit(10)) / 10.0).alias("modality"), text.statement_scope("text").alias("scope"),
    )


def fn_cells(spark: SparkSession, d: str) -> DataFrame:
    """FN7, FN12, FN55 on the tables of column headers: every page of a capture is a row of cells."""
    rows = table(spark, d, "table_columns").groupBy("capture_id", "page", "ordinal").agg(F.min("header_raw").alias("h")).groupBy("capture_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]).alias("cells"))
    t = rows.groupBy("capture_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "cells"))), lambda x: x["cells"]).alias("rows"))
    clean = t.withColumn("clean", text.sanitize_table("rows"))
    label = text.find_label(F.try_element_at("clean", F.lit(1)), numbers.is_number_like)
    return clean.select("capture_id", F.size("clean").alias("n_rows"), label["label"].alias("label"), label["column"].alias("column_index"), text.table_signature("clean").alias("signature"))


def excluded_cells(spark: SparkSession, d: str) -> DataFrame:
    """FI4: the first observation of every capture is excluded with its own item and value as evidence."""
    o = _obs(spark, d).where("value IS NOT NULL AND normalized_item IS NOT NULL")
    e = o.groupBy("capture_run_id").agg(F.min(F.struct("observation_id", F.col("normalized_item").alias("expected_item"), F.col("value").alias("expected_value"))).alias("m")).select("m.*")
    return ob.exclude_checked(o, e, ["observation_id"]).select("observation_id")


def kept_columns(spark: SparkSession, d: str) -> DataFrame:
    """FI19: columns after the first that name no year are dropped."""
    c = table(spark, d, "table_columns").groupBy("capture_id", "ordinal").agg(F.min("data_year").alias("y"))
    return ib.keep_columns(c.select("capture_id", "ordinal"), c.where("ordinal > 1 AND y IS NULL").select("capture_id", "ordinal", F.lit("DROP").alias("action")))


def absolute_periods(spark: SparkSession, d: str) -> DataFrame:
    """PR10: no relative period is left in the observations."""
    return ib.check_periods(_obs(spark, d).select("observation_id", "data_year"))


def taxonomy_matches(spark: SparkSession, d: str) -> DataFrame:
    """JO25: keys of the rulebook's names and aliases; a row has the key of its family, else its item alone."""
    m = table(spark, d, "metric_aliases")
    tax = m.select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"), F.lit("S").alias("canonical_section"), F.col("canonical_name").alias("canonical_item"))
    tax = tax.select(F.concat(F.lit("||"), "t").alias("source_key"), "canonical_section", "canonical_item")
    q = table(spark, d, "captures").select("capture_id", F.col("table_query").alias("normalized_item"), F.concat(F.when(F.col("merge_ready") == 1, "||").otherwise("x||"), "table_query").alias("source_key"))
    return taxonomy_lookup(q, tax).select("capture_id", "canonical_item", "match_kind")


def segment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JO32: certified segments are those of high confidence; boxes lie where page and number put them, found ones shifted by their unit."""
    s = table(spark, d, "table_segments").groupBy("segment_id").agg(F.min("pdf_page_number").alias("page"), F.max("confidence").alias("c"), F.max("unit").alias("u"))
    n = F.substring("segment_id", 5, 20).cast("int")
    box = lambda shift: F.when(n % 5 != 0, F.array(*(((n % 50) + shift + k).cast("double") for k in (0, 10, 200, 300))))
    found = s.where(n % 7 != 0).select("segment_id", F.when(n % 11 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), box(F.coalesce(F.length("u"), F.lit(0)) * 4).alias("bbox"))
    return rg.compatible_segments(found, s.where("c = 'HIGH'").select("segment_id", "page", box(F.lit(0)).alias("bbox")))


def anchor_relations(spark: SparkSession, d: str) -> DataFrame:
    """RE7: every total against the numbers of its column."""
    o = _obs(spark, d).where("value IS NOT NULL AND row_order IS NOT NULL")
    total = F.col("normalized_item").rlike("合计|总计|小计|总额")
    anchors = o.where(total).select("observation_id", "capture_run_id", "column_ordinal", F.col("value").alias("anchor"))
    others = o.where(~F.coalesce(total, F.lit(False))).groupBy("capture_run_id", "column_ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_order", "observation_id", "value"))), lambda x: x["value"]).alias("numbers"))
    return anchors.join(others, ["capture_run_id", "column_ordinal"]).select("observation_id", pg.anchor_relation(F.col("anchor"), F.col("numbers")).alias("relation"))


def physical_segments(spark: SparkSession, d: str) -> DataFrame:
    """HI14, HI15: pieces of a table on pages to segments by header and width."""
    s = table(spark, d, "table_segments").groupBy("capture_id", F.col("pdf_page_number").alias("page")).agg(F.min("note_identity").alias("header"), F.min("confidence").alias("width"))
    return cp.page_segments(s.where("page IS NOT NULL").select(F.lit("d").alias("doc_id"), F.col("capture_id").alias("table_id"), "page", "header", "width")).select("table_id", "page", "segment_order", "segment_page")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """One word for each cell: its column puts it at 80 points, its row a little aside; a page is a capture."""
    o = _obs(spark, d).where("row_order < 5000").groupBy("capture_run_id", "row_order", "column_ordinal").agg(F.min("observation_id").alias("text"))
    x = F.col("column_ordinal") * 80.0 + F.pmod("row_order", F.lit(5)) * 3.0
    return o.select(F.substring("capture_run_id", 5, 20).cast("long").alias("page_id"), F.col("row_order").alias("line"), x.alias("x0"), (x + 20.0 + F.pmod("row_order", F.lit(4)) * 16.0).alias("x1"), "text")


def cells_of_lines(spark: SparkSession, d: str) -> DataFrame:
    return sq.line_cells(_words(spark, d)).select("page_id", "line", "cell", "x0", "x1", "text")


def number_lanes(spark: SparkSession, d: str) -> DataFrame:
    return sq.number_lanes(_words(spark, d).select("page_id", "line", "x1"))


def word_columns(spark: SparkSession, d: str) -> DataFrame:
    """JO31, FN56: every word to the nearest column; and how far it overlaps the column's band."""
    words = _words(spark, d)
    anchors = words.groupBy("page_id", F.floor(F.col("x0") / 80).cast("int").alias("anchor_id")).agg(F.count("*").alias("n")).select("page_id", "anchor_id", (F.col("anchor_id") * 80.0 + 20.0).alias("centre"), F.lit(12.0).alias("half_width"))
    near = sq.nearest_anchor(words.select("page_id", F.col("text").alias("word_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x")), anchors)
    shares = words.select("page_id", F.col("text").alias("word_id"), F.round(sq.overlap_ratio(F.col("x0"), F.col("x1"), F.lit(80.0), F.lit(120.0)), 6).alias("overlap"))
    return shares.join(near, ["page_id", "word_id"], "left").select("word_id", "anchor_id", "distance", "overlap")


QUERIES = {
    f.__name__: f
    for f in (
        fn_pages, fn_cells, excluded_cells, kept_columns, absolute_periods, taxonomy_matches, segment_pairs, anchor_relations, physical_segments, cells_of_lines, number_lanes, word_columns,
    )
}

_O = "o AS (SELECT * FROM long_observations QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC) = 1)"
_CELL = r"CASE WHEN lower(trim(regexp_replace(coalesce({0}, ''), '[\s\x{{3000}}]+', ' ', 'g'))) = 'none' THEN '' ELSE trim(regexp_replace(coalesce({0}, ''), '[\s\x{{3000}}]+', ' ', 'g')) END"
_HITS = {k: " + ".join(f"contains(n, '{w}')::INT" for w in words) for k, words in text.STATEMENT_LABELS.items()}
_WORDS = f"""{_O}, ws AS (SELECT substr(capture_run_id, 5)::BIGINT AS page_id, row_order AS line, column_ordinal * 80.0::DOUBLE + (row_order % 5) * 3.0::DOUBLE AS x0, column_ordinal * 80.0::DOUBLE + (row_order % 5) * 3.0::DOUBLE + 20.0 + (row_order % 4) * 16.0::DOUBLE AS x1, min(observation_id) AS text
 FROM o WHERE row_order < 5000 GROUP BY capture_run_id, row_order, column_ordinal)"""
_HEAD20 = sql_norm("array_to_string(string_split(coalesce(text, ''), chr(10))[1:20], chr(10))")
SQL = {
    "fn_pages": f"""WITH x AS (SELECT doc_id AS page_id, text, {sql_norm('text')} AS n, {_HEAD20} AS h, length(coalesce(text, '')) AS c, doc_id % 3 AS im, (doc_id % 10) / 10.0::DOUBLE AS lg FROM documents), y AS (SELECT *, {", ".join(f"{v} AS h{i}" for i, v in enumerate(_HITS.values()))} FROM x)
SELECT page_id, CASE WHEN greatest({", ".join(f"h{i}" for i in range(len(_HITS)))}) = 0 THEN '未知表' {" ".join(f"WHEN h{i} = greatest({', '.join(f'h{j}' for j in range(len(_HITS)))}) THEN '{k}'" for i, k in enumerate(_HITS))} END AS table_type, sha256(coalesce(text, '')) AS sha,
 CASE WHEN c < 80 AND lg >= 0.5 THEN 'IMAGE_DOMINANT' WHEN c < 80 AND im = 0 THEN 'EMPTY_OR_UNKNOWN' WHEN im > 0 AND lg >= 0.5 THEN 'HYBRID' ELSE 'TEXT_DOMINANT' END AS modality,
 CASE {" ".join(f"WHEN contains(h, '{k}') THEN '{v}'" for k, v in text.SCOPE_TITLES.items())} ELSE 'UNKNOWN' END AS scope FROM y""",
    "fn_cells": f"""WITH a AS (SELECT capture_id, page, ordinal, min(header_raw) AS h FROM table_columns GROUP BY 1, 2, 3), r AS (SELECT capture_id, page, list(h ORDER BY ordinal) AS cells FROM a GROUP BY 1, 2), w AS (SELECT *, max(len(cells)) OVER (PARTITION BY capture_id) AS width FROM r),
c AS (SELECT capture_id, page, list_transform(list_concat(cells, list_transform(range(width - len(cells)), lambda i: '')), lambda x: {_CELL.format('x')}) AS cells FROM w), k AS (SELECT * FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0),
t AS (SELECT capture_id, count(*) AS n_rows, list(cells ORDER BY page) AS rows FROM k GROUP BY 1), al AS (SELECT DISTINCT capture_id FROM a),
f AS (SELECT al.capture_id, coalesce(n_rows, 0) AS n_rows, rows, list_filter(list_transform(range(len(rows[1][1:8])), lambda i: {{'i': i, 'l': rows[1][i + 1]}}), lambda s: s.l <> '' AND length(s.l) <= 150 AND NOT (regexp_matches(translate(s.l, '（）', '()'), '{numbers.NUMBER}') AND s.l NOT IN ('', '-', '—', '–', '－', '不适用', 'N/A', 'n/a'))) AS fit FROM al LEFT JOIN t USING (capture_id))
SELECT capture_id, n_rows, fit[1].l AS label, fit[1].i::INT AS column_index, sha1(coalesce(array_to_string(list_transform(rows[1:20], lambda r: array_to_string(list_transform(r, lambda x: {sql_norm('x')}), '|')), chr(10)), '')) AS signature FROM f""",
    "excluded_cells": f"WITH {_O} SELECT observation_id FROM o WHERE value IS NOT NULL AND normalized_item IS NOT NULL AND observation_id NOT IN (SELECT min(observation_id) FROM o WHERE value IS NOT NULL AND normalized_item IS NOT NULL GROUP BY capture_run_id)",
    "kept_columns": "SELECT capture_id, ordinal FROM table_columns GROUP BY 1, 2 HAVING ordinal <= 1 OR min(data_year) IS NOT NULL",
    "absolute_periods": f"WITH {_O} SELECT observation_id, data_year FROM o",
    "taxonomy_matches": """WITH t AS (SELECT DISTINCT unnest(list_concat([canonical_name], coalesce(aliases, []))) AS t, canonical_name FROM metric_aliases), e AS (SELECT t, min(canonical_name) AS c, count(DISTINCT canonical_name) AS n FROM t GROUP BY 1)
SELECT capture_id, CASE WHEN merge_ready = 1 THEN c WHEN n = 1 THEN c END AS canonical_item, CASE WHEN merge_ready = 1 AND c IS NOT NULL THEN 'EXACT' WHEN n = 1 THEN 'ITEM' END AS match_kind FROM captures LEFT JOIN e ON e.t = table_query""",
    "segment_pairs": """WITH s AS (SELECT segment_id, min(pdf_page_number) AS page, max(confidence) AS c, max(unit) AS u, substr(segment_id, 5)::INT AS n FROM table_segments GROUP BY 1)
SELECT segment_id, CASE WHEN n % 7 = 0 OR page IS NULL THEN 'SEGMENT_MISSING' WHEN n % 11 = 0 THEN 'PAGE_DIFFERS' WHEN n % 5 = 0 THEN 'BOX_UNKNOWN' WHEN coalesce(length(u), 0) * 4 <= 12 THEN 'OK' ELSE 'BOX_DIFFERS' END AS issue FROM s WHERE c = 'HIGH'""",
    "anchor_relations": f"""WITH {_O}, v AS (SELECT *, coalesce(regexp_matches(normalized_item, '合计|总计|小计|总额'), false) AS t FROM o WHERE value IS NOT NULL AND row_order IS NOT NULL), n AS (SELECT capture_run_id, column_ordinal, list(value ORDER BY row_order, observation_id) AS ns FROM v WHERE NOT t GROUP BY 1, 2)
SELECT observation_id, CASE WHEN len(list_filter(ns, lambda x: abs(x - value) <= greatest(0.5, abs(value) * 1e-8))) > 0 THEN 'EXACT_TOTAL' WHEN len(list_filter(ns[1:30], lambda g: len(list_filter(ns[1:30], lambda a: g >= a AND abs(g - a - value) <= greatest(0.5, abs(value) * 1e-8))) > 0)) > 0 THEN 'GROSS_MINUS_ALLOWANCE' ELSE 'NONE' END AS relation
FROM v JOIN n USING (capture_run_id, column_ordinal) WHERE t""",
    "physical_segments": """WITH s AS (SELECT capture_id AS table_id, pdf_page_number AS page, min(note_identity) AS header, min(confidence) AS width FROM table_segments WHERE pdf_page_number IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND header IS NOT DISTINCT FROM lag(header) OVER w AND width IS NOT DISTINCT FROM lag(width) OVER w THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY table_id ORDER BY page)),
y AS (SELECT *, sum(opens) OVER (PARTITION BY table_id ORDER BY page) AS segment_order FROM x) SELECT table_id, page, segment_order::BIGINT AS segment_order, row_number() OVER (PARTITION BY table_id, segment_order ORDER BY page) AS segment_page FROM y""",
    "cells_of_lines": f"""WITH {_WORDS}, g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, line ORDER BY x0, x1, text) > 12 THEN 1 ELSE 0 END AS op FROM ws), c AS (SELECT *, sum(op) OVER (PARTITION BY page_id, line ORDER BY x0, x1, text ROWS UNBOUNDED PRECEDING) AS cell FROM g)
SELECT page_id, line, cell::BIGINT AS cell, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0, x1, text) AS text FROM c GROUP BY 1, 2, 3""",
    "number_lanes": f"""WITH {_WORDS}, g AS (SELECT page_id, line, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page_id ORDER BY x1, line) > 12 THEN 1 ELSE 0 END AS op FROM ws), l AS (SELECT *, sum(op) OVER (PARTITION BY page_id ORDER BY x1, line ROWS UNBOUNDED PRECEDING) AS lane FROM g), n AS (SELECT page_id, count(DISTINCT line) AS lines FROM ws GROUP BY 1)
SELECT page_id, lane::BIGINT AS lane, min(x1) AS "left", max(x1) AS "right", count(DISTINCT line) AS support FROM l JOIN n USING (page_id) GROUP BY page_id, lane, lines HAVING count(DISTINCT line) >= greatest(2.0, lines * 0.2)""",
    "word_columns": f"""WITH {_WORDS}, an AS (SELECT DISTINCT page_id, floor(x0 / 80)::INT AS anchor_id FROM ws), m AS (SELECT ws.page_id, ws.text AS word_id, min((abs((x0 + x1) / 2 - (anchor_id * 80.0::DOUBLE + 20)), anchor_id)) AS b FROM ws JOIN an USING (page_id) WHERE abs((x0 + x1) / 2 - (anchor_id * 80.0::DOUBLE + 20)) <= 18 GROUP BY 1, 2)
SELECT ws.text AS word_id, b[2] AS anchor_id, b[1] AS distance, round(greatest(0.0, least(x1, 120.0) - greatest(x0, 80.0)) / greatest(1e-9, least(x1 - x0, 40.0)), 6)::DOUBLE AS overlap FROM ws LEFT JOIN m ON m.page_id = ws.page_id AND m.word_id = ws.text""",
}

TITLES = ("说明", "保险", "准备金", "风险", "结余")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    lines = pg.lines_of(_docs(spark, d)).select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "line", "content")
    return cp.table_regions(lines, spark.createDataFrame([(t,) for t in TITLES], "title string"))


def region_lines(spark: SparkSession, d: str) -> DataFrame:
    """HI18: lines below headings that name one of TITLES."""
    return _regions(spark, d).select("doc_id", "title", "start_line", "line")


def region_headers(spark: SparkSession, d: str) -> DataFrame:
    """HI16."""
    h = cp.header_lines(_regions(spark, d))
    return h.select("doc_id", "title", "start_line", "header_line", F.array_join("headers", "|").alias("headers"))


def region_rows(spark: SparkSession, d: str) -> DataFrame:
    """HI17, HI21."""
    r = _regions(spark, d)
    return cp.table_rows(r, cp.header_lines(r)).select("doc_id", "title", "start_line", "row_order", "raw_item", "column_ordinal", "value", "data_year")


def best_blocks(spark: SparkSession, d: str) -> DataFrame:
    """HI20: pieces of a capture on its pages as blocks; cells are their identity, unit and confidence."""
    s = table(spark, d, "table_segments").where("pdf_page_number IS NOT NULL").groupBy("capture_id", "pdf_page_number", "segment_id").agg(F.min(F.coalesce("note_identity", F.lit(""))).alias("a"), F.min(F.coalesce("unit", F.lit(""))).alias("b"))
    rows = F.array(F.array("a", "b"), F.when(F.col("b") != "", F.array(F.lit("12"), "a", F.lit("3"))).otherwise(F.array(F.lit("7"), "a")))
    return cp.best_blocks(s.select(F.col("capture_id").alias("doc_id"), F.col("pdf_page_number").alias("page"), F.col("segment_id").alias("block"), rows.alias("rows")), "附注")


def definition_versions(spark: SparkSession, d: str) -> DataFrame:
    """UD7: the rulebook as definitions; one gets a new version, another is archived."""
    m = table(spark, d, "metric_aliases").select(F.col("metric_id").alias("definition_id"), F.lit(1).alias("version"), F.col("canonical_name").alias("payload"), F.lit("CURRENT").alias("status"))
    return cp.new_definition(cp.new_definition(m, "MET-001", "新"), "MET-002", "", archive=True)


QUERIES |= {f.__name__: f for f in (region_lines, region_headers, region_rows, best_blocks, definition_versions)}

_TITLES = ", ".join(f"('{t}')" for t in TITLES)
_CELLS = r"list_filter(regexp_split_to_array(content, '\t+|\s{2,}|\s*\|\s*'), lambda c: trim(c) <> '')"
_REGION = f"""{_LINES}, {_HEADS}, wt AS (SELECT title AS t, {sql_norm('title')} AS n FROM (VALUES {_TITLES}) v(title)),
pl AS (SELECT ln.page_id AS doc_id, ln.line, ln.content, max(h.line) AS start_line FROM ln JOIN heads h ON h.page_id = ln.page_id AND h.line < ln.line WHERE NOT EXISTS (SELECT 1 FROM heads g WHERE g.page_id = ln.page_id AND g.line = ln.line) GROUP BY ALL),
rg AS (SELECT pl.*, wt.t AS title FROM pl JOIN heads h ON h.page_id = pl.doc_id AND h.line = pl.start_line JOIN wt ON contains({sql_norm('h.title')}, wt.n)), rc AS (SELECT *, {_CELLS} AS cells FROM rg)"""
_PERIOD = rf"""list_filter(cells, lambda c: {_CELL.format('c')} <> '' AND (regexp_matches({_CELL.format('c')}, '20\d{{2}}') OR regexp_matches({sql_norm(_CELL.format('c'))}, '{"|".join(periods.HEADER_WORDS)}')))"""
_HEADER = f"{_REGION}, hp AS (SELECT *, {_PERIOD} AS ps FROM rc), hh AS (SELECT * FROM hp WHERE len(ps) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, title, start_line ORDER BY len(ps) DESC, line) = 1)"
_F = "translate({0}, '（）', '()')"


def _ok(x: str) -> str:
    c = _CELL.format(x)
    return f"(regexp_matches({_F.format(c)}, '{numbers.NUMBER}') AND {c} NOT IN ('', '-', '—', '–', '－', '不适用', 'N/A', 'n/a'))"


def _value(x: str) -> str:
    f = _F.format(_CELL.format(x))
    v = f"try_cast(regexp_replace(regexp_extract({f}, '{numbers.NUMBER}', 2), '[,，]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN regexp_extract({f}, '{numbers.NUMBER}', 1) = '-' OR (starts_with({f}, '(') AND contains({f}, ')')) THEN -{v} ELSE {v} END"


SQL["region_lines"] = f"WITH {_REGION} SELECT doc_id, title, start_line, line FROM rg"
SQL["region_headers"] = f"WITH {_HEADER} SELECT doc_id, title, start_line, line AS header_line, array_to_string(ps, '|') AS headers FROM hh"
SQL["region_rows"] = rf"""WITH {_HEADER}, b AS (SELECT rc.*, hh.ps, list_filter(rc.cells, lambda c: {_ok('c')}) AS ns, list_filter(list_transform(rc.cells[1:8], lambda c: {_CELL.format('c')}), lambda c: c <> '' AND length(c) <= 150 AND NOT {_ok('c')})[1] AS label FROM rc JOIN hh USING (doc_id, title, start_line) WHERE rc.line > hh.line),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title, start_line ORDER BY line) AS row_order FROM b WHERE len(ns) > 0), u AS (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM r)
SELECT doc_id, title, start_line, row_order, label AS raw_item, k AS column_ordinal, {_value('ns[k]')} AS value, list_max(list_transform(regexp_extract_all(coalesce(ps[k], ''), '(20\d{{2}})', 1), lambda y: y::INT)) AS data_year FROM u"""
SQL["best_blocks"] = rf"""WITH s AS (SELECT capture_id AS doc_id, pdf_page_number AS page, segment_id AS block, min(coalesce(note_identity, '')) AS a, min(coalesce(unit, '')) AS b FROM table_segments WHERE pdf_page_number IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN b <> '' THEN [a, b, '12', a, '3'] ELSE [a, b, '7', a] END AS cs, CASE WHEN b <> '' THEN 3 ELSE 2 END AS width FROM s),
x AS (SELECT *, len(list_filter(cs, lambda c: {_ok('c')}))::DOUBLE / len(cs) + CASE WHEN contains({sql_norm("array_to_string(cs, ' ')")}, '附注') THEN 1 ELSE 0 END AS score, {sql_norm("array_to_string(cs, ' ')")} AS n FROM c), f AS (SELECT doc_id, arg_min(width, (page, -score, block)) AS wanted FROM x GROUP BY 1),
y AS (SELECT *, {", ".join(f"{v} AS h{i}" for i, v in enumerate(_HITS.values()))} FROM x JOIN f USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY (width = wanted) DESC, score DESC, block) = 1)
SELECT doc_id, page, block, width, CASE WHEN greatest({", ".join(f"h{i}" for i in range(len(_HITS)))}) = 0 THEN '未知表' {" ".join(f"WHEN h{i} = greatest({', '.join(f'h{j}' for j in range(len(_HITS)))}) THEN '{k}'" for i, k in enumerate(_HITS))} END AS table_type, round(score, 6) AS score FROM y"""
SQL["definition_versions"] = "SELECT metric_id AS definition_id, 1 AS version, canonical_name AS payload, CASE metric_id WHEN 'MET-001' THEN 'SUPERSEDED' WHEN 'MET-002' THEN 'ARCHIVED' ELSE 'CURRENT' END AS status FROM metric_aliases UNION ALL SELECT 'MET-001', 2, '新', 'CURRENT'"
