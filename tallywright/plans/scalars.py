"""Registered queries of the scalar functions, over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import notes, numbers, periods, text
from tallywright.session import small
from tallywright.sources.tables import table


def fn_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """FN1, FN2, FN17, FN26 on raw labels."""
    o = table(spark, d, "long_observations").select("raw_item", "row_path").distinct()
    return o.select("raw_item", "row_path", text.normalize_text("raw_item").alias("norm"), text.clean_cell("raw_item").alias("cell"), text.normalize_item_label("raw_item").alias("label"), text.normalize_section("row_path").alias("section"))


def fn_parse_number(spark: SparkSession, d: str) -> DataFrame:
    """FN4, FN6, FN48 on the joined pieces of each reading."""
    n = table(spark, d, "numeric_tokens").select("token_id", F.array_join("raw_numeric_tokens", "").alias("raw"))
    p = numbers.parse_number("raw")
    return n.select("token_id", p["value"].alias("number"), p["unit"].alias("unit"), p["ok"].alias("ok"))


def fn_note_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """FN28, FN29, FN31 on note numbers."""
    c = table(spark, d, "captures")
    return c.select("capture_id", "note_number", notes.note_ordinal("note_number").alias("ordinal"), notes.note_reference("note_number")["section"].alias("section"))


def fn_period(spark: SparkSession, d: str) -> DataFrame:
    """PR9, FN8, FN9, FN22, FN24, WI15 on column headers with the year of their document."""
    c = table(spark, d, "captures").select("capture_id", "document_year")
    t = table(spark, d, "table_columns").select("column_id", "capture_id", "header_raw").join(c, "capture_id", "left")
    return t.select(
        "column_id", periods.absolute_year("document_year").alias("doc_year"), periods.relative_kind("header_raw").alias("kind"), periods.latest_year("header_raw").alias("year"),
        periods.is_period_header("header_raw").alias("is_header"), F.round(periods.period_score("header_raw"), 4).alias("score"), periods.resolve_year("header_raw", "document_year").alias("resolved"),
    )


def fn_row_roles(spark: SparkSession, d: str) -> DataFrame:
    """FN18, FN19, FN21 on observation labels."""
    o = table(spark, d, "long_observations").select("normalized_item", F.col("value").isNotNull().alias("has_value")).distinct()
    kind = text.classify_row_type("normalized_item", F.col("has_value"))
    return o.select("normalized_item", "has_value", kind.alias("row_type"), text.infer_row_role("normalized_item", kind, F.col("has_value")).alias("row_role"), text.classify_cell_role("normalized_item", F.lit(None)).alias("cell_role"))


def fn_unit_hint(spark: SparkSession, d: str) -> DataFrame:
    """FN11, FN35 on declaration texts."""
    c = table(spark, d, "document_contexts")
    return c.select("pdf_id", "page", text.detect_unit_hint("unit_source_text").alias("hint"), text.classify_note("unit_source_text").alias("note_class"))


def fn_file_names(spark: SparkSession, d: str) -> DataFrame:
    """PR22, PR23 on stored file names."""
    p = table(spark, d, "pdf_assets")
    return p.select("pdf_id", text.file_year("filename").alias("year"), text.file_company("filename").alias("company_part"), text.stored_name("filename").alias("shown"), periods.absolute_year("document_year").alias("doc_year"))


def fn_format_amount(spark: SparkSession, d: str) -> DataFrame:
    """FN5 on amounts."""
    o = table(spark, d, "long_observations").select("observation_id", "value").distinct()
    return o.select("observation_id", numbers.format_amount(F.round("value", 6)).alias("shown"))


def fn_identity_hash(spark: SparkSession, d: str) -> DataFrame:
    """PR18, PR19, FN52: stable identity of a logical asset from its fields, nulls as empty."""
    c = table(spark, d, "captures")
    fields = [text.identity_text(x) for x in ("pdf_id", "document_year", "table_family_id", "table_query", "note_number")]
    return c.select("capture_id", F.sha2(F.concat_ws("\u001f", *fields), 256).alias("identity_key"))


def fn_title_match(spark: SparkSession, d: str) -> DataFrame:
    """FN34: class and weight of each typed query against the canonical names it contains or is contained in."""
    q = table(spark, d, "captures").select("table_query").where("table_query IS NOT NULL").distinct()
    m = table(spark, d, "metric_aliases").select("metric_id", "canonical_name")
    w = text.title_match_weight("canonical_name", "table_query")
    pairs = q.join(small(m), text.normalize_text("table_query").contains(text.normalize_text("canonical_name")))
    return pairs.select("table_query", "metric_id", w["kind"].alias("kind"), w["weight"].alias("weight"))


QUERIES = {f.__name__: f for f in (fn_normalize_text, fn_parse_number, fn_note_ordinal, fn_period, fn_row_roles, fn_unit_hint, fn_file_names, fn_format_amount, fn_identity_hash, fn_title_match)}

_PUNCT = r"""[\s\x{3000}:：,，;；。\.、_/\\\-—–·''"“”‘’（）()【】\[\]{}<>《》]+"""
_PREFIX = r"^(?:[一二三四五六七八九十]+[、.]|\d+[、.]|[（(][一二三四五六七八九十\d]+[）)]|其中|加|减)[:：]?"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


def sql_norm(x: str) -> str:
    s = _strip(f"coalesce({x}, '')")
    s = f"CASE WHEN lower({s}) = 'nan' THEN '' ELSE regexp_replace({s}, '[－–—]', '-', 'g') END"
    for _ in range(3):
        s = _strip(f"regexp_replace({s}, '{_PREFIX}', '')")
    return f"lower(regexp_replace({s}, '{_PUNCT}', '', 'g'))"


def _sql_cell(x: str) -> str:
    s = rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{3000}}]+', ' ', 'g'))"
    return f"CASE WHEN lower({s}) = 'none' THEN '' ELSE {s} END"


def _sql_section(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\s+', '', 'g'), '^[：:]+|[：:]+$', '', 'g')"


def _sql_label(x: str) -> str:
    s = rf"regexp_replace(regexp_replace({_sql_cell(x)}, '\s*[（(]\s*(?:附注|注)\s*[^（）()]{{0,40}}\s*[）)]\s*$', ''), '\s*[（(]\s*[A-Za-z]\s*[）)]\s*$', '')"
    cut = f"CASE WHEN length({s}) > 1 AND regexp_matches({s}, '注$') AND NOT regexp_matches({s}, '(附注|备注|批注|标注|注释|关注|专注|投注|灌注)$') THEN left({s}, -1) ELSE {s} END"
    return _sql_section(cut)


def sql_token(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    s = rf"regexp_replace(replace(replace(regexp_replace({t}, '\s+', '', 'g'), '（', '('), '）', ')'), '\(?(?:已重述|经重述|重述后|重述)\)?', '', 'g')"
    return rf"CASE WHEN regexp_matches({t}, '^20\d{{2}}\.0$') THEN left({t}, 4) ELSE regexp_replace({s}, '(?:人民币)?(?:亿元|百万元|万元|千元|元)$', '') END"


def sql_year(x: str) -> str:
    return rf"nullif(regexp_extract({sql_token(x)}, '^(20\d{{2}})(?:\.0)?(?:年度|年)?$', 1), '')"


def sql_kind(x: str) -> str:
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"CASE WHEN {sql_token(x)} IN ({listed(periods.CURRENT)}) THEN 'CURRENT' WHEN {sql_token(x)} IN ({listed(periods.PRIOR)}) THEN 'PRIOR' END"


def _sql_digit(x: str, missing: int) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[零〇一二三四五六七八九]$') THEN try_cast(translate({x}, '零〇一二三四五六七八九', '00123456789') AS INT) ELSE {missing} END"


def _sql_number(x: str) -> str:
    left, right = f"split_part({x}, '十', 1)", f"regexp_replace({x}, '^[^十]*十', '')"
    return rf"""CASE WHEN regexp_matches({x}, '^\d+$') THEN try_cast({x} AS INT)
 WHEN contains({x}, '十') THEN (CASE WHEN {left} = '' THEN 1 ELSE {_sql_digit(left, 1)} END) * 10 + (CASE WHEN {right} = '' THEN 0 ELSE {_sql_digit(right, 0)} END)
 WHEN regexp_matches({x}, '^[零〇一二三四五六七八九]+$') THEN try_cast(translate({x}, '零〇一二三四五六七八九', '00123456789') AS INT) END"""


_CELL = _sql_cell("array_to_string(raw_numeric_tokens, '')")
_NUM = numbers.NUMBER
_HEAD = _sql_cell("t.header_raw")
_NI = "regexp_replace(trim(coalesce(normalized_item, '')), '\\s+', '', 'g')"
SQL = {
    "fn_normalize_text": f"SELECT DISTINCT raw_item, row_path, {sql_norm('raw_item')} AS norm, {_sql_cell('raw_item')} AS cell, {_sql_label('raw_item')} AS label, {_sql_section('row_path')} AS section FROM long_observations",
    "fn_parse_number": rf"""WITH c AS (SELECT token_id, {_CELL} AS s FROM numeric_tokens), f AS (SELECT token_id, s, translate(s, '（）', '()') AS t FROM c),
m AS (SELECT *, regexp_matches(t, '{_NUM}') AND s NOT IN ('', '-', '—', '–', '－', '不适用', 'N/A', 'n/a') AS ok,
      try_cast(regexp_replace(regexp_extract(t, '{_NUM}', 2), '[,，]', '', 'g') AS DOUBLE) AS v FROM f)
SELECT token_id, CASE WHEN ok THEN CASE WHEN regexp_extract(t, '{_NUM}', 1) = '-' OR (starts_with(t, '(') AND contains(t, ')')) THEN -v ELSE v END END AS number,
       CASE WHEN ok THEN CASE WHEN regexp_extract(t, '{_NUM}', 4) = '%' THEN '%' ELSE nullif(regexp_extract(t, '{_NUM}', 3), '') END END AS unit, ok AND v IS NOT NULL AS ok FROM m""",
    "fn_note_ordinal": rf"""WITH p AS (SELECT capture_id, note_number, list_extract(regexp_extract_all(regexp_extract(trim(coalesce(note_number, '')), '([^-—–/]*)$', 1), '(\d{{1,3}}|[零〇一二三四五六七八九十百]{{1,5}})', 1), -1) AS x,
  regexp_replace(regexp_replace(coalesce(note_number, ''), '\s+', '', 'g'), '^(?:附注|注)', '') AS body FROM captures)
SELECT capture_id, note_number, {_sql_number("x")} AS ordinal, regexp_extract(body, '^([一二三四五六七八九十\d]+)[-、.．]([一二三四五六七八九十\d]+)$', 1) AS section FROM p""",
    "fn_period": rf"""WITH t AS (SELECT column_id, header_raw, document_year FROM table_columns LEFT JOIN captures USING (capture_id)),
x AS (SELECT t.*, {sql_year("t.document_year")} AS doc_year, {sql_kind("t.header_raw")} AS kind, list_max(list_transform(regexp_extract_all(coalesce(t.header_raw, ''), '(20\d{{2}})', 1), lambda y: y::INT)) AS year,
      {sql_norm("t.header_raw")} AS n, {_HEAD} AS cell, {sql_year("t.header_raw")} AS own FROM t)
SELECT column_id, doc_year, kind, year, cell <> '' AND (regexp_matches(cell, '20\d{{2}}') OR regexp_matches(n, '本期|本年|本报告期|上期|上年|期末|期初|年末|年初')) AS is_header,
  round(coalesce((year - 2000)::DOUBLE, 0.0) + CASE WHEN regexp_matches(n, '本期|本年|期末|年末|本报告期') THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches(n, '上期|上年|期初|年初') THEN 0.15 ELSE 0 END, 4) AS score,
  coalesce(own, CASE WHEN kind = 'CURRENT' THEN doc_year WHEN kind = 'PRIOR' THEN (doc_year::INT - 1)::VARCHAR END, header_raw) AS resolved FROM x""",
    "fn_row_roles": f"""WITH o AS (SELECT DISTINCT normalized_item, value IS NOT NULL AS has_value FROM long_observations), x AS (SELECT *, {sql_norm("normalized_item")} AS n, {_NI} AS r FROM o)
SELECT normalized_item, has_value, CASE WHEN NOT has_value THEN 'SECTION_HEADER' WHEN n = '总计' OR n LIKE '%合计' THEN 'TOTAL' WHEN contains(n, '小计') THEN 'SUBTOTAL' WHEN contains(n, '可归属于保险合同组合的费用') THEN 'CLASSIFICATION_TOTAL' ELSE 'DETAIL' END AS row_type,
 CASE WHEN trim(coalesce(normalized_item, '')) = '' AND has_value THEN 'ANONYMOUS_NUMERIC_ROW'
  WHEN regexp_matches(r, '注：|说明|其中：') THEN CASE WHEN has_value THEN 'NOTE_TEXT' ELSE 'MEMO_TEXT' END
  WHEN r IN ('总计', '总额') OR r LIKE '%合计' THEN 'TOTAL' WHEN regexp_matches(r, '^(小计|其中|减：|加：)') THEN CASE WHEN contains(r, '计') THEN 'SUBTOTAL' ELSE 'ADJUSTMENT' END
  WHEN r LIKE '减%' OR contains(r, '减：') THEN 'ADJUSTMENT' WHEN contains(r, '净额') OR r LIKE '净%' THEN 'NET_VALUE' WHEN contains(r, '原值') OR contains(r, '账面余额') THEN 'GROSS_VALUE'
  WHEN NOT has_value AND trim(coalesce(normalized_item, '')) LIKE '%：' THEN 'SECTION' ELSE 'DETAIL' END AS row_role,
 CASE WHEN regexp_matches(coalesce(normalized_item, ''), '[A-Za-z\\x{{4E00}}-\\x{{9FFF}}]') AND regexp_matches(coalesce(normalized_item, ''), '\\d') THEN 'MIXED' WHEN regexp_matches(coalesce(normalized_item, ''), '\\d') THEN 'NUMERIC' ELSE 'TEXT' END AS cell_role FROM x""",
    "fn_unit_hint": r"""WITH x AS (SELECT pdf_id, page, coalesce(unit_source_text, '') AS s FROM document_contexts)
SELECT pdf_id, page, nullif(CASE WHEN regexp_matches(s, '单位\s*[:：]\s*(?:人民币)?\s*(百万元|亿元|万元|千元|元)') THEN regexp_extract(s, '单位\s*[:：]\s*(?:人民币)?\s*(百万元|亿元|万元|千元|元)', 1)
 ELSE regexp_extract(s, '(百万元|亿元|万元|千元|元)', 1) END, '') AS hint,
 CASE WHEN contains(s, '重述') THEN 'RESTATEMENT' WHEN contains(s, '包括') THEN 'INCLUSION_EXCLUSION' WHEN contains(s, '单位') OR contains(s, '人民币') THEN 'UNIT_OR_PRESENTATION'
  WHEN contains(s, '按照') OR contains(s, '计量') THEN 'ACCOUNTING_POLICY' ELSE 'OTHER' END AS note_class FROM x""",
    "fn_file_names": rf"""WITH x AS (SELECT pdf_id, document_year, regexp_replace(coalesce(filename, ''), '^[0-9a-fA-F]{{12}}_', '') AS shown FROM pdf_assets),
y AS (SELECT *, regexp_replace(shown, '\.[^.]*$', '') AS stem FROM x), z AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '20\d{{2}}', '', 'g'), '(?:年)?(?:年度信息披露报告|年度报告|年报|年度财务报告|信息披露报告|报告|财务报表|偿付能力报告)$', ''), '[_\-\s]+', ' ', 'g'), '^[ _-]+|[ _-]+$', '', 'g') AS c FROM y)
SELECT pdf_id, nullif(regexp_extract(shown, '(20\d{{2}})', 1), '') AS year, CASE WHEN c <> '' THEN c ELSE stem END AS company_part, shown, {sql_year("document_year")} AS doc_year FROM z""",
    "fn_identity_hash": "SELECT capture_id, sha256(concat_ws(chr(31), " + ", ".join(f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('nan', 'none', '<na>') THEN '' ELSE trim(coalesce({c}, '')) END" for c in ("pdf_id", "document_year", "table_family_id", "table_query", "note_number")) + ")) AS identity_key FROM captures",
    "fn_title_match": f"""WITH q AS (SELECT DISTINCT table_query FROM captures WHERE table_query IS NOT NULL), x AS (SELECT table_query, metric_id, {sql_norm("canonical_name")} AS a, {sql_norm("table_query")} AS b FROM q, metric_aliases)
SELECT table_query, metric_id, CASE WHEN a = b THEN 'EXACT' WHEN starts_with(b, a) THEN 'PREFIX' ELSE 'CONTAINS' END AS kind, CASE WHEN a = b THEN 0.28 WHEN starts_with(b, a) THEN 0.24 ELSE 0.14 END::DOUBLE AS weight FROM x WHERE contains(b, a)""",
}
SQL["fn_format_amount"] = """SELECT DISTINCT observation_id, CASE WHEN value IS NULL THEN '-' WHEN abs(v) >= 1e8 THEN format('{:,.2f} 亿元', v / 1e8) WHEN abs(v) >= 1e4 THEN format('{:,.2f} 万元', v / 1e4) ELSE format('{:,.2f} 元', v) END AS shown
FROM (SELECT observation_id, value, round(value, 6) AS v FROM long_observations)"""
