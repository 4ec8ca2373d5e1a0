"""Label and text functions as Column expressions (built-in functions only, except the difflib ratio)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs dropped by normalize_text, and the numbering prefixes it strips up to three times.
PUNCTUATION = r"[\s\x{3000}:：,，;；。\.、_/\\\-—–·'\"“”‘’（）()【】\[\]{}<>《》]+"
PREFIX = r"^(?:[一二三四五六七八九十]+[、.]|\d+[、.]|[（(][一二三四五六七八九十\d]+[）)]|其中|加|减)[:：]?"
BLANK_TOKENS = ("nan", "none", "<na>")
# Labels ending in 注 that are words of their own.
WORDS_IN_ZHU = ("附注", "备注", "批注", "标注", "注释", "关注", "专注", "投注", "灌注")
# Statement kinds with their key labels, in order of preference on ties.
STATEMENT_LABELS = {
    "资产负债表": ("资产总计", "负债合计", "所有者权益"),
    "利润表": ("营业收入", "利润总额", "净利润"),
    "现金流量表": ("经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量"),
    "综合收益表": ("其他综合收益", "综合收益总额"),
}
# Texts that mean true.
TRUE_WORDS = ("1", "true", "yes", "y", "已重述", "经重述", "重述")
# Asset names of the new and of the legacy classification, and what a statement is called that bears them.
NEW_REGIME = ("交易性金融资产", "债权投资", "其他债权投资", "其他权益工具投资")
LEGACY_REGIME = ("可供出售金融资产", "持有至到期投资", "贷款及应收款项", "贷款")
REGIMES = ("MIXED_TRANSITION_PRESENTATION", "NEW_FINANCIAL_INSTRUMENT_CLASSIFICATION", "LEGACY_FINANCIAL_ASSET_CLASSIFICATION", "UNKNOWN")
# Words that narrow a label to a part of what its metric means.
QUALIFIERS = ("本公司", "母公司", "归属于母公司", "归属于母公司股东", "归母", "少数股东", "持续经营", "终止经营", "扣除非经常性", "扣非", "调整后", "基本每股", "稀释每股")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[\s\x{3000}]+", ""), r"[\s\x{3000}]+$", "")


def clean_cell(x: Column | str) -> Column:
    """FN2: line breaks and runs of blanks to one blank, trimmed; 'none' and null to ''."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\s\x{3000}]+", " "))
    return F.when(F.lower(s) == "none", "").otherwise(s)


def normalize_text(x: Column | str) -> Column:
    """FN1: comparison form of a label: dashes unified, up to three numbering prefixes off, punctuation and blanks off, lower case.
    Null and 'nan' give ''."""
    s = strip(F.coalesce(_c(x), F.lit("")))
    s = F.when(F.lower(s) == "nan", "").otherwise(F.regexp_replace(s, "[－–—]", "-"))
    for _ in range(3):
        s = strip(F.regexp_replace(s, PREFIX, ""))
    return F.lower(F.regexp_replace(s, PUNCTUATION, ""))


def identity_text(x: Column | str) -> Column:
    """FN27: trimmed text; null and the words that stand for missing give ''."""
    s = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(*BLANK_TOKENS), "").otherwise(s)


def normalize_section(x: Column | str) -> Column:
    """FN26: no blanks, no colons at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", ""), "^[：:]+|[：:]+$", "")


# References at the end of a label that are no part of it.
LABEL_REFERENCES = (r"\s*[（(]\s*(?:附注|注)\s*[^（）()]{0,40}\s*[）)]\s*$", r"\s*[（(]\s*[A-Za-z]\s*[）)]\s*$")


def normalize_item_label(x: Column | str) -> Column:
    """FN17: label without footnote references; a final 注 goes unless it belongs to a word."""
    s = clean_cell(x)
    for reference in LABEL_REFERENCES:
        s = F.regexp_replace(s, reference, "")
    word = F.lit(False)
    for w in WORDS_IN_ZHU:
        word = word | s.endswith(w)
    s = F.when((F.length(s) > 1) & s.endswith("注") & ~word, s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)
    return normalize_section(s)


def as_bool(x: Column | str) -> Column:
    """FN25: text flag to boolean; null is false."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def infer_table_type(x: Column | str) -> Column:
    """FN10: statement kind whose key labels occur most; ties keep the order of STATEMENT_LABELS."""
    n = normalize_text(x)
    hits = {k: sum((F.when(n.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for k, words in STATEMENT_LABELS.items()}
    top = F.greatest(*hits.values())
    out = F.when(top == 0, "未知表")
    for kind, h in hits.items():
        out = out.when(h == top, kind)
    return out


def detect_unit_hint(x: Column | str) -> Column:
    """FN11: unit after '单位:', else the first unit word."""
    s = F.coalesce(_c(x), F.lit(""))
    first = F.regexp_extract(s, r"单位\s*[:：]\s*(?:人民币)?\s*(百万元|亿元|万元|千元|元)", 1)
    second = F.regexp_extract(s, r"(?:人民币)?\s*(百万元|亿元|万元|千元|元)", 1)
    return F.nullif(F.when(first != "", first).otherwise(second), F.lit(""))


def classify_row_type(label: Column | str, has_values: Column) -> Column:
    """FN18: row type from the label."""
    n = normalize_text(label)
    return (
        F.when(~has_values, "SECTION_HEADER")
        .when((n == "总计") | n.endswith("合计"), "TOTAL")
        .when(n.contains("小计"), "SUBTOTAL")
        .when(n.contains("可归属于保险合同组合的费用"), "CLASSIFICATION_TOTAL")
        .otherwise("DETAIL")
    )


def infer_row_role(label: Column | str, row_type: Column, has_value: Column) -> Column:
    """FN19: accounting role of a row, first rule that applies."""
    text = F.trim(F.coalesce(_c(label), F.lit("")))
    n = F.regexp_replace(text, r"\s+", "")
    return (
        F.when((text == "") & has_value, "ANONYMOUS_NUMERIC_ROW")
        .when(F.coalesce(row_type == "MEMO_TEXT", F.lit(False)) | n.contains("注：") | n.contains("说明") | n.contains("其中："), F.when(has_value, "NOTE_TEXT").otherwise("MEMO_TEXT"))
        .when(n.isin("总计", "总额") | n.endswith("合计"), "TOTAL")
        .when(n.rlike("^(小计|其中|减：|加：)"), F.when(n.contains("计"), "SUBTOTAL").otherwise("ADJUSTMENT"))
        .when(n.startswith("减") | n.contains("减："), "ADJUSTMENT")
        .when(n.contains("净额") | n.startswith("净"), "NET_VALUE")
        .when(n.contains("原值") | n.contains("账面余额"), "GROSS_VALUE")
        .when(F.coalesce(row_type == "SECTION", F.lit(False)) | (~has_value & text.endswith("：")), "SECTION")
        .otherwise("DETAIL")
    )


def classify_cell_role(raw: Column | str, parsed: Column) -> Column:
    """FN21: MIXED, NUMERIC or TEXT."""
    t = F.coalesce(_c(raw), F.lit(""))
    letters, digits = t.rlike(r"[A-Za-z\x{4E00}-\x{9FFF}]"), t.rlike(r"\d")
    return F.when(letters & digits, "MIXED").when(parsed.isNotNull() | digits, "NUMERIC").otherwise("TEXT")


def classify_non_data_text(x: Column | str, numeric_cells: Column, expected: Column) -> Column:
    """FN20: NOTE_TEXT, MEMO_TEXT or null for label-only rows."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", "")
    short = numeric_cells < F.greatest(F.lit(1), expected)
    memo = s.rlike("以下名称|以下简称|截至|包括|上述|不构成|请见附注")
    prose = (F.length(s) >= 12) | s.rlike("[，。；：]")
    return (
        F.when((s != "") & s.rlike("^(注|说明)[：:]") & short, "NOTE_TEXT")
        .when((s != "") & memo & prose & short, "MEMO_TEXT")
        .when(s.startswith("其中") & (F.length(s) >= 12) & short, "MEMO_TEXT")
    )


def classify_note(x: Column | str) -> Column:
    """FN35: note class, first rule that applies."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(t.contains("重述"), "RESTATEMENT")
        .when(t.contains("包括"), "INCLUSION_EXCLUSION")
        .when(t.contains("单位") | t.contains("人民币"), "UNIT_OR_PRESENTATION")
        .when(t.contains("按照") | t.contains("计量"), "ACCOUNTING_POLICY")
        .otherwise("OTHER")
    )


# Titles of a balance sheet and the scope they state, the first that fits.
SCOPE_TITLES = {"合并及公司资产负债表": "COMBINED_CONSOLIDATED_AND_PARENT", "合并资产负债表": "CONSOLIDATED", "资产负债表": "PARENT_COMPANY"}


def statement_scope(x: Column | str) -> Column:
    """FN54: scope that a title in the first 20 lines states (SCOPE_TITLES), else UNKNOWN."""
    head = normalize_text(F.array_join(F.slice(F.split(F.coalesce(_c(x), F.lit("")), "\n"), 1, 20), "\n"))
    out = F.lit("UNKNOWN")
    for title, scope in reversed(SCOPE_TITLES.items()):
        out = F.when(head.contains(title), scope).otherwise(out)
    return out


def presentation_regime(labels: Column | str) -> Column:
    """FN42: which classification the labels of a statement follow (REGIMES): new, legacy, both or neither. ``labels``: array of texts."""
    joined = F.array_join(F.transform(_c(labels), normalize_text), "|")
    new, old = joined.rlike("|".join(NEW_REGIME)), joined.rlike("|".join(LEGACY_REGIME))
    mixed, fresh, legacy, neither = REGIMES
    return F.when(new & old, mixed).when(new, fresh).when(old, legacy).otherwise(neither)


def qualified_variant_penalty(label: Column, standard: Column) -> Column:
    """FN15: -0.16 where a scope qualifier is in the label but not in the standard name (both normalized)."""
    extra = F.lit(False)
    for q in QUALIFIERS:
        extra = extra | (label.contains(q) & ~standard.contains(q))
    return F.when(extra, -0.16).otherwise(0.0)


def position_bonus(hint: Column, row: Column, rows: Column) -> Column:
    """FN14: bonus for a row near the place the metric usually stands at."""
    ratio = row / F.greatest(F.lit(1), rows - 1)
    zero = F.lit(0.0)
    return (
        F.when((rows <= 1) | hint.isNull() | (hint == "any"), 0.0)
        .when(hint == "top", F.greatest(zero, 1 - ratio / 0.4) * 0.04)
        .when(hint == "bottom", F.greatest(zero, 1 - (1 - ratio) / 0.4) * 0.04)
        .when(hint == "middle", F.greatest(zero, 1 - F.abs(ratio - 0.5) / 0.5) * 0.02)
        .otherwise(0.0)
    )


def character_jaccard(a: Column, b: Column) -> Column:
    """FN34: shared over all distinct characters; 0 where both are empty."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    x, y = F.filter(x, lambda c: c != ""), F.filter(y, lambda c: c != "")
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def title_match_weight(target: Column | str, heading: Column | str) -> Column:
    """FN34: struct(class, weight) of a heading against the wanted title."""
    a, b = normalize_text(target), normalize_text(heading)
    return (
        F.when((a == "") | (b == ""), F.struct(F.lit("NONE").alias("kind"), F.lit(0.0).alias("weight")))
        .when(a == b, F.struct(F.lit("EXACT").alias("kind"), F.lit(0.28).alias("weight")))
        .when(b.startswith(a), F.struct(F.lit("PREFIX").alias("kind"), F.lit(0.24).alias("weight")))
        .when(b.contains(a), F.struct(F.lit("CONTAINS").alias("kind"), F.lit(0.14).alias("weight")))
        .when(a.contains(b), F.struct(F.lit("CONTAINED").alias("kind"), F.lit(0.06).alias("weight")))
        .otherwise(F.struct(F.lit("OVERLAP").alias("kind"), F.round(0.03 * character_jaccard(a, b), 6).alias("weight")))
    )


def title_compatible(title: Column | str, query: Column | str) -> Column:
    """FI21: whether a heading may be that of the wanted table: one contains the other, the heading with four characters at least; blank texts fit nothing."""
    t, q = (F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", "") for x in (title, query))
    return (t != "") & (q != "") & (t.contains(q) | (q.contains(t) & (F.length(t) >= 4)))


def scope_compatible(hint: Column, wanted: Column) -> Column:
    """FI24: an unknown scope fits every wanted one."""
    h = F.when(F.coalesce(hint, F.lit("")) == "", "UNKNOWN").otherwise(hint)
    return (h == "UNKNOWN") | F.coalesce(h == wanted, F.lit(False))


# Texts of an amount cell that state no amount.
NO_AMOUNT = ("", "-", "—", "–", "－")


def member_period_status(regime: Column, member_regime: Column, amount: Column, outside: Column) -> Column:
    """FN41: state of a statement row. ``outside``: a registered member that does not stand below the explicit parent of its page."""
    mixed, fresh, legacy, _ = REGIMES
    raw = F.trim(F.coalesce(amount, F.lit("")))
    stated = ~raw.isin(*NO_AMOUNT)
    return (
        F.when(F.coalesce(outside, F.lit(False)), "OUTSIDE_FAMILY")
        .when((regime == mixed) & F.coalesce(member_regime == legacy, F.lit(False)) & raw.isin(*NO_AMOUNT, "N/A", "n/a"), "COMPARATIVE_ONLY_LEGACY_MEMBER")
        .when(F.coalesce(regime.isin(fresh, mixed, legacy), F.lit(False)) & stated, "ACTIVE_CURRENT_PERIOD")
        .otherwise("UNRESOLVED")
    )


def page_cache_key(mode: Column, language: Column, dpi: Column, quality: Column, native: Column, pages: Column) -> Column:
    """FN49: 12 digits that name a configuration of page reading; ``pages``: array of page numbers read anew, in any order."""
    parts = F.concat(mode, F.lit("_"), language, F.lit("_"), dpi.cast("string"), F.lit("_fq"), quality.cast("string"), F.lit("_mn"), F.coalesce(native.cast("string"), F.lit("na")), F.lit("_"), F.array_join(F.array_sort(pages).cast("array<string>"), "-"))
    return F.substring(F.sha1(parts), 1, 12)


def list_to_json(x: Column) -> Column:
    """FN47: list column as JSON text; null as an empty list."""
    return F.to_json(F.coalesce(x, F.array().cast("array<string>")))


def json_to_list(x: Column) -> Column:
    """FN47: JSON text to a list; blank and broken text to an empty one."""
    return F.coalesce(F.from_json(x, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def find_label(cells: Column | str, is_number) -> Column:
    """FN7: first non-blank, non-numeric cell of at most 150 characters among the first eight; struct(column, label) or null."""
    numbered = F.transform(F.slice(_c(cells), 1, 8), lambda x, i: F.struct(i.alias("column"), clean_cell(x).alias("label")))
    fit = F.filter(numbered, lambda s: (s["label"] != "") & ~is_number(s["label"]) & (F.length(s["label"]) <= 150))
    return F.try_element_at(fit, F.lit(1))


def sanitize_table(rows: Column | str) -> Column:
    """FN55: ragged rows padded with '', cells cleaned, blank rows dropped."""
    r = F.filter(_c(rows), lambda x: x.isNotNull())
    width = F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0))
    padded = F.transform(r, lambda x: F.transform(F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))), clean_cell))
    return F.filter(padded, lambda x: F.exists(x, lambda c: c != ""))


def table_signature(rows: Column | str) -> Column:
    """FN12: sha1 of the normalized cells of the first 20 rows."""
    lines = F.transform(F.slice(_c(rows), 1, 20), lambda r: F.array_join(F.transform(r, normalize_text), "|"))
    return F.sha1(F.array_join(lines, "\n"))


def stored_name(x: Column | str) -> Column:
    """PR23: file name without the 12-digit storage prefix."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^[0-9a-fA-F]{12}_", "")


def file_year(x: Column | str) -> Column:
    """PR22: first 20dd in the stored file name, or null."""
    return F.nullif(F.regexp_extract(stored_name(x), r"(20\d{2})", 1), F.lit(""))


# Endings of a report's file name.
REPORT_ENDINGS = r"(?:年)?(?:年度信息披露报告|年度报告|年报|年度财务报告|信息披露报告|报告|财务报表|偿付能力报告)$"


def file_company(x: Column | str) -> Column:
    """PR22: what the file name says besides year and report words."""
    stem = F.regexp_replace(stored_name(x), r"\.[^.]*$", "")
    s = F.regexp_replace(stem, r"20\d{2}", "")
    s = F.regexp_replace(s, REPORT_ENDINGS, "")
    s = F.regexp_replace(F.regexp_replace(s, r"[_\-\s]+", " "), r"^[ _-]+|[ _-]+$", "")
    return F.when(s != "", s).otherwise(stem)


def download_name(x: Column | str, extension: str) -> Column:
    """FN51: safe file name."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), r'[\\/:*?"<>|\s]+', "_")
    return F.concat(F.when(s != "", s).otherwise("export"), F.lit("." + extension))


def printed_page(x: Column | str) -> Column:
    """FN57: number of a line that holds only a page number, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?m)^[-—\s]*(\d{1,4})[-—\s]*$", 1), F.lit(""))


# Review reasons; a text that is one of them stays.
REASONS = (
    "BOUNDARY_LOW_CONFIDENCE", "HEADER_AMBIGUOUS", "ROW_STRUCTURE_AMBIGUOUS", "UNIT_UNCERTAIN", "SCOPE_UNCERTAIN", "RESTATEMENT_UNCERTAIN", "SOURCE_IDENTITY_MISSING", "RECONCILIATION_WARNING",
    "RECONCILIATION_MISMATCH", "MIXED_CELL", "IMPLICIT_TOTAL_UNCERTIFIED", "UNSUPPORTED_LAYOUT", "MANUAL_OVERRIDE_REQUIRED", "IMPLICIT_TOTAL_UNCERTIFIED_NON_BLOCKING", "DERIVED_OBSERVATION_WARNING",
    "ANONYMOUS_NUMERIC_ROW_PRESENT", "BOUNDARY_AUTO_ACCEPTED_WITH_WARNING",
)
# Pattern of the upper-case text -> reason, the first that fits.
REASON_RULES = {
    "BOUNDARY": "BOUNDARY_LOW_CONFIDENCE", "HEADER": "HEADER_AMBIGUOUS", "STRUCTURE|ROW_": "ROW_STRUCTURE_AMBIGUOUS", "^MIXED_CELL:": "MIXED_CELL", "^IMPLICIT_ROW_UNRESOLVED:": "IMPLICIT_TOTAL_UNCERTIFIED",
    "^IMPLICIT_TOTAL_UNCERTIFIED_NON_BLOCKING": "IMPLICIT_TOTAL_UNCERTIFIED_NON_BLOCKING", "^DERIVED_OBSERVATION_WARNING": "DERIVED_OBSERVATION_WARNING", "^ANONYMOUS_NUMERIC_ROW": "ANONYMOUS_NUMERIC_ROW_PRESENT",
    "UNIT": "UNIT_UNCERTAIN", "SOURCE|IDENTITY": "SOURCE_IDENTITY_MISSING", "RECONCILIATION.*MISMATCH|MISMATCH.*RECONCILIATION": "RECONCILIATION_MISMATCH", "RECONCILIATION": "RECONCILIATION_WARNING",
}


def review_reason(x: Column | str) -> Column:
    """FN44: free reason text to its class (REASON_RULES), else itself if it is one, else ROW_STRUCTURE_AMBIGUOUS."""
    t = F.upper(F.coalesce(_c(x), F.lit("")))
    out = F.when(t.isin(*REASONS), t).otherwise("ROW_STRUCTURE_AMBIGUOUS")
    for pattern, name in reversed(REASON_RULES.items()):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


@F.pandas_udf(T.DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """FN3: Ratcliff-Obershelp ratio; 0 where either text is empty or null. Each distinct pair of a batch is computed once."""
    memo: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in memo:
            x, y = pair
            memo[pair] = difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_similarity(label: pd.Series, names: pd.Series) -> pd.Series:
    """FN3: greatest ratio of a label to any of several names; 0 where either side is empty. Each pair of a batch is computed once, and only
    where its length and characters leave room for more than the best so far."""
    memo: dict[tuple, float] = {}

    def ratio(x: str, y: str, floor: float) -> float:
        if (x, y) not in memo:
            m = difflib.SequenceMatcher(None, x, y)
            if m.real_quick_ratio() <= floor or m.quick_ratio() <= floor:
                return 0.0
            memo[x, y] = m.ratio()
        return memo[x, y]

    out = []
    for x, ys in zip(label, names):
        best = 0.0
        for y in dict.fromkeys(ys if ys is not None else ()):
            if x and y:
                best = max(best, ratio(x, y, best))
        out.append(best)
    return pd.Series(out, dtype="float64")
