"""Text pages and their lines: page kinds, statement and section pages, references, note locating, row amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.notes import peer_heading
from tallywright.functions.text import normalize_text, title_match_weight

# Title words of the primary statements and of disclosure sections.
STATEMENTS = {"BALANCE_SHEET": ("资产负债表",), "INCOME": ("利润表", "损益表"), "CASH_FLOW": ("现金流量表",), "EQUITY": ("所有者权益变动表", "股东权益变动表")}
SECTIONS = {"MANAGEMENT_DISCUSSION": ("管理层讨论", "经营情况讨论"), "INVESTMENT_BUSINESS_ANALYSIS": ("投资业务", "投资组合"), "BUSINESS_REVIEW": ("业务回顾", "业务概要")}
STRUCTURE_WORDS = ("项目", "附注", "合计", "资产总计", "负债合计", "净利润")


def lines_of(pages: DataFrame) -> DataFrame:
    """(page_id, line, content) with trimmed lines; null and empty texts give one empty line."""
    return pages.select("page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content")).withColumn("content", F.trim("content"))


def contains_any(x: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | x.contains(w)
    return hit


def is_contents_page(text: Column) -> Column:
    """FI22: contents page: the title in the first 36 lines, or two dotted lines and three that end in a number."""
    lead = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 36)
    dotted, numbered = F.filter(lead, lambda x: x.rlike(r"[.．·…]{3,}")), F.filter(lead, lambda x: F.trim(x).rlike(r"\d{1,4}$"))
    head = F.lower(F.regexp_replace(F.array_join(lead, ""), r"\s+", ""))
    return head.contains("目录") | head.contains("contents") | ((F.size(dotted) >= 2) & (F.size(numbered) >= 3))


def page_modality(chars: Column, images: Column, largest: Column, least_chars: int = 80, area: float = 0.5) -> Column:
    """FN36: IMAGE_DOMINANT, EMPTY_OR_UNKNOWN, HYBRID or TEXT_DOMINANT."""
    few, big = chars < least_chars, largest >= area
    return F.when(few & big, "IMAGE_DOMINANT").when(few & (images == 0), "EMPTY_OR_UNKNOWN").when((images > 0) & big, "HYBRID").otherwise("TEXT_DOMINANT")


def statement_score(text: Column, kind: str) -> Column:
    """FN37: 0 without the statement's title, else 0.58 with bounded bonuses for structure words, dates and units, at most 0.99."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    words = sum((F.when(s.contains(w), 1).otherwise(0) for w in STRUCTURE_WORDS), F.lit(0))
    date, unit = s.rlike(r"20\d{2}年|年\d{1,2}月\d{1,2}日|期末|期初"), s.rlike(r"人民币[元万千]|单位[:：]?(?:元|万元|千元|百万元)")
    score = 0.58 + F.least(F.lit(0.22), words * 0.04) + F.when(date, 0.08).otherwise(0.0) + F.when(unit, 0.06).otherwise(0.0)
    return F.when(contains_any(s, STATEMENTS[kind]), F.least(F.lit(0.99), score)).otherwise(0.0)


def section_pages(pages: DataFrame, patterns: dict[str, Sequence[str]], head: int = 2500) -> DataFrame:
    """RK14, RK15: (kind, page_id, by_title): pages whose head names a statement or section; by_title where a line is that title."""
    out = None
    for kind, words in patterns.items():
        lead = F.coalesce(F.array_join(F.slice(F.split("text", "\n"), 1, 32), "\n"), F.lit(""))
        titled = lead.rlike(r"(?m)(" + "|".join(words) + r")\s*(?:[(（][^\n]*[)）])?[:：]?\s*$")
        one = pages.where(contains_any(F.coalesce(F.substring("text", 1, head), F.lit("")), words)).select(F.lit(kind).alias("kind"), "page_id", titled.alias("by_title"))
        out = one if out is None else out.unionByName(one)
    return out


def primary_pages(found: DataFrame) -> DataFrame:
    """RK14: of each kind the pages found by title; pages that only mention it where no title was found."""
    any_title = found.groupBy("kind").agg(F.bool_or("by_title").alias("titled"))
    return found.join(any_title, "kind").where(F.col("by_title") | ~F.col("titled")).select("kind", "page_id")


def note_references(pages: DataFrame, items: Sequence[str]) -> DataFrame:
    """RK16: (page_id, line, item, note): in each line the longest listed item, then the first note number after it; lines without one give no row."""
    longest = F.lit(None).cast("string")
    for item in sorted(items, key=lambda x: (len(x), x)):
        longest = F.when(F.col("content").contains(item), F.lit(item)).otherwise(longest)
    x = lines_of(pages).withColumn("item", longest).where("item IS NOT NULL")
    tail = F.expr("substring(content, locate(item, content) + length(item))")
    return x.withColumn("note", F.regexp_extract(tail, r"(?:附注\s*)?(\d{1,2})(?:\D|$)", 1)).where("note <> ''").select("page_id", "line", "item", F.col("note").cast("int").alias("note"))


def locate_notes(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """RK13, RK27: best heading for each wanted note (item, note): confidence 0.98 with number and title, 0.90 with title alone, 0 without.

    Headings and wanted notes meet by number first and by title for the rest, so no note meets all headings.
    """
    heads = lines_of(pages).withColumn("h", peer_heading("content")).where("h IS NOT NULL").select("page_id", "line", F.col("h.ordinal").alias("note"), F.col("h.title").alias("title"))
    w = wanted.select("item", "note", normalize_text("item").alias("n")).distinct()
    by_number = w.join(heads, "note").where(normalize_text("title").contains(F.col("n"))).select("item", "note", "page_id", "line", F.lit(0.98).alias("confidence"), title_match_weight("item", "title")["weight"].alias("weight"))
    by_title = w.join(heads.select("page_id", "line", "title"), F.col("n") == normalize_text("title")).select("item", "note", "page_id", "line", F.lit(0.90).alias("confidence"), F.lit(0.28).alias("weight"))
    best = by_number.unionByName(by_title).groupBy("item", "note").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("weight")).alias("w"), "page_id", "line")).alias("m"))
    return w.select("item", "note").join(best, ["item", "note"], "left").select("item", "note", F.col("m.page_id").alias("page_id"), F.col("m.line").alias("line"), F.coalesce(-F.col("m.c"), F.lit(0.0)).alias("confidence"))


def following_amounts(pages: DataFrame, labels: Sequence[str], reach: int = 6) -> DataFrame:
    """WI18, FI23, JO36: amounts on up to ``reach`` lines after a label line, up to the next line with ideographs: (page_id, line, amounts)."""
    order = Window.partitionBy("page_id").orderBy("line")
    x = lines_of(pages).where("content <> ''")
    labelled, stop = F.lit(False), None
    for label in labels:
        labelled = labelled | (F.col("content") == label)
    x = x.withColumn("is_label", labelled)
    amounts = []
    for k in range(1, reach + 1):
        cell = F.lead("content", k).over(order)
        blocked = F.coalesce(cell.rlike(r"[\x{4E00}-\x{9FFF}]"), F.lit(True))
        stop = blocked if stop is None else stop | blocked
        value = F.regexp_replace(cell, "[,，]", "").try_cast("double")
        amounts.append(F.when(~stop & value.isNotNull(), value))
    return x.withColumn("amounts", F.filter(F.array(*amounts), lambda v: v.isNotNull())).where("is_label").select("page_id", "line", "content", "amounts")


def absence(found: Column, exact: Column, alias: Column, searched: Column, table: Column, narrative: Column, reviewed: Column) -> Column:
    """RK18: why a table was or was not found."""
    return (
        F.when((found > 0) & exact & table, "FOUND_CANONICAL_TABLE")
        .when((found > 0) & alias & table, "FOUND_DISCLOSURE_VARIANT")
        .when((found > 0) & narrative, "NARRATIVE_ONLY")
        .when(found > 0, "FOUND_DISCLOSURE_VARIANT")
        .when(reviewed & searched, "LEGITIMATELY_ABSENT")
        .when(~searched, "DISCOVERY_FAILED")
        .otherwise("UNRESOLVED")
    )


def statement_rows(pages: DataFrame, members: Sequence[str]) -> DataFrame:
    """AG30, FN42: member rows of a statement family per page: number of members, first line, amounts on the line, regime of the page's labels.
    Pages without a member give no row."""
    from tallywright.functions.text import presentation_regime

    named = F.lit(None).cast("string")
    for m in sorted(members, key=lambda x: (len(x), x)):
        named = F.when(F.col("content").startswith(m), F.lit(m)).otherwise(named)
    x = lines_of(pages).withColumn("member", named).where("member IS NOT NULL")
    numbers = F.size(F.regexp_extract_all("content", F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1))
    g = x.groupBy("page_id").agg(F.countDistinct("member").alias("members"), F.min("line").alias("first_line"), F.sum(numbers).alias("amounts"), F.array_sort(F.collect_set("member")).alias("labels"))
    return g.withColumn("regime", presentation_regime("labels")).withColumn("labels", F.array_join("labels", "|"))


def anchor_relation(anchor: Column, numbers: Column, most: int = 30) -> Column:
    """RE7: how a note's numbers explain a statement amount: EXACT_TOTAL, GROSS_MINUS_ALLOWANCE (two of the first ``most``) or NONE; null amounts are MISSING."""
    tolerance = F.greatest(F.lit(0.5), F.abs(anchor) * 1e-8)
    head = F.slice(numbers, 1, most)
    exact = F.exists(numbers, lambda v: F.abs(v - anchor) <= tolerance)
    pair = F.exists(head, lambda g: F.exists(head, lambda a: (g >= a) & (F.abs(g - a - anchor) <= tolerance)))
    return F.when(anchor.isNull(), "MISSING_MAIN_STATEMENT_AMOUNT").when(exact, "EXACT_TOTAL").when(pair, "GROSS_MINUS_ALLOWANCE").otherwise("NONE")
