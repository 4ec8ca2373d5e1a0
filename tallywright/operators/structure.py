"""Row structure of captured tables: parents by level, subtotals, formulas and arithmetic audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.text import identity_text
from tallywright.functions.numbers import audit_status, block_tolerance, rounding_tolerance
from tallywright.operators.hierarchy import SEPARATOR, resolve_paths

TOTAL_WORDS = "合计|总计|小计|总额"
DIMS = ("column_ordinal", "data_year", "statement_scope", "restated_flag")


def is_total(item: Column) -> Column:
    return F.coalesce(item.rlike(TOTAL_WORDS), F.lit(False))


def level_of(path: Column) -> Column:
    """Depth of a row path; null counts as a top row."""
    return F.coalesce(F.size(F.split(path, SEPARATOR)) - 1, F.lit(0))


def _nearest_by_level(rows: DataFrame, askers: DataFrame, later: bool, found: str) -> DataFrame:
    """For each asking row the nearest earlier row of a smaller level (or, with ``later``, the nearest later row of the same or a smaller one), as ``found``.

    Rows are published under every level that they can answer, up to the deepest of their table; a row asks under its own level and a
    running window per (capture_id, level) finds the last one published. Work grows with the depth of a table, not with its length squared.
    """
    top = rows.groupBy("capture_id").agg(F.max("level").alias("__top"))
    first = F.col("level") if later else F.col("level") + 1
    published = rows.join(top, "capture_id").where(first <= F.col("__top")).select("capture_id", F.explode(F.sequence(first, F.col("__top"))).alias("key"), "row_order", F.lit(False).alias("asks"))
    asking = askers.select("capture_id", F.col("level").alias("key"), "row_order", F.lit(True).alias("asks"))
    place = F.col("row_order").desc() if later else F.col("row_order")
    w = Window.partitionBy("capture_id", "key").orderBy(place, F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("asks"), F.col("row_order")), True).over(w)
    return published.unionByName(asking).withColumn(found, last).where("asks").select("capture_id", "row_order", found)


def parents_by_level(rows: DataFrame) -> DataFrame:
    """HI1: parent_row_order, confidence and evidence of every row from levels and stated sections.

    Rows: capture_id, row_order, level (null or negative counts as 0), is_total, label and parent_section (either may be missing or null). The ancestor of a
    row at a level is the last earlier row of that level or less, if it has just that level and is no total (totals close a block and are never parents).
    The parent is the nearest ancestor, or, where the row states its section, the nearest ancestor of that label: EXPLICIT_PARENT_SECTION 0.82; a section
    that no ancestor bears is PARENT_SECTION_UNMATCHED 0.58 and leaves the nearest ancestor. ROW_LEVEL is 0.66, ORDER alone 0.35, a total at least 0.72.

    Rows are published under the levels they answer and ask under the smaller levels; one running window per (capture_id, level) answers all, so
    work grows with the depth of a table, not with its length squared, and nothing is gathered.
    """
    have = set(rows.columns)
    x = rows.withColumn("level", F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)))
    x = x.withColumn("label", F.col("label") if "label" in have else F.lit(None).cast("string")).withColumn("parent_section", identity_text("parent_section") if "parent_section" in have else F.lit(""))
    top = x.groupBy("capture_id").agg(F.max("level").alias("__top"))
    base = x.join(top, "capture_id")
    shown = F.struct("row_order", "level", "is_total", "label")
    published = base.select("capture_id", F.explode(F.sequence("level", "__top")).alias("key"), "row_order", shown.alias("row"), F.lit(False).alias("asks"), F.lit("").alias("parent_section"))
    asking = x.where("level > 0").select("capture_id", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("key"), "row_order", F.lit(None).cast(published.schema["row"].dataType).alias("row"), F.lit(True).alias("asks"), "parent_section")
    w = Window.partitionBy("capture_id", "key").orderBy("row_order", F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = published.unionByName(asking).withColumn("up", F.last(F.when(~F.col("asks"), F.col("row")), True).over(w)).where("asks AND up.level = key AND NOT up.is_total")
    named = F.when((F.col("parent_section") != "") & (F.col("up.label") == F.col("parent_section")), F.col("up.row_order"))
    found = seen.groupBy("capture_id", "row_order").agg(F.max("up.row_order").alias("__near"), F.max(named).alias("__named"))
    y = x.join(found, ["capture_id", "row_order"], "left")
    stated, by_level = F.col("parent_section") != "", (F.col("level") > 0) & F.col("__near").isNotNull()
    confidence = F.when(stated & F.col("__named").isNotNull(), 0.82).when(stated, 0.58).when(by_level, 0.66).otherwise(0.35)
    first = F.when(stated & F.col("__named").isNotNull(), "EXPLICIT_PARENT_SECTION").when(stated, "PARENT_SECTION_UNMATCHED").when(by_level, "ROW_LEVEL")
    return y.select(
        *rows.columns, F.coalesce("__named", "__near").alias("parent_row_order"), F.when(F.col("is_total"), F.greatest(confidence, F.lit(0.72))).otherwise(confidence).alias("confidence"),
        F.concat_ws("+", first, F.lit("ORDER"), F.when(F.col("is_total"), "TOTAL_SUBTOTAL_CUE")).alias("evidence"),
    )


def ensure_paths(rows: DataFrame) -> DataFrame:
    """HI2: row paths of captures that have them all, inferred paths (parents_by_level, then pointer doubling) for the others.
    Input: capture_id, row_order, row_path, normalized_item."""
    whole = rows.groupBy("capture_id").agg(F.bool_and(F.col("row_path").isNotNull()).alias("complete"))
    marked = rows.join(whole, "capture_id")
    kept = marked.where("complete").select("capture_id", "row_order", "row_path")
    open_ = marked.where("NOT complete")
    tree = parents_by_level(open_.select("capture_id", "row_order", level_of(F.col("row_path")).alias("level"), is_total(F.col("normalized_item")).alias("is_total"), "normalized_item"))
    paths = resolve_paths(tree.select("capture_id", "row_order", "parent_row_order", "normalized_item"))
    return kept.unionByName(paths.select("capture_id", "row_order", F.col("full_path").alias("row_path")))


def subtotal_checks(rows: DataFrame) -> DataFrame:
    """RE3, JO27, JO28: parent rows against the sum of their direct children, per column dimension (null dimensions match).

    A child's parent path is its path without the last part, so parent and children meet by equality; sums are
    combined before the join. Parents named like totals and parents with fewer than two child rows are left out.
    Status: PASS, PASS_WITH_ROUNDING (unit tolerance) or WARNING.
    """
    data = rows.where("value IS NOT NULL AND row_path IS NOT NULL")
    children = (
        data.where(F.col("row_path").contains(SEPARATOR))
        .withColumn("parent_path", F.regexp_replace("row_path", SEPARATOR + "(?:(?!" + SEPARATOR + ").)*$", ""))
        .groupBy("capture_run_id", "parent_path", *DIMS)
        .agg(F.sum("value").alias("children_sum"), F.count("*").alias("n_children"), F.countDistinct("row_order").alias("n_rows"))
        .where("n_rows >= 2")
    )
    p, c = data.where(~is_total(F.col("normalized_item"))).alias("p"), children.alias("c")
    on = (F.col("p.capture_run_id") == F.col("c.capture_run_id")) & (F.col("p.row_path") == F.col("c.parent_path"))
    for dim in DIMS:
        on = on & F.col("p." + dim).eqNullSafe(F.col("c." + dim))
    joined = p.join(c, on).select("p.observation_id", "p.capture_run_id", "p.row_order", "p.value", "p.unit", "c.children_sum", "c.n_children")
    yuan = F.coalesce(F.col("unit") == "元", F.lit(False))
    gap = F.abs(F.col("value") - F.col("children_sum"))
    status = F.when(gap <= F.greatest(F.lit(1e-8), F.abs("value") * 1e-10), "PASS").when(gap <= rounding_tolerance(F.col("unit"), F.col("n_children"), yuan), "PASS_WITH_ROUNDING").otherwise("WARNING")
    return joined.select("observation_id", "capture_run_id", "row_order", "value", "n_children", F.col("children_sum"), status.alias("status"))


def running_totals(rows: DataFrame) -> DataFrame:
    """RE4, Q5: every total against the sum of all values above it in its column; NOT_TESTABLE where there are none."""
    w = Window.partitionBy("capture_run_id", "column_ordinal").orderBy("row_order", "observation_id").rowsBetween(Window.unboundedPreceding, -1)
    s = rows.where("value IS NOT NULL AND row_order IS NOT NULL").withColumn("above", F.sum("value").over(w)).where(is_total(F.col("normalized_item")))
    ok = F.abs(F.col("value") - F.col("above")) <= block_tolerance(F.col("value"))
    return s.select("observation_id", "capture_run_id", "row_order", "value", "above", F.when(F.col("above").isNull(), "NOT_TESTABLE").when(ok, "PASS").otherwise("MISMATCH").alias("status"))


def formulas(rows: DataFrame) -> DataFrame:
    """RE1: formula of every total row from structure alone: (capture_id, row_order, pattern, block, base_order, operator, first_below).

    Rows: capture_id, row_order, level, is_total, is_section, operator (1, -1 or null: 加 / 减 headings).
    LEADING_PARENT_TOTAL: deeper rows follow. BASE_PLUS_COMPONENTS / BASE_MINUS_COMPONENTS: an 加/减 heading stands between the last total and this one.
    TRAILING_TOTAL: rows since the last heading or total. UNKNOWN otherwise. All of it is running windows.
    """
    order = Window.partitionBy("capture_id").orderBy("row_order")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.col("is_total") | F.col("is_section")
    x = rows.withColumn("block", F.coalesce(F.sum(edge.cast("int")).over(before), F.lit(0)))
    x = x.withColumn("last_total", F.max(F.when(F.col("is_total"), F.col("row_order"))).over(before)).withColumn("last_operator", F.max(F.when(F.col("operator").isNotNull(), F.struct("row_order", "operator"))).over(before))
    x = x.withColumn("next_level", F.lead("level").over(order)).withColumn("in_block", F.sum((~edge).cast("int")).over(Window.partitionBy("capture_id", "block")))
    leading = F.coalesce(F.col("next_level") > F.col("level"), F.lit(False))
    based = F.col("last_operator").isNotNull() & F.col("last_total").isNotNull() & (F.col("last_operator.row_order") > F.col("last_total")) & (F.col("in_block") > 0)
    pattern = (
        F.when(leading, "LEADING_PARENT_TOTAL")
        .when(based & (F.col("last_operator.operator") == -1), "BASE_MINUS_COMPONENTS")
        .when(based, "BASE_PLUS_COMPONENTS")
        .when(F.col("in_block") > 0, "TRAILING_TOTAL")
        .otherwise("UNKNOWN")
    )
    return x.where("is_total").select(
        "capture_id", "row_order", "level", pattern.alias("pattern"), "block",
        F.when(based & ~leading, F.col("last_total")).alias("base_order"), F.when(based & ~leading, F.col("last_operator.operator")).otherwise(F.lit(1)).alias("operator"),
    )


def formula_members(rows: DataFrame, found: DataFrame, span: int = 32) -> DataFrame:
    """Rows that enter each formula: (capture_id, row_order, member_order, operator, nested). Blocks meet by equality; rows below a leading
    total meet in spans of row orders, up to the next row that is not deeper, so no total meets a whole table."""
    order = Window.partitionBy("capture_id").orderBy("row_order")
    edge = F.col("is_total") | F.col("is_section")
    placed = rows.withColumn("block", F.coalesce(F.sum(edge.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_block = found.where("pattern NOT IN ('UNKNOWN', 'LEADING_PARENT_TOTAL')").join(
        placed.where(~edge).select("capture_id", "block", F.col("row_order").alias("member_order")), ["capture_id", "block"]
    ).select("capture_id", "row_order", "member_order", "operator", F.lit(False).alias("nested"))
    bases = found.where("base_order IS NOT NULL").select("capture_id", "row_order", F.col("base_order").alias("member_order"), F.lit(1).alias("operator"), F.lit(False).alias("nested"))
    leading = found.where("pattern = 'LEADING_PARENT_TOTAL'").select("capture_id", "row_order", "level")
    end = rows.groupBy("capture_id").agg((F.max("row_order") + 1).alias("end"))
    ranges = _nearest_by_level(rows, leading, True, "until").join(end, "capture_id").select("capture_id", "row_order", F.coalesce("until", "end").alias("until"))
    spread = ranges.withColumn("span", F.explode(F.sequence(F.floor(F.col("row_order") / span), F.floor(F.col("until") / span))))
    below = spread.join(rows.select("capture_id", F.floor(F.col("row_order") / span).alias("span"), F.col("row_order").alias("member_order"), F.col("is_total").alias("nested"), "is_section"), ["capture_id", "span"]).where(
        "member_order > row_order AND member_order < until AND NOT is_section"
    )
    return in_block.unionByName(bases).unionByName(below.select("capture_id", "row_order", "member_order", F.lit(1).alias("operator"), "nested"))


def audit_totals(values: DataFrame, rows: DataFrame) -> DataFrame:
    """RE2: one row per total and column ordinal: calculated sum, difference and status.

    ``values``: capture_id, row_order, column_ordinal, value, unit (one reading per cell; several different ones make the cell ambiguous).
    PASS_EXACT, PASS_ROUNDING, WARNING_SUM_MISMATCH; WARNING_COMPONENT_SCOPE_AMBIGUOUS where a member lacks a single value, contains a nested total or
    has another unit; NOT_TESTABLE_NO_CONFIDENT_CHILD_SET without members.
    """
    cells = values.where("value IS NOT NULL").groupBy("capture_id", "row_order", "column_ordinal").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("unit").alias("unit"))
    found = formulas(rows)
    members = formula_members(rows, found)
    targets = found.join(cells.where("lo = hi"), ["capture_id", "row_order"]).select("capture_id", "row_order", "pattern", "column_ordinal", F.col("lo").alias("reported"), F.col("unit").alias("t_unit"))
    wanted = targets.select("capture_id", "row_order", "column_ordinal", "t_unit").join(members, ["capture_id", "row_order"])
    member_cells = cells.select("capture_id", F.col("row_order").alias("member_order"), "column_ordinal", "lo", "hi", F.col("unit").alias("m_unit"))
    parts = wanted.join(member_cells, ["capture_id", "member_order", "column_ordinal"], "left")
    unclear = F.col("lo").isNull() | (F.col("lo") != F.col("hi")) | F.col("nested") | (F.col("t_unit").isNotNull() & F.col("m_unit").isNotNull() & (F.col("t_unit") != F.col("m_unit")))
    sums = parts.groupBy("capture_id", "row_order", "column_ordinal").agg(F.sum(F.col("operator") * F.col("lo")).alias("calculated"), F.count("*").alias("n_members"), F.max(unclear.cast("int")).alias("unclear"))
    out = targets.join(sums, ["capture_id", "row_order", "column_ordinal"], "left")
    status = (
        F.when(F.col("n_members").isNull(), "NOT_TESTABLE_NO_CONFIDENT_CHILD_SET")
        .when(F.col("unclear") == 1, "WARNING_COMPONENT_SCOPE_AMBIGUOUS")
        .otherwise(audit_status(F.col("calculated") - F.col("reported"), F.col("reported")))
    )
    return out.select("capture_id", "row_order", "column_ordinal", "pattern", "reported", F.when(F.col("unclear") == 0, F.col("calculated")).alias("calculated"), "n_members", status.alias("status"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """SK5: number of totals per status family."""
    return audit.groupBy(F.regexp_extract("status", "^(PASS|WARNING|NOT_TESTABLE)", 1).alias("family"), "status").agg(F.count("*").alias("n"))


def implicit_totals(rows: DataFrame, tolerance: float = 2.0, part: Sequence[str] = ("capture_id",)) -> DataFrame:
    """WI13, WI14: unlabelled numeric rows that equal the sum of the two to four labelled rows right above them (shortest match), each part by itself;
    SUPPRESSED where a labelled total stands within five rows. Rows: the columns of ``part`` (a capture, or a capture and a column), row_order, raw_item, value."""
    order = Window.partitionBy(*part).orderBy("row_order")
    named = F.trim(F.coalesce("raw_item", F.lit(""))) != ""
    x = rows.withColumn("named", named)
    for k in range(1, 5):
        x = x.withColumn(f"v{k}", F.when(F.lag("named", k).over(order), F.lag("value", k).over(order)))
    near = order.rowsBetween(-5, 5)
    x = x.withColumn("explicit", F.max((F.col("named") & is_total(F.col("raw_item"))).cast("int")).over(near))
    total = F.col("v1")
    sums = []
    for k in range(2, 5):
        total = total + F.col(f"v{k}")
        sums.append(F.when(F.abs(total - F.col("value")) <= tolerance, k))
    size = F.coalesce(*sums)
    return x.where(~F.col("named") & F.col("value").isNotNull()).withColumn("children", size).where("children IS NOT NULL").select(
        *part, "row_order", "value", "children", F.when(F.col("explicit") == 1, "SUPPRESSED_BY_EXPLICIT_TOTAL").otherwise("DERIVED_REJECTED_NON_BLOCKING").alias("derived_status")
    )


def note_reconciliation(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: Column) -> DataFrame:
    """RE6: values of statement ``a`` and note ``b`` on one key: PASS, MISMATCH or MISSING_NOTE. ``tolerance`` reads column value."""
    right = b.groupBy(*key).agg(F.min("value").alias("note_value"))
    gap = F.abs(F.col("value") - F.col("note_value"))
    return a.join(right, list(key), "left").withColumn("status", F.when(F.col("note_value").isNull(), "MISSING_NOTE").when(gap <= tolerance, "PASS").otherwise("MISMATCH"))


def blocks(rows: DataFrame, change: Column) -> DataFrame:
    """HI6: number of the block a row belongs to: a new block begins where ``change`` is true. Rows: capture_id, row_order."""
    w = Window.partitionBy("capture_id").orderBy("row_order").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block_order", F.coalesce(F.sum(F.when(change, 1).otherwise(0)).over(w), F.lit(0)))
