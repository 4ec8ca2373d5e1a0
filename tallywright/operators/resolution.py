"""Metric resolution: evidence of candidate rows, arbitration, deterministic choice, and ranks by certified examples and templates."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.numbers import UNIT_FACTORS
from tallywright.functions.periods import is_period_header
from tallywright.functions.text import clean_cell, normalize_text
from tallywright.session import small

# Base quality of a row's source by the beginning or part of its method, and what recovery takes off.
SOURCE_BASE = (("^pdfplumber_table", 1.0), ("pymupdf_ocr", 0.80), ("^coordinate_rows", 0.70))
OTHER_SOURCE = 0.60
SOURCE_LOSS = {"adjacent_numeric_recovery": 0.08, "cross_block": 0.05}
UNKNOWN_TABLE = "未知表"
# Weights of the evidence of a candidate, and of score and evidence in the arbitration.
EVIDENCE = {
    "numeric_presence": 0.20, "numeric_parse_completeness": 0.08, "period_header_presence": 0.10, "period_header_strength": 0.10, "unit_presence": 0.10, "unit_compatibility": 0.15,
    "source_quality": 0.12, "known_table_type": 0.05, "inherited_header": 0.02, "own_header": 0.04,
}
STRONG_PERIOD = 0.7
SCORE_WEIGHT, EVIDENCE_WEIGHT = 0.72, 0.28
# Levels that a certified example may share with a context, and weights and threshold of its rank.
CERTIFIED_LEVELS = ("industry", "company", "filing_type", "statement_type", "scope", "table_family", "member_table")
CERTIFIED_LABELS = ("ACCEPT", "CONFIRMED", "CONFIRMED_AUTO")
CONFIDENCE_WEIGHT, LEVEL_WEIGHT, ABSTAIN_BELOW = 0.75, 0.25, 0.70
# Weights of a template's rank.
TEMPLATE_ROWS, TEMPLATE_COMPANY, TEMPLATE_TABLE = 0.55, 0.20, 0.25

#: One value of a candidate row.
VALUE = T.StructType().add("parsed", "double").add("header", "string").add("period_score", "double").add("unit", "string")


def source_quality(method: Column) -> Column:
    """RK3: quality of the way a row was read, 0..1."""
    m = F.coalesce(method, F.lit(""))
    out = F.lit(OTHER_SOURCE)
    for pattern, base in reversed(SOURCE_BASE):
        out = F.when(m.rlike(pattern), base).otherwise(out)
    for part, loss in SOURCE_LOSS.items():
        out = out - F.when(m.contains(part), loss).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def evidence_quality(values: Column, value_type: Column, method: Column, table_type: Column, header_page: Column) -> Column:
    """RK3: completeness of a candidate's evidence, 0..1 with six decimals: numbers, period headers, units that fit the value type, source, table type, header.

    ``values``: array of VALUE; null and empty count as a row without numbers.
    """
    n = F.coalesce(F.size(values), F.lit(0))
    share = lambda test: F.when(n > 0, F.size(F.filter(values, lambda v: F.coalesce(test(v), F.lit(False)))) / n).otherwise(0.0)
    has_unit = lambda v: F.trim(F.coalesce(v["unit"], F.lit(""))) != ""
    kind = F.lower(F.coalesce(value_type, F.lit("")))
    fits = F.when(kind == "percentage", share(lambda v: v["unit"] == "%")).when(kind == "monetary", share(lambda v: v["unit"].isin(*UNIT_FACTORS))).otherwise(share(has_unit))
    periods = share(lambda v: F.trim(v["header"]) != "")
    w = EVIDENCE
    total = (
        F.when(n > 0, w["numeric_presence"]).otherwise(0.0)
        + share(lambda v: v["parsed"].isNotNull()) * w["numeric_parse_completeness"]
        + periods * w["period_header_presence"]
        + share(lambda v: v["period_score"] >= STRONG_PERIOD) * w["period_header_strength"]
        + share(has_unit) * w["unit_presence"]
        + fits * w["unit_compatibility"]
        + source_quality(method) * w["source_quality"]
        + F.when(F.coalesce(table_type, F.lit(UNKNOWN_TABLE)) != UNKNOWN_TABLE, w["known_table_type"]).otherwise(0.0)
        + F.when(header_page.isNotNull(), w["inherited_header"]).when(periods > 0, w["own_header"]).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def arbitration(score: Column, quality: Column) -> Column:
    """RK4: one number from semantic score and evidence."""
    return F.round(score * SCORE_WEIGHT + quality * EVIDENCE_WEIGHT, 6)


def pick(candidates: DataFrame, key: Sequence[str], high: float = 0.86, medium: float = 0.72, margin: float = 0.10) -> DataFrame:
    """RK5, RK7: one decision for each key: (key, candidate_id or null, confidence, pick_reason, status).

    Candidates: key, candidate_id, match_class (FN53), qualified (carries the qualified-variant penalty), quality, arbitration, source_quality, n_values, score, page.
    An exact name or alias with a number wins over all others; one without a number stops the choice (EXACT_LABEL_WITHOUT_NUMBER). Else only rows with
    numbers take part (NO_NUMERIC_CANDIDATE without any); a qualified variant at the top goes to review; ``high`` alone or ``medium`` with ``margin`` resolve, the rest is
    AMBIGUOUS. Rows are ranked by match class, quality, arbitration, source, numbers, score, number of values, earlier page, then id.
    Status: RESOLVED with a candidate, REVIEW_REQUIRED with candidates but none chosen. Keys without candidates have no row.
    """
    exact, numeric = F.col("match_class").isin(50, 45), F.col("n_values") > 0
    order = [F.desc("match_class"), F.desc("quality"), F.desc("arbitration"), F.desc("source_quality"), numeric.desc(), F.desc("score"), F.desc("n_values"), F.asc("page"), F.asc("candidate_id")]
    group = Window.partitionBy(*key)
    x = candidates.withColumn("__exact", F.max((exact & numeric).cast("int")).over(group)).withColumn("__bare", F.max((exact & ~numeric).cast("int")).over(group))
    x = x.withColumn("__in", numeric & (exact | (F.col("__exact") == 0))).withColumn("__best_score", F.max("score").over(group)).withColumn("__exact_score", F.max(F.when(exact, F.col("score"))).over(group))
    ranked = x.withColumn("__place", F.row_number().over(group.orderBy(F.desc("__in"), *order))).withColumn("__next", F.lead(F.when(F.col("__in"), F.col("arbitration"))).over(group.orderBy(F.desc("__in"), *order)))
    top = ranked.where("__place = 1")
    gap = F.col("arbitration") - F.coalesce("__next", F.lit(0.0))
    reason = (
        F.when(F.col("__exact") == 1, "EXACT_LABEL").when(F.col("__bare") == 1, "EXACT_LABEL_WITHOUT_NUMBER").when(~F.col("__in"), "NO_NUMERIC_CANDIDATE").when(F.col("qualified"), "QUALIFIED_VARIANT")
        .when(F.col("arbitration") >= high, "HIGH_SCORE").when((F.col("arbitration") >= medium) & (F.round(gap, 9) >= margin), "MEDIUM_SCORE_WITH_MARGIN").otherwise("AMBIGUOUS")
    )
    chosen = F.col("pick_reason").isin("EXACT_LABEL", "HIGH_SCORE", "MEDIUM_SCORE_WITH_MARGIN")
    confidence = F.when(F.col("pick_reason") == "EXACT_LABEL_WITHOUT_NUMBER", F.col("__exact_score")).when(F.col("pick_reason") == "NO_NUMERIC_CANDIDATE", F.col("score")).otherwise(F.col("arbitration"))
    return top.withColumn("pick_reason", reason).select(*key, F.when(chosen, F.col("candidate_id")).alias("candidate_id"), confidence.alias("confidence"), "pick_reason", F.when(chosen, "RESOLVED").otherwise("REVIEW_REQUIRED").alias("status"))


def value_type_guard(status: Column, value_type: Column, unit: Column) -> Column:
    """RK7: a resolved value whose unit contradicts the metric's value type goes to review: struct(status, conflict)."""
    kind = F.lower(F.coalesce(value_type, F.lit("")))
    bad = F.coalesce(((kind == "percentage") & unit.isin(*UNIT_FACTORS)) | ((kind == "monetary") & (unit == "%")), F.lit(False)) & (status == "RESOLVED")
    return F.struct(F.when(bad, "REVIEW_REQUIRED").otherwise(status).alias("status"), F.when(bad, "VALUE_TYPE_CONFLICT").alias("conflict"))


def standard_metric(inputs: DataFrame, metrics: DataFrame, candidates: DataFrame, least: float = 0.78) -> DataFrame:
    """RK7: metric that each input text means: (input, metric_id, layer, confidence, status).

    L0: the normalized text is a name (or alias) of the rulebook; L1: the best candidate of ``metric_candidates`` (query, metric_id, score, place) scores ``least``;
    else UNRESOLVED with the best score as confidence. Inputs are distinct texts; null and blank ones are UNRESOLVED.
    """
    q = inputs.select("input").distinct().withColumn("n", normalize_text("input"))
    listed = metrics.select("metric_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t"))
    exact = listed.select(normalize_text("t").alias("n"), "metric_id").where("n <> ''").groupBy("n").agg(F.min("metric_id").alias("exact_id"))
    best = candidates.where("place = 1").select(F.col("query").alias("input"), F.col("metric_id").alias("near_id"), F.col("score").alias("near_score"))
    j = q.join(exact, "n", "left").join(best, "input", "left")
    near = F.coalesce(F.col("near_score") >= least, F.lit(False))
    return j.select(
        "input", F.coalesce("exact_id", F.when(near, F.col("near_id"))).alias("metric_id"), F.when(F.col("exact_id").isNotNull(), "L0").otherwise("L1").alias("layer"),
        F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.coalesce("near_score", F.lit(0.0))).alias("confidence"), F.when(F.col("exact_id").isNotNull() | near, "MAPPED").otherwise("UNRESOLVED").alias("status"),
    )


def period_headers(rows: DataFrame, lookback: int = 50) -> DataFrame:
    """WI11: header of each value column of a row from the nearest of the ``lookback`` rows above that holds period headers: adds ``headers``, a map of column to header.

    Rows: block_id, row, cells (array of text), value_cols (sorted array of column indices). As many headers as value columns are bound from left to right; otherwise headers in
    the same column first, the rest in order. No header row gives an empty map.
    """
    texts = F.transform("cells", lambda c, i: F.struct(i.alias("col"), clean_cell(c).alias("text")))
    own = F.filter(texts, lambda s: is_period_header(s["text"]))
    w = Window.partitionBy("block_id").orderBy("row").rangeBetween(-lookback, -1)
    x = rows.withColumn("__own", own).withColumn("__own", F.when(F.size("__own") > 0, F.col("__own"))).withColumn("h", F.coalesce(F.last("__own", True).over(w), F.array().cast("array<struct<col:int,text:string>>")))
    direct = F.filter("h", lambda s: F.array_contains("value_cols", s["col"]))
    x = x.withColumn("__direct", direct)
    open_cols = F.array_except("value_cols", F.transform("__direct", lambda s: s["col"]))
    open_texts = F.filter("h", lambda s: ~F.array_contains(F.transform("__direct", lambda d: d["text"]), s["text"]))
    pair = lambda cols, texts: F.filter(F.zip_with(cols, texts, lambda c, t: F.struct(c.alias("col"), t["text"].alias("text"))), lambda s: s["col"].isNotNull() & s["text"].isNotNull())
    bound = F.when(F.size("h") == F.size("value_cols"), pair(F.col("value_cols"), F.col("h"))).otherwise(F.concat("__direct", pair(open_cols, open_texts)))
    return x.withColumn("headers", F.map_from_entries(bound)).drop("__own", "__direct", "h")


def snippets(rows: DataFrame) -> DataFrame:
    """WI12: rows with ``snippet``, the cells of the row before, the row and the row behind it in its block. Rows: block_id, row, cells."""
    w = Window.partitionBy("block_id").orderBy("row")
    return rows.withColumn("snippet", F.filter(F.array(F.lag("cells").over(w), F.col("cells"), F.lead("cells").over(w)), lambda c: c.isNotNull()))


def _cube(rows: DataFrame, levels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every row under each set of its non-blank levels: keep columns, mask and the values of the set. Two rows share a set where they meet by equality."""
    sets = [s for k in range(1, len(levels) + 1) for s in itertools.combinations(range(len(levels)), k)]
    stated = lambda s: F.lit(True) if not s else stated(s[:-1]) & (F.coalesce(levels[s[-1]], F.lit("")) != "")
    entries = F.filter(F.array(*(F.when(stated(s), F.struct(F.lit(sum(1 << i for i in s)).alias("mask"), F.lit(len(s)).alias("size"), F.array(*(F.col(levels[i]).cast("string") for i in s)).alias("vs"))) for s in sets)), lambda e: e.isNotNull())
    return rows.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*")


def shared_levels(contexts: DataFrame, examples: DataFrame, levels: Sequence[str]) -> DataFrame:
    """RK19, RK20: most levels that a context shares with any one example: (context_id, matched). Contexts: context_id and the levels; examples: the levels.

    Both sides are put under all sets of their stated levels (2^n for n levels) and meet by equality, so no context meets all examples; examples are distinct.
    A context that shares none has 0.
    """
    known = _cube(examples.select(*levels).distinct(), levels, []).select("mask", "vs").distinct()
    hits = _cube(contexts.select("context_id", *levels), levels, ["context_id"]).join(known, ["mask", "vs"], "left_semi").groupBy("context_id").agg(F.max("size").alias("matched"))
    return contexts.select("context_id").distinct().join(hits, "context_id", "left").select("context_id", F.coalesce("matched", F.lit(0)).alias("matched"))


def certified_rank(candidates: DataFrame, contexts: DataFrame, examples: DataFrame, levels: Sequence[str] = CERTIFIED_LEVELS, least: float = ABSTAIN_BELOW) -> DataFrame:
    """RK20: candidates of each context ranked by confidence and the levels that certified examples share: (context_id, candidate_id, rank_score, place, status).

    Examples count with a label of CERTIFIED_LABELS. The first is RANKED if it scores ``least``, else the context is an ABSTAIN; others are CANDIDATE.
    """
    matched = shared_levels(contexts, examples.where(F.col("label").isin(*CERTIFIED_LABELS)), levels)
    score = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)) * CONFIDENCE_WEIGHT + F.col("matched") / float(len(levels)) * LEVEL_WEIGHT)
    w = Window.partitionBy("context_id").orderBy(F.desc("rank_score"), "candidate_id")
    x = candidates.join(matched, "context_id").withColumn("rank_score", F.round(score, 9)).withColumn("place", F.row_number().over(w))
    return x.select("context_id", "candidate_id", "rank_score", "place", F.when(F.col("place") > 1, "CANDIDATE").when(F.col("rank_score") >= least, "RANKED").otherwise("ABSTAIN").alias("status"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple, float] = {}
    for pair in zip(a, b):
        if pair not in memo:
            memo[pair] = difflib.SequenceMatcher(None, *pair).ratio()
    return pd.Series([memo[p] for p in zip(a, b)], dtype="float64")


def template_rank(queries: DataFrame, templates: DataFrame, n: int = 5, most: int = 2_000) -> DataFrame:
    """RK21, SO12, UD4: the best ``n`` templates of each query by likeness of row paths, company and table: (query_id, template_id, score, place).

    Queries: query_id, company, table_id, row_paths; templates: template_id and the same. A store of templates is small: more than ``most`` are refused, and
    they are broadcast to the queries. Null or blank company and table give no bonus.
    """
    t = templates.select("template_id", F.col("company").alias("__c"), F.col("table_id").alias("__t"), F.array_join(F.coalesce("row_paths", F.array().cast("array<string>")), "|").alias("__rows"))
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))
    x = queries.select("query_id", "company", "table_id", F.array_join(F.coalesce("row_paths", F.array().cast("array<string>")), "|").alias("rows")).join(small(t, most))
    score = _ratio("rows", "__rows") * TEMPLATE_ROWS + F.when(same("company", "__c"), TEMPLATE_COMPANY).otherwise(0.0) + F.when(same("table_id", "__t"), TEMPLATE_TABLE).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "template_id")
    return x.withColumn("score", F.round(F.least(F.lit(1.0), score), 4)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "template_id", "score", "place")


def template_stats(templates: DataFrame, key: Sequence[str]) -> DataFrame:
    """AG19: per key the accepted uses of active templates, all rejections and the number of templates. Templates: key, status, success_count, rejection_count."""
    accepted = F.coalesce(F.sum(F.when(F.col("status") == "ACTIVE", F.col("success_count")).otherwise(0)), F.lit(0))
    return templates.groupBy(*key).agg(accepted.alias("accepted"), F.sum("rejection_count").alias("rejected"), F.count("*").alias("templates"))


def tiered(candidates: DataFrame, key: Sequence[str], limits: Sequence[int] = (3, 8, 8)) -> DataFrame:
    """RK12: the best candidates of each tier of each key, the n-th tier limited by the n-th of ``limits``; a candidate that several tiers find stands in the first.

    Candidates: key, tier (1 ..), candidate_id, score. Ties go to the smaller id.
    """
    first = candidates.groupBy(*key, "candidate_id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("m")).select(*key, "candidate_id", F.col("m.tier").alias("tier"), (-F.col("m.s")).alias("score"))
    w = Window.partitionBy(*key, "tier").orderBy(F.desc("score"), "candidate_id")
    limit = F.element_at(F.array(*map(F.lit, limits)), F.col("tier"))
    return first.where(F.col("tier").between(1, len(limits))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
