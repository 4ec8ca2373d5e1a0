"""Retrieval and ranking: pages, labels, anchors, evidence clusters and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.numbers import value_type_adjustment
from tallywright.functions.text import best_similarity, normalize_text, position_bonus, qualified_variant_penalty, string_similarity

EXACT, ALIAS, KEYWORD = 8.0, 5.0, 1.0


def search_terms(metrics: DataFrame) -> DataFrame:
    """SC7, UD6: (metric_id, term, weight) of a rulebook, normalized: names 8, aliases 5, keywords 1. One row per listing: a term of two lists counts in both.
    Keywords are the rulebook's ``keywords``, or its soft aliases where it has no such column."""
    keywords = "keywords" if "keywords" in metrics.columns else "soft_aliases"
    lists = F.concat(
        F.array(F.struct(F.col("canonical_name").alias("t"), F.lit(EXACT).alias("w"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(x.alias("t"), F.lit(ALIAS).alias("w"))),
        F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda x: F.struct(x.alias("t"), F.lit(KEYWORD).alias("w"))),
    )
    rows = metrics.select("metric_id", F.explode(lists).alias("x")).select("metric_id", normalize_text("x.t").alias("term"), F.col("x.w").alias("weight"))
    return rows.where("term <> ''")


def _term_finder(terms: list[str]):
    """Arrow function: numbers of the terms that a text contains, by one automaton for all terms, built once per task."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, w in enumerate(terms):
            automaton.add_word(w, k)
        automaton.make_automaton()
        for text in batches:
            yield text.map(lambda t: sorted({k for _, k in automaton.iter(t)}))

    return find


def score_pages(pages: DataFrame, terms: DataFrame, most: int = 20_000) -> DataFrame:
    """RK1: (page_id, metric_id, score) of every page that holds a term: sum of the weights of the terms it contains.

    A rulebook is short and fixed: its distinct terms are read by the driver and travel with the function; more than ``most`` of them are refused, for they would not
    be a rulebook. Every page is searched for all terms in one pass over its normalized text; only hits are exploded, meet their listings by an
    equi-join and are summed per page before anything else is shuffled.
    """
    words = [r.term for r in terms.select("term").distinct().orderBy("term").limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} distinct terms")
    if not words:
        return pages.sparkSession.createDataFrame([], "page_id long, metric_id string, score double")
    listed = terms.groupBy("term", "metric_id").agg(F.sum("weight").alias("weight"))
    numbered = pages.sparkSession.createDataFrame(list(enumerate(words)), "k int, term string").join(listed, "term").select("k", "metric_id", "weight")
    found = pages.select("page_id", _term_finder(words).asNondeterministic()(normalize_text("text")).alias("ks")).where(F.size("ks") > 0)
    hits = found.select("page_id", F.explode("ks").alias("k")).join(F.broadcast(numbered), "k")  # listings of at most ``most`` terms
    return hits.groupBy("page_id", "metric_id").agg(F.sum("weight").alias("score"))


def top_pages(scores: DataFrame, n: int = 8, least: float = 0.5) -> DataFrame:
    """SO6: best pages of each metric by score, then page."""
    w = Window.partitionBy("metric_id").orderBy(F.desc("score"), "page_id")
    return scores.where(F.col("score") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def with_neighbours(pages: DataFrame, last: Column, radius: int = 1) -> DataFrame:
    """JO30: chosen pages and their neighbours inside the document, distinct."""
    around = F.sequence(F.greatest(F.lit(1), F.col("page_id") - radius), F.least(last, F.col("page_id") + radius))
    return pages.select(F.explode(around).alias("page_id")).distinct()


#: Columns that score_labels takes where a caller has them, with what stands for them otherwise.
OPTIONAL = {"user_aliases": "array<string>", "keywords": "array<string>", "table_hint": "array<string>", "table_type": "string", "value_type": "string", "units": "array<string>"}
# Lexical scores of exact matches by match class, of a contained name, and the shares of similarity and keywords.
EXACT_SCORES = {50: 0.985, 45: 0.955, 42: 0.925, 38: 0.855}
CONTAINS = {"name": 0.74, "alias": 0.70, "user_alias": 0.67}
SIMILARITY_SHARE, KEYWORD_SHARE = 0.63, 0.50
TABLE_FITS, TABLE_DIFFERS, UNKNOWN_TABLE = 0.045, -0.04, "未知表"


def score_labels(pairs: DataFrame) -> DataFrame:
    """RK2, FN14-FN16, FN53: score and match class of a label for a metric, with ``qualified`` where a qualifier was penalized.

    Pairs: label, canonical_name, aliases, soft_aliases, exclude, position_hint, row, rows, n_values, and the OPTIONAL columns where known.
    An exact name, alias, user alias or soft alias has the score of its class (EXACT_SCORES); otherwise the greatest of similarity to any of these names,
    a contained name (CONTAINS) and the share of keywords contained, less the qualifier penalty. Table kind, position, number of values and value type add their
    bonuses, an excluded word takes 0.90 off; the result lies in 0..1, an exact name is never below its score and an exact alias never above 0.975.
    """
    x = pairs
    for c, kind in OPTIONAL.items():
        if c not in x.columns:
            x = x.withColumn(c, F.lit(None).cast(kind))
    norm_list = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalize_text), lambda t: t != "")
    lists = {"na": "aliases", "nu": "user_aliases", "nf": "soft_aliases", "nx": "exclude", "nk": "keywords"}
    x = x.withColumns({"nl": normalize_text("label"), "ns": normalize_text("canonical_name"), **{k: norm_list(v) for k, v in lists.items()}})
    within = lambda names: F.exists(names, lambda t: F.col("nl").contains(t))
    kind = F.when(F.col("nl") == F.col("ns"), 50).when(F.array_contains("na", F.col("nl")), 45).when(F.array_contains("nu", F.col("nl")), 42).when(F.array_contains("nf", F.col("nl")), 38)
    holds = F.when((F.col("ns") != "") & F.col("nl").contains(F.col("ns")), CONTAINS["name"]).when(within("na"), CONTAINS["alias"]).when(within("nu"), CONTAINS["user_alias"]).otherwise(0.0)
    words = F.when(F.size("nk") > 0, F.size(F.filter("nk", lambda k: F.col("nl").contains(k))) / F.size("nk") * KEYWORD_SHARE).otherwise(0.0)
    x = x.withColumn("exact", kind).withColumn("contains", holds).withColumn("similar", best_similarity(F.col("nl"), F.concat(F.array("ns"), "na", "nu", "nf")) * SIMILARITY_SHARE)
    lexical = F.greatest("similar", "contains", words)
    for cls, score in EXACT_SCORES.items():
        lexical = F.when(F.col("exact") == cls, score).otherwise(lexical)
    penalty = F.when(F.col("exact").isNull(), qualified_variant_penalty(F.col("nl"), F.col("ns"))).otherwise(0.0)
    numeric = F.when(F.col("n_values") > 0, F.least(F.lit(0.025), 0.008 + F.col("n_values") * 0.006)).otherwise(-0.12)
    hinted = F.coalesce(F.size("table_hint"), F.lit(0)) > 0
    in_table = F.when(hinted & F.array_contains("table_hint", F.col("table_type")), TABLE_FITS).when(hinted & (F.coalesce("table_type", F.lit(UNKNOWN_TABLE)) != UNKNOWN_TABLE), TABLE_DIFFERS).otherwise(0.0)
    typed = F.when((F.col("n_values") > 0) & F.col("units").isNotNull(), value_type_adjustment(F.lower("value_type"), F.col("units"))).otherwise(0.0)
    raw = lexical + position_bonus(F.col("position_hint"), F.col("row"), F.col("rows")) + numeric + penalty + F.coalesce(in_table, F.lit(0.0)) + F.coalesce(typed, F.lit(0.0)) + F.when(within("nx"), -0.90).otherwise(0.0)
    capped = F.when(F.col("exact") == 50, F.least(F.lit(1.0), F.greatest(raw, F.lit(EXACT_SCORES[50])))).when(F.col("exact") == 45, F.least(F.lit(0.975), raw)).otherwise(raw)
    match_class = F.coalesce("exact", F.when(F.col("contains") > 0, 25).otherwise(15))
    return x.select(*pairs.columns, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 6).alias("score"), match_class.alias("match_class"), (penalty < 0).alias("qualified"))


def rank_with_margin(rows: DataFrame, key: Sequence[str], score: str, tie: str, least: float = 0.85, margin: float = 0.10) -> DataFrame:
    """WI9, WI10, RK10: place and margin to the second of each key; PRESELECTED with a score of ``least`` and that margin (or alone), MULTIPLE_VALID within 0.03
    of the second, else REVIEW."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    x = rows.withColumn("place", F.row_number().over(w)).withColumn("next_score", F.lead(score).over(w))
    gap = F.round(F.col(score) - F.col("next_score"), 9)
    status = F.when(F.col("place") > 1, "CANDIDATE").when((F.col(score) >= least) & (gap.isNull() | (gap >= margin)), "PRESELECTED").when(gap <= 0.03, "MULTIPLE_VALID").otherwise("REVIEW")
    return x.withColumn("margin", gap).withColumn("selection", status).drop("next_score")


def weighted_score(components: dict[str, Column], gates: dict[str, Column]) -> Column:
    """Struct(score, passed, failed): components summed into 0..1 with four decimals, gates all true, names of failed gates."""
    total = sum(components.values(), F.lit(0.0))
    failed = F.filter(F.array(*(F.when(~F.coalesce(g, F.lit(False)), n) for n, g in gates.items())), lambda n: n.isNotNull())
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4))).alias("score"), (F.size(failed) == 0).alias("passed"), F.array_join(failed, "|").alias("failed"))


# Titles of formal statements and of pages that only summarize them, and the form of a full note reference.
FORMAL_TITLES = ("资产负债表", "利润表", "现金流量表", "所有者权益变动表")
SUMMARY_TITLES = ("目录", "摘要", "主要会计数据", "财务指标")
NOTE_FORM = r"^附注(?:[一二三四五六七八九十百\d]+-)?[一二三四五六七八九十百\d]+$"
# Weights of the anchor score, and the score that qualifies.
ANCHOR_WEIGHTS = {
    "exact_parent": 0.14, "contained_parent": 0.08, "formal_region": 0.13, "statement_type": 0.06, "scope_wanted": 0.05, "scope_known_only": 0.03, "children": 0.10, "note_rows": 0.12, "valid_notes": 0.05,
    "amounts": 0.09, "periods": 0.07, "unit": 0.04, "scope_known": 0.03, "alignment": 0.04, "history": 0.03, "definition": 0.02, "summary": -0.28, "note_section": -0.22, "no_children": -0.18,
    "scope_conflict": -0.18, "ocr_only": -0.12,
}
QUALIFIED_SCORE = 0.70


def anchor_score() -> Column:
    """RK9: struct(score, passed, failed, tier) of an anchor candidate from 20 weighted components and 9 gates.

    Columns: pdf_id, scope, wanted_scope, statement_type, title, parent_text, display_name, n_children, note_rows, valid_notes, value_rows, n_periods, unit, formal_region, summary_page,
    period_header, columns_aligned, history, definition, ocr_only, bbox_verified (null counts as verified). Null numbers and flags count as 0 and false.
    """
    w = ANCHOR_WEIGHTS
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    gain = lambda test, name: F.when(test, w[name]).otherwise(0.0)
    parent, target = normalize_text("parent_text"), normalize_text("display_name")
    scope, kind, wanted = F.when(text("scope") == "", "UNKNOWN").otherwise(text("scope")), F.upper(text("statement_type")), text("wanted_scope")
    per_child = lambda c: F.when(number("n_children") > 0, number(c) / number("n_children")).otherwise(0.0)
    formal = text("title").rlike("|".join(FORMAL_TITLES)) | flag("formal_region")
    summary = text("title").rlike("|".join(SUMMARY_TITLES)) | flag("summary_page")
    periods = (number("n_periods") >= 2) | flag("period_header")
    verified = F.coalesce("bbox_verified", F.lit(True))
    conflict = (wanted != "") & ~scope.isin("UNKNOWN") & (scope != wanted)
    components = {
        "exact_parent": gain((parent != "") & (parent == target), "exact_parent"), "contained_parent": gain((parent != "") & (target != "") & (parent.contains(target) | target.contains(parent)), "contained_parent"),
        "formal_region": gain(formal, "formal_region"), "statement_type": gain(~kind.isin("", "UNKNOWN", "NOTE_SECTION"), "statement_type"),
        "scope_match": F.when((wanted != "") & (scope == wanted), w["scope_wanted"]).when(scope != "UNKNOWN", w["scope_known_only"]).otherwise(0.0),
        "children": F.least(number("n_children") / 4, F.lit(1.0)) * w["children"], "note_rows": per_child("note_rows") * w["note_rows"], "valid_notes": per_child("valid_notes") * w["valid_notes"],
        "amounts": per_child("value_rows") * w["amounts"], "periods": gain(periods, "periods"), "unit": gain(text("unit") != "", "unit"), "scope_known": gain(scope != "UNKNOWN", "scope_known"),
        "alignment": gain(flag("columns_aligned"), "alignment"), "history": gain(flag("history"), "history"), "definition": gain(flag("definition"), "definition"), "summary": gain(summary, "summary"),
        "note_section": gain(kind == "NOTE_SECTION", "note_section"), "no_children": gain(number("n_children") == 0, "no_children"), "scope_conflict": gain(conflict, "scope_conflict"),
        "ocr_only": gain(flag("ocr_only") & ~F.coalesce("bbox_verified", F.lit(False)), "ocr_only"),
    }
    gates = {
        "source_pdf_identity": text("pdf_id") != "", "scope_compatible": ~conflict, "target_parent_exists": parent != "", "amount_columns_present": number("value_rows") > 0, "period_recognized": (number("n_periods") > 0) | flag("period_header"),
        "formal_statement_not_note": (kind != "NOTE_SECTION") & ~summary, "bbox_intersects_statement": verified, "not_toc_or_summary": ~summary, "ocr_evidence_sufficient": ~flag("ocr_only") | F.coalesce("bbox_verified", F.lit(False)),
    }
    s = weighted_score(components, gates)
    return F.struct(s["score"].alias("score"), s["passed"].alias("passed"), s["failed"].alias("failed"), F.when(s["passed"] & (s["score"] >= QUALIFIED_SCORE), "QUALIFIED").otherwise("LOW_CONFIDENCE").alias("tier"))


def evidence_clusters(rows: DataFrame, key: Sequence[str], confidence: str, member: str, keep: Sequence[str]) -> DataFrame:
    """AG28, AG29, SE5, SE6, Q12: one row per key with the most confident member, number of members and a stable cluster id."""
    best = F.max_by(F.struct(*keep), F.struct(F.coalesce(confidence, F.lit(0.0)), member)).alias("b")
    g = rows.groupBy(*key).agg(best, F.max(confidence).alias("confidence"), F.count("*").alias("evidence_count"), F.min(member).alias("first_member"))
    return g.select(*key, *(F.col("b." + k).alias(k) for k in keep), "confidence", "evidence_count", F.concat(F.lit("CLUSTER_"), F.substring(F.sha2(F.concat_ws("\u001f", *key), 256), 1, 20)).alias("cluster_id"))


def choose_primary(values: Column, target_year: Column) -> Column:
    """RK6: the value of the target year if it is the only one, else the best period score, else the leftmost. ``values``: array of
    struct(year, period_score, column_index, value)."""
    match = F.filter(values, lambda v: v["year"] == target_year)
    by_score = F.array_sort(values, lambda a, b: F.when(a["period_score"] > b["period_score"], -1).when(a["period_score"] < b["period_score"], 1).otherwise(a["column_index"] - b["column_index"]))
    left = F.array_sort(values, lambda a, b: a["column_index"] - b["column_index"])
    clear = (F.size(values) == 1) | (F.try_element_at(by_score, F.lit(1))["period_score"] > F.try_element_at(by_score, F.lit(2))["period_score"] + 0.10)
    return F.when(F.size(match) == 1, match[0]).when(clear, F.try_element_at(by_score, F.lit(1))).otherwise(F.try_element_at(left, F.lit(1)))


def backoff_share(a: DataFrame, b: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """RK19: share of equal levels between each row of ``a`` and the rows of ``b`` with its key, best first: (id_a, id_b, share)."""
    left = a.select(key, F.col("id").alias("id_a"), *(F.col(c).alias("a_" + c) for c in levels))
    right = b.select(key, F.col("id").alias("id_b"), *(F.col(c).alias("b_" + c) for c in levels))
    equal = sum((F.coalesce(F.col("a_" + c) == F.col("b_" + c), F.lit(False)).cast("int") for c in levels), F.lit(0))
    return left.join(right, key).where("id_a <> id_b").select("id_a", "id_b", F.round(equal / F.lit(float(len(levels))), 3).alias("share"))


def note_lines(pages: DataFrame) -> DataFrame:
    """RK13, RK27, RK28, FI23: numbered heading lines of every page: (page_id, line, ordinal, title)."""
    from tallywright.functions.notes import peer_heading

    lines = pages.select("page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content"))
    return lines.withColumn("h", peer_heading("content")).where("h IS NOT NULL").select("page_id", "line", F.col("h.ordinal").alias("ordinal"), F.col("h.title").alias("title"))


_ASSIGNED = T.StructType().add("anchor", "string").add("child", "string").add("candidate", "string").add("score", "double").add("status", "string")


def assign_greedily(links: DataFrame) -> DataFrame:
    """RK11: inside each anchor every child in turn takes its best free candidate: (anchor, child, candidate, score, status).

    Links: anchor, child_order, child, candidate, score. The order of children matters, so the walk is sequential; it runs per anchor
    (one statement line with its notes). An anchor's links are cut to each child's best candidates, as many as the anchor has children: by
    pigeonhole a child never needs more, so the group that one task holds is at most the square of the children of one statement.
    """
    sizes = links.groupBy("anchor").agg(F.countDistinct("child").alias("children"))
    w = Window.partitionBy("anchor", "child").orderBy(F.desc("score"), "candidate")
    kept = links.join(sizes, "anchor").withColumn("place", F.row_number().over(w)).where("place <= children")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        links_ = sorted(zip(pdf["child_order"].tolist(), pdf["child"].tolist(), (-pdf["score"]).tolist(), pdf["candidate"].tolist()))
        anchor, used, rows = pdf["anchor"].iloc[0], set(), []
        for order, child in dict.fromkeys((o, c) for o, c, _, _ in links_):
            rows.append([order, child, None, None, "CONFLICT"])
        place = {(r[0], r[1]): r for r in rows}
        for order, child, score, candidate in links_:  # children in order, each child's links best first
            row = place[order, child]
            if row[2] is None and candidate not in used:
                used.add(candidate)
                row[2:] = [candidate, -score, "ASSIGNED"]
        return pd.DataFrame([(anchor, *r[1:]) for r in rows], columns=["anchor", "child", "candidate", "score", "status"])

    return kept.select("anchor", "child_order", "child", "candidate", "score").groupBy("anchor").applyInPandas(walk, _ASSIGNED)


def suggest_labels(open_labels: DataFrame, known: DataFrame, least: float = 0.72) -> DataFrame:
    """JO26, D9: best known label for each open one by Ratcliff-Obershelp ratio of at least ``least``; ties go to the smaller name.

    Both sides are distinct labels. A ratio of r needs r / 2 of both lengths in shared characters (repeats counted), so at least r / (2 - r) of
    each label: labels meet by their rarest characters, as many as leave fewer than that, and pairs that share too few drop out; no other
    pair can reach the ratio.
    """
    a = open_labels.select("label", normalize_text("label").alias("na")).where("na <> ''").distinct()
    b = known.select(F.col("label").alias("known"), normalize_text("label").alias("nb")).where("nb <> ''").distinct()

    def numbered(c: str) -> Column:  # characters with the number of their occurrence
        chars = F.filter(F.split(c, ""), lambda x: x != "")
        return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))

    frequency = b.select(F.explode(numbered("nb")).alias("ch")).groupBy("ch").agg(F.count("*").alias("times"))

    def rare(x: DataFrame, name: str, norm: str, chars: str) -> DataFrame:
        e = x.select(name, norm, F.explode(numbered(norm)).alias("ch")).join(frequency, "ch", "left")
        g = e.groupBy(name, norm).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "ch"))).alias("s")).withColumn(chars, F.transform("s", lambda v: v["ch"]))
        needed = F.ceil(F.size("s") * (least / (2 - least)) - 1e-9).cast("int")
        return g.select(name, norm, chars, F.explode(F.slice(F.col(chars), F.lit(1), F.size("s") - needed + 1)).alias("ch"))

    met = rare(a, "label", "na", "ca").join(rare(b, "known", "nb", "cb"), "ch").drop("ch")
    shared = met.where(F.size(F.array_intersect("ca", "cb")) >= (F.size("ca") + F.size("cb")) * (least / 2) - 1e-9).select("label", "na", "known", "nb").distinct()
    near = shared.where(F.col("label") != F.col("known"))
    scored = near.withColumn("score", string_similarity("na", "nb")).where(F.col("score") >= least)
    return scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("known"))).alias("m")).select("label", F.col("m.known").alias("suggested"), F.round(-F.col("m.s"), 4).alias("score"))
