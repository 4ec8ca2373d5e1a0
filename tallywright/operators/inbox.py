"""Review inbox, research batches and asset usage: multi-table control-plane queries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.text import as_bool, identity_text, string_similarity
from tallywright.session import small

SEVERITY = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def severity_rank(x: Column) -> Column:
    """SO9: 0 for the most severe; unknown words come last."""
    out = F.lit(len(SEVERITY))
    for k, name in reversed(list(enumerate(SEVERITY))):
        out = F.when(x == name, k).otherwise(out)
    return out


def inbox(reviews: DataFrame, assets: DataFrame, versions: DataFrame, captures: DataFrame, pdfs: DataFrame) -> DataFrame:
    """JO10, JO11, JO13, FI36: open reviews with asset, version, capture and pdf; capture and pdf may be missing."""
    a = reviews.join(assets, "logical_asset_id").join(versions.select("logical_asset_id", "capture_id", "capture_version", "is_current"), ["logical_asset_id", "capture_id"])
    return a.join(captures.select("capture_id", "pdf_id", "table_query"), "capture_id", "left").join(pdfs.select("pdf_id", "filename"), "pdf_id", "left")


def recent(rows: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """FI14, FN46: rows touched in the last days before ``now``."""
    return rows.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def inbox_order(parity: bool = False) -> list[Column]:
    """SO9, Q4: most severe first, then newest; ``parity`` reverses severity as the reference's default does."""
    rank = severity_rank(F.col("severity"))
    return [rank.desc() if parity else rank.asc(), F.col("updated_at").desc_nulls_last(), F.col("review_item_id")]


def json_key(payload: str, path: str, fallback: str) -> Column:
    """JO16, FN45: key of a row: its own field, else one inside its JSON payload; broken JSON gives null."""
    return F.coalesce(F.nullif(F.trim(fallback), F.lit("")), F.get_json_object(payload, path))


def batch_progress(jobs: DataFrame, members: DataFrame) -> DataFrame:
    """JO16, JO17, JO20, JO21, AG27, AG34, SE13: per batch the number of jobs, distinct assets and research batches, each combined before the join."""
    j = jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), F.countDistinct("capture_id").alias("assets"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    m = members.groupBy("batch_id").agg(F.countDistinct("research_batch_id").alias("research_batches"))
    return j.join(m, "batch_id", "left").withColumn("research_batches", F.coalesce("research_batches", F.lit(0)))


def rerun_candidates(plans: DataFrame, latest: DataFrame, key: Sequence[str]) -> DataFrame:
    """FI34, FI27, JO21: plan items of a note with a target whose latest attempt failed, needs review or is missing."""
    j = plans.where("role = 'NOTE_DETAIL' AND target IS NOT NULL").join(latest.select(*key, "status"), list(key), "left")
    return j.where("status IS NULL OR status IN ('FAILED', 'REVIEW_REQUIRED')").select(*key, F.coalesce("status", F.lit("NOT_RUN")).alias("status"))


def usage(capture: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """FI37, GV8: where captures are used: rows (capture_id, kind, n) over merges, bundles and flags."""
    out = None
    for kind, rows in kinds.items():
        one = rows.join(capture.select("capture_id").distinct(), "capture_id", "left_semi").groupBy("capture_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def schema_variant(targets: DataFrame, group: Sequence[str]) -> DataFrame:
    """AG26, AG27: variant of a table family from the roles that succeeded."""
    ok = F.when(F.col("status").isin("SUCCESS", "REVIEW_REQUIRED"), F.upper("role"))
    g = targets.groupBy(*group).agg(F.max((ok == "LEGACY_COMBINED").cast("int")).alias("old"), F.max((ok == "INVESTMENT_COMPONENT").cast("int")).alias("inv"), F.max((ok == "INTEREST_COMPONENT").cast("int")).alias("int"), F.max((ok != "LEGACY_COMBINED").cast("int")).alias("new"))
    c = lambda x: F.coalesce(x, F.lit(0)) == 1
    return g.select(
        *group,
        F.when(~c("old") & ~c("new"), "NO_MATCH").when(c("old") & ~c("new"), "LEGACY_COMBINED").when(c("old"), "MIXED_REVIEW_REQUIRED").when(c("inv") & c("int"), "SPLIT_COMPONENTS").otherwise("PARTIAL_COMPONENTS_REVIEW_REQUIRED").alias("variant"),
    )


def plans_from_links(links: DataFrame, key: Sequence[str], member: Sequence[str]) -> DataFrame:
    """AG30, AG38, PR30: certified links as one plan per key with its members in order; repeated members count once, so a plan is as long as its distinct members."""
    return links.select(*key, *member).distinct().groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*member))).alias("members"), F.count("*").alias("n_members"))


def provenance(rows: DataFrame, key: Sequence[str], seq: str, most: int = 50) -> DataFrame:
    """AG4: sources of each identity as JSON and as text, in order: one row per ``most`` sources, numbered by ``chunk`` from 0, so that no row
    grows with the data and all sources come out; ``n_sources`` counts all of the identity."""
    w = Window.partitionBy(*key).orderBy(seq)
    r = rows.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*key)))
    item = F.struct("__k", "capture_run_id", "source_pdf", "page", "raw_item")
    chunk = F.floor((F.col("__k") - 1) / most).cast("int").alias("chunk")
    g = r.groupBy(*key, chunk).agg(F.max("__n").alias("n_sources"), F.sort_array(F.collect_list(item)).alias("x"))
    text = F.array_join(F.transform("x", lambda v: F.concat_ws(":", v["capture_run_id"], F.concat(F.lit("p"), v["page"].cast("string")), v["raw_item"])), " | ")
    return g.select(*key, "chunk", "n_sources", text.alias("source_rows"), F.to_json(F.transform("x", lambda v: F.struct(v["capture_run_id"].alias("capture_run_id"), v["source_pdf"].alias("pdf"), v["page"].alias("page")))).alias("source_provenance"))


def keep_columns(columns: DataFrame, actions: DataFrame) -> DataFrame:
    """FI19: columns that a review keeps; columns without an action stay; dropping every column of a capture fails."""
    j = columns.join(actions, ["capture_id", "ordinal"], "left").withColumn("keep", F.coalesce(F.col("action") != "DROP", F.lit(True)))
    left = F.sum(F.col("keep").cast("int")).over(Window.partitionBy("capture_id"))
    checked = j.withColumn("keep", F.when(left == 0, F.raise_error(F.lit("all columns dropped")).cast("boolean")).otherwise(F.col("keep")))
    return checked.where("keep").drop("keep", "action")


def move_noise(official: DataFrame, excluded: DataFrame, noise: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """FI5, FI6: rows marked as noise leave the official rows and join the excluded ones with a reason.

    The key is joined as one struct, so a null key is named by a null key. Both sides are shuffled by it: the official rows may be a union whose parts are
    already partitioned by the key, and Spark 4.1 takes such a union as partitioned alike, yet runs it with the partitions of all parts, where a join fails."""
    named = noise.select(F.struct(*key).alias("__key")).distinct()
    rows = official.withColumn("__key", F.struct(*key))
    moved = rows.join(named, "__key", "left_semi").drop("__key").withColumn("reason", F.lit("HUMAN_LAYOUT_NOISE"))
    return rows.join(named, "__key", "left_anti").drop("__key"), excluded.unionByName(moved, allowMissingColumns=True)


def check_periods(rows: DataFrame) -> DataFrame:
    """PR10: the rows, once no relative period is left; otherwise the action fails and names the label."""
    from tallywright.functions.periods import relative_kind

    bad = relative_kind("data_year").isNotNull()
    return rows.withColumn("data_year", F.when(bad, F.raise_error(F.concat(F.lit("PERIOD_RESOLUTION_REQUIRED: "), F.col("data_year"))).cast("string")).otherwise(F.col("data_year")))


def with_family(rows: DataFrame, family: str, member: str, title: str = "", note: str = "") -> DataFrame:
    """PR16, PR8: family identity on every row; the path begins with the member."""
    path = F.coalesce("row_path", "normalized_item", F.lit(""))
    prefix = member + " / "
    return rows.withColumns({"table_family": F.lit(family), "member_table": F.lit(member), "source_table_title": F.lit(title or member), "note_reference": F.lit(note), "row_path": F.when(path.startswith(prefix), path).otherwise(F.concat(F.lit(prefix), path))})


def in_canonical_order(rows: DataFrame, order: DataFrame, key: str, then: Sequence[str]) -> DataFrame:
    """JO2, JO3, JO8, SO1, SO2, PR14: rows with the order of their key; unknown keys come last, ties by the given columns."""
    one = order.groupBy(key).agg(F.min("canonical_order").alias("canonical_order"))
    return rows.join(one, key, "left").orderBy(F.col("canonical_order").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in then))


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JO7: left join on dimensions where missing equals missing."""
    right = b.select(*(F.col(k).alias("__" + k) for k in keys), *(c for c in b.columns if c not in keys))
    on = None
    for k in keys:
        one = a[k].eqNullSafe(right["__" + k])
        on = one if on is None else on & one
    return a.join(right, on, "left").drop(*("__" + k for k in keys))


def batch_long(results: DataFrame) -> DataFrame:
    """PR21, PR25, PR26: machine results with their effective year: the value's own, else the document's, and which one it was."""
    own, doc = F.nullif(F.regexp_extract(identity_text("value_year"), r"(20\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract(identity_text("document_year"), r"(20\d{2})", 1), F.lit(""))
    return results.withColumn("effective_year", F.coalesce(own, doc)).withColumn("year_source", F.when(own.isNotNull(), "table_header").otherwise("document_fallback")).withColumn("company", F.coalesce(F.nullif(identity_text("company"), F.lit("")), F.lit("UNKNOWN")))


def metric_candidates(queries: DataFrame, terms: DataFrame, n: int = 8) -> DataFrame:
    """SO11: best metrics of each query by 0.8 x similarity of the closest name and 0.2 x keyword share: (query, metric_id, score, place).
    Queries are distinct texts; ``terms`` (metric_id, term, weight) is the fixed rulebook, whose size is checked before it is broadcast to them."""
    q = queries.select("query").where("query IS NOT NULL").distinct()
    pairs = q.join(small(terms))
    scored = pairs.withColumn("s", string_similarity("query", "term")).groupBy("query", "metric_id").agg(
        F.max("s").alias("sim"), (F.count_if(F.col("query").contains(F.col("term")) & (F.col("weight") <= 1)) / F.greatest(F.lit(1), F.count_if(F.col("weight") <= 1))).alias("kw")
    )
    w = Window.partitionBy("query").orderBy(F.desc("score"), "metric_id")
    return scored.withColumn("score", F.round(F.col("sim") * 0.8 + F.col("kw") * 0.2, 4)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query", "metric_id", "score", "place")


def candidate_order() -> list[Column]:
    """SO4: order of candidates: match class, evidence, arbitration, source quality, has values, score, number of values, then the earlier page."""
    return [*(F.col(c).desc() for c in ("match_class", "evidence_quality", "arbitration", "source_quality", "has_values", "score", "n_values")), F.col("page").asc()]


def recover_values(rows: DataFrame, part: Sequence[str] = ("page_id",)) -> DataFrame:
    """RK8: values for label rows without one: from the unlabelled numeric row at +1, -1, +2 or -2, else from the same label elsewhere in the same part (first row).
    Rows: the columns of ``part`` (a page, or a page and a column), row, label, value. Output adds value_source OWN, NEIGHBOUR, SAME_LABEL or NONE."""
    order = Window.partitionBy(*part).orderBy("row")
    free = lambda k: F.when((F.lead("label", k) if k > 0 else F.lag("label", -k)).over(order) == "", (F.lead("value", k) if k > 0 else F.lag("value", -k)).over(order))
    x = rows.withColumn("near", F.coalesce(free(1), free(-1), free(2), free(-2)))
    same = rows.where("label <> '' AND value IS NOT NULL").groupBy(*part, "label").agg(F.min(F.struct("row", "value")).alias("m")).select(*part, "label", F.col("m.value").alias("same"))
    j = x.where("label <> ''").join(same, [*part, "label"], "left")
    source = F.when(F.col("value").isNotNull(), "OWN").when(F.col("near").isNotNull(), "NEIGHBOUR").when(F.col("same").isNotNull(), "SAME_LABEL").otherwise("NONE")
    return j.select(*part, "row", "label", F.coalesce("value", "near", "same").alias("value"), source.alias("value_source"))


def nearest_section_parent(rows: DataFrame) -> DataFrame:
    """WI19: parent of a row is the nearest earlier row whose label is its section; rows: capture_id, row_order, label, parent_section.
    Each row meets only rows of that label, and the running maximum is taken in one window over both."""
    label = rows.select("capture_id", "row_order", F.col("label").alias("name"), F.lit(0).alias("asks"))
    ask = rows.where(identity_text("parent_section") != "").select("capture_id", "row_order", F.col("parent_section").alias("name"), F.lit(1).alias("asks"))
    w = Window.partitionBy("capture_id", "name").orderBy("row_order", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    seen = label.unionByName(ask).withColumn("parent", F.max(F.when(F.col("asks") == 0, F.col("row_order"))).over(w)).where("asks = 1").select("capture_id", "row_order", "parent")
    return rows.join(seen, ["capture_id", "row_order"], "left")


_PARENTS = T.StructType().add("capture_id", "string").add("row_order", "long").add("n_children", "long")


def numeric_parents(rows: DataFrame, least: float = 6.0, most: float = 72.0) -> DataFrame:
    """HI10, RE18: numeric top rows whose following indented rows add up to them: (capture_id, row_order, n_children).

    Rows: capture_id, row_order, indent (left edge), values (map of column ordinal to number, or one column value), and where known page, block_id, row_level,
    row_type, label, parent_section, excluded; a column that is missing bars nothing.
    A run of children ends at the first row that is excluded, has a parent section, lacks label, number or left edge, stands on another page or block, or is
    not indented by ``least`` to ``most`` points against the parent. Two children at least must fill every column of the parent and add up to it within
    max(2, number of children) in each. A child of an accepted parent is no parent itself. Runs have no length limit.

    Rows are numbered into stretches that no run can leave (one running window) and the stretches are walked in row order: the open parents of a row are
    at least ``least`` apart and within ``most``, so a row meets at most most / least of them; only their sums are kept.
    """
    have = set(rows.columns)
    given = lambda c, default: F.col(c) if c in have else default
    order = Window.partitionBy("capture_id").orderBy("row_order")
    numbers = F.map_filter(given("values", F.create_map(F.lit(1), F.col("value")) if "value" in have else None), lambda k, v: v.isNotNull() & ~F.isnan(v))
    x = rows.select(
        "capture_id", F.col("row_order").cast("long").alias("row_order"), F.col("indent").cast("double").alias("left"), numbers.alias("values"), given("page", F.lit(0)).alias("page"), given("block_id", F.lit("")).alias("block_id"),
        ((given("row_level", F.lit(0)).isNull() | (given("row_level", F.lit(0)) == 0)) & ~F.coalesce(F.upper(given("row_type", F.lit(""))).isin("TOTAL", "SUBTOTAL"), F.lit(False))).alias("may"),
        (F.coalesce(given("excluded", F.lit(False)), F.lit(False)) | (identity_text(given("parent_section", F.lit(""))) != "") | (F.trim(F.coalesce(given("label", F.lit("-")), F.lit(""))) == "")).alias("barred"),
    )
    x = x.withColumn("barred", F.col("barred") | F.col("left").isNull() | (F.coalesce(F.size("values"), F.lit(0)) < 1))
    moved = ~(F.col("page").eqNullSafe(F.lag("page").over(order)) & F.col("block_id").eqNullSafe(F.lag("block_id").over(order)))
    x = x.withColumn("cut", (F.col("barred") | moved | F.coalesce(F.lag("barred").over(order), F.lit(True))).cast("int"))
    x = x.withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("NOT barred")
    x = x.select("capture_id", "stretch", "row_order", "left", "may", F.map_keys("values").alias("ks"), F.map_values("values").alias("vs"))

    def walk(batches):
        at, runs, live = None, [], []  # a run: [row_order, left, numbers, n, sums, last child, whole]

        def close() -> list:
            out, until = [], None
            for r in runs:  # in row order; children of an accepted parent give none
                if (until is None or r[0] > until) and r[3] >= 2 and r[6] and all(abs(v - r[4][k]) <= max(2.0, float(r[3])) for k, v in r[2].items()):
                    out.append((at[0], r[0], r[3]))
                    until = r[5]
            return out

        for pdf in batches:
            found = []
            for capture, stretch, row, left, may, ks, vs in zip(*(pdf[c] for c in ("capture_id", "stretch", "row_order", "left", "may", "ks", "vs"))):
                live = [r for r in live if at == (capture, stretch) and least <= left - r[1] <= most]
                if not live:  # no run goes on: what was found is final
                    found += close()
                    at, runs = (capture, stretch), []
                numbers = dict(zip(ks, vs))
                for r in live:
                    r[3], r[5] = r[3] + 1, row
                    r[6] = r[6] and all(k in numbers for k in r[2])
                    if r[6]:
                        for k in r[2]:
                            r[4][k] += numbers[k]
                if may:
                    runs.append([row, left, numbers, 0, dict.fromkeys(numbers, 0.0), row, True])
                    live.append(runs[-1])
            if found:
                yield pd.DataFrame(found, columns=_PARENTS.names)
        last = close()
        if last:
            yield pd.DataFrame(last, columns=_PARENTS.names)

    return x.repartition("capture_id", "stretch").sortWithinPartitions("capture_id", "stretch", "row_order").mapInPandas(walk, _PARENTS)


def segment_class(segments: DataFrame) -> DataFrame:
    """HI13: class of each piece from its predecessor in the capture: PRIMARY first, CONTINUATION with the same header and the next page, PEER with the same
    header elsewhere, SUPPLEMENTARY with another header, UNRESOLVED where a header is unknown. Segments: capture_id, segment_id, page, header."""
    w = Window.partitionBy("capture_id").orderBy("page", "segment_id")
    x = segments.withColumn("before", F.lag("header").over(w)).withColumn("page_before", F.lag("page").over(w)).withColumn("place", F.row_number().over(w))
    same = F.col("header") == F.col("before")
    kind = F.when(F.col("place") == 1, "PRIMARY").when(same.isNull(), "UNRESOLVED").when(same & (F.col("page") == F.col("page_before") + 1), "CONTINUATION").when(same, "PEER").otherwise("SUPPLEMENTARY")
    return x.select("capture_id", "segment_id", kind.alias("segment_class"))


def topology(rows: DataFrame) -> DataFrame:
    """AG40: per block the numbers of parsed cells of its rows and whether they agree; rows: capture_id, block_order, n_cells."""
    g = rows.groupBy("capture_id", "block_order").agg(F.min("n_cells").alias("least"), F.max("n_cells").alias("most"), F.count("*").alias("n_rows"))
    return g.withColumn("consistent", F.col("least") == F.col("most"))


def header_fingerprint(headers: Column) -> Column:
    """FN43: 16 digits of the hash of the normalized headers in order."""
    from tallywright.functions.text import normalize_text

    return F.substring(F.sha2(F.array_join(F.transform(headers, normalize_text), "\u001f"), 256), 1, 16)


def company_key(x: Column | str) -> Column:
    """FN50: company text without blanks and brackets' contents, lower case."""
    s = F.col(x) if isinstance(x, str) else x
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"[（(].*?[)）]", ""), r"\s+", ""))


def selection_summary(rows: DataFrame) -> DataFrame:
    """AG36, FI25: selected captures in one row: number, companies, years, incomplete identities and restated ones."""
    blank = (identity_text("company") == "") | (identity_text("table_family_id") == "")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("company").alias("companies"), F.countDistinct("document_year").alias("years"), F.count_if(blank).alias("incomplete"), F.count_if(as_bool("merge_ready")).alias("ready"))


def repaired_periods(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """PR11: stored rows with the document year of their source as text and relative periods resolved against it; rows of no source keep theirs.
    Sources: capture_run_id, document_year (the smallest absolute year counts where one is listed twice)."""
    from tallywright.functions.periods import absolute_year, resolve_year

    one = sources.groupBy("capture_run_id").agg(F.min(absolute_year("document_year")).alias("__year"))
    j = rows.join(one, "capture_run_id", "left").withColumn("document_year", F.coalesce("__year", F.col("document_year").cast("string")))
    return j.withColumn("data_year", resolve_year(F.col("data_year").cast("string"), F.col("document_year"))).select(*rows.columns)


def capture_metadata(captures: DataFrame, columns: DataFrame) -> DataFrame:
    """PR24: company and document year of each capture: the greatest absolute year of its file name and its column headers; '' without one.
    Captures: capture_id, pdf_name; columns: capture_id, data_year, period_label, header_raw."""
    from tallywright.functions.periods import latest_year
    from tallywright.functions.text import file_company, file_year

    top = columns.groupBy("capture_id").agg(F.max(F.greatest(*(latest_year(c) for c in ("data_year", "period_label", "header_raw")))).alias("y"))
    year = F.greatest(F.col("y"), file_year("pdf_name").cast("int"))
    return captures.join(top, "capture_id", "left").select("capture_id", "pdf_name", file_company("pdf_name").alias("company"), F.coalesce(year.cast("string"), F.lit("")).alias("document_year"))


def ordered_sources(sources: DataFrame) -> DataFrame:
    """FI32: (merge_id, place, capture_id) in stored order; places are dense from 1, ties by capture."""
    w = Window.partitionBy("merge_id").orderBy("source_order", "capture_id")
    return sources.select("merge_id", F.row_number().over(w).alias("place"), "capture_id")


def active_members(members: DataFrame) -> DataFrame:
    """FI38: active members of each family in canonical order: (family_id, place, member_id)."""
    w = Window.partitionBy("family_id").orderBy(F.col("canonical_order").asc_nulls_last(), "member_id")
    return members.where("status = 'ACTIVE'").select("family_id", F.row_number().over(w).alias("place"), "member_id")


def latest_attempts(jobs: DataFrame, key: Sequence[str]) -> DataFrame:
    """WI3: per key the attempt that counts and all attempts in order: a rerun takes the place of the job it reruns only if it succeeded and is ready to merge;
    of the rest the newest counts. Jobs: key, job_id, rerun_of (or null), status, merge_ready, at."""
    good = jobs.where("rerun_of IS NOT NULL AND status = 'SUCCESS' AND merge_ready = 1").select(*key, F.col("rerun_of").alias("job_id")).distinct()
    failed_rerun = (F.col("rerun_of").isNotNull()) & ~F.coalesce((F.col("status") == "SUCCESS") & (F.col("merge_ready") == 1), F.lit(False))
    w = Window.partitionBy(*key).orderBy(F.col("failed_rerun"), F.col("at").desc_nulls_last(), F.desc("job_id"))
    live = jobs.join(good, [*key, "job_id"], "left_anti").withColumn("failed_rerun", failed_rerun)
    chosen = live.withColumn("__place", F.row_number().over(w)).where("__place = 1").select(*key, "job_id", "status")
    history = jobs.groupBy(*key).agg(F.count("*").alias("attempts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "job_id", "status"))), lambda x: x["status"]), ">").alias("history"))
    return chosen.join(history, list(key))


def semantic_rows(rows: DataFrame) -> DataFrame:
    """HI3: stable row id, role, parent row and path by levels: sections and details may be parents, totals and notes are not.
    Rows: capture_id, row_order, row_level, raw_item, row_type, has_value. Output adds row_id, row_role, parent_row_order."""
    from tallywright.functions.text import infer_row_role
    from tallywright.operators.structure import parents_by_level

    role = infer_row_role("raw_item", F.col("row_type"), F.col("has_value"))
    x = rows.withColumn("row_role", role).withColumn("level", F.coalesce("row_level", F.lit(0)))
    closed = ~(F.col("row_role").isin("SECTION", "DETAIL", "BREAKDOWN_DETAIL") & (F.coalesce("raw_item", F.lit("")) != ""))
    tree = parents_by_level(x.select("capture_id", "row_order", "level", closed.alias("is_total"))).select("capture_id", "row_order", "parent_row_order")
    row_id = F.concat(F.lit("ROW_"), F.substring(F.sha2(F.concat_ws("\u001f", "capture_id", F.col("row_order").cast("string")), 256), 1, 20))
    return x.drop("level").join(tree, ["capture_id", "row_order"]).withColumn("row_id", row_id)


def sum_relations(rows: DataFrame) -> DataFrame:
    """RE5: arithmetic relations that the tree suggests, as candidates only: (capture_id, row_order, relationship, n_children, children).
    Totals and net values with children that hold a value; rows: capture_id, row_order, row_role, parent_row_order, has_value."""
    kids = rows.where("has_value AND parent_row_order IS NOT NULL").groupBy("capture_id", F.col("parent_row_order").alias("row_order")).agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("row_order")).cast("array<string>"), ",").alias("children"))
    kind = F.when(F.col("row_role") == "NET_VALUE", "GROSS_MINUS_ADJUSTMENT").otherwise("SUM_CHILDREN")
    return rows.where(F.col("row_role").isin("TOTAL", "IMPLICIT_TOTAL", "NET_VALUE")).join(kids, ["capture_id", "row_order"]).select("capture_id", "row_order", kind.alias("relationship"), "n_children", "children")
