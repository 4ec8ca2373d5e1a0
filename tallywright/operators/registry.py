"""Control-plane relations: search, latest-per-key, versions, summaries, dependency state and table updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.text import identity_text

# --- filters and pages -------------------------------------------------------


def filter_captures(
    captures: DataFrame,
    *,
    lifecycle: str | None = None,
    query_contains: str | None = None,
    company_contains: str | None = None,
    equals: dict[str, object] | None = None,
    include_trash: bool = False,
    only_trash: bool = False,
    in_batches: DataFrame | None = None,
) -> DataFrame:
    """FI9-FI11, FI29, JO20, JO22: the one filter builder behind list, count and id queries. ``in_batches`` (batch_id) is a semi join."""
    out = captures
    if only_trash:
        out = out.where("is_trashed = 1 OR lifecycle_status = 'TRASHED'")
    elif not include_trash:
        out = out.where("is_trashed = 0 AND lifecycle_status <> 'TRASHED'")
    if lifecycle:
        out = out.where(F.col("lifecycle_status") == lifecycle)
    if query_contains:
        out = out.where(F.lower(F.coalesce("table_query", F.lit(""))).contains(query_contains.lower()))
    if company_contains:
        out = out.where(F.lower(F.coalesce("company", F.lit(""))).contains(company_contains.lower()))
    for column, value in (equals or {}).items():
        out = out.where(F.col(column) == value)
    if in_batches is not None:
        out = out.join(in_batches.select("batch_id").distinct(), "batch_id", "left_semi")
    return out


def page(rows: DataFrame, order: Sequence[Column], size: int = 500, number: int = 1) -> DataFrame:
    """SO8, SO10, SO13: one page of an ordered list; size is kept in 1..2000. The order needs a unique last key."""
    size = max(1, min(size, 2000))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def in_given_order(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """FI12: rows of a list of ids (id, pos), in list order; unknown ids give no row, repeated ids repeat."""
    return ids.join(rows, ids["id"] == rows[key]).drop("id").orderBy("pos", key)


def search(rows: DataFrame, equals: dict[str, object], contains_any: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """FI13, FI17, FI18, FI33, FI35: equality facets and one case-insensitive text over several columns."""
    for column, value in equals.items():
        rows = rows.where(F.col(column).isin(*value) if isinstance(value, list | tuple | set) else F.col(column) == value)
    if contains_any and contains_any[0].strip():
        hit = F.lit(False)
        for column in contains_any[1]:
            hit = hit | F.coalesce(F.col(column).ilike("%" + contains_any[0].strip() + "%"), F.lit(False))
        rows = rows.where(hit)
    return rows


def top_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """WI1, WI2, WI4, WI20, SO5-SO7: first ``n`` rows of each key; the order needs a unique last column. Catalyst turns the rank filter into
    a per-task limit before the shuffle, so a hot key sends ``n`` rows per task."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__place") <= n).drop("__place")


def with_latest(rows: DataFrame, decisions: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """JO14, JO15: every row with its latest decision; rows without one stay (the decision is chosen before the join)."""
    return rows.join(top_per_key(decisions, [key], order), key, "left")


# --- assets and versions -----------------------------------------------------

IDENTITY = ("pdf_id", "document_year", "table_family_id", "table_query")


def logical_id(fields: Sequence[str] = IDENTITY) -> Column:
    """PR18, GV11: identity of the asset that a capture is a version of."""
    return F.sha2(F.concat_ws("\u001f", *(identity_text(f) for f in fields)), 256)


def versions(captures: DataFrame, fields: Sequence[str] = IDENTITY) -> DataFrame:
    """GV6, GV20, AG24: versions of every asset in order of creation; the newest is current, neighbours supersede each other."""
    rows = captures.withColumn("logical_asset_id", logical_id(fields))
    w = Window.partitionBy("logical_asset_id").orderBy("created_at", "capture_id")
    return rows.select(
        "logical_asset_id", "capture_id", F.row_number().over(w).alias("capture_version"), F.lead("capture_id").over(w).isNull().alias("is_current"),
        F.lag("capture_id").over(w).alias("supersedes"), F.lead("capture_id").over(w).alias("superseded_by"),
    )


def merge_ready(captures: DataFrame, versions_: DataFrame) -> DataFrame:
    """FI15, FI26, Q9: current, ready, active captures with family and known company; filtered before any page limit."""
    current = versions_.where("is_current").select("capture_id")
    good = (F.col("merge_ready") == 1) & (F.col("is_trashed") == 0) & (F.col("lifecycle_status") == "ACTIVE") & (identity_text("table_family_id") != "") & (identity_text("company") != "")
    return captures.where(good).join(current, "capture_id", "left_semi")


def not_in(ids: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """FI16, JO23: ids that ``allowed`` lacks (null ids count as lacking)."""
    return ids.join(allowed.select(key).distinct(), key, "left_anti")


# --- summaries ---------------------------------------------------------------


def joined_set(column: str) -> Column:
    """D6: sorted distinct non-null values of a group in one text; meant for columns of few values."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def batch_summary(captures: DataFrame) -> DataFrame:
    """AG15: counts, first and last time, producer versions and status of each batch."""
    g = captures.where(identity_text("batch_id") != "").groupBy("batch_id").agg(
        F.count("*").alias("capture_count"),
        F.count_if((F.col("lifecycle_status") == "ACTIVE") & (F.col("is_trashed") == 0)).alias("active_count"),
        F.count_if((F.col("lifecycle_status") == "INVALIDATED") & (F.col("is_trashed") == 0)).alias("invalidated_count"),
        F.count_if((F.col("is_trashed") == 1) | (F.col("lifecycle_status") == "TRASHED")).alias("trashed_count"),
        F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"), joined_set("producer_version").alias("producer_versions"),
    )
    live = F.col("active_count") + F.col("invalidated_count")
    base = (
        F.when((live == 0) & (F.col("trashed_count") > 0), "TRASHED")
        .when((F.col("active_count") > 0) & (F.col("invalidated_count") > 0), "PARTIALLY_INVALIDATED")
        .when((F.col("active_count") == 0) & (F.col("invalidated_count") > 0), "FULLY_INVALIDATED")
        .otherwise("ACTIVE")
    )
    return g.withColumn("batch_status", F.concat(base, F.when((F.col("trashed_count") > 0) & (live > 0), "_WITH_TRASHED_ITEMS").otherwise("")))


def job_monitor(jobs: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """AG17, AG22, FI27: per batch the number of jobs, finished jobs, their ratio and whether any still runs."""
    done = F.count_if(F.col("status").isin(*terminal))
    return jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), done.alias("finished"), F.max("updated_at").alias("last_update")).withColumn("ratio", F.col("finished") / F.col("jobs")).withColumn(
        "is_running", F.col("finished") < F.col("jobs")
    )


def facet_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG20, SE12, SE14: distinct non-blank values of each column with their counts, as rows (facet, value, n)."""
    out = None
    for c in columns:
        one = rows.select(F.lit(c).alias("facet"), identity_text(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AG23, AG39: number of rows of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def reference_counts(pdfs: DataFrame, captures: DataFrame) -> DataFrame:
    """JO19, AG32: every pdf with the number of its captures and batches."""
    c = captures.groupBy("pdf_id").agg(F.count("*").alias("n_captures"), F.countDistinct("batch_id").alias("n_batches"), F.min("capture_id").alias("first_capture"))
    return pdfs.select("pdf_id", "filename").join(c, "pdf_id", "left").select("pdf_id", "filename", F.coalesce("n_captures", F.lit(0)).alias("n_captures"), F.coalesce("n_batches", F.lit(0)).alias("n_batches"), "first_capture")


def homogeneous(rows: DataFrame, group: str, reason: str, complete: Column, conflict: Column) -> DataFrame:
    """AG35: groups that a bulk action may treat as one: one reason, complete evidence, no conflict."""
    return rows.groupBy(group).agg(F.countDistinct(reason).alias("reasons"), F.bool_and(complete).alias("complete"), F.bool_or(conflict).alias("conflict")).withColumn("allowed", (F.col("reasons") == 1) & F.col("complete") & ~F.col("conflict"))


def bundle_check(children: DataFrame, bundle: str, order: str, ready: Column) -> DataFrame:
    """JO12, JO35, RE17, AG25, SE15: child orders must be 0..n-1 once each; roll-up READY, PARTIALLY_REVIEW_REQUIRED or REVIEW_REQUIRED."""
    g = children.groupBy(bundle).agg(
        F.count("*").alias("n"), F.countDistinct(order).alias("d"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.bool_and(ready).alias("all_ready"), F.bool_or(ready).alias("any_ready")
    )
    ok = (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    status = F.when(F.col("all_ready"), "READY").when(F.col("any_ready"), "PARTIALLY_REVIEW_REQUIRED").otherwise("REVIEW_REQUIRED")
    return g.select(bundle, "n", F.coalesce(ok, F.lit(False)).alias("order_ok"), status.alias("bundle_status"))


# --- dependencies and lifecycle ----------------------------------------------


def dependency_status(sources: DataFrame, captures: DataFrame) -> DataFrame:
    """GV9, JO18, AG33: state of each merge from its sources: missing capture, capture not active, else CURRENT, with the numbers."""
    j = sources.join(captures.select("capture_id", "lifecycle_status", "is_trashed"), "capture_id", "left")
    missing = F.col("lifecycle_status").isNull()
    bad = F.coalesce((F.col("lifecycle_status") != "ACTIVE") | (F.col("is_trashed") == 1), F.lit(False))
    g = j.groupBy("merge_id").agg(F.count("*").alias("n_sources"), F.count_if(bad).alias("n_bad"), F.count_if(missing).alias("n_missing"))
    return g.withColumn("dependency_status", F.when(F.col("n_bad") > 0, "STALE_SOURCE_INVALIDATED").when(F.col("n_missing") > 0, "STALE_SOURCE_MISSING").otherwise("CURRENT"))


def lifecycle_after(captures: DataFrame, transitions: DataFrame) -> DataFrame:
    """GV7, GV19, GV23: status of each capture after its latest transition; captures without one keep theirs.
    Transitions: capture_id, new_status, at, seq (ties in time are settled by seq)."""
    last = transitions.groupBy("capture_id").agg(F.max(F.struct("at", "seq", "new_status")).alias("m")).select("capture_id", F.col("m.new_status").alias("new_status"))
    return captures.join(last, "capture_id", "left").withColumn("lifecycle_status", F.coalesce("new_status", "lifecycle_status")).drop("new_status")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """GV1-GV3, GV5, SE11, GV24: rows of ``new`` replace those of the same key; others stay. Columns only one side has are null."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def fill_missing(rows: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """GV16: blank fields from the other table, stated fields stay."""
    o = other.groupBy(key).agg(*(F.min(c).alias("__" + c) for c in columns))
    out = rows.join(o, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(identity_text(c) != "", F.col(c)).otherwise(F.col("__" + c))).drop("__" + c)
    return out


def merge_lists(a: DataFrame, b: DataFrame, key: Sequence[str], lists: Sequence[str], scalars: Sequence[str] = ()) -> DataFrame:
    """SE9, SE10, GV21: full outer join of two rule tables: lists are united in order, scalars keep the left value."""
    right = b.select(*key, *(F.col(c).alias("__" + c) for c in (*lists, *scalars)))
    out = a.join(right, list(key), "full_outer")
    empty = F.array().cast("array<string>")
    cols = [F.array_distinct(F.concat(F.coalesce(c, empty), F.coalesce("__" + c, empty))).alias(c) for c in lists]
    return out.select(*key, *cols, *(F.coalesce(c, "__" + c).alias(c) for c in scalars))


def issue_state(open_issues: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """GV15, GV22, RE19: issues after a new finding: OPENED, KEPT, AUTO_RESOLVED; RESOLVED stays resolved."""
    j = open_issues.select(*key, F.col("status").alias("old")).join(found.select(*key).distinct().withColumn("now", F.lit(True)), list(key), "full_outer")
    return j.select(*key, F.when(F.col("old") == "RESOLVED", "RESOLVED").when(F.col("old").isNull(), "OPENED").when(F.col("now"), "KEPT").otherwise("AUTO_RESOLVED").alias("status"))


def selection(old: DataFrame, visible: DataFrame, chosen: DataFrame, valid: DataFrame) -> DataFrame:
    """SE7: ((old minus visible) plus (chosen and visible)) and valid, as distinct ids."""
    return old.subtract(visible).union(chosen.intersect(visible)).intersect(valid)


def adjudicated(results: DataFrame, reviews: DataFrame, key: Sequence[str]) -> DataFrame:
    """WI2, JO24, PR20, Q8: machine results with their last review (greatest line): CONFIRMED_AUTO keeps the machine value, CONFIRMED_OVERRIDE takes the
    reviewer's, REJECTED has none, otherwise the machine status decides."""
    last = reviews.groupBy(*key).agg(F.max(F.struct("line", "review_status", "override_value")).alias("r"))
    j = results.join(last, list(key), "left")
    status = F.col("r.review_status")
    final = F.when(status == "CONFIRMED_OVERRIDE", F.col("r.override_value")).when(status == "REJECTED", F.lit(None)).when((status == "CONFIRMED_AUTO") | (status.isNull() & (F.col("status") == "RESOLVED")), F.col("value"))
    state = F.when(status.isin("CONFIRMED_AUTO", "CONFIRMED_OVERRIDE"), "ADJUDICATED").when(status == "REJECTED", "REJECTED").when(F.col("status") == "RESOLVED", "MACHINE_RESOLVED").otherwise("UNRESOLVED")
    return j.select(*key, status.alias("review_status"), final.alias("final_value"), state.alias("final_status"))


def expected_members(observed: DataFrame, required: Sequence[str], optional: Sequence[str], group: Sequence[str], member: str) -> DataFrame:
    """AG31, SE8: missing and unexpected members of each group and the covered share of the required ones."""
    have = observed.groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("have"))
    need, may = F.array(*map(F.lit, required)), F.array(*map(F.lit, [*required, *optional]))
    hit = F.size(F.array_intersect("have", need))
    return have.select(
        *group, F.array_join(F.array_sort(F.array_except(need, "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("have", may)), ",").alias("unexpected"), F.round(hit / F.lit(float(max(len(required), 1))), 6).alias("coverage")
    )


def golden_compare(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """JO33, JO34, RE15: expected facts against observed ones: MATCH with exactly one equal value, MISMATCH, or NO_OBSERVATION."""
    a = actual.groupBy(*key).agg(F.countDistinct("value").alias("n"), F.min("value").alias("seen"))
    j = expected.join(a, list(key), "left")
    return j.withColumn("result", F.when(F.col("n").isNull() | (F.col("n") == 0), "NO_OBSERVATION").when((F.col("n") == 1) & (F.col("seen") == F.col("expected_value")), "MATCH").otherwise("MISMATCH"))


def readiness(captures: DataFrame, columns: DataFrame, segments: DataFrame) -> DataFrame:
    """RE10: blocker codes of each capture and whether it may enter a merge (no blocker)."""
    cols = columns.groupBy("capture_id").agg(F.count("*").alias("n_columns"), F.count_if(F.col("data_year").isNull()).alias("no_year"))
    seg = segments.groupBy("capture_id").agg(F.count("*").alias("n_segments"), F.count_if(F.col("confidence") == "LOW").alias("low"))
    j = captures.join(cols, "capture_id", "left").join(seg, "capture_id", "left")
    codes = F.array(
        F.when(F.col("lifecycle_status") != "ACTIVE", "LIFECYCLE_NOT_ACTIVE"),
        F.when(F.col("is_trashed") == 1, "TRASHED"),
        F.when(F.coalesce("boundary_status", F.lit("")) != "COMPLETE", "BOUNDARY_NOT_COMPLETE"),
        F.when(F.coalesce("header_dimension_status", F.lit("")) != "OK", "HEADER_NOT_OK"),
        F.when(F.col("n_columns").isNull(), "NO_COLUMNS"),
        F.when(F.col("n_segments").isNull(), "NO_SEGMENTS"),
        F.when(F.coalesce("low", F.lit(0)) > 0, "LOW_CONFIDENCE_SEGMENT"),
    )
    blockers = F.filter(codes, lambda c: c.isNotNull())
    return j.select("capture_id", F.array_join(blockers, "|").alias("blockers"), (F.size(blockers) == 0).alias("is_ready"))


def compatible_segments(found: DataFrame, certified: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """JO32: certified segments against found ones of the same id and page; all four box edges within ``tolerance``, an unknown box is UNKNOWN.
    Issue codes: SEGMENT_MISSING, PAGE_DIFFERS, BOX_DIFFERS, BOX_UNKNOWN, OK. Boxes are arrays of four numbers."""
    f = found.groupBy("segment_id").agg(F.min("page").alias("f_page"), F.min("bbox").alias("f_box"))
    near = F.forall(F.zip_with("bbox", "f_box", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    j = certified.join(f, "segment_id", "left")
    return j.select("segment_id", F.when(F.col("f_page").isNull(), "SEGMENT_MISSING").when(F.col("f_page") != F.col("page"), "PAGE_DIFFERS").when(F.col("bbox").isNull() | F.col("f_box").isNull(), "BOX_UNKNOWN").when(near, "OK").otherwise("BOX_DIFFERS").alias("issue"))


# --- lists, resynchronisation and append-only layers ---------------------------


def newest(rows: DataFrame, at: str, key: str, limit: int = 500) -> DataFrame:
    """SC13, SC14, FI28, FI30, FI31, FI36: the newest rows first, rows without a time last, ties by key; at most ``limit`` (1..2000) of them."""
    return page(rows, [F.col(at).desc_nulls_last(), F.col(key)], limit)


def resync(stored: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """SC18, SC20: the table after a full scan, with what happened to each row: rows of ``seen`` replace stored ones (ADDED, CHANGED, UNCHANGED); what was not seen any more is
    REMOVED and keeps its stored values, so that the caller may delete or archive it. Keys are unique on both sides (the smallest row counts otherwise)."""
    cols = [c for c in stored.columns if c not in key]
    one = lambda t, name: t.groupBy(*key).agg(F.min(F.struct(*cols)).alias(name))
    j = one(stored, "a").join(one(seen.select(*stored.columns), "b"), list(key), "full_outer")
    state = F.when(F.col("b").isNull(), "REMOVED").when(F.col("a").isNull(), "ADDED").when(F.col("a").eqNullSafe(F.col("b")), "UNCHANGED").otherwise("CHANGED")
    row = F.coalesce("b", "a")
    return j.select(*key, *(row[c].alias(c) for c in cols), state.alias("sync_state"))


def append_once(layer: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """GV12-GV14: rows that an append-only layer takes: those of new keys. A new row whose key is there with other values would change history, so the action fails;
    equal repeats are dropped."""
    cols = [c for c in layer.columns if c not in key]
    fresh = new.select(*layer.columns).distinct()
    old = layer.select(*key, F.struct(*cols).alias("__old")).distinct()
    j = fresh.join(old, list(key), "left")
    clash = F.col("__old").isNotNull() & ~F.col("__old").eqNullSafe(F.struct(*cols))
    checked = j.withColumn("__ok", F.when(clash, F.raise_error(F.lit("rows of this layer are never changed")).cast("boolean")).otherwise(F.col("__old").isNull()))
    return checked.where("__ok").select(*layer.columns)


def stale_merges(merges: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """GV8: merges with a changed source are STALE, the others keep their status: (merge_id, status, n_changed)."""
    hit = sources.join(changed.select("capture_id").distinct(), "capture_id", "left_semi").groupBy("merge_id").agg(F.countDistinct("capture_id").alias("n_changed"))
    return merges.join(hit, "merge_id", "left").select("merge_id", F.when(F.col("n_changed") > 0, "STALE").otherwise(F.col("status")).alias("status"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def cascade_archive(children: DataFrame, archived: DataFrame, parent: str) -> DataFrame:
    """GV10: children of an archived parent carry the flag; archived children stay archived, others of live parents are untouched."""
    gone = archived.select(parent).distinct().withColumn("__gone", F.lit(True))
    return children.join(gone, parent, "left").withColumn("parent_archived", F.coalesce("__gone", F.lit(False))).drop("__gone")


def replaced_sources(old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """GV4: sources of merges after an upsert: all rows of a merge that ``new_sources`` names are replaced by its own, in order; other merges keep theirs.
    Each row is a dependency of its merge. Columns: merge_id, source_order, capture_id."""
    kept = old_sources.join(new_sources.select("merge_id").distinct(), "merge_id", "left_anti")
    return kept.unionByName(new_sources.select(*old_sources.columns))


def persisted_taxonomy(taxonomy: DataFrame, queue: DataFrame) -> DataFrame:
    """GV17: taxonomy (section, item, source_keys) with the confirmed keys of a queue (canonical_section, canonical_item, row_key, mapping_status) added; keys are sorted and distinct.
    Keys are gathered per entry of the taxonomy, which a reviewer keeps by hand."""
    new = queue.where(F.col("mapping_status").isin("CONFIRMED", "CONFIRMED_OVERRIDE")).select(F.col("canonical_section").alias("section"), F.col("canonical_item").alias("item"), F.col("row_key").alias("key"))
    old = taxonomy.select("section", "item", F.explode_outer("source_keys").alias("key"))
    return old.unionByName(new).groupBy("section", "item").agg(F.array_sort(F.collect_set("key")).alias("source_keys"))


def dedup_anchors(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """AG29: one row per identity with the candidate of most children (then the smallest id), the distinct strategies in order, and the number of candidates."""
    best = F.min_by(F.struct("candidate_id", "n_children"), F.struct((-F.coalesce("n_children", F.lit(0))).alias("n"), "candidate_id")).alias("b")
    return candidates.groupBy(*key).agg(best, F.array_join(F.array_sort(F.collect_set("strategy")), "|").alias("strategies"), F.count("*").alias("duplicate_count")).select(*key, F.col("b.candidate_id").alias("candidate_id"), F.col("b.n_children").alias("n_children"), "strategies", "duplicate_count")


def table_names(captures: DataFrame, n: int = 3) -> DataFrame:
    """AG16: per batch (a capture without one is its own: LEGACY_SINGLE::id) the captures, each status' number as 'STATUS=n', and the first ``n`` table names in order."""
    x = captures.select(F.when(identity_text("batch_id") != "", F.col("batch_id")).otherwise(F.concat(F.lit("LEGACY_SINGLE::"), "capture_id")).alias("batch"), F.coalesce("lifecycle_status", F.lit("UNKNOWN")).alias("status"), "table_query")
    status = x.groupBy("batch", "status").agg(F.count("*").alias("n")).groupBy("batch").agg(F.sum("n").alias("captures"), F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), ",").alias("statuses"))
    names = x.where("table_query IS NOT NULL").select("batch", "table_query").distinct().withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy("table_query"))).where(F.col("k") <= n)
    lead = names.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "table_query"))), lambda v: v["table_query"]), "|").alias("tables"))
    return status.join(lead, "batch", "left")
