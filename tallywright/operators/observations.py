"""Long observations: delivery clean-up, resolution of repeated readings, conflicts, wide tables and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.numbers import lookup
from tallywright.functions.text import as_bool, identity_text

#: Identity of an observation in the order of the wide table's label.
DIMENSIONS = (
    "company", "document_year", "table_family", "member_table_role", "row_path", "normalized_item",
    "data_year", "statement_scope", "restated_flag", "period_type", "measure", "currency", "unit",
)
LABEL_FIELDS = ("company", "document_year", "data_year", "period_type", "unit", "statement_scope", "restated_flag", "measure")
SCOPES = {"本集团": "CONSOLIDATED", "集团": "CONSOLIDATED", "本公司": "COMPANY", "公司": "COMPANY"}
MAPPED = ("AUTO_TAXONOMY", "AUTO_EXACT_IDENTITY", "CONFIRMED", "CONFIRMED_OVERRIDE")


def latest_delivery(rows: DataFrame, key: Sequence[str], arrival: str, ties: Sequence[str] = ()) -> DataFrame:
    """SE4, WI2: one row per key, the one that arrived last. Redelivered rows equal the first in all but their arrival, so rows that tie in it are
    taken as equal; where they may differ, ``ties`` names the columns that settle it. Only the columns that later steps use are read and shuffled."""
    order = Window.partitionBy(*key).orderBy(F.col(arrival).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties))
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def canonical_scope(x: Column) -> Column:
    """PR2: statement scope words to their codes; others stay."""
    return F.coalesce(lookup(x, SCOPES), x)


def _numeric(rows: DataFrame) -> DataFrame:
    """FI1."""
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def distinct_in_order(values: Column) -> Column:
    """AG2: greedy first-seen distinct values of an ordered array, equal within max(1e-8, |u| 1e-10)."""
    return F.aggregate(
        values,
        F.array().cast("array<double>"),
        lambda kept, v: F.when(F.exists(kept, lambda u: F.abs(v - u) <= F.greatest(F.lit(1e-8), F.abs(u) * 1e-10)), kept).otherwise(F.concat(kept, F.array(v))),
    )


def resolve(rows: DataFrame, dims: Sequence[str] = DIMENSIONS, seq: Sequence[str] = ("observation_id",)) -> DataFrame:
    """AG1-AG3, Q7: one row per identity with its values, conflict status and final value.

    Null dimensions are kept as their own group. Readings are reduced to (identity, capture, value) and then to (identity, value) before anything is
    gathered, so an identity that is repeated in a third of all rows is combined before the shuffle and only its distinct values meet.
    Status: REVIEW_REQUIRED_SOURCE_IDENTITY (family or role missing), REVIEW_REQUIRED_DIMENSION_AMBIGUITY (several values, several physical
    columns, data year or scope missing), VALUE_CONFLICT, else OK; final_value only where OK and one value.
    Output: dims, source_count (rows), capture_count, value_count, first_value, last_value, conflict_status, conflict_severity, final_value.
    """
    missing = (identity_text("table_family") == "") | (identity_text("member_table_role") == "")
    by_capture = _numeric(rows).groupBy(F.struct(*dims).alias("__id"), "capture_run_id", "value").agg(
        F.min(F.struct(*seq)).alias("s"), F.count("*").alias("n"), F.min("column_ordinal").alias("lo"), F.max("column_ordinal").alias("hi")
    )
    first = (F.row_number().over(Window.partitionBy("__id", "capture_run_id").orderBy("value")) == 1) & F.col("capture_run_id").isNotNull()  # counts each capture once
    small = by_capture.withColumn("c", first.cast("long")).groupBy("__id", "value").agg(F.min("s").alias("s"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    collected = small.groupBy("__id").agg(
        F.sum("n").alias("source_count"), F.sum("c").alias("capture_count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("s", F.col("value").alias("v")))).alias("vs")
    )
    grouped = collected.select(*(F.col("__id." + d).alias(d) for d in dims), "source_count", "capture_count", "lo", "hi", "vs")
    values = grouped.withColumn("values", distinct_in_order(F.col("vs.v"))).withColumn("identity_missing", missing)
    many = F.size("values") > 1
    dim_missing = (identity_text("data_year") == "") | (identity_text("statement_scope") == "")
    status = (
        F.when(F.col("identity_missing"), "REVIEW_REQUIRED_SOURCE_IDENTITY")
        .when(many & (F.col("lo") != F.col("hi")) & dim_missing, "REVIEW_REQUIRED_DIMENSION_AMBIGUITY")
        .when(many, "VALUE_CONFLICT")
        .otherwise("OK")
    )
    return values.withColumn("conflict_status", status).select(
        *dims, "source_count", "capture_count", F.size("values").alias("value_count"), F.col("values")[0].alias("first_value"),
        F.element_at("values", -1).alias("last_value"), "conflict_status",
        F.when(F.col("conflict_status") == "OK", "OK").when(F.col("conflict_status") == "VALUE_CONFLICT", "BLOCKING").otherwise("WARNING").alias("conflict_severity"),
        F.when((F.col("conflict_status") == "OK") & ~many, F.col("values")[0]).alias("final_value"),
    )


def combine(values: Column, many: str) -> Column:
    """AG5-AG7: one value as it is, several as ``many[a|b]``, none as ''."""
    return F.when(F.size(values) == 0, "").when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.concat(F.lit(many + "["), F.array_join(values, "|"), F.lit("]")))


def units_sorted(column: str) -> Column:
    """AG6: non-blank units in order."""
    return combine(F.array_sort(F.collect_set(F.when(identity_text(column) != "", identity_text(column)))), "REVIEW_REQUIRED")


def ordered_distinct(column: Column, order: Column) -> Column:
    """First-seen order of the distinct non-blank values of a group; the set is gathered, so use it on values that repeat."""
    pairs = F.sort_array(F.collect_set(F.when(identity_text(column) != "", F.struct(order.alias("o"), identity_text(column).alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def wide_by_key(resolved: DataFrame, key: Sequence[str], column: str, labels: Sequence[str], prefix: str, order: Sequence[str]) -> DataFrame:
    """PV1, PV2, PV4, JO4: safe final values with one column per label (first by ``order``) and the unit list of the key, in one aggregate.
    Labels are given, so the schema does not depend on the data; ``n_unlabelled`` counts the values whose label is not among them."""
    safe = resolved.where("conflict_status = 'OK' AND final_value IS NOT NULL")
    cells = [F.min_by(F.when(F.col(column) == x, F.col("final_value")), F.when(F.col(column) == x, F.struct(*order))).alias(f"{prefix}{x}") for x in labels]
    return safe.groupBy(*key).agg(units_sorted("unit").alias("unit"), _unlabelled(column, labels), *cells)


def _unlabelled(column: str, labels: Sequence[str]) -> Column:
    """Number of values of a group whose label has no column."""
    return F.count_if(~F.coalesce(F.col(column).isin(*labels), F.lit(False))).alias("n_unlabelled")


def metric_wide(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """PV3, JO6, AG7, SO3: metric x year with units in first-seen order; full outer join of units and values, in order of first appearance."""
    seen = rows.groupBy("normalized_item", "unit").agg(F.min("observation_id").alias("first"))
    units = seen.groupBy("normalized_item").agg(combine(F.transform(F.sort_array(F.collect_list(F.when(identity_text("unit") != "", F.struct("first", "unit")))), lambda p: p["unit"]), "REVIEW_REQUIRED").alias("unit"))
    value = _numeric(rows)
    cells = [F.min_by(F.when(F.col("document_year") == x, F.col("value")), F.when(F.col("document_year") == x, F.col("observation_id"))).alias(f"y{x}") for x in labels]
    return units.join(value.groupBy("normalized_item").agg(F.min("observation_id").alias("first_seen"), _unlabelled("document_year", labels), *cells), "normalized_item", "full_outer")


def family_merge(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """AG9, Q3: per key more than one distinct value is a conflict, else the first row's value stands, null included."""
    first = F.min_by(F.struct("value"), F.col(seq))
    return rows.groupBy(*key).agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_rows"), first.alias("f")).select(
        *key, "n_values", "n_rows", F.when(F.col("n_values") > 1, "VALUE_CONFLICT").otherwise("OK").alias("conflict_status"), F.when(F.col("n_values") <= 1, F.col("f.value")).alias("value")
    )


def cross_family_guard(rows: DataFrame) -> DataFrame:
    """AG8, Q1: items that occur in more than one family, with the sorted families."""
    return rows.select("normalized_item", "table_family").distinct().groupBy("normalized_item").agg(F.count("table_family").alias("n"), F.array_join(F.array_sort(F.collect_set("table_family")), "|").alias("families")).where("n > 1").select(
        "normalized_item", "families"
    )


def source_keys(rows: DataFrame) -> DataFrame:
    """PR7, WI5, WI7: identity of each source row inside its capture: the item alone where it is unique there, else item, path and occurrence.
    One structural row per (capture, row_order): the first by observation_id. Output: capture_run_id, row_order, normalized_item, row_key."""
    first = rows.where("row_order IS NOT NULL").groupBy("capture_run_id", "row_order").agg(F.min_by(F.struct("normalized_item", "row_path"), "observation_id").alias("r")).select(
        "capture_run_id", "row_order", F.trim(F.coalesce("r.normalized_item", F.lit(""))).alias("normalized_item"), F.coalesce("r.row_path", F.lit("")).alias("row_path")
    )
    item = Window.partitionBy("capture_run_id", "normalized_item")
    n, k = F.count("*").over(item), F.row_number().over(item.orderBy("row_order"))
    return first.select("capture_run_id", "row_order", "normalized_item", "row_path", n.alias("n"), k.alias("k")).select(
        "capture_run_id", "row_order", "normalized_item",
        F.when(F.col("normalized_item") == "", "LEGACY||").when(F.col("n") == 1, F.concat(F.lit("UNIQUE||"), "normalized_item"))
        .otherwise(F.concat(F.lit("CONTEXT_PATH||"), "normalized_item", F.lit("||"), "row_path", F.lit("||OCC"), F.col("k").cast("string"))).alias("row_key"),
    )


def mapping_queue(rows: DataFrame, keys: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """AG10: per row key the occurrences, captures, companies (number, first by name, and all in name order), first six raw labels, canonical fields and the status:
    AUTO_TAXONOMY where the taxonomy (source_key, canonical_section, canonical_item, category) lists the key, AUTO_EXACT_IDENTITY where two captures share it, else
    UNMAPPED_PRESERVED, which keeps section and item of its first row. Raw labels are reduced to six and companies to distinct names before they are gathered.
    Suggestions for what is unmapped are ``retrieval.suggest_labels``'s.
    """
    keyed = _numeric(rows).join(keys, ["capture_run_id", "row_order", "normalized_item"])
    raw = keyed.where("raw_item IS NOT NULL").groupBy("row_key", "raw_item").agg(F.min("observation_id").alias("o"))
    six = raw.withColumn("k", F.row_number().over(Window.partitionBy("row_key").orderBy("o", "raw_item"))).where("k <= 6").groupBy("row_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "raw_item"))), lambda x: x["raw_item"]), " | ").alias("examples"))
    names = keyed.where("trim(company) <> ''").groupBy("row_key", "company").agg(F.lit(1).alias("one")).groupBy("row_key").agg(F.array_join(F.array_sort(F.collect_list("company")), " | ").alias("companies"))
    section = F.col("parent_section") if "parent_section" in rows.columns else F.lit("")
    first = F.min_by(F.struct(F.coalesce(section, F.lit("")).alias("section"), F.coalesce("normalized_item", F.lit("")).alias("item")), "observation_id").alias("f")
    main = keyed.groupBy("row_key").agg(F.count("*").alias("occurrences"), F.countDistinct("capture_run_id").alias("capture_count"), F.countDistinct("company").alias("company_count"), F.min("company").alias("first_company"), first)
    out = main.join(six, "row_key", "left").join(names, "row_key", "left")
    known = F.lit(False)
    if taxonomy is not None:
        entry = taxonomy.groupBy(F.col("source_key").alias("row_key")).agg(F.min(F.struct("canonical_section", "canonical_item", "category")).alias("t"))
        out, known = out.join(entry, "row_key", "left"), F.col("t").isNotNull()
    else:
        out = out.withColumn("t", F.lit(None).cast("struct<canonical_section:string,canonical_item:string,category:string>"))
    status = F.when(known, "AUTO_TAXONOMY").when(F.col("capture_count") >= 2, "AUTO_EXACT_IDENTITY").otherwise("UNMAPPED_PRESERVED")
    return out.select(
        "row_key", "occurrences", "capture_count", "company_count", "first_company", F.coalesce("companies", F.lit("")).alias("companies"), "examples",
        F.coalesce("t.canonical_section", "f.section").alias("canonical_section"), F.coalesce("t.canonical_item", "f.item").alias("canonical_item"), F.coalesce("t.category", F.lit("")).alias("category"), status.alias("mapping_status"),
    )


def apply_mapping(rows: DataFrame, queue: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """JO1: left join of the reviewed queue on ``key``; the queue is reduced to one row per key (smallest payload) and its columns replace equal names on the left."""
    one = queue.groupBy(key).agg(F.min(F.struct(*payload)).alias("m")).select(key, *(F.col("m." + p).alias(p) for p in payload))
    return rows.drop(*[p for p in payload if p in rows.columns]).join(one, key, "left")


def canonical_key(status: Column, table: Column, family: Column, role: Column, capture: Column, section: Column, item: Column, path: Column) -> Column:
    """PR6: key of a canonical row; rows without family or role are isolated by their capture."""
    scope = F.when((identity_text(family) == "") | (identity_text(role) == ""), F.concat(F.lit("MISSING_SOURCE::"), F.when(identity_text(capture) == "", "UNKNOWN").otherwise(identity_text(capture)))).otherwise(
        F.concat(F.lit("FAMILY::"), identity_text(family), F.lit("::ROLE::"), identity_text(role))
    )
    return F.concat_ws("::", F.when(status.isin(*MAPPED), "CANON").otherwise("RAW"), F.coalesce(table, F.lit("")), scope, F.coalesce(section, F.lit("")), F.coalesce(item, F.lit("")), F.coalesce(path, F.lit("")))


def coverage(mapped: DataFrame) -> DataFrame:
    """AG11: per capture the numeric rows, mapped rows, preserved rows and their ratio."""
    yes = F.coalesce(F.col("mapping_status").isin(*MAPPED), F.lit(False))
    return _numeric(mapped).groupBy("capture_run_id").agg(
        F.count("*").alias("numeric_rows"), F.count_if(yes).alias("mapped_rows"), F.count_if(F.col("mapping_status") == "UNMAPPED_PRESERVED").alias("preserved_rows")
    ).withColumn("coverage", F.col("mapped_rows") / F.col("numeric_rows"))


def identity_qa(rows: DataFrame) -> DataFrame:
    """AG12: first family, role and pdf of each capture, distinct paths and the missing identity fields."""
    first = F.min_by(F.struct("table_family", "member_table_role", "source_pdf"), "observation_id").alias("f")
    g = rows.groupBy("capture_run_id").agg(first, F.countDistinct("row_path").alias("path_count"))
    fields = ("table_family", "member_table_role", "source_pdf")
    missing = F.array_join(F.filter(F.array(*(F.when(identity_text(F.col("f." + x)) == "", x) for x in fields)), lambda v: v.isNotNull()), "|")
    return g.select("capture_run_id", *(F.col("f." + x).alias(x) for x in fields), "path_count", missing.alias("missing_fields"))


def dimension_label(fields: Sequence[str] = LABEL_FIELDS) -> Column:
    """PR12: 'name=value' parts of the non-blank fields; the restatement flag is always there."""
    parts = []
    for f in fields:
        if f == "restated_flag":
            parts.append(F.concat(F.lit(f + "="), F.when(as_bool(f), "TRUE").otherwise("FALSE")))
        else:
            parts.append(F.when(identity_text(f) != "", F.concat(F.lit(f + "="), identity_text(f))))
    return F.concat_ws(" | ", *parts)


def column_codes(rows: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """PR13, PR17: COL_00001... for every distinct label in label order; the fields stay next to it, so nothing is parsed back.
    Codes are numbered in two levels (range of labels, place in the range), so no single task numbers all of them."""
    labels = rows.groupBy(dimension_label(fields).alias("label")).agg(F.min(F.struct(*fields)).alias("d"))
    lead = labels.withColumn("head", F.substring("label", 1, 24))
    sizes = lead.groupBy("head").agg(F.count("*").alias("c")).withColumn("skip", F.coalesce(F.sum("c").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    place = F.row_number().over(Window.partitionBy("head").orderBy("label"))
    return lead.withColumn("place", place).join(sizes, "head").select(F.format_string("COL_%05d", F.col("skip") + F.col("place")).alias("code"), "label", *(F.col("d." + f).alias(f) for f in fields))


def header_policy(rows: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """PR15: for each field whether it is shown as a header level or kept as metadata: years always shown, other fields if they vary,
    the restatement flag only where it alone tells two columns apart. One row per field."""
    shown = rows.agg(*(F.countDistinct(F.when(identity_text(f) != "", identity_text(f))).alias(f) for f in fields))
    others = [f for f in fields if f != "restated_flag"]
    splits = rows.groupBy(*others).agg(F.min(as_bool("restated_flag")).alias("lo"), F.max(as_bool("restated_flag")).alias("hi")).agg(F.coalesce(F.max((F.col("lo") != F.col("hi")).cast("int")), F.lit(0)).alias("splits"))
    long = shown.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_values")) for f in fields))).alias("x")).select("x.field", "x.n_values").crossJoin(splits)  # one row per field, one row
    role = F.when(F.col("field").isin("document_year", "data_year"), "VISIBLE").when(F.col("field") == "restated_flag", F.when(F.col("splits") == 1, "VISIBLE").otherwise("METADATA")).when(F.col("n_values") > 1, "VISIBLE").otherwise("METADATA")
    return long.select("field", "n_values", role.alias("role"))


def item_dictionary(rows: DataFrame) -> DataFrame:
    """PR27, PR28: distinct items of each capture with the raw label of their first row."""
    return rows.where(identity_text("normalized_item") != "").groupBy("capture_run_id", "normalized_item").agg(F.min_by("raw_item", F.struct("row_order", "observation_id")).alias("first_raw"), F.min("row_order").alias("first_row"))


def union_captures(frames: Sequence[DataFrame]) -> DataFrame:
    """SE1, SE2, AG13: bag union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cutoff_split(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """FI2, FI3: rows up to a capture's cutoff are OFFICIAL, later ones EXCLUDED; captures without a cutoff stay OFFICIAL, rows without
    an order are UNPLACED."""
    return rows.join(cutoffs, "capture_run_id", "left").withColumn(
        "part", F.when(F.col("row_order").isNull(), "UNPLACED").when(F.col("cutoff").isNull() | (F.col("row_order") <= F.col("cutoff")), "OFFICIAL").otherwise("EXCLUDED")
    )


def exclude_checked(rows: DataFrame, exclusions: DataFrame, key: Sequence[str]) -> DataFrame:
    """FI4: rows without those that an exclusion names. Each exclusion must name exactly one row and agree with its item and number
    (within max(1e-9, |x| 1e-12)); otherwise the action fails."""
    named = exclusions.select(*key, F.col("expected_item"), F.col("expected_value"))
    hits = named.join(rows.select(*key, "normalized_item", "value"), list(key), "left").groupBy(*key).agg(
        F.count("normalized_item").alias("n"),
        F.max(((F.col("normalized_item") != F.col("expected_item")) | (F.abs(F.col("value") - F.col("expected_value")) > F.greatest(F.lit(1e-9), F.abs("expected_value") * 1e-12))).cast("int")).alias("wrong"),
    )
    checked = hits.select(*key, F.when((F.col("n") != 1) | (F.coalesce("wrong", F.lit(0)) == 1), F.raise_error(F.lit("exclusion does not match exactly one row"))).otherwise(F.lit(1)).cast("int").alias("ok"))
    return rows.join(checked.where("ok = 1").select(*key), list(key), "left_anti")


def orphan_numbers(rows: DataFrame) -> DataFrame:
    """FI7, FI8: unlabelled numeric rows whose neighbours in row order are labelled: (capture_run_id, row_order)."""
    w = Window.partitionBy("capture_run_id").orderBy("row_order")
    one = rows.where("row_order IS NOT NULL").groupBy("capture_run_id", "row_order").agg(F.max((identity_text("raw_item") == "").cast("int")).alias("blank"), F.count("value").alias("n"))
    near = one.select("capture_run_id", "row_order", "blank", "n", F.lag("blank").over(w).alias("before"), F.lead("blank").over(w).alias("after"))
    return near.where("blank = 1 AND n > 0 AND coalesce(before, 0) = 0 AND coalesce(after, 0) = 0").select("capture_run_id", "row_order")
