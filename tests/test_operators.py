import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywright.operators import long_form, observations as ob, registry as rg, retrieval as rt, sequences as sq, structure as st

LONG = "observation_id string, capture_run_id string, table_family string, member_table_role string, company string, document_year string, row_path string, normalized_item string, data_year string, statement_scope string, restated_flag boolean, period_type string, measure string, currency string, unit string, column_ordinal int, row_order int, raw_item string, value double"


def obs(i, value, **kw):
    base = dict(capture_run_id="c1", table_family="f", member_table_role="PRIMARY", company="A", document_year="2022", row_path="p", normalized_item="x", data_year="2022", statement_scope="C", restated_flag=False, period_type="D", measure="AMOUNT", currency=None, unit="元", column_ordinal=1, row_order=1, raw_item="x")
    base.update(kw)
    return (f"o{i}", *(base[k] for k in ("capture_run_id", "table_family", "member_table_role", "company", "document_year", "row_path", "normalized_item", "data_year", "statement_scope", "restated_flag", "period_type", "measure", "currency", "unit", "column_ordinal", "row_order", "raw_item")), value)


def test_resolution(rows):
    df = rows(LONG, obs(1, 100.0), obs(2, 100.0 + 1e-9, capture_run_id="c2"), obs(3, 1.0, company="B"), obs(4, 2.0, company="B"), obs(5, 1.0, company="C", data_year=None), obs(6, 2.0, company="C", data_year=None, column_ordinal=2),
              obs(7, 1.0, company="D", member_table_role=" "), obs(8, None, company="E"), obs(9, 3.0, company=None), obs(10, float("nan"), company="F"))
    got = {r.company: r for r in ob.resolve(df).collect()}
    assert got["A"].conflict_status == "OK" and got["A"].final_value == 100.0 and got["A"].capture_count == 2
    assert got["B"].conflict_status == "VALUE_CONFLICT" and got["B"].final_value is None and got["B"].value_count == 2
    assert got["C"].conflict_status == "REVIEW_REQUIRED_DIMENSION_AMBIGUITY" and got["C"].conflict_severity == "WARNING"
    assert got["D"].conflict_status == "REVIEW_REQUIRED_SOURCE_IDENTITY"
    assert got[None].final_value == 3.0 and "E" not in got and "F" not in got  # null dimensions stay, null and NaN values do not
    assert ob.resolve(rows(LONG)).count() == 0


def test_greedy_distinct_depends_on_order_only(spark):
    df = spark.createDataFrame([([1.0, 1.0 + 5e-9, 1.0 + 1.5e-8, 2.0],)], "v array<double>")
    assert df.select(ob.distinct_in_order(F.col("v")).alias("u")).first().u == [1.0, 1.0 + 1.5e-8, 2.0]


def test_units_and_wide(rows):
    df = rows(LONG, obs(1, 1.0, unit="万元"), obs(2, 2.0, unit="元", document_year="2021"), obs(3, 5.0, unit=None, document_year="2020"))
    wide = ob.wide_by_key(ob.resolve(df), ["normalized_item"], "document_year", ["2020", "2021", "2022"], "y", ["first_value"]).first()
    assert (wide.y2020, wide.y2021, wide.y2022) == (5.0, 2.0, 1.0) and wide.unit == "REVIEW_REQUIRED[万元|元]".replace("万元|元", "|".join(sorted(["万元", "元"])))
    assert ob.metric_wide(df, ["2022"]).first().unit == "REVIEW_REQUIRED[万元|元]"


def test_exclusions_must_match(rows):
    df = rows("capture_run_id string, row_order int, normalized_item string, value double", ("c", 1, "a", 1.0), ("c", 2, "b", 2.0))
    good = rows("capture_run_id string, row_order int, expected_item string, expected_value double", ("c", 1, "a", 1.0))
    assert [r.row_order for r in ob.exclude_checked(df, good, ["capture_run_id", "row_order"]).collect()] == [2]
    bad = rows("capture_run_id string, row_order int, expected_item string, expected_value double", ("c", 1, "z", 1.0))
    with pytest.raises(PySparkException):
        ob.exclude_checked(df, bad, ["capture_run_id", "row_order"]).collect()


def test_parents_by_level_like_a_stack(rows):
    import random

    rng = random.Random(2)
    data = [("c", i, rng.randrange(4), rng.random() < 0.2) for i in range(120)]
    stack, want = [], {}
    for _, i, level, total in data:
        while stack and stack[-1][1] >= level:
            stack.pop()
        want[i] = stack[-1][0] if stack else None
        if not total:
            stack.append((i, level))
    got = {r.row_order: r.parent_row_order for r in st.parents_by_level(rows("capture_id string, row_order int, level int, is_total boolean", *data)).collect()}
    assert got == want


@pytest.mark.parametrize("total, status", [(100.0, "PASS_EXACT"), (100.02, "PASS_ROUNDING"), (110.0, "WARNING_SUM_MISMATCH")])
def test_trailing_total(rows, total, status):
    r = rows("capture_id string, row_order int, level int, is_total boolean, is_section boolean, operator int", ("c", 1, 0, False, False, None), ("c", 2, 0, False, False, None), ("c", 3, 0, True, False, None))
    v = rows("capture_id string, row_order int, column_ordinal int, value double, unit string", ("c", 1, 1, 40.0, "元"), ("c", 2, 1, 60.0, "元"), ("c", 3, 1, total, "元"))
    got = st.audit_totals(v, r).first()
    assert got.status == status and got.pattern == "TRAILING_TOTAL"


def test_formula_patterns(rows):
    s = "capture_id string, row_order int, level int, is_total boolean, is_section boolean, operator int"
    lead = rows(s, ("a", 1, 0, True, False, None), ("a", 2, 1, False, False, None), ("a", 3, 2, False, False, None), ("a", 4, 0, False, False, None),
                ("b", 1, 0, False, False, None), ("b", 2, 0, True, False, None), ("b", 3, 0, False, True, -1), ("b", 4, 0, False, False, None), ("b", 5, 0, True, False, None), ("n", 1, 0, True, False, None))
    f = st.formulas(lead)
    got = {(r.capture_id, r.row_order): r.pattern for r in f.collect()}
    assert got == {("a", 1): "LEADING_PARENT_TOTAL", ("b", 2): "TRAILING_TOTAL", ("b", 5): "BASE_MINUS_COMPONENTS", ("n", 1): "UNKNOWN"}
    m = {(r.capture_id, r.row_order, r.member_order, r.operator) for r in st.formula_members(lead, f).collect()}
    assert m == {("a", 1, 2, 1), ("a", 1, 3, 1), ("b", 2, 1, 1), ("b", 5, 2, 1), ("b", 5, 4, -1)}


def test_implicit_totals(rows):
    s = "capture_id string, row_order int, raw_item string, value double"
    df = rows(s, *[("c", i, n, v) for i, (n, v) in enumerate([("上市", 10.0), ("非上市", 20.0), ("", 31.0)])], *[("d", i, n, v) for i, (n, v) in enumerate([("上市", 10.0), ("非上市", 20.0), (None, 30.0), ("合计", 30.0)])], ("e", 0, "", 5.0))
    got = {r.capture_id: (r.children, r.derived_status) for r in st.implicit_totals(df).collect()}
    assert got == {"c": (2, "DERIVED_REJECTED_NON_BLOCKING"), "d": (2, "SUPPRESSED_BY_EXPLICIT_TOTAL")}


def test_versions_and_dependencies(rows):
    c = rows("capture_id string, pdf_id string, document_year string, table_family_id string, table_query string, created_at timestamp, lifecycle_status string, is_trashed int", ("a", "p", "2020", "f", "q", None, "ACTIVE", 0), ("b", "p", "2020", "f", "q", None, "INVALIDATED", 0), ("c", "p", None, "f", "q", None, "ACTIVE", 0))
    v = {r.capture_id: r for r in rg.versions(c).collect()}
    assert not v["a"].is_current and v["a"].superseded_by == "b" and v["b"].capture_version == 2 and v["c"].is_current
    s = rows("merge_id string, capture_id string", ("m1", "a"), ("m1", "b"), ("m2", "a"), ("m3", "zz"))
    assert {r.merge_id: r.dependency_status for r in rg.dependency_status(s, c).collect()} == {"m1": "STALE_SOURCE_INVALIDATED", "m2": "CURRENT", "m3": "STALE_SOURCE_MISSING"}


def test_upsert_selection_issues(rows):
    k = "id string, v int"
    assert {tuple(r) for r in rg.upsert(rows(k, ("a", 1), ("b", 2)), rows(k, ("b", 3), ("c", 4)), ["id"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    i = "id string"
    got = rg.selection(rows(i, ("a",), ("b",)), rows(i, ("b",), ("c",)), rows(i, ("c",), ("z",)), rows(i, ("a",), ("b",), ("c",)))
    assert {r.id for r in got.collect()} == {"a", "c"}
    state = rg.issue_state(rows("id string, status string", ("a", "OPEN"), ("b", "OPEN"), ("c", "RESOLVED")), rows(i, ("a",), ("d",), ("c",)), ["id"])
    assert {r.id: r.status for r in state.collect()} == {"a": "KEPT", "b": "AUTO_RESOLVED", "c": "RESOLVED", "d": "OPENED"}


def test_segments_with_boxes(rows):
    s = "segment_id string, page int, bbox array<double>"
    found = rows(s, ("a", 1, [0.0, 0.0, 10.0, 10.0]), ("b", 2, [0.0, 0.0, 10.0, 10.0]), ("c", 3, None), ("d", 4, [0.0, 0.0, 1.0, 1.0]))
    certified = rows(s, ("a", 1, [12.0, 0.0, 10.0, 10.0]), ("b", 3, None), ("c", 3, [0.0, 0.0, 1.0, 1.0]), ("d", 4, [13.0, 0.0, 1.0, 1.0]), ("e", 1, None))
    assert {r.segment_id: r.issue for r in rg.compatible_segments(found, certified).collect()} == {"a": "OK", "b": "PAGE_DIFFERS", "c": "BOX_UNKNOWN", "d": "BOX_DIFFERS", "e": "SEGMENT_MISSING"}


def test_merge_order():
    assert sq.merge_order(["a", "b", "c"], ["a", "x", "b"]) == ["a", "x", "b", "c"]
    assert sq.merge_order(["a", "b"], ["x", "a"]) == ["x", "a", "b"]
    assert sq.merge_order(["a", "b"], ["b", "y", "z"]) == ["a", "b", "y", "z"]
    assert sq.merge_order(["a", "b"], ["b", "n", "a"]) == ["a", "b", "n"]
    assert sq.merge_order(["a"], ["q", "r"]) == ["a", "q", "r"] and sq.merge_order([], ["q", "q"]) == ["q"]


def test_structural_order_and_conflicts(rows):
    s = rows("table_id string, source_order long, key string, pos int", ("t", 0, "a", 1), ("t", 0, "b", 2), ("t", 1, "a", 1), ("t", 1, "n", 2), ("t", 1, "b", 3), ("t", 2, "b", 1), ("t", 2, "a", 2), ("t", 2, "a", 5))
    assert [(r.key, r.order_source) for r in sq.structural_order(s).orderBy("canonical_order").collect()] == [("a", "REFERENCE"), ("n", "INSERTED"), ("b", "REFERENCE")]
    q = rows("source string, key string, pos int", ("x", "b", 1), ("x", "a", 2), ("x", "c", 3))
    assert [tuple(r) for r in sq.order_conflicts(q, rows("key string, ref_pos int", ("a", 1), ("b", 2), ("c", 3))).collect()] == [("x", "a", "b")]


def test_structural_order_spans_batches(rows, monkeypatch):
    from tallywright.plans import ranking

    data = {
        "captures": rows("capture_id string, table_family_id string, batch_id string", ("CAP-1", "F", "b1"), ("CAP-2", "F", "b2")),
        "structure_edges": rows("capture_id string, row_order int, normalized_item string", ("CAP-1", 1, "a"), ("CAP-1", 2, "b"), ("CAP-2", 1, "a"), ("CAP-2", 2, "n"), ("CAP-2", 3, "b")),
    }
    monkeypatch.setattr(ranking, "table", lambda spark, d, name: data[name])
    assert [(r.table_id, r.key) for r in ranking.structural_order(None, "").orderBy("canonical_order").collect()] == [("F", "a"), ("F", "n"), ("F", "b")]


def test_geometry(rows):
    w = rows("page_id long, x0 double, y0 double, x1 double, y1 double, text string", (1, 0.0, 0.0, 10.0, 10.0, "货币"), (1, 12.0, 1.0, 20.0, 11.0, "资金"), (1, 100.0, 2.0, 130.0, 12.0, "1,000"), (1, 0.0, 30.0, 10.0, 40.0, "合计"))
    lines = sq.words_to_lines(w).orderBy("line").collect()
    assert [x.text for x in lines] == ["货币 资金 1,000", "合计"] and lines[0].x1 == 130.0
    cells = sq.line_cells(rows("page_id long, line int, x0 double, x1 double, text string", (1, 0, 0.0, 10.0, "货币"), (1, 0, 12.0, 20.0, "资金"), (1, 0, 100.0, 130.0, "1,000"))).orderBy("cell").collect()
    assert [c.text for c in cells] == ["货币 资金", "1,000"]
    near = sq.nearest_anchor(rows("page_id long, word_id long, x double", (1, 7, 98.0), (1, 8, 300.0)), rows("page_id long, anchor_id int, centre double, half_width double", (1, 1, 100.0, 10.0), (1, 2, 120.0, 30.0)))
    assert [(r.word_id, r.anchor_id) for r in near.collect()] == [(7, 1)]
    lanes = sq.number_lanes(rows("page_id long, line int, x1 double", *[(1, k, 100.0 + k) for k in range(4)], (1, 0, 300.0)))
    assert [(r.lane, r.support) for r in lanes.collect()] == [(0, 4)]


def test_ranking(rows):
    r = rt.rank_with_margin(rows("k string, id string, score double", ("a", "x", 0.90), ("a", "y", 0.80), ("b", "x", 0.90), ("b", "y", 0.89), ("c", "x", 0.99), ("d", "x", 0.5)), ["k"], "score", "id").where("place = 1")
    assert {x.k: x.selection for x in r.collect()} == {"a": "PRESELECTED", "b": "MULTIPLE_VALID", "c": "PRESELECTED", "d": "REVIEW"}
    links = rows("anchor string, child_order int, child string, candidate string, score double", ("A", 1, "c1", "x", 0.9), ("A", 2, "c2", "x", 0.95), ("A", 2, "c2", "y", 0.5), ("A", 3, "c3", "x", 0.7))
    assert {(r.child, r.candidate, r.status) for r in rt.assign_greedily(links).collect()} == {("c1", "x", "ASSIGNED"), ("c2", "y", "ASSIGNED"), ("c3", None, "CONFLICT")}


def test_label_scores(rows):
    s = "label string, canonical_name string, aliases array<string>, soft_aliases array<string>, exclude array<string>, position_hint string, row int, rows int, n_values int"
    df = rows(s, ("净利润", "净利润", [], [], [], "any", 1, 10, 2), ("本公司净利润", "净利润", [], [], [], "any", 1, 10, 2), ("利润净额", "净利润", ["利润净额"], [], [], "any", 1, 10, 0), ("营业外收入", "营业收入", [], [], ["营业外"], None, 1, 10, 1))
    got = [(round(r.score, 4), r.match_class) for r in rt.score_labels(df).collect()]
    assert got[0] == (1.0, 50) and got[1] == (round(0.74 + 0.02 - 0.16, 4), 25) and got[2] == (0.835, 45) and got[3][0] == 0.0


def test_every_label_meets_every_metric(rows, monkeypatch):
    from tallywright.plans import ranking

    data = {
        "captures": rows("table_query string", ("「净利润",), ("利润净额",), ("利润净额",), (None,)),
        "metric_aliases": rows("metric_id string, canonical_name string, aliases array<string>, soft_aliases array<string>, exclude array<string>, position_hint string", ("m1", "净利润", ["利润净额"], [], [], "any"), ("m2", "营业收入", [], [], [], "any")),
    }
    monkeypatch.setattr(ranking, "table", lambda spark, d, name: data[name])
    got = {(r.label, r.metric_id): r.match_class for r in ranking.label_scores(None, "").collect()}
    assert set(got) == {(x, m) for x in ("「净利润", "利润净额") for m in ("m1", "m2")} and got["利润净额", "m1"] == 45


def test_suggestions(rows):
    got = rt.suggest_labels(rows("label string", ("营业总收入",), ("电话",)), rows("label string", ("营业收入",), ("净利润",), ("营业收入",)))
    assert [(r.label, r.suggested) for r in got.collect()] == [("营业总收入", "营业收入")]


def test_suggestions_against_all_pairs(rows):
    import difflib
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    df = rows("label string", *((n,) for n in names))
    want = {}
    for a in names:
        score, best = min((-difflib.SequenceMatcher(None, a, b).ratio(), b) for b in names if b != a)
        if -score >= 0.72:
            want[a] = (best, round(-score, 4))
    assert {r.label: (r.suggested, r.score) for r in rt.suggest_labels(df, df).collect()} == want


def test_suggestions_know_the_other_labels(rows, monkeypatch):
    from tallywright.plans import ranking

    data = {"captures": rows("table_query string", ("其他应收款余额",), ("其他应收款余额表",), ("其他应收款余额表",)), "metric_aliases": rows("canonical_name string", ("净利润",))}
    monkeypatch.setattr(ranking, "table", lambda spark, d, name: data[name])
    assert [(r.label, r.suggested) for r in ranking.label_suggestions(None, "").collect()] == [("其他应收款余额", "其他应收款余额表")]


def test_long_form(spark):
    from tallywright import schemas

    cell = lambda k, v, u=None: dict(column_ordinal=k, raw=str(v), parsed_number=v, unit_original=u)
    result = dict(capture_id="c", unit="万元", columns=[dict(ordinal=1, header_raw="2022年", year="2022", scope="集团", restated=None)], rows=[
        dict(row_order=1, normalized_item="a", cells=[cell(1, 5.0), cell(2, 6.0, "%")]), dict(row_order=2, normalized_item="b", cells=[]), dict(row_order=3, normalized_item="n", cells=[cell(1, 1.0)], excluded_from_table_logic=True)])
    df = spark.createDataFrame([result], schemas.CAPTURE_RESULT)
    got = [(r.row_order, r.column_ordinal, r.value, r.statement_scope, r.currency_unit) for r in long_form.to_long(df).orderBy("row_order", "column_ordinal").collect()]
    assert got == [(1, 1, 5.0, "CONSOLIDATED", "CNY_TEN_THOUSAND"), (1, 2, 6.0, None, "PERCENT"), (2, None, None, None, "CNY_TEN_THOUSAND")]


def test_numeric_parents_without_a_length_limit(rows):
    s = "capture_id string, row_order int, indent double, values map<int,double>, page int, label string, parent_section string"
    long_run = [("a", 0, 0.0, {1: 120.0, 2: 60.0}, 1, "p", None)] + [("a", k, 12.0, {1: 1.0, 2: 0.5}, 1, "x", None) for k in range(1, 121)]
    short_sum = [("b", 0, 0.0, {1: 100.0}, 1, "p", None)] + [("b", k, 12.0, {1: 1.0}, 1, "x", None) for k in range(1, 31)]
    other = [
        ("c", 0, 0.0, {1: 30.0, 2: 5.0}, 1, "p", None), ("c", 1, 12.0, {1: 10.0}, 1, "x", None), ("c", 2, 12.0, {1: 20.0}, 1, "x", None),  # a column of the parent is not filled
        ("d", 0, 0.0, {1: 30.0}, 1, "p", None), ("d", 1, 12.0, {1: 10.0}, 1, "x", None), ("d", 2, 12.0, {1: 20.0}, 2, "x", None),  # the page ends
        ("e", 0, 0.0, {1: 30.0}, 1, "p", None), ("e", 1, 200.0, {1: 10.0}, 1, "x", None), ("e", 2, 12.0, {1: 20.0}, 1, "x", None),  # too deep
        ("f", 0, 0.0, {1: 60.0}, 1, "p", None), ("f", 1, 10.0, {1: 30.0}, 1, "x", None), ("f", 2, 20.0, {1: 10.0}, 1, "y", None), ("f", 3, 20.0, {1: 20.0}, 1, "y", None),  # children of an accepted parent
        ("g", 0, 0.0, {1: 99.0}, 1, "p", None), ("g", 1, 10.0, {1: 30.0}, 1, "x", None), ("g", 2, 20.0, {1: 10.0}, 1, "y", None), ("g", 3, 20.0, {1: 20.0}, 1, "y", None),  # its parent fails, so it stands
        ("h", 0, 0.0, {1: 30.0}, 1, "p", None), ("h", 1, 12.0, {1: 10.0}, 1, "x", "s"), ("h", 2, 12.0, {1: 20.0}, 1, "x", None), ("i", 0, 0.0, None, 1, "p", None),
    ]
    from tallywright.operators import inbox as ib

    got = {tuple(r) for r in ib.numeric_parents(rows(s, *long_run, *short_sum, *other)).collect()}
    assert got == {("a", 0, 120), ("f", 0, 3), ("g", 1, 2)}
    assert ib.numeric_parents(rows(s)).count() == 0


def test_stated_sections(rows):
    s = "capture_id string, row_order int, level int, is_total boolean, label string, parent_section string"
    df = rows(s, ("c", 1, 0, False, "资产", None), ("c", 2, 1, False, "投资", None), ("c", 3, 2, False, "债券", "资产"), ("c", 4, 2, False, "股票", "负债"), ("c", 5, 1, True, "合计", None), ("c", 6, 2, False, "其他", "投资"), ("c", 7, None, False, "负债", None))
    got = {r.row_order: (r.parent_row_order, r.confidence, r.evidence) for r in st.parents_by_level(df).collect()}
    assert got[3] == (1, 0.82, "EXPLICIT_PARENT_SECTION+ORDER") and got[4] == (2, 0.58, "PARENT_SECTION_UNMATCHED+ORDER")
    assert got[5] == (1, 0.72, "ROW_LEVEL+ORDER+TOTAL_SUBTOTAL_CUE") and got[6] == (1, 0.58, "PARENT_SECTION_UNMATCHED+ORDER") and got[7] == (None, 0.35, "ORDER")


def test_terms_of_two_lists_count_in_both(rows):
    m = rows("metric_id string, canonical_name string, aliases array<string>, soft_aliases array<string>", ("m", "净利润", ["利润"], ["利润"]))
    pages = rows("page_id long, text string", (1, "净利润"), (2, "利润"), (3, None), (4, ""))
    assert {(r.page_id, r.score) for r in rt.score_pages(pages, rt.search_terms(m)).collect()} == {(1, 14.0), (2, 6.0)}
    with pytest.raises(ValueError):
        rt.score_pages(pages, rt.search_terms(m), most=1)


def test_labels_without_a_column_are_counted(rows):
    df = rows(LONG, obs(1, 1.0), obs(2, 2.0, document_year="1999"), obs(3, 2.0, document_year=None))
    assert ob.wide_by_key(ob.resolve(df), ["normalized_item"], "document_year", ["2022"], "y", ["first_value"]).first().n_unlabelled == 2
    assert ob.metric_wide(df, ["2022"]).first().n_unlabelled == 2
