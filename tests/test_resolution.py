import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywright.functions import notes, text
from tallywright.operators import inbox as ib, long_form as lf, observations as ob, registry as rg, resolution as rs, retrieval as rt, sequences as sq
from tallywright.operators.strategies import ROW_PARSERS, AmbiguousStrategy, StrategyRegistry, Strategy, builtin_strategies, provider_choice

PICK = "k string, candidate_id string, match_class int, qualified boolean, quality double, arbitration double, source_quality double, n_values int, score double, page int"


def test_pick(rows):
    df = rows(
        PICK,
        ("exact", "a", 50, False, 0.5, 0.8, 1.0, 1, 0.98, 1), ("exact", "b", 25, False, 0.9, 0.95, 1.0, 2, 0.74, 1),
        ("bare", "a", 50, False, 0.5, 0.8, 1.0, 0, 0.98, 1), ("bare", "b", 25, False, 0.9, 0.95, 1.0, 2, 0.74, 1),
        ("none", "a", 25, False, 0.5, 0.8, 1.0, 0, 0.7, 1), ("qual", "a", 25, True, 0.9, 0.95, 1.0, 2, 0.7, 1),
        ("high", "a", 25, False, 0.9, 0.90, 1.0, 2, 0.7, 1), ("high", "b", 25, False, 0.9, 0.89, 1.0, 2, 0.7, 1),
        ("medium", "a", 25, False, 0.9, 0.80, 1.0, 2, 0.7, 1), ("medium", "b", 15, False, 0.9, 0.70, 1.0, 2, 0.7, 1),
        ("close", "a", 25, False, 0.9, 0.80, 1.0, 2, 0.7, 1), ("close", "b", 25, False, 0.9, 0.75, 1.0, 2, 0.7, None), ("tie", "b", 50, False, 0.9, 0.9, 1.0, 1, 0.9, 2), ("tie", "a", 50, False, 0.9, 0.9, 1.0, 1, 0.9, 2),
    )
    got = {r.k: (r.candidate_id, r.pick_reason, r.status) for r in rs.pick(df, ["k"]).collect()}
    assert got["exact"] == ("a", "EXACT_LABEL", "RESOLVED") and got["bare"] == (None, "EXACT_LABEL_WITHOUT_NUMBER", "REVIEW_REQUIRED") and got["none"][1] == "NO_NUMERIC_CANDIDATE"
    assert got["qual"][1] == "QUALIFIED_VARIANT" and got["high"][:2] == ("a", "HIGH_SCORE") and got["medium"][:2] == ("a", "MEDIUM_SCORE_WITH_MARGIN") and got["close"][1] == "AMBIGUOUS" and got["tie"][0] == "a"
    assert rs.pick(rows(PICK), ["k"]).count() == 0


def test_label_scores_with_all_terms(rows):
    s = "label string, canonical_name string, aliases array<string>, soft_aliases array<string>, exclude array<string>, position_hint string, row int, rows int, n_values int, user_aliases array<string>, keywords array<string>, table_hint array<string>, table_type string, value_type string, units array<string>"
    base = lambda label, **k: tuple({"label": label, "name": "净利润", "al": ["净收益"], "so": ["盈利"], "ex": None, "h": "any", "r": 1, "rs": 10, "n": 0, "u": ["纯利"], "kw": None, "th": None, "tt": None, "vt": None, "un": None, **k}.values())
    df = rows(s, base("纯利"), base("纯利总额"), base("甲乙", kw=["甲", "丙"]), base("净收益", th=["利润表"], tt="利润表"), base("净收益", th=["利润表"], tt="资产负债表"), base("净收益", n=1, vt="percentage", un=["元"]), base(None))
    got = [(r.score, r.match_class) for r in rt.score_labels(df).collect()]
    assert got[0] == (pytest.approx(0.805), 42) and got[1] == (pytest.approx(0.55), 25) and got[2] == (pytest.approx(0.13), 15)
    assert got[3][0] == pytest.approx(0.88) and got[4][0] == pytest.approx(0.795) and got[5][0] == pytest.approx(0.955 + 0.014 - 0.22) and got[6][0] == 0.0


def test_headers_above(rows):
    s = "block_id string, row int, cells array<string>, value_cols array<int>"
    df = rows(s, ("b", 0, ["2022年度", "2021年度"], []), ("b", 1, ["净利润", "1", "2"], [1, 2]), ("b", 2, ["", "2020年", "附注", "2019年"], []), ("b", 3, ["x", "1", "2"], [1, 2, 4]), ("b", 60, ["y", "1"], [1]), ("c", 1, None, [1]))
    got = {(r.block_id, r.row): (r.headers, len(r.snippet)) for r in rs.snippets(rs.period_headers(df)).collect()}
    assert got["b", 1] == ({1: "2022年度", 2: "2021年度"}, 3) and got["b", 3][0] == {1: "2020年", 2: "2019年"} and got["b", 60][0] == {} and got["c", 1] == ({}, 0)


def test_certified_examples(rows):
    levels = ["company", "scope"]
    ctx = rows("context_id string, company string, scope string", ("1", "A", "X"), ("2", "A", "Y"), ("3", "", None))
    ex = rows("company string, scope string, label string", ("A", "X", "ACCEPT"), ("B", "Y", "CONFIRMED"), ("", None, "ACCEPT"), ("A", "Y", "REJECT"))
    assert {r.context_id: r.matched for r in rs.shared_levels(ctx, ex.where("label <> 'REJECT'"), levels).collect()} == {"1": 2, "2": 1, "3": 0}
    c = rows("context_id string, candidate_id string, confidence double", ("1", "p", 0.7), ("1", "q", 0.6), ("2", "p", 0.7), ("3", "p", None))
    got = {(r.context_id, r.candidate_id): (r.rank_score, r.status) for r in rs.certified_rank(c, ctx, ex, levels).collect()}
    assert got["1", "p"] == (pytest.approx(0.775), "RANKED") and got["1", "q"][1] == "CANDIDATE" and got["2", "p"] == (pytest.approx(0.65), "ABSTAIN") and got["3", "p"] == (0.0, "ABSTAIN")


def test_templates(rows):
    s = "{} string, company string, table_id string, row_paths array<string>"
    q = rows(s.format("query_id"), ("q", "A", "t", ["x", "y"]), ("n", None, None, None))
    t = rows(s.format("template_id"), ("1", "A", "t", ["x", "y"]), ("2", "B", "t", ["x", "y"]), ("3", "", "", []))
    got = {(r.query_id, r.place): (r.template_id, r.score) for r in rs.template_rank(q, t).collect()}
    assert got["q", 1] == ("1", 1.0) and got["q", 2] == ("2", 0.8) and got["n", 1] == ("3", 0.55)
    with pytest.raises(ValueError):
        rs.template_rank(q, t, most=2)
    assert rs.template_rank(q, t.limit(0)).count() == 0


def test_tiers_anchors_and_names(rows):
    c = rows("k string, tier int, candidate_id string, score double", *[("a", 1, f"c{i}", float(i)) for i in range(5)], ("a", 2, "c4", 9.0), ("a", 2, "z", 1.0), ("a", 9, "far", 1.0))
    assert {(r.tier, r.candidate_id, r.place) for r in rs.tiered(c, ["k"]).collect()} == {(1, "c4", 1), (1, "c3", 2), (1, "c2", 3), (2, "z", 1)}
    a = rows("k string, candidate_id string, n_children int, strategy string", ("x", "a", 1, "s1"), ("x", "b", 3, "s2"), ("x", "c", 3, "s1"), (None, "d", None, None))
    got = {r.k: (r.candidate_id, r.strategies, r.duplicate_count) for r in rg.dedup_anchors(a, ["k"]).collect()}
    assert got == {"x": ("b", "s1|s2", 3), None: ("d", "", 1)}


def test_keys_and_predicates(spark):
    df = spark.createDataFrame([("附注八-9",), ("八、9",), ("（十二）",), ("无",), (None,)], "t string")
    got = [r.k for r in df.select(notes.note_reference_key("t").alias("k")).collect()]
    assert (got[0].section, got[0].item, got[0].normalized) == (8, 9, "附注8-9") and got[1].item == 9 and (got[2].section, got[2].item) == (None, 12) and got[3].confidence == "NONE" and got[4].raw == ""
    t = spark.createDataFrame([("业务及管理费", "业务及管理费和其他业务成本"), ("费用", "业务费用"), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in t.select(text.title_compatible("a", "b")).collect()] == [True, False, False, False]
    m, new, old, _ = text.REGIMES
    p = spark.createDataFrame([(m, old, "-", False), (m, new, "5", False), (old, old, "5", False), (old, old, "—", False), ("UNKNOWN", new, "5", False), (new, new, "5", True), (None, None, None, None)], "r string, mr string, a string, o boolean")
    assert [r[0] for r in p.select(text.member_period_status(F.col("r"), F.col("mr"), F.col("a"), F.col("o"))).collect()] == ["COMPARATIVE_ONLY_LEGACY_MEMBER", "ACTIVE_CURRENT_PERIOD", "ACTIVE_CURRENT_PERIOD", "UNRESOLVED", "UNRESOLVED", "OUTSIDE_FAMILY", "UNRESOLVED"]
    j = spark.createDataFrame([(["a", '"'],), (None,)], "x array<string>").select(text.json_to_list(text.list_to_json(F.col("x"))).alias("y"))
    assert [r.y for r in j.collect()] == [["a", '"'], []]


def test_mapping_queue_with_taxonomy(rows):
    r = rows("observation_id string, capture_run_id string, row_order int, normalized_item string, raw_item string, company string, value double, parent_section string", ("1", "a", 1, "x", "X", "B", 1.0, "s"), ("2", "b", 1, "x", "x", "A", 1.0, "s"), ("3", "a", 2, "y", "y", None, 1.0, None), ("4", "a", 3, "z", "z", " ", 1.0, "s"), ("5", "a", 4, "n", "n", "A", None, "s"))
    k = r.select("capture_run_id", "row_order", "normalized_item", F.concat(F.lit("UNIQUE||"), "normalized_item").alias("row_key"))
    tax = rows("source_key string, canonical_section string, canonical_item string, category string", ("UNIQUE||z", "S", "Z", "c"))
    got = {q.row_key: (q.mapping_status, q.companies, q.canonical_section, q.canonical_item, q.category) for q in ob.mapping_queue(r, k, tax).collect()}
    assert got == {"UNIQUE||x": ("AUTO_EXACT_IDENTITY", "A | B", "s", "x", ""), "UNIQUE||y": ("UNMAPPED_PRESERVED", "", "", "y", ""), "UNIQUE||z": ("AUTO_TAXONOMY", "", "S", "Z", "c")}


def test_reference_year(rows):
    r = rows("table_id string, source string, key string, member string, row_order int", ("t", "s1", "b", "M1", 2), ("t", "s1", "a", "M1", 1), ("t", "s2", "c", "M2", 1), ("t", "s3", "d", "M3", 1), ("t", "s3", "e", None, 1), ("u", "s9", "z", "M", 1))
    s = rows("table_id string, source string, document_year string, member string, member_order int, note_ordinal int, is_reference boolean", ("t", "s1", "2020", "M1", 1, 9, True), ("t", "s2", "2020", "M2", 2, 3, False), ("t", "s3", "2019", "M3", 3, 1, False), ("u", "s9", "2019", "M", 1, 1, True))
    assert [(x.key, x.note_ordinal) for x in sq.reference_year_order(r, s, "2020").orderBy("base_order").collect()] == [("c", 3), ("a", 9), ("b", 9), ("d", None)]


def test_attempts(rows):
    s = "k string, job_id string, rerun_of string, status string, merge_ready int, at int"
    j = rows(s, ("a", "1", None, "FAILED", 0, 1), ("a", "2", "1", "SUCCESS", 1, 2), ("b", "1", None, "SUCCESS", 1, 1), ("b", "2", "1", "FAILED", 0, 2), ("c", "1", None, "FAILED", None, None))
    assert {r.k: (r.job_id, r.attempts, r.history) for r in ib.latest_attempts(j, ["k"]).collect()} == {"a": ("2", 2, "FAILED>SUCCESS"), "b": ("1", 2, "SUCCESS>FAILED"), "c": ("1", 1, "FAILED")}


def test_append_only_and_resync(rows):
    s = "id string, v int"
    assert {tuple(r) for r in rg.append_once(rows(s, ("a", 1)), rows(s, ("a", 1), ("b", 2), ("b", 2)), ["id"]).collect()} == {("b", 2)}
    with pytest.raises(PySparkException):
        rg.append_once(rows(s, ("a", 1)), rows(s, ("a", 2)), ["id"]).collect()
    got = {r.id: (r.v, r.sync_state) for r in rg.resync(rows(s, ("a", 1), ("b", 2), ("c", None)), rows(s, ("b", 3), ("c", None), ("d", 4)), ["id"]).collect()}
    assert got == {"a": (1, "REMOVED"), "b": (3, "CHANGED"), "c": (None, "UNCHANGED"), "d": (4, "ADDED")}


def test_column_review(rows):
    v = rows("capture_id string, row_order int, column_ordinal int, value double, is_derived boolean", ("a", 1, 1, 1.0, False), ("a", 1, 2, 2021.0, None), ("b", 1, 1, 3.0, False), ("b", 2, 1, 3.0, False), ("b", 3, 2, 3.0, True))
    c = rows("capture_id string, ordinal int, data_year string", ("a", 1, "2021"), ("a", 2, "2020"), ("b", 1, "2020"), ("b", 2, "2021"))
    assert {r.capture_id: r.issues for r in lf.column_review(v, c).collect()} == {"a": "NUMERIC_TOKEN_ORIGIN_AMBIGUOUS", "b": "VALUE_COLUMN_COUNT_MISMATCH|PERIOD_COLUMN_SWAP_RISK|LAST_COLUMN_SPARSE"}


def test_strategies_and_providers(spark, rows):
    reg = StrategyRegistry([Strategy("a", lambda r: r["k"] == 1, lambda r: spark.range(3), lambda d: d), Strategy("b", lambda r: True, lambda r: spark.range(0), lambda d: d)])
    with pytest.raises(AmbiguousStrategy):
        reg.resolve({"k": 1})
    assert reg.resolve({"k": 1, "strategy": "a"})[0] == "a" and reg.resolve({"k": 2}) == (None, None)
    with pytest.raises(ValueError):
        reg.resolve({"k": 2, "strategy": "a"})
    with pytest.raises(KeyError):
        reg.resolve({"k": 1, "strategy": "z"})
    pages = rows("page_id long, text string", (1, "利润表\n营业收入 1,200 (300)\n"), (2, "9、营业收入\n..."))
    name, found = builtin_strategies().resolve({"kind": "statement", "pages": pages, "members": ["营业收入"]})
    assert name == "STATEMENT_MEMBERS" and found.first().page_id == 1
    assert builtin_strategies().resolve({"kind": "note", "pages": pages, "wanted": rows("item string, note int", ("营业收入", 9))})[1].first().page_id == 2
    with pytest.raises(AmbiguousStrategy):
        builtin_strategies().resolve({"kind": "?"})
    lines = rows("page_id long, line int, content string", (1, 1, "营业收入 1,200 (300)"), (1, 2, "说明"), (1, 3, None))
    assert [(r.label, r.amounts) for r in ROW_PARSERS["LABEL_THEN_AMOUNTS"].parse(lines).collect()] == [("营业收入", [1200.0, -300.0])]

    class First:
        def select(self, question, candidates):
            return ("made up", 0.99) if question == "2" else (candidates[0]["candidate_id"], 0.9 if question == "1" else 0.1)

    keys = rows("k string", ("1",), ("2",), ("3",), ("4",))
    c = rows("k string, candidate_id string, label string, score double", ("1", "x", "l", 0.5), ("1", "y", "l", 0.9), ("2", "x", "l", 1.0), ("3", "x", "l", 1.0))
    got = {r.k: (r.candidate_id, r.status) for r in provider_choice(keys, c, "k", First).collect()}
    assert got == {"1": ("y", "RESOLVED"), "2": (None, "REVIEW_REQUIRED"), "3": (None, "REVIEW_REQUIRED"), "4": (None, "REVIEW_REQUIRED")}
    assert provider_choice(keys, c, "k", None).where("status = 'REVIEW_REQUIRED'").count() == 4


def test_evidence(spark):
    df = spark.createDataFrame([([(1.0, "2022", 22.0, "元"), (None, "", 0.0, None)], "monetary", "pdfplumber_table", "利润表", None), (None, None, None, None, None), ([(5.0, "2022", 22.0, "%")], "percentage", "coordinate_rows|cross_block", "未知表", 3)], T := "v array<struct<parsed:double,header:string,period_score:double,unit:string>>, k string, m string, t string, h int")
    assert T and [r[0] for r in df.select(rs.evidence_quality(F.col("v"), F.col("k"), F.col("m"), F.col("t"), F.col("h"))).collect()] == [pytest.approx(0.2 + 0.04 + 0.05 + 0.05 + 0.05 + 0.075 + 0.12 + 0.05 + 0.04), pytest.approx(0.072), pytest.approx(0.2 + 0.08 + 0.1 + 0.1 + 0.1 + 0.15 + 0.65 * 0.12 + 0.02)]
