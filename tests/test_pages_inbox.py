import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywright.operators import inbox as ib
from tallywright.operators import pages as pg
from tallywright.operators import retrieval as rt
from tallywright.plans.resolving import united_rows

PAGES = "page_id long, text string"


def test_page_kinds(rows):
    df = rows(PAGES, (1, "目 录\n一、概要......3"), (2, "货币......3\n存款………7\n合计 9\n"), (3, "利润表\n项目 附注 2022年\n净利润 单位：万元"), (4, None), (5, ""))
    got = {r.page_id: (r.c, round(r.s, 2)) for r in df.select("page_id", pg.is_contents_page(F.col("text")).alias("c"), pg.statement_score(F.col("text"), "INCOME").alias("s")).collect()}
    assert got[1][0] and got[2][0] and not got[3][0] and not got[4][0]
    assert got[3][1] == 0.84 and got[5][1] == 0.0
    m = rows("c int, i int, a double", (10, 1, 0.9), (10, 0, 0.0), (500, 1, 0.9), (500, 0, 0.0)).select(pg.page_modality(F.col("c"), F.col("i"), F.col("a")).alias("m")).collect()
    assert [r.m for r in m] == ["IMAGE_DOMINANT", "EMPTY_OR_UNKNOWN", "HYBRID", "TEXT_DOMINANT"]


def test_sections_prefer_titles(rows):
    df = rows(PAGES, (1, "合并资产负债表（续）\n货币资金"), (2, "如资产负债表所示，存款增加。"), (3, "净额见利润表说明。"))
    assert {(r.kind, r.page_id) for r in pg.primary_pages(pg.section_pages(df, pg.STATEMENTS)).collect()} == {("BALANCE_SHEET", 1), ("INCOME", 3)}


def test_references_and_notes(rows):
    df = rows(PAGES, (1, "其他债权投资 附注 12 1,000\n债权投资 11 5\n存款 5"), (2, "12、其他债权投资\n正文"), (3, "债权投资"), (4, None))
    refs = pg.note_references(df, ["债权投资", "其他债权投资"])
    assert {(r.item, r.note) for r in refs.collect()} == {("其他债权投资", 12), ("债权投资", 11)}
    found = {r.item: (r.page_id, r.confidence) for r in pg.locate_notes(df, refs.select("item", "note")).collect()}
    assert found["其他债权投资"] == (2, 0.98) and found["债权投资"] == (None, 0.0)


def test_amounts_after_a_label(rows):
    df = rows(PAGES, (1, "货币资金\n1,000\n\n2,000\n存款\n5"), (2, "货币资金"))
    assert {r.page_id: list(r.amounts) for r in pg.following_amounts(df, ["货币资金"]).collect()} == {1: [1000.0, 2000.0], 2: []}


def test_anchor_relation(rows):
    df = rows("a double, n array<double>", (100.0, [100.2]), (90.0, [100.0, 10.0]), (5.0, [1.0]), (None, [1.0]), (1.0, []))
    assert [r.x for r in df.select(pg.anchor_relation(F.col("a"), F.col("n")).alias("x")).collect()] == ["EXACT_TOTAL", "GROSS_MINUS_ALLOWANCE", "NONE", "MISSING_MAIN_STATEMENT_AMOUNT", "NONE"]


def test_term_scores(rows):
    terms = rt.search_terms(rows("metric_id string, canonical_name string, aliases array<string>, soft_aliases array<string>", ("A", "营业收入", ["营收"], ["收入"]), ("B", "收入", None, None)))
    got = {(r.page_id, r.metric_id): r.score for r in rt.score_pages(rows(PAGES, (1, "营业 收入，收入"), (2, "营收"), (3, None), (4, "")), terms).collect()}
    assert got == {(1, "A"): 9.0, (1, "B"): 8.0, (2, "A"): 5.0}
    assert [r.page_id for r in rt.with_neighbours(rows("page_id int", (1,), (3,)), F.lit(3)).orderBy("page_id").collect()] == [1, 2, 3]


def test_column_review(rows):
    cols = rows("capture_id string, ordinal int", ("c", 1), ("c", 2), ("d", 1))
    assert ib.keep_columns(cols, rows("capture_id string, ordinal int, action string", ("c", 1, "DROP"))).count() == 2
    with pytest.raises(PySparkException):
        ib.keep_columns(cols, rows("capture_id string, ordinal int, action string", ("d", 1, "DROP"))).collect()


def test_relative_periods_stop_the_merge(rows):
    assert ib.check_periods(rows("data_year string", ("2022",), (None,))).count() == 2
    with pytest.raises(PySparkException):
        ib.check_periods(rows("data_year string", ("本年",))).collect()


def test_numeric_parents(rows):
    s = "capture_id string, row_order int, indent double, value double"
    df = rows(s, ("c", 1, 0.0, 30.0), ("c", 2, 12.0, 10.0), ("c", 3, 12.0, 20.0), ("c", 4, 0.0, 7.0), ("c", 5, 12.0, 7.0), ("d", 1, 0.0, 99.0), ("d", 2, 12.0, 1.0), ("d", 3, 12.0, 1.0))
    assert [tuple(r) for r in ib.numeric_parents(df).collect()] == [("c", 1, 2)]


def test_value_recovery(rows):
    s = "page_id long, row int, label string, value double"
    df = rows(s, (1, 1, "收入", None), (1, 2, "", 5.0), (1, 3, "成本", None), (1, 4, "税金", 1.0), (1, 9, "利润", None), (1, 20, "利润", 8.0), (2, 1, "收入", None))
    got = {(r.page_id, r.row): (r.value, r.value_source) for r in ib.recover_values(df).collect()}
    assert got[1, 1] == (5.0, "NEIGHBOUR") and got[1, 9] == (8.0, "SAME_LABEL") and got[2, 1] == (None, "NONE") and got[1, 20] == (8.0, "OWN")


def test_null_safe_join_keeps_clashing_columns_apart(rows):
    a = rows("id int, y string, x int", (1, None, 7), (2, "2022", 8), (3, "2021", 9))
    b = rows("y string, label string", (None, "none"), ("2022", "now"))
    assert {r.id: (r.label, r.x) for r in ib.join_null_safe(a, b, ["y"]).collect()} == {1: ("none", 7), 2: ("now", 8), 3: (None, 9)}


def test_metric_candidates(rows):
    terms = rows("metric_id string, term string, weight double", ("A", "营业收入", 8.0), ("A", "收入", 1.0), ("B", "净利润", 8.0))
    got = ib.metric_candidates(rows("query string", ("营业收入",), (None,), ("营业收入",)), terms).collect()
    assert [(r.metric_id, r.score, r.place) for r in got if r.place == 1] == [("A", 1.0, 1)]


def test_provenance_lists_every_source(rows):
    data = [("k", i, f"r{i:03d}", "f", i, "x") for i in range(123)] + [("one", 1, "r", "f", None, "y")]
    got = ib.provenance(rows("source_key string, observation_id long, capture_run_id string, source_pdf string, page int, raw_item string", *data), ["source_key"], "observation_id").orderBy("source_key", "chunk").collect()
    assert [(r.source_key, r.chunk, r.n_sources) for r in got] == [("k", 0, 123), ("k", 1, 123), ("k", 2, 123), ("one", 0, 1)]
    assert " | ".join(r.source_rows for r in got[:3]) == " | ".join(f"r{i:03d}:p{i}:x" for i in range(123))


def test_noise_leaves_a_union_whose_parts_are_partitioned_by_the_key(spark, rows, tmp_path):
    families = ("投资资产", "保险合同", "其他")
    data = [(f"o{i}", families[i % 3], i * 300, f"p{i}", f"n{i}", 1.0, i) for i in range(40)] + [("o21", families[0], 6000, "p21", "n21", 1.0, 99), (None, families[1], 9000, "p", "n", 1.0, 1)]
    s = "observation_id string, table_family string, row_order int, row_path string, normalized_item string, value double, loaded_at int"
    rows(s, *data).write.parquet(f"{tmp_path}/long_observations.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that are not broadcast
    try:
        got = [tuple(r) for r in united_rows(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    latest = [d for d in data if d[1] != families[2] and (d[0], d[6]) != ("o21", 21)]
    want = [(d[0], *(("INVEST", "投资", f"投资 / {d[3]}") if d[1] == families[0] else (d[1], None, None)), "HUMAN_LAYOUT_NOISE" if d[2] >= 5000 else None) for d in latest]
    assert sorted(got, key=str) == sorted(want, key=str)
