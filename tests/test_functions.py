import difflib

import pytest
from pyspark.sql import functions as F

from tallywright.functions import notes, numbers, periods, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("raw, value, unit", [("1,234.50", 1234.5, None), ("(1,234)", -1234, None), ("（1,234）", -1234, None), ("12.5%", 12.5, "%"), ("3万元", 3, "万元"), ("-5", -5, None)])
def test_numbers(spark, raw, value, unit):
    r = one(spark, numbers.parse_number("x"), raw)
    assert r.value == value and r.unit == unit and r.ok


@pytest.mark.parametrize("raw", ["-", "不适用", "N/A", "", None, "abc", "1-2"])
def test_no_number(spark, raw):
    assert not one(spark, numbers.parse_number("x"), raw).ok


def test_parity_switch(spark):
    assert one(spark, numbers.parse_number("x", strict_parity=True), "（1,234）").value == 1234


@pytest.mark.parametrize("raw, year", [("2022.0", "2022"), ("2022年度", "2022"), ("2022年", "2022"), ("2022（已重述）", "2022"), ("本年", None), (None, None)])
def test_years(spark, raw, year):
    assert one(spark, periods.absolute_year("x"), raw) == year


@pytest.mark.parametrize("raw, year", [("本年累计数", "2023"), ("上年数", "2022"), ("2021年", "2021"), ("其他", "其他")])
def test_relative_years(spark, raw, year):
    assert one(spark, periods.resolve_year("x", F.lit("2023")), raw) == year


@pytest.mark.parametrize("raw, n", [("附注八-9", 9), ("（十）", 10), ("二十一", 21), ("附注五-13", 13), ("note 7", 7), ("一百零五", 105), ("", None), ("无", None)])
def test_note_ordinals(spark, raw, n):
    assert one(spark, notes.note_ordinal("x"), raw) == n


def test_headings(spark):
    assert tuple(one(spark, notes.peer_heading("x"), "（十二）投资 收益")) == (12, "投资收益")
    assert one(spark, notes.peer_heading("x"), "93.15亿元") is None and one(spark, notes.peer_heading("x"), "3个月至1年") is None


def test_labels(spark):
    assert one(spark, text.normalize_text("x"), "（一）其中：营业 收入。") == "营业收入"
    assert one(spark, text.normalize_text("x"), "nan") == "" and one(spark, text.normalize_text("x"), None) == ""
    assert one(spark, text.normalize_item_label("x"), "存款（附注五、3）") == "存款" and one(spark, text.normalize_item_label("x"), "附注") == "附注" and one(spark, text.normalize_item_label("x"), "余额注") == "余额"
    assert one(spark, text.infer_table_type("x"), "资产总计 负债合计") == "资产负债表"
    assert one(spark, text.statement_scope("x"), "合并资产负债表") == "CONSOLIDATED"


def test_tables(spark):
    df = spark.createDataFrame([([["项目", "2022"], [" ", None], ["收入\n合计", "1,000"], None],)], "t array<array<string>>")
    r = df.select(text.sanitize_table("t").alias("s"), text.find_label(F.array(F.lit("12"), F.lit(" 收入 ")), numbers.is_number_like).alias("l"), text.table_signature("t").alias("g")).first()
    assert r.s == [["项目", "2022"], ["收入 合计", "1,000"]] and (r.l.column, r.l.label) == (1, "收入") and len(r.g) == 40


def test_similarity_is_the_ratio(spark):
    pairs = [("营业收入", "营业总收入"), ("a", ""), (None, "x"), ("同", "同")]
    got = [r.y for r in spark.createDataFrame(pairs, "a string, b string").select(text.string_similarity("a", "b").alias("y")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_reasons_and_regimes(spark):
    from tallywright.functions import text

    df = spark.createDataFrame([("MIXED_CELL:UNIT",), ("unit?",), ("RECONCILIATION_MISMATCH",), ("reconciliation",), ("scope_uncertain",), ("anything",), (None,), ("SOURCE_X",)], "t string")
    assert [r[0] for r in df.select(text.review_reason("t")).collect()] == ["MIXED_CELL", "UNIT_UNCERTAIN", "RECONCILIATION_MISMATCH", "RECONCILIATION_WARNING", "SCOPE_UNCERTAIN", "ROW_STRUCTURE_AMBIGUOUS", "ROW_STRUCTURE_AMBIGUOUS", "SOURCE_IDENTITY_MISSING"]
    df = spark.createDataFrame([(["债权投资", "贷款"],), (["交易性金融资产"],), (["可供出售金融资产"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.presentation_regime("t")).collect()] == [text.REGIMES[0], text.REGIMES[1], text.REGIMES[2], "UNKNOWN", "UNKNOWN"]
