from pyspark.sql import functions as F

from tallywright.operators import capture as cp

LINES = "doc_id string, page int, line int, content string"


def test_table_from_lines(rows):
    text = ["八、其他事项", "7、投资资产", "项目    2022年    2021年", "定期存款    1,000    900", "债券投资    （50）    -", "说明文字", "合计    950    900", "8、租赁负债", "余额    5"]
    lines = rows(LINES, *[("d", 1 + k // 5, k % 5, t) for k, t in enumerate(text)], ("e", 1, 0, None))
    region = cp.table_regions(lines, rows("title string", ("投资资产",), ("",)))
    assert region.count() == 5
    header = cp.header_lines(region)
    assert header.first().headers == ["2022年", "2021年"]
    got = [(r.row_order, r.raw_item, r.column_ordinal, r.value, r.data_year) for r in cp.table_rows(region, header).orderBy("row_order", "column_ordinal").collect()]
    assert got == [(1, "定期存款", 1, 1000.0, 2022), (1, "定期存款", 2, 900.0, 2021), (2, "债券投资", 1, -50.0, 2022), (3, "合计", 1, 950.0, 2022), (3, "合计", 2, 900.0, 2021)]


def test_segments_over_pages(rows):
    s = "doc_id string, table_id string, page int, header string, width int"
    df = rows(s, ("d", "t", 1, "h", 3), ("d", "t", 2, "h", 3), ("d", "t", 4, "h", 3), ("d", "t", 5, "g", 3), ("d", "t", 6, None, 3), ("d", "t", 7, None, 3))
    assert [(r.page, r.segment_order, r.segment_page) for r in cp.page_segments(df).orderBy("page").collect()] == [(1, 1, 1), (2, 1, 2), (4, 2, 1), (5, 3, 1), (6, 4, 1), (7, 4, 2)]


def test_blocks_keep_their_shape(rows):
    s = "doc_id string, page int, block int, rows array<array<string>>"
    df = rows(s, ("d", 1, 0, [["文字", "说明"]]), ("d", 1, 1, [["投资资产", "1", "2"]]), ("d", 2, 0, [["9", "8"]]), ("d", 2, 1, [["x", "1", "y"]]), ("d", 3, 0, [["1", "2"]]))
    assert [(r.page, r.block) for r in cp.best_blocks(df, "投资资产").orderBy("page").collect()] == [(1, 1), (2, 1), (3, 0)]


def test_refresh_and_definitions(spark, rows, tmp_path):
    from test_operators import LONG, obs

    raw = rows(LONG, obs(1, 5.0), obs(2, 6.0, row_path="q")).withColumn("source_key", F.concat(F.lit("k"), "row_path"))
    queue = rows("source_key string, canonical_item string, mapping_status string", ("kp", "甲", "CONFIRMED"), ("kp", "甲", "CONFIRMED"))
    raw.write.parquet(f"{tmp_path}/in/raw_long")
    queue.write.parquet(f"{tmp_path}/in/mapping_queue")
    out = cp.refresh_merge(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert out["mapped_long"].count() == 2 and out["resolved"].count() == 2 and out["coverage"].first().mapped_rows == 1
    d = rows("definition_id string, version int, payload string, status string", ("a", 1, "x", "CURRENT"))
    two = cp.new_definition(cp.new_definition(d, "a", "y"), "b", "z")
    assert {(r.definition_id, r.version, r.status) for r in two.collect()} == {("a", 1, "SUPERSEDED"), ("a", 2, "CURRENT"), ("b", 1, "CURRENT")}
    assert cp.new_definition(two, "a", "", archive=True).where("status = 'ARCHIVED'").count() == 2
