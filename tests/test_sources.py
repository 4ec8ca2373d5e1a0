import json

import pytest
from pyspark.errors import PySparkException

from tallywright import schemas
from tallywright.operators.strategies import Strategy, StrategyRegistry
from tallywright.sources import documents, sinks
from tallywright.streaming import event_log


def test_csv(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("﻿capture_run_id,company\nc1,甲\n", encoding="utf-8")
    schema = schemas.struct(capture_run_id=schemas._S, company=schemas._S)
    assert [tuple(r) for r in documents.read_csv(spark, str(p), schema).collect()] == [("c1", "甲")]
    (tmp_path / "empty.csv").write_text("﻿", encoding="utf-8")
    assert documents.read_csv(spark, str(tmp_path / "empty.csv"), schema).count() == 0 and documents.read_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0


def test_json_documents(spark, tmp_path):
    for run, trash in (("r1", ""), ("r2", "_trash/")):
        d = tmp_path / "runs" / trash / run
        d.mkdir(parents=True)
        (d / "result.json").write_text(json.dumps({"capture_id": run, "rows": [{"row_order": 1, "cells": []}]}), encoding="utf-8")
    got = documents.read_results(spark, f"{tmp_path}/runs/*/result.json").unionByName(documents.read_results(spark, f"{tmp_path}/runs/_trash/*/result.json")).collect()
    assert {(r.run_id, r.is_trashed) for r in got} == {("r1", False), ("r2", True)}
    reviews = tmp_path / "reviews.jsonl"
    reviews.write_text('{"pdf_sha256": "s", "metric_input": "m", "review_status": "REJECTED"}\nnot json\n{"pdf_sha256": "s", "metric_input": "m", "review_status": "CONFIRMED_AUTO"}\n', encoding="utf-8")
    assert [r.review_status for r in documents.read_reviews(spark, str(reviews)).orderBy("line").collect()] == ["REJECTED", "CONFIRMED_AUTO"]
    tax = tmp_path / "tax.json"
    tax.write_text(json.dumps({"tables": {"t": {"mappings": [{"canonical_item": "收入", "canonical_section": "", "source_keys": ["s||收入", "x||营收"]}]}}}), encoding="utf-8")
    t = documents.read_taxonomy(spark, str(tax))
    rows = spark.createDataFrame([("s||收入", "收入"), ("q||营收", "营收"), ("z", "z")], "source_key string, normalized_item string")
    assert {r.source_key: r.match_kind for r in documents.taxonomy_lookup(rows, t).collect()} == {"s||收入": "EXACT", "q||营收": "ITEM", "z": None}
    book = tmp_path / "rules.json"
    book.write_text(json.dumps({"收入": {"aliases": ["营收"]}, "利润": {"aliases": ["营 收"]}}), encoding="utf-8")
    with pytest.raises(ValueError):
        documents.read_rulebook(spark, str(book))


def test_pages_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo", encoding="utf-8")
    first = documents.read_pages(spark, f"{tmp_path}/*.txt", documents.text_pages, "k")
    assert [(r.page, r.text) for r in first.orderBy("page").collect()] == [(1, "one"), (2, "two")]

    def forbidden(path, content):
        raise AssertionError("parsed again")

    cached = spark.createDataFrame(first.collect(), schemas.PAGE_INDEX)
    assert documents.read_pages(spark, f"{tmp_path}/*.txt", forbidden, "k", cached=cached).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("PASS_EXACT", 1), ("WARNING_SUM_MISMATCH", 2)], "status string, n int")
    sinks.write_datasets(str(tmp_path), {"audit": df})
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2
    sinks.export_csv(df, f"{tmp_path}/csv")
    with pytest.raises(PySparkException):
        sinks.export_csv(df, f"{tmp_path}/csv")
    s = sinks.status_counts(df).first()
    assert (s.passed, s.warned, s.not_testable) == (1, 1, 0)
    assert "<b>" not in sinks.preview_html(spark.createDataFrame([("<b>", True)], "a string, t boolean"), bold="t") and "strong" in sinks.preview_html(spark.createDataFrame([("x", True)], "a string, t boolean"), bold="t")
    assert sinks.display_labels(df, {"status": "n"}).columns == ["n", "n (n)"]
    sinks.write_document(f"{tmp_path}/m.json", {"a": 1})
    assert json.load(open(f"{tmp_path}/m.json")) == {"a": 1}


def test_stream(spark, tmp_path):
    log, out, mark = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/mark"
    e = spark.sql("SELECT * FROM VALUES ('1','A','x','',timestamp'2024-01-01 00:01:00'),('1','A','x','',timestamp'2024-01-01 00:01:00'),('2','B','x','',timestamp'2024-01-01 00:02:00'),('3','A','y','',timestamp'2024-01-02 00:00:00') AS t(event_id,event_type,entity_id,payload,at)")
    sinks.append_lines(e, log)
    event_log.run_available(event_log.once_each(event_log.read_events(spark, log)), out, mark)
    assert spark.read.parquet(out).count() == 3
    event_log.run_available(event_log.once_each(event_log.read_events(spark, log)), out, mark)
    assert spark.read.parquet(out).count() == 3  # nothing new, nothing twice
    event_log.run_available(event_log.windowed_counts(event_log.read_events(spark, log)), f"{tmp_path}/w", f"{tmp_path}/wm")
    assert {(r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/w").collect()} >= {("A", 2), ("B", 1)}


def test_page_cache_stream(spark, tmp_path):
    pages = spark.createDataFrame([("s", "k", 1, "t", 1, "text", False), ("s", "k", 1, "t", 1, "text", False), ("s", "k", 2, "u", 1, "text", False)], schemas.PAGE_INDEX)
    pages.write.parquet(f"{tmp_path}/in")
    for mark in ("m1", "m2"):
        event_log.cache_pages(spark.readStream.schema(schemas.PAGE_INDEX).parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", f"{tmp_path}/{mark}")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2


def test_strategies(spark):
    reg = StrategyRegistry()
    reg.register(Strategy("none", lambda r: not r["ok"], lambda r: spark.createDataFrame([], "x int"), lambda d: d))  # several that support one request are an error
    reg.register(Strategy("one", lambda r: r["ok"], lambda r: spark.range(3), lambda d: d.orderBy("id")))
    assert reg.resolve({"ok": True})[0] == "one" and reg.resolve({"ok": False}) == (None, None)
    with pytest.raises(ValueError):
        reg.register(Strategy("one", lambda r: True, lambda r: spark.range(1), lambda d: d))


def test_presentation_sheet(spark, tmp_path):
    import zipfile
    import xml.etree.ElementTree as ET

    from tallywright.sources import sinks

    df = spark.createDataFrame([("资产 & <b>", 1.5, None, False), ("合计", 2.0, 7.0, True)], "item string, a double, b double, total boolean")
    path = str(tmp_path / "sheet.xlsx")
    assert sinks.write_presentation(df, path, {"item": ["", "项目"], "a": ["2022", "合并"], "b": ["2022", "公司"]}, bold="total") == 2
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ET.fromstring(z.read(name))
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 'mergeCell ref="B1:C1"' in sheet and '<c r="A4" s="1"' in sheet and "资产 &amp; &lt;b&gt;" in sheet and '<c r="B3" s="0"><v>1.5</v>' in sheet
    with pytest.raises(ValueError):
        sinks.write_presentation(df, path, {}, rows=1)


def test_candidate_pages_within_a_budget(spark, tmp_path):
    import hashlib

    from tallywright.sources import documents

    (tmp_path / "a.txt").write_text("p1\fp2\fp3")
    (tmp_path / "b.txt").write_text("q1")
    sha = hashlib.sha256(b"p1\fp2\fp3").hexdigest()
    cand = spark.createDataFrame([(sha, 1, 0.1), (sha, 2, 0.9), (sha, 3, 0.9), (sha, 2, 0.2), ("other", 1, 1.0)], "pdf_sha256 string, page int, score double")

    def parser(path, content, pages):
        return [{"page": k, "text": t} for k, t in enumerate(content.decode().split("\f"), start=1)]  # gives more than it was asked for

    got = documents.read_candidate_pages(spark, str(tmp_path), parser, cand, 2, "k").collect()
    assert sorted((r.page, r.text, r.ocr_used) for r in got) == [(2, "p2", True), (3, "p3", True)]


def test_progress_queue(spark, tmp_path):
    from tallywright.streaming.event_log import ProgressQueue

    spark.range(3).write.parquet(f"{tmp_path}/in")
    progress = ProgressQueue()
    spark.streams.addListener(progress)
    try:
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        events = []
        for _ in range(50):
            events += progress.poll(0.2)
            if events and events[-1]["kind"] == "TERMINATED":
                break
    finally:
        spark.streams.removeListener(progress)
    assert events[0]["kind"] == "STARTED" and events[-1] == {"kind": "TERMINATED", "id": events[0]["id"], "error": None} and sum(e.get("rows", 0) for e in events) == 3


def test_control_tables_and_datasets(spark, tmp_path):
    from tallywright.sources import documents, sinks

    t = documents.import_control_tables({"jobs_imported": spark.createDataFrame([("a", None)], "id string, n int")}, str(tmp_path / "control"))
    assert spark.sql("SELECT count(*) FROM jobs_imported").first()[0] == 1 and t["jobs_imported"].first().n is None
    long = spark.createDataFrame([("o1", "c", 1, 1, "x", "X", 5.0, "元"), ("o2", "c", 9, 1, "y", "Y", 6.0, None)], "observation_id string, capture_run_id string, row_order int, column_ordinal int, normalized_item string, raw_item string, value double, unit string")
    sets = sinks.capture_datasets(long, spark.createDataFrame([("c", 5)], "capture_run_id string, cutoff int"), [1])
    assert {k: v.count() for k, v in sets.items()} == {"machine_full_long": 2, "official_long": 1, "excluded_long": 1, "official_wide": 1, "item_dictionary": 1}
    r = spark.createDataFrame([("k", "UNRESOLVED", 1.0)], "id string, status string, value double")
    v = spark.createDataFrame([], "id string, line int, review_status string, override_value double")
    assert sinks.batch_datasets(r, v, ["id"])["review_queue"].count() == 1
