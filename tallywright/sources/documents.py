"""Readers of stored capture, merge and review documents, and the pluggable page source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright import schemas


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (with wildcards) names at least one non-empty file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found) and any(f.isDirectory() or f.getLen() > 3 for f in found)  # three bytes: a mark of order alone


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SC1, SC2, SC17: CSV with a header and a declared schema; missing, empty and mark-only files give an empty frame. Years stay text."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SC17: Parquet or CSV by suffix."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SC3, SC12, SC13, SC19: capture result documents, one JSON document per file, with their run and whether they lie in the trash."""
    rows = spark.read.schema(schemas.CAPTURE_RESULT).option("multiLine", True).json(path)
    source = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(source, r"/([^/]+)/[^/]+$", 1).alias("run_id"), source.contains("/_trash/").alias("is_trashed"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """SC4: append-only review lines with their file and offset order; malformed lines are skipped."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = raw.select("file", "line", F.from_json("value", schemas.REVIEW, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL AND r.review_status IS NOT NULL")
    return parsed.select("file", "line", "r.*")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SC5, SC14, SC20: merge manifests, one row per source in order."""
    m = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return m.select("merge_id", "table_id", "created_at", F.posexplode("sources").alias("source_order", "s")).select("merge_id", "table_id", "created_at", "source_order", "s.*")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SC6, JO25: taxonomy document {tables: {id: {mappings: [...]}}} as (table_id, source_key, canonical fields); a missing file is empty."""
    out = T.StructType().add("table_id", "string").add("source_key", "string").add("canonical_section", "string").add("canonical_item", "string").add("category", "string")
    if not _exists(spark, path):
        return spark.createDataFrame([], out)
    schema = T.StructType().add("tables", T.MapType(T.StringType(), T.StructType().add("mappings", T.ArrayType(schemas.TAXONOMY_ENTRY))))
    t = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("tables").alias("table_id", "t"))
    e = t.select("table_id", F.explode("t.mappings").alias("m")).select("table_id", "m.*")
    return e.select("table_id", F.explode("source_keys").alias("source_key"), "canonical_section", "canonical_item", "category")


def taxonomy_lookup(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """JO25: exact key first, else the item if it means one entry only."""
    exact = taxonomy.groupBy("source_key").agg(F.min(F.struct("canonical_section", "canonical_item")).alias("e"))
    item = taxonomy.groupBy(F.regexp_extract("source_key", r"\|\|(.*)$", 1).alias("item")).agg(F.countDistinct("canonical_section", "canonical_item").alias("n"), F.min(F.struct("canonical_section", "canonical_item")).alias("i")).where("n = 1").select("item", "i")
    j = rows.join(exact, "source_key", "left").join(item, rows["normalized_item"] == item["item"], "left").drop("item")
    return j.withColumn("match", F.coalesce("e", "i")).select(*rows.columns, F.col("match.canonical_section").alias("canonical_section"), F.col("match.canonical_item").alias("canonical_item"), F.when(F.col("e").isNotNull(), "EXACT").when(F.col("i").isNotNull(), "ITEM").alias("match_kind"))


def read_rulebook(spark: SparkSession, path: str) -> DataFrame:
    """SC7: rulebook document {name: rule} as one row per metric; a term of two metrics fails the read."""
    from tallywright.functions.text import normalize_text

    schema = T.MapType(T.StringType(), schemas.RULE)
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", schema)).alias("metric_id", "rule")).select("metric_id", F.col("metric_id").alias("canonical_name"), "rule.*")
    lists = F.concat(F.array("canonical_name"), *(F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "soft_aliases")))
    clash = rows.select("metric_id", F.explode(lists).alias("t")).groupBy(normalize_text("t").alias("term")).agg(F.countDistinct("metric_id").alias("n")).where("n > 1 AND term <> ''").limit(1).collect()
    if clash:
        raise ValueError(f"term of several metrics: {clash[0].term}")
    return rows


def read_golden(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """SC16: golden facts that the caller loaded from its own format."""
    schema = T.StructType().add("member_id", "string").add("label", "string").add("data_year", "string").add("expected_value", "double")
    return spark.createDataFrame([(r.get("member_id"), r.get("label"), r.get("data_year"), r.get("expected_value")) for r in rows], schema)


PageParser = Callable[[str, bytes], Iterator[dict]]


def read_pages(spark: SparkSession, path: str, parser: PageParser, config_key: str = "", cached: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """SC8-SC10, FN13: pages of stored files by a pluggable parser (path, bytes) -> page records.

    Files are read as binary and parsed where they lie; pages already in ``cached`` (same file hash and configuration) are not parsed
    again, and ``wanted`` (pdf_sha256) restricts the files by a semi join. The result is PAGE_INDEX; cached pages are united with new ones.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("pdf_sha256"))
    if wanted is not None:
        files = files.join(wanted.select("pdf_sha256").distinct(), "pdf_sha256", "left_semi")
    if cached is not None:
        done = cached.where(F.col("config_key") == config_key).select("pdf_sha256").distinct()
        files = files.join(done, "pdf_sha256", "left_anti")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                rows = [{"pdf_sha256": f.pdf_sha256, "config_key": config_key, "page": p["page"], "text": p.get("text", ""), "text_chars": len(p.get("text", "")), "source": p.get("source", "text"), "ocr_used": bool(p.get("ocr_used", False))} for p in parser(f.path, f.content)]
                if rows:
                    yield pd.DataFrame(rows, columns=schemas.PAGE_INDEX.names)

    new = files.mapInPandas(parse, schemas.PAGE_INDEX)
    return new if cached is None else cached.where(F.col("config_key") == config_key).unionByName(new)


def read_candidate_pages(spark: SparkSession, path: str, parser: Callable[[str, bytes, list[int]], Iterator[dict]], candidates: DataFrame, budget: int, config_key: str = "") -> DataFrame:
    """SC11: costly reading of the best candidate pages only: of each file at most ``budget`` pages (pdf_sha256, page, score; ties go to the earlier page) are handed to the parser
    (path, bytes, pages). Files without candidates are not parsed. The result is PAGE_INDEX with ocr_used true."""
    from pyspark.sql import Window

    w = Window.partitionBy("pdf_sha256").orderBy(F.desc("score"), "page")
    chosen = candidates.groupBy("pdf_sha256", "page").agg(F.max("score").alias("score")).withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= budget)
    wanted = chosen.groupBy("pdf_sha256").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("pdf_sha256")).join(wanted, "pdf_sha256")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples():
                allowed = {int(p) for p in f.pages}
                rows = [{"pdf_sha256": f.pdf_sha256, "config_key": config_key, "page": p["page"], "text": p.get("text", ""), "text_chars": len(p.get("text", "")), "source": p.get("source", "ocr"), "ocr_used": True} for p in parser(f.path, f.content, sorted(allowed)) if p["page"] in allowed]
                if rows:
                    yield pd.DataFrame(rows, columns=schemas.PAGE_INDEX.names)

    return files.select("path", "content", "pdf_sha256", "pages").mapInPandas(parse, schemas.PAGE_INDEX)


def text_pages(path: str, content: bytes) -> Iterator[dict]:
    """Parser of plain text files: pages end with a form feed."""
    for k, text in enumerate(content.decode("utf-8", "replace").split("\f"), start=1):
        yield {"page": k, "text": text}


def read_control_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """SC15: one control-plane table over JDBC, for import; Parquet tables are the working form."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def import_control_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """SC15: control-plane tables (from ``read_control_table`` or any other reader) as Parquet in ``folder``, read back under their names."""
    out = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
        out[name].createOrReplaceTempView(name)
    return out
