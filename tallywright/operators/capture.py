"""Tables out of page lines: regions, headers, segments over pages and rows; and merge projects from stored datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions.notes import peer_heading
from tallywright.functions.numbers import is_number_like, parse_number
from tallywright.functions.periods import is_period_header, latest_year
from tallywright.functions.text import find_label, infer_table_type, normalize_text
from tallywright.operators import observations as ob
from tallywright.session import small
from tallywright.sources.sinks import write_datasets


def cells_of(lines: DataFrame) -> DataFrame:
    """Lines with their cells: text between tabs or at least two blanks. Lines: doc_id, page, line, content."""
    return lines.withColumn("cells", F.filter(F.split(F.coalesce("content", F.lit("")), r"\t+|\s{2,}|\s*\|\s*"), lambda c: F.trim(c) != ""))


def table_regions(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """HI18: region of each wanted table: from the line after its title to the line before the next numbered heading of the document.

    Titles (title) are few and fixed; a title line is a heading whose text contains the title. Output: lines of all regions with
    region (title, page and line of its start). A line belongs to the last heading before it, found by one running window.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("heading", peer_heading("content"))
    at = F.last(F.when(F.col("heading").isNotNull(), F.struct("page", "line", F.col("heading.title").alias("title"))), True).over(order)
    placed = x.withColumn("start", at).where("start IS NOT NULL AND heading IS NULL")
    wanted = titles.select("title", normalize_text("title").alias("n")).where("n <> ''").distinct()
    hit = normalize_text("start.title").contains(F.col("n"))
    return placed.join(small(wanted), hit).select("doc_id", "title", F.col("start.page").alias("start_page"), F.col("start.line").alias("start_line"), "page", "line", "content")


def header_lines(region_lines: DataFrame) -> DataFrame:
    """HI16: header line of each region: the line with most period cells, then the upper one; regions without one have no row.
    Output: doc_id, title, start_page, start_line, header_page, header_line, headers."""
    x = cells_of(region_lines).withColumn("periods", F.filter("cells", is_period_header)).where(F.size("periods") > 0)
    region = ["doc_id", "title", "start_page", "start_line"]
    w = Window.partitionBy(*region).orderBy(F.size("periods").desc(), "page", "line")
    return x.withColumn("place", F.row_number().over(w)).where("place = 1").select(*region, F.col("page").alias("header_page"), F.col("line").alias("header_line"), F.col("periods").alias("headers"))


def table_rows(region_lines: DataFrame, headers: DataFrame) -> DataFrame:
    """HI17, HI21: rows below the header of each region: label, numbers in order and the years of the headers; lines without a number are no rows.
    Output: region columns, row_order, page, raw_item, column_ordinal, value, value_raw, data_year."""
    region = ["doc_id", "title", "start_page", "start_line"]
    x = cells_of(region_lines).join(headers, region).where(F.struct("page", "line") > F.struct("header_page", "header_line"))
    numbers = F.filter(F.transform("cells", lambda c: F.struct(c.alias("raw"), parse_number(c).alias("p"))), lambda s: s["p"]["ok"])
    y = x.withColumn("label", find_label(F.col("cells"), is_number_like)["label"]).withColumn("numbers", numbers).where(F.size("numbers") > 0)
    w = Window.partitionBy(*region).orderBy("page", "line")
    z = y.withColumn("row_order", F.row_number().over(w)).select(*region, "row_order", "page", F.col("label").alias("raw_item"), "headers", F.posexplode("numbers").alias("k", "n"))
    return z.select(*region, "row_order", "page", "raw_item", (F.col("k") + 1).alias("column_ordinal"), F.col("n.p.value").alias("value"), F.col("n.raw").alias("value_raw"), latest_year(F.get("headers", F.col("k"))).alias("data_year"))


def page_segments(pieces: DataFrame) -> DataFrame:
    """HI14, HI15: pieces of a table on pages to physical segments: a piece continues the one before if it stands on the next page with the same header
    and width, else it opens a segment. Pieces: doc_id, table_id, page, header, width. Output adds segment_order and segment_page."""
    w = Window.partitionBy("doc_id", "table_id").orderBy("page", "header", "width")
    goes_on = (F.col("page") == F.lag("page").over(w) + 1) & F.col("header").eqNullSafe(F.lag("header").over(w)) & F.col("width").eqNullSafe(F.lag("width").over(w))
    x = pieces.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    y = x.withColumn("segment_order", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("doc_id", "table_id", "segment_order").orderBy("page", "header", "width")
    return y.withColumn("segment_page", F.row_number().over(inner)).drop("opens")


def best_blocks(blocks: DataFrame, query: str) -> DataFrame:
    """HI20, FI22: one block per page of a document: the first page takes the best score, later pages prefer its number of columns, then the score.
    Blocks: doc_id, page, block, rows (array of arrays). The score is the share of number cells, plus 1 where the text names the query."""
    cells = F.flatten("rows")
    text = F.array_join(cells, " ")
    score = F.size(F.filter(cells, lambda c: is_number_like(c))) / F.greatest(F.lit(1), F.size(cells)) + F.when(normalize_text(text).contains(normalize_text(F.lit(query))), 1.0).otherwise(0.0)
    x = blocks.withColumn("score", score).withColumn("width", F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))).withColumn("table_type", infer_table_type(text))
    first = x.groupBy("doc_id").agg(F.min(F.struct("page", (-F.col("score")).alias("s"), "block", "width")).alias("f")).select("doc_id", F.col("f.width").alias("wanted"))
    w = Window.partitionBy("doc_id", "page").orderBy((F.col("width") == F.col("wanted")).desc(), F.desc("score"), "block")
    return x.join(first, "doc_id").withColumn("place", F.row_number().over(w)).where("place = 1").select("doc_id", "page", "block", "width", "table_type", F.round("score", 6).alias("score"))


def refresh_merge(spark: SparkSession, folder: str, out: str, dims: Sequence[str] = ob.DIMENSIONS) -> dict[str, DataFrame]:
    """GV18: a merge project once more from its stored rows and its (edited) mapping queue: mapped rows, resolved values, conflicts and coverage are
    written to ``out`` and returned. Stored datasets: raw_long and mapping_queue, as Parquet in ``folder``."""
    raw = spark.read.parquet(f"{folder}/raw_long")
    queue = spark.read.parquet(f"{folder}/mapping_queue")
    mapped = ob.apply_mapping(raw, queue, "source_key", [c for c in ("canonical_item", "mapping_status") if c in queue.columns])
    resolved = ob.resolve(mapped, dims)
    datasets = {"mapped_long": mapped, "resolved": resolved, "conflicts": resolved.where("conflict_status <> 'OK'"), "coverage": ob.coverage(mapped)}
    write_datasets(out, datasets)
    return {name: spark.read.parquet(f"{out}/{name}") for name in datasets}


def new_definition(definitions: DataFrame, definition_id: str, payload: str, archive: bool = False) -> DataFrame:
    """UD7: definitions with one more version of ``definition_id``: the new version is current and the earlier ones are kept; ``archive`` closes it instead.
    Definitions: definition_id, version, payload, status."""
    mine = F.col("definition_id") == definition_id
    if archive:
        return definitions.withColumn("status", F.when(mine, "ARCHIVED").otherwise(F.col("status")))
    last = definitions.where(mine).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    added = last.select(F.lit(definition_id).alias("definition_id"), (F.col("v") + 1).cast("int").alias("version"), F.lit(payload).alias("payload"), F.lit("CURRENT").alias("status"))
    return definitions.withColumn("status", F.when(mine, "SUPERSEDED").otherwise(F.col("status"))).unionByName(added)
