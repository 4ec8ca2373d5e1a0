"""Writers: datasets as Parquet, small exports as CSV, JSON lines, HTML or Markdown."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import identity_text

#: Most rows that a preview or a driver-side document holds.
PREVIEW_ROWS = 200


def write_datasets(folder: str, datasets: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> None:
    """SK4: one Parquet dataset per name; committed by Spark's file commit protocol."""
    for name, df in datasets.items():
        writer = df.write.mode("overwrite")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}")


def append_lines(df: DataFrame, folder: str) -> None:
    """SK12, ST2, GV25: append-only JSON lines; nothing is updated in place."""
    df.write.mode("append").json(folder)


def export_csv(df: DataFrame, folder: str, overwrite: bool = False, single_file: bool = False) -> None:
    """SK10, SK11: CSV with a header; an existing folder is refused unless told. A single file is for small reports only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(folder)


def write_document(path: str, data: dict) -> None:
    """SK9: small JSON document on the driver, replaced in one step."""
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1, sort_keys=True, default=str)
    os.replace(part, path)


def preview_html(df: DataFrame, rows: int = PREVIEW_ROWS, bold: str | None = None) -> str:
    """SK7: first rows as an HTML table; rows whose ``bold`` column is true are set in bold. Only ``rows`` rows reach the driver."""
    shown = [c for c in df.columns if c != bold]
    out = ["<table><thead><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in shown) + "</tr></thead><tbody>"]
    for r in df.limit(rows).collect():
        tag = "strong" if bold and r[bold] else "span"
        out.append("<tr>" + "".join(f"<td><{tag}>{html.escape('' if r[c] is None else str(r[c]))}</{tag}></td>" for c in shown) + "</tr>")
    return "".join(out) + "</tbody></table>"


def capture_datasets(long: DataFrame, cutoffs: DataFrame, ordinals: list[int]) -> dict[str, DataFrame]:
    """SK2: datasets of captures: all machine rows, the official and the excluded ones, the official wide table, item dictionary and totals by status."""
    from tallywright.operators import long_form, observations

    split = observations.cutoff_split(long, cutoffs)
    official = split.where("part <> 'EXCLUDED'").drop("cutoff")
    return {
        "machine_full_long": long, "official_long": official, "excluded_long": split.where("part = 'EXCLUDED'").drop("cutoff"), "official_wide": long_form.capture_wide(official, ordinals),
        "item_dictionary": observations.item_dictionary(official),
    }


def merge_datasets(raw: DataFrame, queue: DataFrame, mapped: DataFrame, dims: list[str], years: list[str]) -> dict[str, DataFrame]:
    """SK1: datasets of a merge: raw and mapped rows, mapping queue, resolved values, conflicts, coverage, identity report, column codes and header roles, wide tables and cross-family items."""
    from tallywright.operators import observations as ob

    resolved = ob.resolve(mapped, dims)
    return {
        "raw_long": raw, "mapping_queue": queue, "mapped_long": mapped, "resolved": resolved, "conflicts": resolved.where("conflict_status <> 'OK'"), "coverage": ob.coverage(mapped), "identity_qa": ob.identity_qa(raw),
        "column_codes": ob.column_codes(raw), "header_roles": ob.header_policy(raw), "research_wide": ob.wide_by_key(resolved, ["table_family", "row_path", "normalized_item"], "document_year", years, "y", ["company", "data_year", "first_value"]),
        "metric_wide": ob.metric_wide(raw, years), "cross_family": ob.cross_family_guard(raw), "item_dictionary": ob.item_dictionary(raw),
    }


def batch_datasets(results: DataFrame, reviews: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """SK3: datasets of a batch: machine results, adjudicated ones, the review log and what is still open."""
    from tallywright.operators import registry

    adjudicated = registry.adjudicated(results, reviews, key)
    return {"machine_long": results, "adjudicated_long": adjudicated, "review_log": reviews, "review_queue": adjudicated.where("final_status = 'UNRESOLVED'")}


def _xlsx_name(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def write_presentation(df: DataFrame, path: str, header: dict[str, list[str]], bold: str | None = None, rows: int = 10_000) -> int:
    """SK6: a wide table as one spreadsheet with a header of several levels: ``header`` gives the texts of each column from the top level down; equal neighbours of a level are merged,
    rows whose ``bold`` column is true are bold, the panes are frozen behind the header. The sheet is for reading: more than ``rows`` rows are refused. Returns the rows written."""
    import zipfile
    from xml.sax.saxutils import escape

    data = df.limit(rows + 1).collect()
    if len(data) > rows:
        raise ValueError(f"more than {rows} rows")
    shown = [c for c in df.columns if c != bold]
    levels = max((len(header.get(c, [c])) for c in shown), default=1)
    heads = [[([""] * (levels - len(header.get(c, [c]))) + header.get(c, [c]))[k] for c in shown] for k in range(levels)]

    def cell(r: int, k: int, v, style: int) -> str:
        at = f'r="{_xlsx_name(k)}{r}" s="{style}"'
        if v is None:
            return f"<c {at}/>"
        if isinstance(v, bool) or not isinstance(v, int | float):
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c {at}><v>{v!r}</v></c>" if v == v else f"<c {at}/>"

    lines, merged = [], []
    for k, texts in enumerate(heads, start=1):
        lines.append(f'<row r="{k}">' + "".join(cell(k, j, t, 1) for j, t in enumerate(texts)) + "</row>")
        j = 0
        while j < len(texts):
            e = j
            while e + 1 < len(texts) and texts[e + 1] == texts[j] != "" and k < levels:
                e += 1
            if e > j:
                merged.append(f'<mergeCell ref="{_xlsx_name(j)}{k}:{_xlsx_name(e)}{k}"/>')
            j = e + 1
    for k, row in enumerate(data, start=levels + 1):
        style = 1 if bold and row[bold] else 0
        lines.append(f'<row r="{k}">' + "".join(cell(k, j, row[c], style) for j, c in enumerate(shown)) + "</row>")
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{levels}" topLeftCell="A{levels + 1}" state="frozen"/></sheetView></sheetViews>'
    merges = f'<mergeCells count="{len(merged)}">{"".join(merged)}</mergeCells>' if merged else ""
    start = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Presentation" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}">{pane}<sheetData>{"".join(lines)}</sheetData>{merges}</worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, start + body)
    return len(data)


def display_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """SK8: columns renamed for display; a label that would repeat gets its column name behind it."""
    seen: dict[str, int] = {}
    names = {}
    for c in df.columns:
        label = labels.get(c, c)
        names[c] = label if label not in seen else f"{label} ({c})"
        seen[label] = 1
    return df.toDF(*(names[c] for c in df.columns))


def report_markdown(df: DataFrame, title: str, rows: int = PREVIEW_ROWS) -> str:
    """SK13: small aggregate as a Markdown table."""
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "\n".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(rows).collect())


def status_counts(audit: DataFrame) -> DataFrame:
    """SK5: rows per status prefix PASS, WARNING, NOT_TESTABLE, in one aggregate."""
    s = F.col("status")
    return audit.agg(F.count_if(s.startswith("PASS")).alias("passed"), F.count_if(s.startswith("WARNING")).alias("warned"), F.count_if(s.startswith("NOT_TESTABLE")).alias("not_testable"), F.count("*").alias("total"))


def backup_then_clear(df: DataFrame, folder: str, confirmation: str) -> DataFrame:
    """SK14: copy of a table, then an empty frame of its schema to write in its place; needs the word CLEAR."""
    if confirmation != "CLEAR":
        raise PermissionError("confirmation missing")
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.createDataFrame([], df.schema)


def same_files(old: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """SK15: rows of a migration that are not stored yet, one per file content (smallest row)."""
    fresh = new.where(identity_text(key) != "").join(old.select(key).distinct(), key, "left_anti")
    cols = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*cols)).alias("m")).select(key, *(F.col("m." + c).alias(c) for c in cols))
