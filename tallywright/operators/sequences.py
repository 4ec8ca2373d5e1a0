"""Order of canonical rows over several sources, and page geometry: the parts that follow a sequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- order of keys -----------------------------------------------------------


def order_conflicts(sequence: DataFrame, reference: DataFrame) -> DataFrame:
    """WI6: keys of a source that stand before an earlier key of the reference order: (source, key, predecessor).

    ``sequence``: source, key, pos; ``reference``: key, ref_pos. A running maximum of reference positions per source, no walk.
    """
    w = Window.partitionBy("source").orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, -1)
    x = sequence.join(reference, "key").withColumn("top", F.max(F.struct("ref_pos", "key")).over(w))
    return x.where(F.col("ref_pos") < F.col("top.ref_pos")).select("source", "key", F.col("top.key").alias("predecessor"))


def first_positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WI7, WI8: first position of each key in a source, and the later ones as duplicates (source, key, first_pos, duplicate_pos)."""
    first = rows.groupBy("source", "key").agg(F.min("pos").alias("pos"))
    repeated = rows.join(first.withColumnRenamed("pos", "first_pos"), ["source", "key"]).where("pos > first_pos").select("source", "key", "first_pos", F.col("pos").alias("duplicate_pos"))
    return first, repeated


def merge_order(base: list[str], incoming: list[str]) -> list[str]:
    """SE3: keys that the base lacks are put next to the neighbours they have in the incoming order; the base keeps its order.

    A missing run goes before its next known neighbour if that comes after the previous one, else behind the previous one (after earlier
    insertions there); without neighbours it goes to the end.
    """
    out, seen = list(base), set(base)
    fresh = list(dict.fromkeys(k for k in incoming if k))
    handled: set[str] = set()
    i = 0
    while i < len(fresh):
        if fresh[i] in seen:
            handled.add(fresh[i])
            i += 1
            continue
        j = i
        while j < len(fresh) and fresh[j] not in seen:
            j += 1
        block = fresh[i:j]
        behind = fresh[i - 1] if i else None  # everything before i is known by now
        ahead = fresh[j] if j < len(fresh) else None
        if behind is not None and ahead is not None and out.index(behind) < out.index(ahead):
            at = out.index(ahead)
        elif behind is not None and ahead is not None:
            at = out.index(behind) + 1
        elif behind is not None:
            at = out.index(behind) + 1
            while at < len(out) and out[at] in handled:
                at += 1
        elif ahead is not None:
            at = out.index(ahead)
        else:
            at = len(out)
        out[at:at] = block
        seen.update(block)
        handled.update(block)
        i = j
    return out


_ORDER = T.StructType().add("table_id", "string").add("key", "string").add("canonical_order", "integer").add("order_source", "string")


def structural_order(sequences: DataFrame) -> DataFrame:
    """HI4: (table_id, key, canonical_order, order_source) over all sources of each table: the reference source first, others inserted in context.

    Sequences: table_id, source_order (0 is the reference), key, pos. Sources are folded one after another, which is sequential by
    nature; what one task holds is the distinct keys of one table family: repeated (source, key) rows are reduced before, and sources whose keys
    are all known already with the same neighbours add nothing.
    """
    first = sequences.groupBy("table_id", "source_order", "key").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("table_id", "source_order").orderBy("pos", "key")
    lists = first.withColumn("n", F.row_number().over(w))
    shape = lists.groupBy("table_id", "source_order").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("keys"))
    distinct = shape.groupBy("table_id", "keys").agg(F.min("source_order").alias("source_order"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        table_id = pdf["table_id"].iloc[0]
        order: list[str] = []
        origin: dict[str, str] = {}
        for _, row in pdf.sort_values("source_order").iterrows():
            keys = list(row["keys"])
            label = "REFERENCE" if not order else "INSERTED"
            order = merge_order(order, keys) if order else list(dict.fromkeys(keys))
            for k in keys:
                origin.setdefault(k, label)
        return pd.DataFrame({"table_id": table_id, "key": order, "canonical_order": range(1, len(order) + 1), "order_source": [origin[k] for k in order]})

    return distinct.groupBy("table_id").applyInPandas(fold, _ORDER)


def note_order(members: DataFrame) -> DataFrame:
    """HI5 without a reference year: members by note ordinal, then hint, year and key; members without a note come last. Ranks are dense per table."""
    w = Window.partitionBy("table_id").orderBy(F.col("note_ordinal").asc_nulls_last(), F.col("hint").asc_nulls_last(), F.col("year").desc_nulls_last(), "key")
    best = members.groupBy("table_id", "key").agg(F.min("note_ordinal").alias("note_ordinal"), F.min("hint").alias("hint"), F.max("year").alias("year"))
    return best.withColumn("base_order", F.row_number().over(w))


def reference_year_order(rows: DataFrame, sources: DataFrame, year: str) -> DataFrame:
    """HI5: order of canonical keys by the notes of one year's sources: (table_id, key, base_order, note_ordinal).

    Rows: table_id, source, key, member, row_order; sources: table_id, source, document_year, member, member_order, note_ordinal, is_reference. Members come by the smallest note ordinal they
    have in sources of ``year``, then by their order hint there; members without a note follow by hint and name. Keys of a member come by their row order in sources of the
    year, in the reference source, anywhere, then by name. Keys without a member and tables without a source of the year have no row: their caller keeps the order of the
    reference source (``structural_order``).
    """
    of_year = sources.where(F.col("document_year") == year)
    hints = of_year.groupBy("table_id", "member").agg(F.min("note_ordinal").alias("note_ordinal"), F.min("member_order").alias("hint"))
    kind = sources.groupBy("table_id", "source").agg(F.bool_or(F.col("document_year") == year).alias("in_year"), F.bool_or(F.coalesce("is_reference", F.lit(False))).alias("in_reference"))
    far = F.lit(10**9)
    placed = rows.where("key IS NOT NULL AND trim(member) <> ''").join(kind, ["table_id", "source"], "left").groupBy("table_id", "key").agg(
        F.min("member").alias("member"),
        F.coalesce(F.min(F.when(F.col("in_year"), F.col("row_order"))), far).alias("of_year"),
        F.coalesce(F.min(F.when(F.col("in_reference"), F.col("row_order"))), far).alias("of_reference"),
        F.coalesce(F.min("row_order"), far).alias("anywhere"),
    )
    covered = placed.join(of_year.select("table_id").distinct(), "table_id", "left_semi").join(hints, ["table_id", "member"], "left")
    w = Window.partitionBy("table_id").orderBy(F.col("note_ordinal").asc_nulls_last(), F.coalesce("hint", F.lit(0)), "member", "of_year", "of_reference", "anywhere", "key")
    return covered.select("table_id", "key", F.row_number().over(w).alias("base_order"), "note_ordinal")


# --- page geometry -----------------------------------------------------------

_LINES = T.StructType().add("page_id", "long").add("line", "integer").add("x0", "double").add("y0", "double").add("x1", "double").add("y1", "double").add("text", "string")


def words_to_lines(words: DataFrame, tolerance: float = 3.8, memory: int = 4) -> DataFrame:
    """HI7, HI22, AG37: words of a page to lines: a word joins one of the last ``memory`` lines whose mean centre is within ``tolerance``, else opens one.

    Words: page_id, x0, y0, x1, y1, text. The running mean makes this sequential; a group is one page. Lines come with their envelope.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for w in pdf.sort_values(["y0", "x0", "text"]).itertuples():
            centre = (w.y0 + w.y1) / 2
            near = [ln for ln in lines[-memory:] if abs(ln[0] / ln[1] - centre) <= tolerance]
            if near:
                best = min(near, key=lambda ln: abs(ln[0] / ln[1] - centre))
                best[0] += centre
                best[1] += 1
                best[2].append(w)
            else:
                lines.append([centre, 1, [w]])
        out = []
        for k, (_, _, ws) in enumerate(sorted(lines, key=lambda ln: ln[0] / ln[1])):
            ws.sort(key=lambda w: w.x0)
            out.append((pdf["page_id"].iloc[0], k, min(w.x0 for w in ws), min(w.y0 for w in ws), max(w.x1 for w in ws), max(w.y1 for w in ws), " ".join(w.text for w in ws)))
        return pd.DataFrame(out, columns=_LINES.names)

    return words.groupBy("page_id").applyInPandas(group, _LINES)


def line_cells(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """HI8: words of one line to cells: a gap wider than ``gap`` starts a new cell. Words: page_id, line, x0, x1, text."""
    w = Window.partitionBy("page_id", "line").orderBy("x0", "x1", "text")
    opened = words.withColumn("cell", F.coalesce(F.sum(F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)).over(w), F.lit(0)))
    return opened.groupBy("page_id", "line", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ").alias("text"))


def nearest_anchor(words: DataFrame, anchors: DataFrame, reach: float = 1.5) -> DataFrame:
    """JO31: nearest column anchor of each word by distance of centres, if within ``reach`` half-widths: (word_id, anchor_id, distance).

    Words: page_id, word_id, x; anchors: page_id, anchor_id, centre, half_width. Anchors of a page are few; words and anchors meet by page only.
    """
    near = words.join(anchors, "page_id").withColumn("distance", F.abs(F.col("x") - F.col("centre"))).where(F.col("distance") <= reach * F.col("half_width"))
    return near.groupBy("page_id", "word_id").agg(F.min(F.struct("distance", "anchor_id")).alias("m")).select("page_id", "word_id", F.col("m.anchor_id").alias("anchor_id"), F.col("m.distance").alias("distance"))


def number_lanes(words: DataFrame, width: float = 12.0, share: float = 0.2) -> DataFrame:
    """HI9, HI23: right edges of number words in lanes: neighbours closer than ``width`` share one; lanes need max(2, share of lines) lines.
    Words: page_id, line, x1. Output: page_id, lane, left, right, support."""
    w = Window.partitionBy("page_id").orderBy("x1", "line")
    gaps = words.withColumn("lane", F.coalesce(F.sum(F.when(F.col("x1") - F.lag("x1").over(w) > width, 1).otherwise(0)).over(w), F.lit(0)))
    lines = words.groupBy("page_id").agg(F.countDistinct("line").alias("lines"))
    lanes = gaps.groupBy("page_id", "lane").agg(F.min("x1").alias("left"), F.max("x1").alias("right"), F.countDistinct("line").alias("support"))
    return lanes.join(lines, "page_id").where(F.col("support") >= F.greatest(F.lit(2.0), F.col("lines") * share)).select("page_id", "lane", "left", "right", "support")


def overlap_ratio(a0, a1, b0, b1):
    """FN56: overlap of two intervals over the shorter one."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1e-9), F.least(a1 - a0, b1 - b0))


def page_context(pages: DataFrame, declared: str) -> DataFrame:
    """JO29: value of ``declared`` on the page, else that of the page right before. Pages: pdf_id, page."""
    before = pages.select("pdf_id", (F.col("page") + 1).alias("page"), F.col(declared).alias("__before"))
    one = before.groupBy("pdf_id", "page").agg(F.max("__before").alias("__before"))
    return pages.join(one, ["pdf_id", "page"], "left").withColumn("inherited", F.coalesce(declared, "__before")).drop("__before")
