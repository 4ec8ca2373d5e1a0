"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import Workspace

SEPARATOR = " / "


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per (capture_id, row_order): exact duplicates merge; among differing repeats the smallest
    (parent, item) wins. Rows without a key are set aside. Parents that were never captured count as null and are flagged."""
    nodes = (
        edges.where("capture_id IS NOT NULL AND row_order IS NOT NULL")
        .groupBy("capture_id", F.col("row_order").cast("long").alias("row_order"))
        .agg(F.min(F.struct(F.col("parent_row_order").cast("long").alias("p"), F.col("normalized_item").alias("i"))).alias("m"))
        .select("capture_id", "row_order", F.col("m.p").alias("parent"), F.coalesce("m.i", F.lit("")).alias("item"))
    )
    known = nodes.select("capture_id", F.col("row_order").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, ["capture_id", "parent"], "left").select(
        "capture_id",
        "row_order",
        F.when(F.col("known"), F.col("parent")).alias("parent"),
        (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"),
        "item",
    )


def rows_on_cycles(edges: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Rows whose parent links lead back to themselves: (capture_id, row_order), each once.

    Pointer doubling: jump(x) is the ancestor 2^k links up. Rows whose jump ends at a top row are finished and leave;
    jumps into a finished row are finished too, so after about log2(depth) rounds only rows on or below a circle stay.
    The set of jump targets then shrinks to exactly the circles: a round that leaves it unchanged ends the search
    (a map onto the same finite set is a permutation, and a permutation has no tails).
    The state is a table in the shared folder; joins use both key columns, so one capture that holds a third of all rows
    is spread like any other.
    """
    spark = edges.sparkSession
    ws = workspace or Workspace(spark, "cycles")
    links = edges.where("capture_id IS NOT NULL AND row_order IS NOT NULL").groupBy("capture_id", F.col("row_order").cast("long").alias("row_order")).agg(
        F.min(F.struct(F.col("parent_row_order").cast("long").alias("p"), F.col("normalized_item"))).alias("m")
    )
    state = ws.save(links.select("capture_id", "row_order", F.col("m.p").alias("jump")).where("jump IS NOT NULL"))
    alive, targets = state.count(), -1
    while alive:
        right = state.select("capture_id", F.col("row_order").alias("jump"), F.col("jump").alias("next"))
        # inner join: a row whose jump target is finished (or unknown) is finished as well
        new = ws.save(state.join(right, ["capture_id", "jump"]).select("capture_id", "row_order", F.col("next").alias("jump")))
        ws.drop(state)
        count = new.count()
        state = new
        if count == alive:
            image = state.select("capture_id", F.col("jump").alias("row_order")).distinct()
            size = image.count()
            if size == targets:
                return image.select("capture_id", "row_order")
            targets = size
        alive = count
    return state.select("capture_id", "row_order")


def resolve_paths(edges: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Path, depth, top row and ancestors of every row; status CYCLE where the links never reach a top row.

    Output: capture_id, row_order, parent (null for top rows and where the parent was never captured), depth (0 for top
    rows), root (row_order of the top row), full_path (items from the top row down), ancestors (row_orders from the top
    row to the parent), status in TOP, CHILD, ORPHAN_TOP (parent never captured), CYCLE (depth, root, path null).
    Rounds are logarithmic in the depth: each joins a row's open jump target with that target's own jump and
    concatenates their segments. A round that finishes no row leaves only circles and what hangs below them.
    """
    spark = edges.sparkSession
    ws = workspace or Workspace(spark, "paths")
    base = ws.save(clean_edges(edges))
    # segments: row_orders/items strictly above the row, nearest last, down from (excluding) the jump target
    start = base.select(
        "capture_id", "row_order", F.col("parent").alias("jump"),
        F.array().cast("array<long>").alias("ups"), F.array().cast("array<string>").alias("names"),
        "item",
    )
    state = ws.save(start)
    open_rows = state.where("jump IS NOT NULL").count()
    while open_rows:
        right = state.select(
            "capture_id", F.col("row_order").alias("jump"), F.col("jump").alias("next"),
            F.col("ups").alias("r_ups"), F.col("names").alias("r_names"), F.col("item").alias("r_item"),
        )
        moved = state.where("jump IS NOT NULL").join(right, ["capture_id", "jump"]).select(
            "capture_id", "row_order", F.col("next").alias("jump"),
            F.concat("r_ups", F.array("jump"), "ups").alias("ups"),
            F.concat("r_names", F.array("r_item"), "names").alias("names"),
            "item",
        )
        new = ws.save(state.where("jump IS NULL").unionByName(moved))
        ws.drop(state)
        state = new
        left = state.where("jump IS NOT NULL").count()
        if left == open_rows:
            break
        open_rows = left
    done = state.withColumn("ok", F.col("jump").isNull())
    info = base.select("capture_id", "row_order", "parent", "orphan")
    return done.join(info, ["capture_id", "row_order"]).select(
        "capture_id",
        "row_order",
        "parent",
        F.when(F.col("ok"), F.size("ups")).alias("depth"),
        F.when(F.col("ok"), F.coalesce(F.try_element_at("ups", F.lit(1)), F.col("row_order"))).alias("root"),
        F.when(F.col("ok"), F.array_join(F.concat("names", F.array("item")), SEPARATOR)).alias("full_path"),
        F.when(F.col("ok"), F.col("ups")).alias("ancestors"),
        F.when(~F.col("ok"), "CYCLE").when(F.col("orphan"), "ORPHAN_TOP").when(F.size("ups") == 0, "TOP").otherwise("CHILD").alias("status"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """Closure of resolve_paths: one row per (row, row below it) with the distance; a row without rows below has none."""
    return paths.where("status <> 'CYCLE'").select(
        "capture_id", F.posexplode("ancestors").alias("pos", "ancestor"), F.col("row_order").alias("descendant"), "depth"
    ).select("capture_id", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(paths: DataFrame) -> DataFrame:
    """resolve_paths plus n_below, the number of rows below each row (null on circles)."""
    below = descendants(paths).groupBy("capture_id", F.col("ancestor").alias("row_order")).agg(F.count("*").alias("n_below"))
    return paths.join(below, ["capture_id", "row_order"], "left").withColumn("n_below", F.when(F.col("status") != "CYCLE", F.coalesce("n_below", F.lit(0))))
