"""Cutting oversized items at natural boundaries, with an overlap, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table


def effective_lengths(files: DataFrame, slices: DataFrame) -> DataFrame:
    """(file_id, n): line_count where positive, else kept_lines of the file's latest slice with sliced=false.

    Latest means greatest sent_at, then greatest slice_id; a missing sent_at counts as oldest.  Files written twice
    count once; files without an id, and files with neither length, do not come out.
    """
    counted = files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(
        F.max(F.when(F.col("line_count") > 0, F.col("line_count").cast("long"))).alias("counted")
    )
    whole = slices.where(~F.col("sliced")).groupBy("file_id").agg(
        F.max_by(F.col("kept_lines").cast("long"), F.struct("sent_at", "slice_id")).alias("kept")
    )
    n = F.coalesce("counted", "kept")
    return counted.join(whole, "file_id", "left").select("file_id", n.alias("n")).where(n > 0)


def successor_table(lengths: DataFrame, boundaries: DataFrame, *, limit: int, overlap: int) -> DataFrame:
    """(item, cut, next, pieces, n): for each boundary, its farthest legal successor.

    A piece that follows a cut at ``cut`` starts at ``cut - overlap``.  ``next`` is the greatest boundary within reach
    of it, after as many forced pieces of full length as the gap to the nearest boundary needs; ``pieces`` counts them
    and the one that ends at ``next``.  ``next`` is null where the item ends first.  The first piece starts at 1, as if
    it followed a cut at ``overlap + 1``.

    Boundaries are gathered in blocks of ``limit - overlap`` positions (at most that many distinct values each).  The
    nearest boundary is in a cut's own block or the first of the next one that has any, and the farthest in reach is in the
    block where the reach ends or the last of the block of the nearest, so a cut meets one other block, by an equality
    join.  Only two numbers a block are put in order along an item.
    """
    step = limit - overlap
    root = overlap + 1
    marks = boundaries.where(F.col("pos") > root).select("item", F.col("pos").cast("long").alias("pos"))
    marks = marks.unionByName(lengths.select("item", F.lit(root).cast("long").alias("pos")))
    inside = marks.join(lengths, "item").where((F.col("pos") <= F.col("n")) | (F.col("pos") == root))
    blocks = inside.groupBy("item", F.floor(F.col("pos") / step).alias("block"), "n").agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    along = Window.partitionBy("item").orderBy("block")
    ends = blocks.select("item", "block", F.lead(F.col("cuts")[0]).over(along).alias("next_first"), F.lead(F.element_at("cuts", -1)).over(along).alias("next_last"))
    own = blocks.join(ends, ["item", "block"])
    nearest = lambda i: F.coalesce(F.get("cuts", i + 1), F.col("next_first"))
    last = lambda i: F.when(i + 1 < F.size("cuts"), F.element_at("cuts", -1)).otherwise(F.col("next_last"))
    cuts = own.select("item", "n", F.explode(F.transform("cuts", lambda s, i: F.struct(s.alias("cut"), nearest(i).alias("nearest"), last(i).alias("last")))).alias("c")).select("item", "n", "c.*")
    forced = F.floor((F.col("nearest") - F.col("cut") - 1) / step).cast("long")
    to_end = F.greatest(F.lit(0), F.ceil((F.col("n") - (limit - 1) - (F.col("cut") - overlap)) / step)).cast("long")
    cuts = cuts.withColumns({"forced": forced, "to_end": to_end}).withColumn("going", F.col("nearest").isNotNull() & (F.col("forced") < F.col("to_end")))
    reach = F.col("cut") + step * (F.col("forced") + 1)
    asked = cuts.withColumns({"reach": F.when(F.col("going"), reach), "block": F.when(F.col("going"), F.floor(reach / step)).otherwise(F.floor(F.col("cut") / step))})
    met = asked.join(blocks.select("item", "block", F.col("cuts").alias("there")), ["item", "block"], "left")
    farthest = F.coalesce(F.array_max(F.filter("there", lambda x: (x <= F.col("reach")) & (x > F.col("cut")))), F.col("last"))
    return met.select(
        "item", "cut", "n", F.when(F.col("going"), farthest).alias("next"), (F.when(F.col("going"), F.col("forced")).otherwise(F.col("to_end")) + 1).alias("pieces")
    )


def split_at_boundaries(lengths: DataFrame, boundaries: DataFrame, *, limit: int = 400, overlap: int = 20) -> DataFrame:
    """(item, piece_no, first, last): the pieces of every item longer than ``limit``.

    ``lengths`` has (item, n), one row per item; ``boundaries`` has (item, pos) in any order, repeated or out of range
    as they come.  Piece 1 starts at 1; the last piece ends at n; each other piece ends before the greatest boundary
    in reach, or after ``limit`` positions where there is none, and the next starts ``overlap`` before the cut.  Items
    at or under the limit, items of unknown length and boundaries of unknown position or item give no rows.

    Method: the successor of every boundary is found first; the table of successors is then squared until no pointer
    of that length is left, and the tables are applied to the first cut from the longest to the shortest, which
    reaches every greedy cut in as many joins as the logarithm of the number of pieces.  All joins are on (item, cut) or
    (item, block), so an item that holds a third of all boundaries spreads over all tasks.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    step = limit - overlap
    long_items = lengths.where((F.col("n") > limit) & F.col("item").isNotNull()).select("item", F.col("n").cast("long").alias("n"))
    edges = Table(successor_table(long_items, boundaries.where("item is not null"), limit=limit, overlap=overlap))

    jumps = [edges.df.where("next is not null").select("item", "cut", "next", "pieces")]
    while True:
        first, second = jumps[-1], jumps[-1].toDF("item", "mid", "far", "more")
        squared = Table(
            first.join(second, (first["item"] == second["item"]) & (first["next"] == second["mid"]))
            .select(first["item"], "cut", F.col("far").alias("next"), (F.col("pieces") + F.col("more")).alias("pieces")),
            counted=True,
        )
        if not squared.rows:
            squared.drop()
            break
        jumps.append(squared.df)

    reached = edges.df.where(F.col("cut") == overlap + 1).select("item", "cut", F.lit(1).cast("long").alias("rank"))
    for jump in reversed(jumps):
        both = reached.join(jump, ["item", "cut"], "left")
        here = F.struct(F.col("cut"), F.col("rank"))
        there = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("cut"), (F.col("rank") + F.col("pieces")).alias("rank")))
        reached = both.select("item", F.explode(F.array_compact(F.array(here, there))).alias("r")).select("item", "r.*")

    i = F.col("i")
    start = F.col("cut") - overlap + step * i
    last = F.when(i < F.col("pieces") - 1, start + limit - 1).otherwise(F.coalesce(F.col("next") - 1, F.col("n")))
    return (
        reached.join(edges.df, ["item", "cut"])
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .select("item", (F.col("rank") + i).alias("piece_no"), start.alias("first"), last.alias("last"))
    )


def file_pieces(files: DataFrame, slices: DataFrame, symbols: DataFrame, *, limit: int = 400, overlap: int = 20) -> DataFrame:
    """(file_id, piece_no, first_line, last_line): files over ``limit`` lines, cut at their declarations."""
    lengths = effective_lengths(files, slices).withColumnRenamed("file_id", "item")
    marks = symbols.select(F.col("file_id").alias("item"), F.col("line").alias("pos"))
    return split_at_boundaries(lengths, marks, limit=limit, overlap=overlap).toDF("file_id", "piece_no", "first_line", "last_line")
