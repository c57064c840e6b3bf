"""Intervals: unions, start and end pairs, clipping to a day, attribution by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table
from . import scan


def merged_intervals(rows: DataFrame, *, key: Sequence[str], start: str, end: str, hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """(key, start, end): the union of each key's intervals; touching ones merge, reversed or open ones are left out."""
    valid = rows.where((F.col(start) <= F.col(end))).select(*key, start, end)
    fresh = lambda before: F.coalesce((F.col(start) > before).cast("int"), F.lit(1))

    def small(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(start, end)
        opened = df.withColumn("__new", fresh(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))))
        return opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def large(df: DataFrame) -> DataFrame:
        parts = scan.carried(scan.parted(df, key, [start, end]), key, {"__reach": F.col(end)}, pick=F.max, fold=F.max)
        w = Window.partitionBy(*key, scan.PART).orderBy(scan.ROW)
        inside = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        opened = parts.withColumn("__new", fresh(F.greatest(inside, F.col("__reach"))))
        opened = scan.carried(opened, key, {"__opened": F.col("__new")}, pick=F.sum, fold=F.sum)
        island = F.coalesce("__opened", F.lit(0)) + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return opened.withColumn("__island", island).drop("__new", "__reach", "__opened", scan.PART, scan.ROW)

    islands = scan.by_size(valid, key, small, large, hot_rows)
    return islands.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def union_length(rows: DataFrame, *, key: Sequence[str], start: str, end: str, hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """(key, length): measure of the union; a key with only a point has 0, a key without a valid interval no row."""
    return merged_intervals(rows, key=key, start=start, end=end, hot_rows=hot_rows).groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def paired_runs(events: DataFrame, *, key: Sequence[str], kind: str, at: str, now: Column) -> DataFrame:
    """(key, start, end, valid): a run counts if it has one distinct start and one distinct end, no abort, and
    start <= end <= now.  Repeated identical events collapse in the counting."""
    distinct = lambda k: F.count_distinct(F.when(F.col(kind) == k, F.col(at)))
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    runs = events.groupBy(*key).agg(
        distinct("start").alias("starts"), distinct("end").alias("ends"), F.count_if(F.col(kind) == "abort").alias("aborts"),
        first("start").alias("start"), first("end").alias("end"),
    )
    valid = (F.col("starts") == 1) & (F.col("ends") == 1) & (F.col("aborts") == 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= now)
    return runs.select(*key, "start", "end", F.coalesce(valid, F.lit(False)).alias("valid"))


def day_summary(runs: DataFrame, *, day_start: Column, day_end: Column) -> DataFrame:
    """(length, missing, state): time of the valid runs inside a day, counted once where they overlap.

    ``length`` is null, not 0, where no valid run touches the day; unpaired runs make the state partial.
    """
    inside = runs.where(F.col("valid") & (F.col("end") >= day_start) & (F.col("start") < day_end)).select(
        F.lit(1).alias("k"), F.greatest("start", day_start).alias("start"), F.least("end", day_end).alias("end")
    )
    length = union_length(inside, key=["k"], start="start", end="end").agg(F.sum("length").alias("length"))
    missing = runs.agg(F.count_if(~F.col("valid"))).scalar()
    state = F.when(F.col("missing") > 0, "partial").when(F.col("length").isNotNull(), "ready").otherwise("no records")
    return length.withColumn("missing", missing).select("length", "missing", state.alias("state"))


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """Start and end of a local day in epoch seconds: 23 to 25 hours apart."""
    at = lambda d: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return at(day), at(F.date_add(day, 1))


def covered_points(points: DataFrame, spans: DataFrame, *, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """``points`` joined to each span of the same key that covers them, both ends included.

    Spans are cut into slots of ``width`` units of ``at``; the join is on key and slot, so a key with many points and
    spans spreads over its slots instead of meeting in one group.
    """
    slot = lambda x: F.floor(x / width)
    cut = spans.where(F.col(start) <= F.col(end)).withColumn("__slot", F.explode(F.sequence(slot(F.col(start)), slot(F.col(end)))))
    return points.withColumn("__slot", slot(F.col(at))).join(cut, [key, "__slot"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__slot")


def focus_intervals(packets: DataFrame, *, key: str, at: str, focused: str, active: str, idle: int = 300, lease: int = 45) -> DataFrame:
    """(key, start, end): time spent while focused, batch twin of the activity ledger.

    From each packet to the next, while the last focus or activity is under ``idle`` and the packet under ``lease``
    seconds old.  ``at`` is in whole seconds.
    """
    w = Window.partitionBy(key).orderBy(at)
    seen = packets.withColumns({
        "next": F.lead(at).over(w),
        "touched": F.last(F.when(F.col(active), F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "held": F.last(focused, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    end = F.least(F.coalesce("next", F.col(at) + lease), F.col(at) + lease, F.col("touched") + idle)
    return seen.where("held and touched is not null").select(key, F.col(at).alias("start"), end.alias("end")).where("end > start")


def measured_time(events: DataFrame, *, most_ranges: int = 512, hot_rows: int = scan.HOT_ROWS) -> DataFrame:
    """(source, length, ranges, partial) from observed beginnings and ends: (source, id, kind, at, n), ``n`` their order.

    A beginning while the id is open is a replay and changes nothing, an end without one counts for nothing, and an end
    before its beginning makes the source partial.  ``interrupt`` (without source and id) discards everything that is
    open, and makes the sources partial that had something open; nothing is closed at an assumed end.  ``length`` is null,
    not 0, without a completed interval, and an interval of no length is a completed one.  Intervals of a source count
    once where they overlap; beyond ``most_ranges`` separate ones the source is partial.
    """
    w = Window.partitionBy("source", "id", "epoch").orderBy("n")
    seen = _epochs(events).withColumn("before", F.lag("kind").over(w))
    real = seen.where(F.coalesce("before", F.lit("end")) != F.col("kind"))
    paired = real.withColumns({"began": F.lag("at").over(w), "next": F.lead("kind").over(w)}).where("kind = 'end' or next is null")
    paired = Table(paired.select("source", "kind", "began", "at", "epoch")).df  # read four times below
    runs = paired.where("kind = 'end'").select("source", F.col("began").alias("start"), F.col("at").alias("end"))
    backwards = runs.where("end < start").select("source")
    last = events.where("kind = 'interrupt'").agg(F.count(F.lit(1)).alias("last"))  # one row
    cut = paired.where("kind = 'begin'").join(last, F.col("epoch") < F.col("last")).select("source")
    refused = events.where("kind = 'begin' and source is not null and (id is null or id = '' or octet_length(id) > 128)").select("source")
    done = merged_intervals(runs, key=["source"], start="start", end="end", hot_rows=hot_rows).where("end is not null")
    lengths = done.groupBy("source").agg(F.sum(F.col("end") - F.col("start")).alias("length"), F.count_if(F.col("end") > F.col("start")).alias("ranges"))
    broken = backwards.unionByName(cut).unionByName(refused).distinct().withColumn("broken", F.lit(True))
    sources = events.where("source is not null").select("source").distinct()
    rows = sources.join(lengths, "source", "left").join(broken, "source", "left")
    return rows.select("source", "length", F.coalesce("ranges", F.lit(0)).alias("ranges"), (F.coalesce("broken", F.lit(False)) | (F.coalesce("ranges", F.lit(0)) > most_ranges)).alias("partial"))


def _epochs(events: DataFrame) -> DataFrame:
    """The beginnings and ends that have a source and an id, with ``epoch``: how many interrupts have a smaller ``n``.

    Both are put in order once, by a range partitioning; each part counts its own interrupts and adds those of the parts
    before, so their number doesn't matter.
    """
    stop = F.col("kind") == "interrupt"
    keyed = F.col("kind").isin("begin", "end") & F.col("source").isNotNull() & F.col("id").isNotNull() & (F.col("id") != "") & (F.octet_length("id") <= 128)
    rows = events.where(stop | keyed).select("source", "id", "kind", "at", "n", F.coalesce(stop & F.col("n").isNotNull(), F.lit(False)).cast("int").alias("__stop"))
    parts = scan.parted(rows, [], ["n", "__stop"])  # a stop comes after the rows of its own n
    earlier = parts.groupBy(scan.PART).agg(F.sum("__stop").alias("__stops"))  # no more rows than shuffle partitions
    before = Window.orderBy(scan.PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = earlier.select(scan.PART, F.coalesce(F.sum("__stops").over(before), F.lit(0)).alias("__earlier"))
    inside = Window.partitionBy(scan.PART).orderBy(scan.ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = parts.withColumn("__inside", F.sum("__stop").over(inside)).where(~stop)
    return counted.join(F.broadcast(earlier), scan.PART).withColumn("epoch", F.col("__earlier") + F.col("__inside")).select("source", "id", "kind", "at", "n", "epoch")
