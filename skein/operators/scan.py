"""Ordered work over keys of any size: windows for ordinary keys, parts of a range partitioning for hot ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Table

HOT_ROWS = 2_000_000  # rows of a key from which it is cut into parts
PART, ROW = "__part", "__row"


def by_size(rows: DataFrame, key: Sequence[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``small`` over the rows of ordinary keys and ``large`` over those of keys with more than ``hot_rows`` rows.

    Counting keys is combined before its shuffle; both ways give the same result, so the limit only decides how.
    """
    hot = Table(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*[F.col(k).alias(f"__{k}") for k in key]), counted=True)
    if not hot.rows:
        hot.drop()
        return small(rows)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return small(rows.join(hot.df, same, "left_anti")).unionByName(large(rows.join(hot.df, same, "left_semi")))


def parted(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``PART`` and ``ROW``: a range partitioning by key and order, written once so that it stays the same.

    A key's parts follow each other in the order, and ``ROW`` grows along it; there are as many parts as shuffle
    partitions at most.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    return Table(ranged.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id()})).df


def carried(rows: DataFrame, key: Sequence[str], values: dict[str, Column], *, fold: Callable[[Column], Column], pick: Callable[[Column], Column]) -> DataFrame:
    """Parted ``rows`` with, for each name, what all earlier parts of the key give by ``fold`` (null for the first).

    ``pick`` makes one value of a part's rows, ``fold`` one of the parts before; both are aggregates that skip nulls.
    """
    summary = rows.groupBy(*key, PART).agg(*[pick(c).alias(name) for name, c in values.items()])
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(PART).alias("__p"), *[fold(F.col(name)).over(before).alias(name) for name in values])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], F.col(PART) == F.col("__p"))
    return rows.join(summary, same).drop("__p", *[f"__{k}" for k in key])
