"""At-least-once delivery: exactly one copy per message identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE_COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def _preference(counters: Sequence[str], received: str, unique: str) -> Column:
    """Ordering struct, smallest first: counted copies, greatest sum, earliest arrival, smallest id; nulls come last."""
    wide = [F.col(c).cast("decimal(25,0)") for c in counters]
    total = sum((F.coalesce(c, F.lit(0).cast("decimal(25,0)")) for c in wide[1:]), F.coalesce(wide[0], F.lit(0).cast("decimal(25,0)")))
    uncounted = F.coalesce(*wide).isNull()
    return F.struct(
        uncounted.alias("uncounted"),
        F.when(~uncounted, -total).cast("decimal(30,0)").alias("less"),
        F.col(received).isNull().alias("unreceived"),
        F.col(received).alias("received"),
        F.col(unique).isNull().alias("unnamed"),
        F.col(unique).alias("unique"),
    )


def kept_copies(
    rows: DataFrame,
    *,
    key: str = "message_id",
    counters: Sequence[str] = USAGE_COUNTERS,
    received: str = "received_at",
    unique: str = "delivery_id",
    payload: Sequence[Column] = (),
) -> DataFrame:
    """One row per ``key``: the key, ``kept`` (the surviving copy's ``unique`` id) and the payload columns of that copy.

    The survivor has the greatest counter sum; a missing counter adds nothing, and a copy with every counter missing
    ranks below all others.  Ties go to the earliest arrival, then the smallest id; a missing arrival or id ranks last.
    Keys are compared exactly; rows without a key are not messages and do not come out.

    ``min_by`` over the ordering struct is combined in each map task before the shuffle, so a key that holds a third
    of all rows sends one row per task.
    """
    what = F.struct(F.col(unique).alias("kept"), *payload)
    best = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.min_by(what, _preference(counters, received, unique)).alias("__best")
    )
    return best.select(F.col("__key").alias(key), "__best.*")


def surplus_copies(
    rows: DataFrame,
    *,
    key: str = "message_id",
    counters: Sequence[str] = USAGE_COUNTERS,
    received: str = "received_at",
    unique: str = "delivery_id",
) -> DataFrame:
    """The ``unique`` ids of the copies that must go: every keyed row but its key's survivor.

    Rows without a key are kept (they cannot be copies); a keyed row without a ``unique`` id cannot be named and does
    not come out.  An empty table gives an empty result.
    """
    narrow = rows.select(*dict.fromkeys([key, unique, received, *counters]))
    kept = kept_copies(narrow, key=key, counters=counters, received=received, unique=unique)
    keyed = narrow.where(F.col(key).isNotNull() & F.col(unique).isNotNull()).select(unique)
    return keyed.join(kept.select(F.col("kept").alias(unique)), unique, "left_anti")


def single_copies(rows: DataFrame, **names) -> DataFrame:
    """All of ``rows`` without the surplus copies, every column kept; rows without a key stay."""
    unique = names.get("unique", "delivery_id")
    return rows.join(surplus_copies(rows, **names), unique, "left_anti")
