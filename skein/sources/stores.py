"""Writes: upserts and appends of versioned tables, snapshots with checks before they go out."""

from __future__ import annotations

from collections.abc import Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import redacted


def upserted(existing: DataFrame, changes: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of ``changes`` put in place of those with the same key (null keys are alike)."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__new")))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def pruned(existing: DataFrame, live: DataFrame, *, key: str) -> DataFrame:
    """Rows whose key is still live."""
    return existing.join(live.select(key), key, "left_semi")


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Writes a new immutable version beside the older ones; a failed write leaves them as they were."""
    path = f"{root.rstrip('/')}/v={version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, *, before: int | None = None) -> DataFrame | None:
    """The newest version whose write has ended (of those under ``before``), or None."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    for name in sorted((status.getPath().getName() for status in files.listStatus(folder)), reverse=True):
        done = name.startswith("v=") and files.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{name}/_SUCCESS"))
        if done and (before is None or int(name[2:]) < before):
            return spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return None


def append_usage(events: DataFrame, root: str) -> None:
    """Appends request events, with sensitive names in the request text redacted first."""
    events.withColumn("query", redacted(F.col("query"))).write.mode("append").parquet(root)


class SnapshotError(ValueError):
    """A snapshot that must not be written."""


MOST_SNAPSHOT_BYTES, MOST_ACTIVITY_BYTES = 256 * 1024, 16 * 1024  # fixed values


def sound_snapshot(rows: DataFrame, *, most_days: int = 7, most_ranks: int = 3) -> DataFrame:
    """One row (sound): whether (kind, name, tokens) rows are at most seven days and three ranks of any other kind, none negative."""
    kinds = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"))
    fits = F.col("n") <= F.when(F.col("kind") == "day", most_days).otherwise(most_ranks)
    return kinds.agg(F.coalesce(F.bool_and(fits & F.coalesce(F.col("least") >= 0, F.lit(True)) & F.col("kind").isNotNull()), F.lit(True)).alias("sound"))


def write_snapshot(daily: DataFrame, ranks: DataFrame, path: str, *, sample: bool = False, production: bool = True, most_days: int = 7, most_ranks: int = 3) -> None:
    """Writes the small display snapshot as JSON: at most seven days and three ranks a kind, nothing negative, 256 KiB.

    Sample data is not written where users would take it for their own (``production``).
    """
    if sample and production:
        raise SnapshotError("sample data in a snapshot for use")
    rows = daily.select(F.lit("day").alias("kind"), F.col("day").cast("string").alias("name"), "tokens").unionByName(ranks.select("kind", "name", "tokens"))
    if not sound_snapshot(rows, most_days=most_days, most_ranks=most_ranks).first()[0]:
        raise SnapshotError("too many rows for a snapshot, or negative totals")
    if (rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0] or 0) > MOST_SNAPSHOT_BYTES:
        raise SnapshotError("too many bytes for a snapshot")
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, **bounds: int) -> DataFrame:
    """(kind, name, tokens) of a snapshot, which must be as ``write_snapshot`` would write it."""
    rows = spark.read.schema("kind string, name string, tokens long").option("mode", "FAILFAST").json(path)
    if not sound_snapshot(rows, **bounds).first()[0]:
        raise SnapshotError("not a sound snapshot")
    return rows


# The keys an activity document may have, and the greatest time of a day.
ACTIVITY_KEYS = ("version", "day", "timeZoneID", "estimatedNanoseconds", "phase", "partial", "idleSeconds", "generatedAt")
ACTIVITY = "version int, day string, timeZoneID string, estimatedNanoseconds bigint, phase string, partial boolean, idleSeconds int, generatedAt double"
MOST_NANOSECONDS = 93_600_000_000_000


def sound_activity(document: Column) -> Column:
    """Whether a JSON text is an activity document: known keys only, at most 16 KiB, every value in its range."""
    d = F.from_json(document, ACTIVITY)
    known = F.size(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, ACTIVITY_KEYS)))) == 0
    nanoseconds = d["estimatedNanoseconds"]
    ranges = (
        (d["version"] == 1) & (d["idleSeconds"] == 300) & (F.octet_length(d["day"]) == 10) & d["timeZoneID"].isin(*available_timezones())
        & (nanoseconds.isNull() | nanoseconds.between(0, MOST_NANOSECONDS)) & d["phase"].isNotNull() & d["partial"].isNotNull() & d["generatedAt"].isNotNull()
    )
    return F.coalesce(known & (F.octet_length(document) <= MOST_ACTIVITY_BYTES) & ranges, F.lit(False))


def write_activity(batch: DataFrame, root: str, number: int) -> None:
    """Activity documents (key, document) of a micro-batch, upserted into a new version (a ``foreachBatch`` writer).

    Documents that aren't sound are left out.  A batch that is tried again writes the same version again; a crash leaves
    the one before.
    """
    sound = batch.where(F.col("key").isNotNull() & sound_activity(F.col("document"))).select("key", "document")
    newest = sound.groupBy("key").agg(F.max_by("document", F.struct(F.from_json("document", ACTIVITY)["generatedAt"], "document")).alias("document"))
    before = read_version(batch.sparkSession, root, before=number)
    write_version(newest if before is None else upserted(before, newest, key=["key"]), root, number)


def read_activity(spark: SparkSession, root: str) -> DataFrame:
    """(key, fields of the document) of the newest version; a document that isn't sound any more is left out."""
    rows = read_version(spark, root)
    if rows is None:
        rows = spark.createDataFrame([], "key string, document string")
    return rows.where(sound_activity(F.col("document"))).select("key", F.from_json("document", ACTIVITY).alias("d")).select("key", "d.*")
