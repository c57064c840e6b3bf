"""Session defaults and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_local_dir: str | None = None


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: UTC, AQE and Arrow."""
    builder = SparkSession.builder.master(master).appName("skein")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks run here."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="skein-")
    return f"file://{_local_dir}"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Table:
    """A frame written once to the shared folder; ``df`` reads it back without the plan that made it.

    ``rows`` tells how many rows a ``counted`` one has, without a job of its own.
    """

    def __init__(self, df: DataFrame, partition_by: tuple[str, ...] = (), *, counted: bool = False) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark)
        seen = Observation()
        if counted:
            df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.schema = self.spark.read.parquet(self.path).schema if partition_by else df.schema
        self.rows = seen.get["n"] if counted else None

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Frees the space; only for tables that no returned frame reads."""
        _delete(self.spark, self.path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to the application
            return


def ship_code() -> None:
    """Sends this package's functions to Python workers by value, so that executors need not have it installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


ship_code()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions a scan that has fewer splits than cores, before CPU-bound Python work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2, *keys)
