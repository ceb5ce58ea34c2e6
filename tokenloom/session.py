"""Session defaults and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# One encoder batch (and one Arrow batch) holds this many documents.
ARROW_BATCH_ROWS = 1024

_local_roots: dict[str, str] = {}


def build_session(app_name: str = "tokenloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which every
    executor can reach. A temporary folder stands in only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tokenloom-")
    return _local_roots[app]


# Whether Spark drops the shuffle files of a query when it ends.
_DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the staging folder and return the stored table.

    The written table cuts the lineage, survives lost executors and keeps
    column statistics, so later filters on a sorted column skip row groups.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/tokenloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what a stage shuffled leaves the disk once the stage is written: nothing reads it again.

    Otherwise it stays until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_DROPS_SHUFFLES)
    spark.conf.set(_DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPS_SHUFFLES, before)


class Rounds:
    """A stored table that grows by rounds and is read as one scan, however many there were."""

    def __init__(self, label: str):
        self.label, self.number, self.path, self.schema, self.spark = label, 0, None, None, None

    def add(self, df: DataFrame) -> DataFrame:
        """Store ``df`` as the next round; returns its rows."""
        if self.path is None:
            self.spark, self.schema = df.sparkSession, df.schema
            self.path = f"{stage_root(self.spark)}/tokenloom/{self.label}-{uuid.uuid4().hex}"
        path = f"{self.path}/{self.number}"
        df.write.parquet(path)
        self.number += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self, first: int = 0) -> DataFrame:
        """The rows of all rounds from ``first`` on."""
        paths = [f"{self.path}/{n}" for n in range(first, self.number)]
        return self.spark.read.schema(self.schema).parquet(*paths)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input of few splits, such as one large row group.

    Inputs with enough splits, which is every large table, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
