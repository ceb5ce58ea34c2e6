"""Document tables: reading, shard files, manifests and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.schemas import DOCUMENT, SHARDED_DOCUMENT

# Shards whose task numbers may be broadcast (a short row each).
BROADCAST_SHARDS = 100_000


def read_corpus(
    spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, format: str = "parquet"
) -> DataFrame:
    return spark.read.schema(schema).format(format).load(path)


def shard_tasks(df: DataFrame, shards: Sequence[tuple[str, int]]) -> DataFrame:
    """``df`` with one task for each of the shards (split, number), whatever their names hash to."""
    table = df.sparkSession.createDataFrame(
        [(split, shard, place) for place, (split, shard) in enumerate(shards)], "split string, shard int, _task int"
    )
    placed = df.join(F.broadcast(table) if len(shards) <= BROADCAST_SHARDS else table, ["split", "shard"])
    return placed.repartitionById(max(1, len(shards)), "_task").drop("_task")


def write_shards(df: DataFrame, path: str, shards: Sequence[tuple[str, int]] | None = None) -> None:
    """One file per split and shard, in seeded order.

    The texts move once, to the task of their shard; ``shards`` names the shards, one task
    each (otherwise they are hashed into the session's number of tasks). Files appear under
    their final names when the job commits; an existing target is refused.
    """
    by_shard = df.repartition("split", "shard") if shards is None else shard_tasks(df, shards)
    (
        by_shard
        .sortWithinPartitions("split", "shard", "order_key")
        .write.mode("errorifexists")
        .partitionBy("split", "shard")
        .parquet(path)
    )


def read_split(spark: SparkSession, path: str, split: str = "train", limit: int | None = None) -> DataFrame:
    """Documents of one split; ``limit`` keeps the first ones in shard order."""
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
        raise TypeError("limit must be an int")
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    try:
        stored = spark.read.parquet(path).columns
    except AnalysisException as error:
        raise FileNotFoundError(f"no shards found in {path}") from error
    if "text" not in stored:
        raise ValueError(f"shards in {path} have no 'text' column; found {stored}")
    rows = spark.read.schema(SHARDED_DOCUMENT).parquet(path).where(F.col("split") == split)
    counts = sorted((r["shard"], r["count"]) for r in rows.groupBy("shard").count().collect())
    if not counts:
        raise FileNotFoundError(f"no shards of split {split!r} found in {path}")
    if limit is None:
        return rows
    left = limit
    for shard, count in counts:
        if left < count:
            last = rows.where(F.col("shard") == shard).select("order_key").orderBy("order_key").limit(left)
            key = last.agg(F.max("order_key")).first()[0] or ""
            return rows.where((F.col("shard") < shard) | ((F.col("shard") == shard) & (F.col("order_key") <= key)))
        left -= count
    return rows


def write_manifest(manifest: DataFrame, path: str, seed: int, corpus: DataFrame) -> None:
    """The manifest as one JSON record: totals, a map of splits, provenance."""
    entry = F.struct("target_tokens", "actual_tokens", "documents", "parquet_shards")
    total = F.max(F.when(F.col("split") == "total", entry)).alias("total")
    splits = F.map_from_entries(
        F.collect_list(F.when(F.col("split") != "total", F.struct("split", entry)))
    ).alias("splits")
    manifest.agg(total, splits).select(
        "total.target_tokens",
        F.col("splits")["validation"]["target_tokens"].alias("validation_target_tokens"),
        "total.actual_tokens",
        "total.documents",
        "total.parquet_shards",
        "splits",
        F.lit(seed).alias("seed"),
        F.current_timestamp().alias("created_at"),
        F.lit(corpus.schema.json()).alias("schema"),
    ).coalesce(1).write.mode("errorifexists").json(path)


MANIFEST_SPLIT = "struct<target_tokens:long,actual_tokens:long,documents:long,parquet_shards:long>"
MANIFEST_SCHEMA = (
    "target_tokens long, validation_target_tokens long, actual_tokens long, documents long, "
    f"parquet_shards long, splits map<string,{MANIFEST_SPLIT}>, seed long, created_at timestamp, schema string"
)


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests with their folder; ``readable`` is false for broken ones."""
    text = spark.read.text(pattern, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*/[^/]*$", 1).alias("folder"),
        F.from_json("value", MANIFEST_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("m"),
    )
    return text.select(
        "folder",
        (F.col("m").isNotNull() & F.col("m._broken").isNull()).alias("readable"),
        "m.parquet_shards",
        "m.actual_tokens",
        "m.documents",
        "m.splits",
        "m.seed",
    )


def write_table(df: DataFrame, path: str, format: str = "csv") -> None:
    """Result tables; columns keep the order of ``df``."""
    writer = df.write.mode("errorifexists")
    if format == "csv":
        writer.option("header", True).csv(path)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown result format {format!r}")
