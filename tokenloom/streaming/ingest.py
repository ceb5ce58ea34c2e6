"""Build a corpus from documents as they arrive."""

from __future__ import annotations

from collections.abc import Mapping
from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.ordering import DEFAULT_SEED
from tokenloom.operators.corpus import Carry, find_ranges, sharded_documents, store_order
from tokenloom.sources.corpus_files import shard_tasks

# Seconds between two looks at whether a build is finished.
POLL_SECONDS = 0.2
STATE_SCHEMA = "split int, split_tokens long, shard int, shard_tokens long, batch long"


def last_state(spark: SparkSession, path: str, up_to: int | None = None) -> Row | None:
    """The state after the latest finished batch, or after batch ``up_to``."""
    try:
        states = spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException:
        return None
    if up_to is not None:
        states = states.where(F.col("batch") <= up_to)
    rows = states.orderBy(F.desc("batch")).limit(1).collect()
    return rows[0] if rows else None


def _carry(state: Row | None) -> Carry:
    return Carry(*state[:4]) if state else Carry()


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    state_path: str,
    budgets: Mapping[str, int],
    tokens_per_shard: int,
    seed: int = DEFAULT_SEED,
) -> bool:
    """Place one micro-batch after the documents of the earlier ones; whether all budgets are met by now.

    Data and state of a batch go to folders of their own. A repeated batch
    finds its state and does nothing; one that failed half-way is written
    again in place. Once all budgets are met nothing is written any more.
    """
    spark = batch.sparkSession
    state = last_state(spark, state_path, batch_id)
    carry = _carry(state)
    if carry.split >= len(budgets) or (state is not None and state["batch"] == batch_id):
        return carry.split >= len(budgets)
    plan = find_ranges(store_order(batch, seed), budgets, tokens_per_shard, carry)
    rows = shard_tasks(sharded_documents(batch, plan, seed), plan.shards)
    rows.write.mode("overwrite").partitionBy("split", "shard").parquet(f"{path}/batch={batch_id}")
    carry = plan.carry
    after = [(carry.split, carry.split_tokens, carry.shard, carry.shard_tokens)]
    spark.createDataFrame(after, STATE_SCHEMA.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(
        f"{state_path}/batch={batch_id}"
    )
    return carry.split >= len(budgets)


def stream_ingest(
    documents: DataFrame,
    path: str,
    state_path: str,
    checkpoint: str,
    budgets: Mapping[str, int],
    tokens_per_shard: int,
    seed: int = DEFAULT_SEED,
) -> StreamingQuery:
    """Start the build over all documents available now."""
    return _start(documents, path, state_path, checkpoint, budgets, tokens_per_shard, seed, Event())


def _start(documents, path, state_path, checkpoint, budgets, tokens_per_shard, seed, met: Event) -> StreamingQuery:
    def place(batch: DataFrame, batch_id: int) -> None:
        if met.is_set():
            return
        if ingest_batch(batch, batch_id, path, state_path, budgets, tokens_per_shard, seed):
            met.set()

    writer = documents.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def ingest_until_met(
    documents: DataFrame,
    path: str,
    state_path: str,
    checkpoint: str,
    budgets: Mapping[str, int],
    tokens_per_shard: int,
    seed: int = DEFAULT_SEED,
) -> bool:
    """Build from the documents available now and stop the stream as soon as all budgets are met.

    Documents that are not needed any more are not read; gives whether the budgets are met.
    """
    met = Event()
    query = _start(documents, path, state_path, checkpoint, budgets, tokens_per_shard, seed, met)
    while not query.awaitTermination(POLL_SECONDS):
        if met.is_set():
            query.stop()
            break
    return met.is_set() or not open_budgets(documents.sparkSession, state_path, budgets)


def ingested_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remaining_work(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a finished counterpart: nothing is done twice."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def open_budgets(spark: SparkSession, state_path: str, budgets: Mapping[str, int]) -> dict[str, int]:
    """Tokens each split still wants, from the last finished batch."""
    carry = _carry(last_state(spark, state_path))
    left = {}
    for number, (name, wanted) in enumerate(budgets.items()):
        if number >= carry.split:
            left[name] = wanted - (carry.split_tokens if number == carry.split else 0)
    return left
