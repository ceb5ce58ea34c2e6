"""Exact length histogram of encoded documents, and what follows from it.

Documents are encoded in their tasks and only their lengths leave; equal lengths
are counted map-side. From the histogram, sums over its tail answer every context
limit: documents and tokens kept whole, tokens after truncation at the limit,
quantiles. All later steps work on the histogram, whose size is the number of
different lengths.

Cases: a null or empty text has length 0 and is counted; repeated rows count
each; null ids and other columns do not matter; an empty table gives an empty
histogram, no quantile and truncated totals without rows.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_or_empty
from tokenloom.session import stage

RANKS = "byte_bpe_50k.tiktoken"
# Lengths in one block of the two-level tail sums.
BLOCK = 4096


@lru_cache(2)
def _encoding(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(text: str | None, ranks: str = RANKS) -> int:
    return len(_encoding(ranks).encode_ordinary(text)) if text else 0


def encoded_lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(n_tokens)``, one row for each document."""

    def run(batches):
        for batch in batches:
            lengths = [count_tokens(batch.column(0)[i].as_py(), ranks) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(n_tokens, n_docs)`` for every length that occurs."""
    return encoded_lengths(docs, ranks).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    ``n_docs`` of this length, ``docs_over`` and ``tokens_over`` of longer documents,
    ``docs_within`` and ``tokens_within`` of the others, and ``truncated_tokens``, the
    total when every document is cut to L tokens. Sums run inside blocks of
    lengths, and block totals are added, so no window holds the whole table.
    """
    blocks = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    return summed.join(totals, "block").select(
        "n_tokens", "n_docs",
        (F.col("d_in") + F.col("d_after")).alias("docs_over"), (F.col("t_in") + F.col("t_after")).alias("tokens_over"),
        (F.col("all_docs") - F.col("d_in") - F.col("d_after")).alias("docs_within"),
        (F.col("all_tokens") - F.col("t_in") - F.col("t_after")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("t_in") - F.col("t_after") + F.col("n_tokens") * (F.col("d_in") + F.col("d_after"))).alias("truncated_tokens"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``(context, tokens)`` for any limits, from the last length at or below each.

    A limit below the shortest document keeps ``limit`` tokens of every document.
    """
    asked = table.select(F.explode(F.array(*(F.lit(n).cast("long") for n in limits))).alias("context"), "*")
    found = asked.groupBy("context").agg(
        F.max(F.when(F.col("n_tokens") <= F.col("context"), F.struct("n_tokens", "tokens_within", "docs_over"))).alias("at"),
        F.sum("n_docs").alias("docs"),
    )
    known = F.col("at.tokens_within") + F.col("context") * F.col("at.docs_over")
    return found.select("context", F.coalesce(known, F.col("context") * F.col("docs")).alias("tokens"))


def length_quantiles(table: DataFrame, quantiles: list[float]) -> DataFrame:
    """``(quantile, n_tokens)``: the least length that at least this share of documents does not exceed."""
    asked = table.select(F.explode(F.array(*map(F.lit, quantiles))).alias("quantile"), "*")
    reached = F.col("docs_within") >= F.col("quantile") * (F.col("docs_within") + F.col("docs_over"))
    return asked.where(reached).groupBy("quantile").agg(F.min("n_tokens").alias("n_tokens"))


def context_lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The context table of all documents."""
    return context_table(stage(length_histogram(docs, ranks), "lengths"))
