"""Fixed-length packs cut from the token stream of each shard.

Documents move once, to lie in order in ranges of keys (:func:`bos_offsets`), and
are cut there in one pass. Only what crosses an edge of a range moves again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import packs as P
from tokenloom.functions.ordering import DEFAULT_SEED, seeded_key
from tokenloom.operators.tokens import bos_offsets
from tokenloom.session import stage

# Windows in one Arrow batch of the cutter, and shards whose limits may be broadcast (a short row each).
ROWS_PER_BATCH = 512
BROADCAST_SHARDS = 100_000


def _check_length(seq_len: int) -> None:
    if seq_len <= 0:
        raise ValueError("seq_len must be positive")


class _Stretch:
    """A run of consecutive tokens of one shard, cut into windows as it grows."""

    def __init__(self, split: str, shard: int, begin: int, seq_len: int):
        self.split, self.shard, self.begin, self.seq_len = split, shard, begin, seq_len
        # The first pack that holds the first token: it may be its look-ahead only.
        self.pack = max(-(-begin // seq_len) - 1, 0)
        self.at, self.held = begin, np.empty(0, np.int32)

    @property
    def end(self) -> int:
        return self.at + len(self.held)

    def _drop(self, before: int) -> None:
        if before > self.at:
            self.held, self.at = self.held[before - self.at :], before

    def add(self, ids: np.ndarray) -> list[tuple[int, int, bool, np.ndarray]]:
        """(first pack, first token, whether whole, rows of ids) of what is now finished."""
        self.held = np.concatenate([self.held, ids]) if len(self.held) else ids
        length, out = self.seq_len, []
        if self.pack * length < self.begin and (self.pack + 1) * length < self.end:
            out.append((self.pack, self.at, False, self.held[None, : (self.pack + 1) * length + 1 - self.at]))
            self.pack += 1
        if self.pack * length >= self.begin:
            self._drop(self.pack * length)
            count = max(0, (self.end - self.pack * length - 1) // length)
            for first in range(0, count, ROWS_PER_BATCH):
                rows = min(ROWS_PER_BATCH, count - first)
                windows = np.lib.stride_tricks.sliding_window_view(self.held[first * length : (first + rows) * length + 1], length + 1)[::length]
                out.append((self.pack + first, self.at + first * length, True, windows))
            self.pack += count
            self._drop(self.pack * length)
        return out

    def rest(self) -> list[tuple[int, int, bool, np.ndarray]]:
        """What is left at the end: a part of one pack."""
        low = max(self.begin, self.pack * self.seq_len)
        return [(self.pack, low, False, self.held[None, low - self.at :])] if low < self.end else []


def _cutter(seq_len: int, ids_type: pa.DataType):
    """Consecutive documents to windows and to parts of windows, in one pass over a partition in order."""
    names = ["split", "shard", "pack", "at", "whole", "ids"]

    def rows_of(stretch: _Stretch, pieces: list) -> Iterator[pa.RecordBatch]:
        for pack, at, whole, rows in pieces:
            count, width = rows.shape
            offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
            step = np.arange(count, dtype=np.int64)
            columns = [
                pa.array([stretch.split] * count, pa.string()), pa.array([stretch.shard] * count, pa.int32()), pa.array(pack + step),
                pa.array(at + step * seq_len), pa.array([whole] * count, pa.bool_()),
                pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel(), ids_type)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = None
        for batch in batches:
            splits, shards = batch.column("split").to_pylist(), batch.column("shard").to_pylist()
            starts, tokens = batch.column("start").to_numpy(), batch.column("tokens")
            offsets = tokens.offsets.to_numpy()
            ids, sizes = tokens.values.to_numpy(), np.diff(offsets)
            first = 0
            while first < len(splits):
                last = first + 1
                while last < len(splits) and splits[last] == splits[first] and shards[last] == shards[first] and starts[last] == starts[last - 1] + sizes[last - 1]:
                    last += 1
                follows = stretch and (stretch.split, stretch.shard, stretch.end) == (splits[first], shards[first], starts[first])
                if stretch and not follows:
                    yield from rows_of(stretch, stretch.rest())
                if not follows:
                    stretch = _Stretch(splits[first], shards[first], int(starts[first]), seq_len)
                yield from rows_of(stretch, stretch.add(ids[offsets[first] : offsets[last]]))
                first = last
        if stretch:
            yield from rows_of(stretch, stretch.rest())

    return run


def cut_packs(df: DataFrame, seq_len: int) -> DataFrame:
    """Windows of ``seq_len + 1`` tokens at stride ``seq_len``.

    ``df`` has split, shard, start and tokens. The last token of a window is
    the first of the next one; a tail too short for a window is dropped.
    Documents that follow each other in a partition, as in the output of
    :func:`bos_offsets`, are cut where they are. Only windows that cross a
    partition's edge, two for each stretch, are put together from parts.
    """
    _check_length(seq_len)
    ids = df.schema["tokens"].dataType
    schema = f"split string, shard int, pack long, at long, whole boolean, ids {ids.simpleString()}"
    element = pa.int64() if isinstance(ids.elementType, T.LongType) else pa.int32()
    held = df.where(F.size("tokens") > 0).select("split", F.col("shard").cast("int").alias("shard"), F.col("start").cast("long").alias("start"), "tokens")
    pieces = stage(held.sortWithinPartitions("split", "shard", "start").mapInArrow(_cutter(seq_len, element), schema), "windows")
    parts = (
        pieces.where("NOT whole")
        .groupBy("split", "shard", "pack")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
        .select("split", "shard", "pack", F.flatten("parts.ids").alias("window"))
        .where(F.size("window") == seq_len + 1)
    )
    return pieces.where("whole").select("split", "shard", "pack", F.col("ids").alias("window")).union(parts)


def cut_blocks(blocks: DataFrame, seq_len: int) -> DataFrame:
    """:func:`cut_packs` on blocks of the token-shard source, without a shuffle.

    A block starts at a multiple of ``seq_len`` and carries one token more
    than it covers, so every window lies inside one block.
    """
    _check_length(seq_len)
    count = F.floor((F.size("tokens") - 1) / seq_len).cast("int")
    inside = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    first_pack = F.floor(F.col("start") / seq_len)
    windows = F.transform(
        inside,
        lambda k: F.struct(
            (first_pack + k).cast("long").alias("pack"),
            F.slice("tokens", k * seq_len + 1, F.lit(seq_len + 1)).alias("window"),
        ),
    )
    return blocks.select("file", F.inline(windows))


def shift_labels(df: DataFrame, seq_len: int) -> DataFrame:
    """Inputs, and labels one token ahead of them."""
    return df.select(
        *[c for c in df.columns if c != "window"],
        F.slice("window", 1, seq_len).alias("input_ids"),
        F.slice("window", 2, seq_len).alias("labels"),
    )


def segment_ids(df: DataFrame, bos: P.Markers, eos: P.Markers = None) -> DataFrame:
    return df.withColumn("attention_mask", P.segment_ids(F.col("input_ids"), bos, eos))


def position_ids(df: DataFrame, bos: P.Markers, eos: P.Markers = None) -> DataFrame:
    return df.withColumn("position_ids", P.position_ids(F.col("input_ids"), bos, eos))


def mask_boundary_labels(df: DataFrame, bos: P.Markers, eos: P.Markers = None) -> DataFrame:
    masked = P.mask_boundary_labels(F.col("input_ids"), F.col("labels"), bos, eos)
    return df.withColumn("labels", masked)


def finish_packs(windows: DataFrame, seq_len: int, bos: P.Markers, eos: P.Markers = None) -> DataFrame:
    """Windows to packs: shifted and masked labels, segments, positions."""
    shifted = shift_labels(windows, seq_len)
    return mask_boundary_labels(position_ids(segment_ids(shifted, bos, eos), bos, eos), bos, eos)


def pack_documents(encoded: DataFrame, seq_len: int, bos: P.Markers, eos: P.Markers = None) -> DataFrame:
    """Encoded documents with split and shard, to packs."""
    return finish_packs(cut_packs(bos_offsets(encoded), seq_len), seq_len, bos, eos)


def order_shards(shards: DataFrame, shuffle: bool = False, seed: int = DEFAULT_SEED) -> DataFrame:
    """``shard_order`` from 0 within each split: by number, or shuffled."""
    name = F.concat_ws("-", "split", F.col("shard").cast("string"))
    key: Column = seeded_key(name, seed) if shuffle else F.col("shard")
    place = F.row_number().over(Window.partitionBy("split").orderBy(key, "shard")) - 1
    return shards.select("split", "shard").distinct().withColumn("shard_order", place)


def shard_packs(encoded: DataFrame, seq_len: int) -> DataFrame:
    """How many packs each shard gives, from token counts alone."""
    _check_length(seq_len)
    tokens = encoded.groupBy("split", "shard").agg(F.sum("n_tokens").alias("n"))
    return tokens.select("split", "shard", F.greatest(F.floor((F.col("n") - 1) / seq_len), F.lit(0)).alias("packs"))


def pack_numbers(packs: DataFrame, counts: DataFrame, shard_order: DataFrame | None = None) -> DataFrame:
    """``pack_number``: place of each pack in its split, shard after shard.

    ``counts`` (see shard_packs) has one row per shard; only these are
    ordered, packs keep their partitions.
    """
    if shard_order is None:
        ordered = counts.withColumn("shard_order", F.col("shard"))
    else:
        ordered = counts.join(shard_order, ["split", "shard"])
    earlier = Window.partitionBy("split").orderBy("shard_order").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.select("split", "shard", F.coalesce(F.sum("packs").over(earlier), F.lit(0)).alias("_before"))
    numbered = packs.join(offsets, ["split", "shard"])
    return numbered.withColumn("pack_number", F.col("_before") + F.col("pack")).drop("_before")


def cap_packs(packs: DataFrame, counts: DataFrame, max_samples: int, shard_order: DataFrame | None = None) -> DataFrame:
    """The first ``max_samples`` packs of each split."""
    if max_samples <= 0:
        raise ValueError("max_samples must be positive")
    return pack_numbers(packs, counts, shard_order).where(F.col("pack_number") < max_samples)


def first_packs(
    encoded: DataFrame, seq_len: int, max_samples: int, bos: P.Markers, eos: P.Markers = None, shard_order: DataFrame | None = None
) -> DataFrame:
    """:func:`cap_packs` on encoded documents: only what the cap keeps is cut.

    The cap becomes a number of packs per shard, and with the starts, which come from narrow
    columns, a last document per shard. Only documents up to it are read with their tokens.
    """
    if max_samples <= 0:
        raise ValueError("max_samples must be positive")
    shards = shard_packs(encoded, seq_len).withColumn("pack", F.lit(0))
    places = pack_numbers(shards.drop("packs"), shards, shard_order)
    limits = shards.drop("pack").join(places.drop("pack"), ["split", "shard"]).select(
        "split", "shard", F.col("pack_number").alias("_before"), F.least("packs", max_samples - F.col("pack_number")).alias("_limit")
    ).where("_limit > 0")
    limits = stage(limits, "limits")
    place = F.struct("order_key", "doc_id")
    starts = bos_offsets(encoded.select("doc_id", "order_key", "bucket", "split", "shard", "n_tokens"))
    inside = starts.join(limits, ["split", "shard"]).where(F.col("start") <= F.col("_limit") * seq_len)
    last = stage(inside.groupBy("split", "shard").agg(F.max(place).alias("_last")), "last")
    few = F.broadcast(last) if last.count() <= BROADCAST_SHARDS else last
    kept = encoded.join(few, ["split", "shard"]).where(place <= F.col("_last")).drop("_last")
    packs = finish_packs(cut_packs(bos_offsets(kept), seq_len), seq_len, bos, eos)
    numbered = packs.join(limits, ["split", "shard"]).where(F.col("pack") < F.col("_limit"))
    return numbered.withColumn("pack_number", F.col("_before") + F.col("pack")).drop("_before", "_limit")


def batch_packs(packs: DataFrame, counts: DataFrame, batch_size: int, shard_order: DataFrame | None = None) -> DataFrame:
    """Batches of consecutive packs; the last one of a split may be short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    fields = ["input_ids", "labels", "attention_mask", "position_ids"]
    numbered = pack_numbers(packs, counts, shard_order).select(
        "split",
        F.floor(F.col("pack_number") / batch_size).cast("long").alias("batch"),
        F.struct("pack_number", *fields).alias("row"),
    )
    rows = numbered.groupBy("split", "batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select(
        "split", "batch", *[F.col(f"rows.{f}").alias(f) for f in fields],
        F.col("rows.attention_mask").alias("packed_seq_ids"),
    )


def pack_stats(packs: DataFrame, encoded: DataFrame, seq_len: int) -> DataFrame:
    """Per shard: packs, segments, masked labels and dropped tail tokens.

    The tail is what no window covers, the last look-ahead token aside.
    """
    made = packs.groupBy("split", "shard").agg(
        F.count("*").alias("packs"),
        F.sum(F.array_max("attention_mask").cast("long")).alias("segments"),
        F.sum(F.size(F.filter("labels", lambda y: y == P.IGNORED_LABEL)).cast("long")).alias("masked_labels"),
    )
    tokens = encoded.groupBy("split", "shard").agg(F.sum("n_tokens").alias("tokens"))
    packs_made = F.coalesce("packs", F.lit(0)).cast("long")
    covered = F.when(packs_made > 0, packs_made * seq_len + 1).otherwise(0)
    return tokens.join(made, ["split", "shard"], "left").select(
        "split",
        "shard",
        "tokens",
        packs_made.alias("packs"),
        F.coalesce("segments", F.lit(0)).cast("long").alias("segments"),
        F.coalesce("masked_labels", F.lit(0)).cast("long").alias("masked_labels"),
        (F.col("tokens") - covered).alias("tail_tokens"),
    )
