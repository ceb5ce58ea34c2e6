"""Token streams: vocabularies, encoding, offsets and shard headers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tokenloom.functions.packs import IGNORED_LABEL
from tokenloom.functions.text import words
from tokenloom.operators.prefix import running_total
from tokenloom.session import stage

# Fixed values of the binary shard format.
SHARD_MAGIC = 278895051
SHARD_VERSION = 1
MAX_SHARD_TOKENS = 2**31 - 1

# Ids kept free in front of the vocabulary.
BOS_ID, EOS_ID, UNKNOWN_ID = 0, 1, 2
FIRST_TERM_ID = 3

# A vocabulary travels to the executors only when it is known to be this small.
BROADCAST_TERMS = 1_000_000
BROADCAST_TERM_BYTES = 64 * 1024 * 1024
# Bytes of text that a worker encodes at once: what it needs beside a batch and its ids does not grow with the batch.
SLICE_BYTES = 1 << 20
# Bytes of text whose distinct words are looked up together.
PART_BYTES = 1 << 22
# Tokens of one range of keys, which one task orders.
CELL_TOKENS = 1 << 22


def build_vocab(df: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent words with their ids, ties by term."""
    counts = df.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("term")).limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term")))
    return top.select("term", "n", (rank - 1 + FIRST_TERM_ID).cast("int").alias("id"))


@dataclass(frozen=True)
class Encoder:
    """Text to ids, added as a column, plus the ids that mark boundaries.

    ``add_ids(df)`` returns ``df`` with ``ids array<int>`` made from ``text``, which may be gone.
    """

    name: str
    add_ids: Callable[[DataFrame], DataFrame]
    max_id: int
    bos_id: int | None = BOS_ID
    eos_id: int | None = EOS_ID
    pad_id: int | None = None


def column_encoder(name: str, encode: Callable[[Column], Column], max_id: int, **ids) -> Encoder:
    """An encoder from a column expression, such as an ``arrow_udf``."""
    return Encoder(name, lambda df: df.withColumn("ids", encode(F.col("text"))), max_id, **ids)


def _slices(texts: pa.Array) -> list[pa.Array]:
    """``texts`` in consecutive parts of about ``SLICE_BYTES``, one text more at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return [texts.slice(first, last - first) for first, last in zip(bounds, bounds[1:])]


def byte_encoder() -> Encoder:
    """One id per UTF-8 byte, after the two boundary ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        data = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        offsets = pa.array((ends - ends[0]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.add(raw, 2, dtype=np.int32)))

    return column_encoder("bytes", encode, 257)


def _broadcast_vocab_encoder(vocab: DataFrame) -> Callable[[DataFrame], DataFrame]:
    terms = vocab.select("term", "id").toArrow().combine_chunks()
    shared = vocab.sparkSession.sparkContext.broadcast(
        (terms["term"].combine_chunks(), terms["id"].combine_chunks())
    )

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        known, ids = shared.value
        known, sizes, values = known.cast(texts.type), [], []
        for part in _slices(texts):
            split = pc.split_pattern_regex(part, r"[ \n\t\r]+")
            pieces, owner = pc.list_flatten(split), pc.list_parent_indices(split)
            filled = pc.not_equal(pieces, "")
            found = pc.index_in(pieces.filter(filled), value_set=known)
            values.append(pc.fill_null(ids.take(found), UNKNOWN_ID).cast(pa.int32()).to_numpy())
            sizes.append(np.bincount(owner.filter(filled).to_numpy(), minlength=len(part)))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))

    return lambda df: df.withColumn("ids", encode(F.col("text")))


def _in_parts(texts: int):
    """Documents in consecutive parts of about ``PART_BYTES`` of text, one more at most. ``texts`` is the place of ``text``,
    which is replaced by the place of each word among the part's distinct words; a part's first row holds these."""

    def part(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, pieces = [], []
        for batch in batches:
            for some in _slices(batch.column(texts)):
                split = pc.split_pattern_regex(some, r"[ \n\t\r]+")
                found, owner = pc.list_flatten(split), pc.list_parent_indices(split)
                filled = pc.not_equal(found, "")
                pieces.append(found.filter(filled).dictionary_encode())
                sizes.append(np.bincount(owner.filter(filled).to_numpy(), minlength=len(some)))
        words = pa.chunked_array(pieces).unify_dictionaries()
        terms = words.chunk(0).dictionary.cast(pa.string())
        at = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        name, first = uuid.uuid4().hex, 0
        for batch in batches:
            bounds = ends[first : first + batch.num_rows + 1]
            places = pa.ListArray.from_arrays(pa.array(bounds - bounds[0]), pa.array(at[bounds[0] : bounds[-1]]))
            held = pa.ListArray.from_arrays(
                pa.array([0, *[len(terms)] * batch.num_rows] if first == 0 else [0] * (batch.num_rows + 1), pa.int32()),
                terms if first == 0 else terms.slice(0, 0),
            )
            first += batch.num_rows
            rest = [c for i, c in enumerate(batch.columns) if i != texts]
            names = [n for i, n in enumerate(batch.schema.names) if i != texts]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([name] * batch.num_rows, pa.string()), places, held], [*names, "_part", "_places", "_terms"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            begin = 0
            for some in _slices(batch.column(texts)):
                if len(some):
                    waiting.append(batch.slice(begin, len(some)))
                begin += len(some)
                size += pc.sum(pc.binary_length(some)).as_py() or 0
                if size >= PART_BYTES:
                    yield from part(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from part(waiting)

    return run


def _placed_ids(documents: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a part with their ids, from the ids of those of its words that are in the vocabulary."""
    places = documents["_places"].combine_chunks()
    words = places.flatten().to_numpy()
    ids = np.full(int(words.max(initial=-1)) + 1, UNKNOWN_ID, np.int32)
    ids[known["place"].to_numpy()] = known["id"].to_numpy()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(places).to_numpy()))).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[words]))
    return documents.drop_columns(["_part", "_places"]).append_column("ids", found)


def _joined_vocab_encoder(vocab: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For vocabularies of any size: look every distinct word of a part of the documents up by a join.

    A part is a few MB of text, so a word counts once per part, not once per text or use, and what comes
    back for a part fits a task. Parts depend on the order of rows, so they are stored before both uses."""

    def add_ids(df: DataFrame) -> DataFrame:
        rest = [f for f in df.schema.fields if f.name != "text"]
        schema = StructType([
            *rest, StructField("_part", StringType()), StructField("_places", ArrayType(IntegerType())), StructField("_terms", ArrayType(StringType())),
        ])
        parts = stage(df.mapInArrow(_in_parts(df.columns.index("text")), schema), "parts")
        terms = parts.select("_part", F.posexplode("_terms").alias("place", "term"))
        known = terms.join(vocab.select("term", "id").where("id IS NOT NULL"), "term").select(F.col("_part").alias("_of"), "place", F.col("id").cast("int").alias("id"))
        result = StructType([*rest, StructField("ids", ArrayType(IntegerType()))])
        documents = parts.drop("_terms").groupBy("_part")
        return documents.cogroup(known.groupBy("_of")).applyInArrow(_placed_ids, result)

    return add_ids


def vocab_encoder(vocab: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> Encoder:
    """Word ids from ``vocab``; words outside it share one id.

    ``vocab`` is read several times: pass a stored table.
    """
    size = vocab.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes"), F.max("id").alias("top")
    ).first()
    small = size["n"] <= broadcast_terms and (size["bytes"] or 0) <= BROADCAST_TERM_BYTES
    add_ids = _broadcast_vocab_encoder(vocab) if small else _joined_vocab_encoder(vocab)
    return Encoder("vocab", add_ids, size["top"] or UNKNOWN_ID)


def encode_documents(df: DataFrame, encoder: Encoder) -> DataFrame:
    """``tokens``: BOS, then the ids of the text; ``n_tokens`` counts them.

    No closing marker. Store the result when more than one operator reads it.
    """
    if encoder.bos_id is None:
        raise ValueError(f"encoder {encoder.name!r} has no BOS id")
    return (
        encoder.add_ids(df)
        .withColumn("n_tokens", F.size("ids").cast("long") + 1)
        .withColumn("tokens", F.concat(F.array(F.lit(encoder.bos_id)), F.col("ids")))
        .drop("ids", "text")
    )


def _width(largest: Column) -> Column:
    return (
        F.when(largest <= 2**16 - 1, 2)
        .when(largest <= 2**32 - 1, 4)
        .otherwise(F.raise_error(F.concat(F.lit("token id too large for 32 bits: "), largest.cast("string"))).cast("int"))
    )


def token_width(vocab: DataFrame) -> DataFrame:
    """Bytes per stored token, from the largest id of the vocabulary."""
    largest = F.coalesce(F.max("id").cast("long"), F.lit(-1).cast("long"))
    return vocab.agg(largest.alias("largest_id")).select("largest_id", _width(F.col("largest_id")).alias("item_size"))


def item_size(max_id: int) -> int:
    if max_id > 2**32 - 1:
        raise ValueError(f"token id {max_id} is too large for 32 bits")
    return 2 if max_id <= 2**16 - 1 else 4


def _cell(df: DataFrame, cell_tokens: int) -> Column:
    """A range of order keys, with about ``cell_tokens`` tokens over all shards: some leading buckets each."""
    total = df.agg(F.sum("n_tokens")).first()[0] or 0
    cells = max(1, -(-total // cell_tokens))
    number = F.coalesce(F.conv("bucket", 16, 10).cast("long"), F.lit(0))
    return F.floor(number * F.least(F.lit(cells), F.lit(1 << 20)) / F.pow(F.lit(16.0), F.length("bucket")))


def bos_offsets(df: DataFrame, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """``start``: where each document begins in its shard, BOS counted.

    ``df`` holds stored, encoded documents with their shard. Documents of a range of keys come to
    lie together and in order; this is the only time their tokens move, and cutting packs
    from the result moves edges of ranges only.
    """
    size = F.col("n_tokens")
    celled = df.withColumn("_cell", _cell(df, cell_tokens))
    ended = running_total(
        celled, group=["split", "shard"], bucket="_cell", order=["order_key", "doc_id"], value=size, name="_end", stored=True
    )
    return ended.withColumn("start", F.col("_end") - size).drop("_end", "_cell")


def audit_token_shards(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Shards of a build next to those on disk.

    ``expected``: split, shard, token_count; ``stored``: split, shard, stored_tokens. What is missing or
    differs is the work that remains.
    """
    joined = expected.join(stored, ["split", "shard"], "full_outer")
    status = (
        F.when(F.col("stored_tokens").isNull(), "missing")
        .when(F.col("token_count").isNull(), "unexpected")
        .when(F.col("token_count") != F.col("stored_tokens"), "token count differs")
        .otherwise("complete")
    )
    return joined.select("split", "shard", "token_count", "stored_tokens", status.alias("status"))


def shard_headers(df: DataFrame, max_id: int) -> DataFrame:
    """Header fields of each shard file."""
    sums = df.groupBy("split", "shard").agg(F.sum("n_tokens").alias("n"))
    too_many = F.raise_error(F.format_string("%s shard %d holds %d tokens", "split", "shard", "n")).cast("long")
    return sums.select(
        "split",
        "shard",
        F.lit(SHARD_MAGIC).alias("magic"),
        F.lit(SHARD_VERSION).alias("version"),
        F.when(F.col("n") <= MAX_SHARD_TOKENS, F.col("n")).otherwise(too_many).alias("token_count"),
        F.lit(item_size(max_id)).alias("item_size"),
    )


def tokenization_manifest(df: DataFrame, encoder: Encoder) -> DataFrame:
    by_shard = df.groupBy("split", "shard").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")
    )
    return by_shard.agg(
        F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), F.count("*").alias("shards")
    ).select(
        F.lit(encoder.name).alias("encoder"),
        F.lit(encoder.bos_id).alias("bos_token_id"),
        F.lit(8 * item_size(encoder.max_id)).alias("bits"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        "shards",
        F.lit(SHARD_MAGIC).alias("magic"),
        F.lit(SHARD_VERSION).alias("version"),
    )


def document_samples(
    df: DataFrame,
    encoder: Encoder,
    seq_length: int | None = None,
    padding: bool = False,
    truncation: bool = False,
) -> DataFrame:
    """One next-token sample per document, boundaries included.

    The sequence is BOS, text, EOS; inputs are all but its last id, labels all
    but its first. ``seq_length`` bounds the inputs (``truncation``) and fills
    short ones (``padding``).
    """
    bos = encoder.bos_id if encoder.bos_id is not None else encoder.eos_id
    eos = encoder.eos_id if encoder.eos_id is not None else encoder.bos_id
    if bos is None:
        raise ValueError(f"encoder {encoder.name!r} has neither BOS nor EOS")
    pad = encoder.pad_id if encoder.pad_id is not None else eos
    whole = F.concat(F.array(F.lit(bos)), F.col("ids"), F.array(F.lit(eos)))
    if truncation and seq_length is not None:
        whole = F.slice(whole, 1, seq_length + 1)
    samples = encoder.add_ids(df).withColumn("whole", whole).withColumn("used", F.size("whole") - 1)
    missing = F.greatest(F.lit(seq_length) - F.col("used"), F.lit(0)) if padding and seq_length else F.lit(0)

    def filled(ids: Column, filler: int) -> Column:
        return F.concat(ids, F.array_repeat(F.lit(filler), missing))

    return samples.select(
        "doc_id",
        filled(F.slice("whole", F.lit(1), F.col("used")), pad).alias("input_ids"),
        filled(F.slice("whole", F.lit(2), F.col("used")), IGNORED_LABEL).alias("labels"),
        filled(F.array_repeat(F.lit(1), F.col("used")), 0).alias("attention_mask"),
    )
