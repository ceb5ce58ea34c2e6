"""Binary token shards as a Spark data source.

A shard is a header of 256 int32 values (magic, version, token count, bytes
per token), then unsigned 16- or 32-bit ids. Beside it, ``.bos.idx`` holds the
int32 position of every document start.

A write puts its files into a folder of its own, which readers pass over, and ends with one
commit record that names them: all shards of a write appear at once, by one rename.
Plain shard files in a folder are read as well.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tokenloom.operators.tokens import MAX_SHARD_TOKENS, SHARD_MAGIC, SHARD_VERSION, audit_token_shards, item_size
from tokenloom.session import stage

# Ordinals of shards are broadcast up to this many (a short row each).
BROADCAST_SHARDS = 100_000
HEADER_WORDS = 256
HEADER_BYTES = 4 * HEADER_WORDS
ROWS_PER_BATCH = 64
# Fixed beginning of the names of commit records.
RECORD = "_committed-"

BLOCK_SCHEMA = "file string, start long, shard_tokens long, tokens array<long>"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def _is_shard(path: str, root: str) -> bool:
    """Whether a file is a plain shard: hidden folders, and those of writes, do not count."""
    below = path.removeprefix(root).strip("/").split("/")
    return path.endswith(".bin") and not any(part.startswith(("_", ".")) for part in below)


def _records(files: fs.FileSystem, root: str) -> dict[str, list[dict]]:
    """The shards that each commit record names: path below ``root``, size, split, shard and tokens."""
    if files.get_file_info(root).type != fs.FileType.Directory:
        return {}
    found = {}
    for info in files.get_file_info(fs.FileSelector(root)):
        name = info.path.rsplit("/", 1)[-1]
        if name.startswith(RECORD) and name.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                found[info.path] = json.loads(stream.read())["shards"]
    return found


def _put_record(files: fs.FileSystem, root: str, attempt: str, shards: list[dict]) -> None:
    """Write a record under a name that readers pass over, then give it its own."""
    hidden = f"{root}/_unfinished-{attempt}"
    with files.open_output_stream(hidden) as stream:
        stream.write(json.dumps({"shards": shards}).encode())
    files.move(hidden, f"{root}/{RECORD}{attempt}.json")


@dataclass
class FileRange(InputPartition):
    """One of ``parts`` equal ranges of blocks of one file."""

    path: str
    size: int
    part: int
    parts: int


class TokenShardReader(DataSourceReader):
    """Rows are blocks of consecutive tokens, aligned to the pack length, each
    with the token that follows it."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.seq_len = int(options.get("seqLen", 1))
        self.block_tokens = max(1, int(options.get("blockTokens", 1 << 18)) // self.seq_len) * self.seq_len
        self.range_bytes = int(options.get("rangeBytes", 128 << 20))
        if self.seq_len <= 0:
            raise ValueError("seqLen must be positive")

    def partitions(self) -> list[FileRange]:
        files, path = _filesystem(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(path, recursive=True))
        else:
            found = [info]
        shards = [(f.path, f.size) for f in found if f.type == fs.FileType.File and _is_shard(f.path, path)]
        committed = [s for record in _records(files, path).values() for s in record]
        shards = sorted(shards + [(f"{path}/{s['path']}", s["size"]) for s in committed])
        if not shards:
            raise FileNotFoundError(f"no token shards found in {self.path}")
        ranges = []
        for name, size in shards:
            parts = max(1, -(-size // self.range_bytes))
            ranges.extend(FileRange(name, size, part, parts) for part in range(parts))
        return ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.path)
        with files.open_input_file(partition.path) as stream:
            header = np.frombuffer(stream.read(HEADER_BYTES), dtype="<i4")
            if len(header) < HEADER_WORDS or header[0] != SHARD_MAGIC or header[1] != SHARD_VERSION:
                raise ValueError(f"{partition.path} is not a token shard")
            total, width = int(header[2]), int(header[3])
            if width not in (2, 4) or partition.size != HEADER_BYTES + total * width:
                raise ValueError(f"{partition.path} does not hold the {total} tokens its header names")
            blocks = max(1, -(-(total - 1) // self.block_tokens)) if total else 0
            first = blocks * partition.part // partition.parts
            last = blocks * (partition.part + 1) // partition.parts
            rows: list[tuple[int, np.ndarray]] = []
            for block in range(first, last):
                start = block * self.block_tokens
                count = min(self.block_tokens + 1, total - start)
                stream.seek(HEADER_BYTES + start * width)
                ids = np.frombuffer(stream.read(count * width), dtype=f"<u{width}")
                rows.append((start, ids.astype(np.int64)))
                if len(rows) == ROWS_PER_BATCH:
                    yield _block_batch(partition.path, total, rows)
                    rows = []
            if rows:
                yield _block_batch(partition.path, total, rows)


def _block_batch(path: str, total: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.cumsum([0] + [len(ids) for _, ids in rows]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([ids for _, ids in rows])))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * len(rows)),
            pa.array([start for start, _ in rows], pa.int64()),
            pa.array([total] * len(rows), pa.int64()),
            tokens,
        ],
        names=["file", "start", "shard_tokens", "tokens"],
    )


@dataclass
class Written(WriterCommitMessage):
    """The shards that one task has written."""

    shards: list[dict] = field(default_factory=list)


class _OpenShard:
    """The files of the shard a task is writing."""

    def __init__(self, files: fs.FileSystem, root: str, folder: str, split: str, shard: int, total: int, width: int):
        self.name = f"{split}-{shard:05d}"
        if total > MAX_SHARD_TOKENS:
            raise ValueError(f"{self.name} holds {total} tokens; use smaller shards")
        self.entry = {"path": f"{folder}/{self.name}.bin", "size": HEADER_BYTES + total * width, "split": split, "shard": shard, "tokens": total}
        self.total, self.width, self.written = total, width, 0
        self.body = files.open_output_stream(f"{root}/{folder}/{self.name}.bin")
        self.index = files.open_output_stream(f"{root}/{folder}/{self.name}.bos.idx")
        header = np.zeros(HEADER_WORDS, dtype="<i4")
        header[:4] = SHARD_MAGIC, SHARD_VERSION, total, width
        self.body.write(header.tobytes())

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        starts = self.written + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.body.write(ids.astype(f"<u{self.width}").tobytes())
        self.index.write(starts.astype("<i4").tobytes())
        self.written += len(ids)

    def close(self) -> dict:
        self.body.close()
        self.index.close()
        if self.written != self.total:
            raise ValueError(f"{self.name} got {self.written} of {self.total} tokens")
        return self.entry


class TokenShardWriter(DataSourceArrowWriter):
    """Each task writes whole shards to a folder of its own inside that of the
    write; the commit record then makes all of them shards at once."""

    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.width = int(options["itemSize"])
        self.attempt = uuid.uuid4().hex
        files, self.target = _filesystem(self.uri)
        self.folder = f"_attempt-{self.attempt}"
        if options.get("resume", "false").lower() != "true":
            self._refuse_existing(files)
        files.create_dir(f"{self.target}/{self.folder}", recursive=True)

    def _refuse_existing(self, files: fs.FileSystem) -> None:
        if files.get_file_info(self.target).type != fs.FileType.Directory:
            return
        existing = [f.path for f in files.get_file_info(fs.FileSelector(self.target)) if f.path.endswith((".bin", ".bos.idx"))]
        existing += [s["path"] for record in _records(files, self.target).values() for s in record]
        if existing:
            raise FileExistsError(f"token shards already exist: {existing[0]}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = _filesystem(self.uri)
        # A task that is run again does not meet the files of its first run.
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        files.create_dir(f"{self.target}/{folder}", recursive=True)
        done, current, shard = Written(), None, None
        for batch in iterator:
            keys = list(zip(batch.column("split").to_pylist(), batch.column("shard").to_pylist()))
            totals = batch.column("shard_tokens").to_numpy()
            tokens = batch.column("tokens")
            offsets = tokens.offsets.to_numpy()
            first = 0
            while first < len(keys):
                last = first
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                if keys[first] != current:
                    if shard is not None:
                        done.shards.append(shard.close())
                    current = keys[first]
                    shard = _OpenShard(files, self.target, folder, *current, int(totals[first]), self.width)
                ids = tokens.values.to_numpy()[offsets[first] : offsets[last]]
                shard.add(np.diff(offsets[first : last + 1]), ids)
                first = last
        if shard is not None:
            done.shards.append(shard.close())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.uri)
        _put_record(files, self.target, self.attempt, [s for m in messages if m for s in m.shards])

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _filesystem(self.uri)
        folder = f"{self.target}/{self.folder}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class TokenShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shard"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema: T.StructType) -> TokenShardReader:
        return TokenShardReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenShardWriter:
        return TokenShardWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; workers need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TokenShardSource)


def read_token_shards(spark: SparkSession, path: str, seq_len: int = 1, block_tokens: int = 1 << 18, range_bytes: int = 128 << 20) -> DataFrame:
    """Blocks of tokens, for :func:`tokenloom.operators.packing.cut_blocks`."""
    register(spark)
    reader = spark.read.format("token_shard").option("seqLen", seq_len).option("blockTokens", block_tokens)
    return reader.option("rangeBytes", range_bytes).load(path)


def stored_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(split, shard, stored_tokens, attempt)`` of every committed shard, from the records alone."""
    files, root = _filesystem(path.rstrip("/"))
    rows = [
        (s["split"], s["shard"], s["tokens"], record.rsplit(RECORD, 1)[-1].removesuffix(".json"))
        for record, shards in _records(files, root).items() for s in shards
    ]
    return spark.createDataFrame(rows, "split string, shard int, stored_tokens long, attempt string")


def forget_shards(path: str, shards: list[tuple[str, int]]) -> None:
    """Take shards out of their commit records, as when their files are found to be damaged."""
    files, root = _filesystem(path.rstrip("/"))
    gone = set(shards)
    for record, held in _records(files, root).items():
        kept = [s for s in held if (s["split"], s["shard"]) not in gone]
        if len(kept) < len(held):
            _put_record(files, root, uuid.uuid4().hex, kept)
            files.delete_file(record)


def write_token_shards(encoded: DataFrame, path: str, max_id: int, only: DataFrame | None = None) -> None:
    """Write stored, encoded documents with their shard, one task per shard.

    The tokens move once, to the task of their shard, which counts the starts as it
    writes. ``only`` (split, shard) resumes a build: these shards are added to what is there.
    """
    spark = encoded.sparkSession
    register(spark)
    totals = encoded.groupBy("split", "shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    if only is not None:
        totals = totals.join(only.select("split", "shard"), ["split", "shard"], "left_semi")
    place = F.row_number().over(Window.orderBy("split", "shard")) - 1
    ordinals = stage(totals.select("split", "shard", "shard_tokens", place.cast("int").alias("ordinal")), "ordinals")
    tasks = ordinals.count()
    if not tasks and only is not None:
        return
    (
        encoded.select("split", "shard", "order_key", "doc_id", "tokens")
        .join(F.broadcast(ordinals) if tasks <= BROADCAST_SHARDS else ordinals, ["split", "shard"])
        .repartitionById(max(1, tasks), "ordinal")
        .sortWithinPartitions("ordinal", "order_key", "doc_id")
        .select("split", "shard", "shard_tokens", "tokens")
        .write.format("token_shard")
        .option("itemSize", item_size(max_id))
        .option("resume", only is not None)
        .mode("append")
        .save(path)
    )


def resume_token_shards(encoded: DataFrame, path: str, max_id: int) -> DataFrame:
    """Write what a build lacks on disk and nothing else; gives the audit that said so."""
    expected = encoded.groupBy("split", "shard").agg(F.sum("n_tokens").alias("token_count"))
    audit = stage(audit_token_shards(expected, stored_shards(encoded.sparkSession, path)), "audit")
    wrong = audit.where("status IN ('token count differs', 'unexpected')").select("split", "shard").collect()
    forget_shards(path, [(r["split"], r["shard"]) for r in wrong])
    write_token_shards(encoded, path, max_id, only=audit.where("status IN ('missing', 'token count differs')"))
    return audit
