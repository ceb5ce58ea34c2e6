"""Files that a table names, opened in the tasks that read or write them.

A listing is narrow: it can be filtered, joined and reduced before any file is opened. Files
are dealt evenly over tasks, many small ones to each. Paths are local ones or such that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files, and bytes of a range of lines, that one task reads about.
FILES_PER_TASK = 500
RANGE_BYTES = 16 << 20
_BLOCK = 1 << 16


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def _dealt(rows: DataFrame, per_task: int) -> DataFrame:
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.repartition(tasks)


def open_texts(paths: DataFrame, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """``paths`` (path and other columns) with ``content``; files that cannot be read are left out."""
    schema = paths.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    files, name = _opened(path)
                    with files.open_input_stream(name) as stream:
                        texts.append(stream.read().decode("utf-8", "replace"))
                except OSError:
                    continue
                kept.append(i)
            columns = [c.take(pa.array(kept, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*batch.schema.names, "content"])

    return _dealt(paths, files_per_task).mapInArrow(run, f"{schema}, content string")


def write_lines(lines: DataFrame) -> None:
    """Write ``lines`` (path, value), whose lines of one path follow each other in one partition, to the files they name.

    Tasks open the files themselves and none is moved afterwards, so many small files cost little more than their
    bytes. A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stream = None, None
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns)):
                if path != last:
                    if stream:
                        stream.close()
                    files, name = _opened(path)
                    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    last, stream = path, files.open_output_stream(name)
                stream.write(f"{value}\n".encode())
        if stream:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["path"])

    lines.select("path", "value").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def lines_of(stream: fs.FileSystem, first: int, last: int, size: int) -> list[bytes]:
    """The lines that begin in bytes [first, last) of an open file; they end with a line feed."""
    begin = max(first - 1, 0)
    stream.seek(begin)
    data = stream.read(last - begin)
    at = begin + len(data)
    # The last line goes on behind the range.
    while at < size and not data.endswith(b"\n"):
        more = stream.read(min(_BLOCK, size - at))
        cut = more.find(b"\n") + 1
        data, at = data + (more[:cut] if cut else more), at + (cut or len(more))
    if first:
        # What precedes the first line feed belongs to the range before.
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    lines = data.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    return [line.removesuffix(b"\r") for line in lines]


def open_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, first, place, value)``: the lines of the files of ``files`` (path, length), read in ranges of bytes.

    ``first`` is the byte at which the line's range begins, ``place`` its place, from 0, among the lines that
    begin in the range. Ranges come from ``range_bytes`` alone, so reading again gives the same rows.
    """
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.explode(begins).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                opened, name = _opened(path)
                with opened.open_input_file(name) as stream:
                    found = lines_of(stream, first, min(first + range_bytes, size), size)
                texts = [line.decode("utf-8", "replace") for line in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(texts), pa.string()), pa.array([first] * len(texts), pa.int64()),
                     pa.array(np.arange(len(texts))), pa.array(texts, pa.string())],
                    ["file", "first", "place", "value"],
                )

    return _dealt(ranges, FILES_PER_TASK).mapInArrow(run, "file string, first long, place long, value string")
