"""Follow growing validation logs: the last record of a step is the valid one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.curves import curve_points, latest_by_step

# Folders of one level that are merged into one of the next.
FAN_IN = 8
# A folder is finished when Spark has marked it.
_FOLDER = re.compile(r"/level=(\d+)/last=(\d+)/_SUCCESS")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


def stream_latest_losses(logs: DataFrame) -> DataFrame:
    """Streaming form of latest_by_step, for update mode."""
    return latest_by_step(logs)


def stream_curve_points(logs: DataFrame, runs: DataFrame, fit_start_fraction: float = 0.0) -> DataFrame:
    """Classified points of followed logs; ``runs`` is a static table."""
    return curve_points(stream_latest_losses(logs), runs, fit_start_fraction)


def _folders(path: str) -> dict[tuple[int, int], str]:
    """Finished update folders by (level, last batch)."""
    files, root = _filesystem(path)
    if files.get_file_info(root).type != fs.FileType.Directory:
        return {}
    found = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
        if name := _FOLDER.fullmatch(info.path.removeprefix(root)):
            found[int(name[1]), int(name[2])] = f"{path}/level={name[1]}/last={name[2]}"
    return found


def _merge(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Where a level has ``FAN_IN`` folders, one folder of the next level with their newest rows takes their place.

    A folder counts once it is finished. Should the job end before the old ones are gone, their
    rows are in both, which changes no result.
    """
    files, _ = _filesystem(path)
    level = 0
    while True:
        present = {last: folder for (at, last), folder in _folders(path).items() if at == level}
        if not present and not any(at > level for at, _ in _folders(path)):
            return
        if len(present) >= FAN_IN:
            rows = spark.read.parquet(*present.values())
            _newest(rows, keys, keep_version=True).write.mode("overwrite").parquet(f"{path}/level={level + 1}/last={max(present)}")
            for folder in present.values():
                files.delete_dir(_filesystem(folder)[1])
        level += 1


def _newest(rows: DataFrame, keys: Sequence[str], keep_version: bool = False) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"), F.max("version").alias("version"))
    return newest.select(*keys, "v.*", *(["version"] if keep_version else []))


def write_updates(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Keep the changed rows of every batch in a folder of its own, and merge folders by levels.

    After b batches there are less than ``FAN_IN`` folders on each of about log b levels. A repeated batch
    replaces itself, or finds that a merge holds it and does nothing.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        merged = max((last for level, last in _folders(path) if level), default=-1)
        if batch_id > merged:
            batch.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/level=0/last={batch_id}")
        _merge(batch.sparkSession, path, keys)

    writer = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every row."""
    return _newest(spark.read.parquet(*_folders(path).values()), keys)
