"""Logs, trial tables, evaluation results and file listings of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.evals import latest_results
from tokenloom.schemas import EVALUATION_MANIFEST, TRIAL
from tokenloom.session import stage
from tokenloom.sources.opened_files import RANGE_BYTES, open_lines, open_texts


def _plain(path: Column) -> Column:
    """Local paths without their scheme; others as they are."""
    return F.regexp_replace(path, r"^file:/*", "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def numbered_lines(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of text files with their number in the file.

    Large files are read in ranges of bytes. A line's number is its place in its range after the
    lines of earlier ones; files of one range, which logs are as a rule, need no count.
    """
    listing = spark.read.format("binaryFile").load(pattern).select(_plain(F.col("path")).alias("path"), "length")
    listing = stage(listing, "listing")
    lines = open_lines(listing, range_bytes)
    if listing.where(F.col("length") > range_bytes).isEmpty():
        return lines.select("file", (F.col("place") + 1).alias("line_no"), "value")
    lines = stage(lines, "lines")
    ranges = lines.groupBy("file", "first").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("file", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return lines.join(before, ["file", "first"]).select("file", (F.col("before") + F.col("place") + 1).alias("line_no"), "value")


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Records from lines of JSON; ``malformed`` marks what cannot be read."""
    names, bad = ("step", "val_loss", "lr"), {"columnNameOfCorruptRecord": "_bad"}

    def parsed_as(kind: str) -> Column:
        return F.from_json("value", ", ".join([f"{n} {kind}" for n in names] + ["_bad string"]), bad)

    # Numbers are read as such (NaN and Infinity too); texts that spell a
    # number count as well.
    parsed = lines.where(F.trim("value") != "").select("*", parsed_as("double").alias("r"), parsed_as("string").alias("t"))
    plain = F.col("r").isNotNull() & F.col("r._bad").isNull()
    spelled = F.col("t").isNotNull() & F.col("t._bad").isNull()
    numbers = {}
    for name in names:
        text = F.col(f"t.{name}")
        numbers[name] = F.when(plain, F.col(f"r.{name}")).when(spelled, text.try_cast("double"))
        spelled = spelled & (text.isNull() | text.try_cast("double").isNotNull())
    broken = ~(plain | spelled)
    others = [c for c in lines.columns if c != "value"]
    return parsed.select(*others, *[n.alias(name) for name, n in numbers.items()], broken.alias("malformed"))


def read_run_logs(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Validation logs of many runs; a run is the folder of its log."""
    lines = numbered_lines(spark, pattern, range_bytes).withColumn("run", _folder(F.col("file")))
    return parse_log_lines(lines)


def read_trials(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(TRIAL).format(format).load(path)


def read_file_listing(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """Paths and modification times; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.load(root).select(_plain(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"))


def read_eval_results(
    spark: SparkSession, root: str, manifest_name: str = "evaluation.json", result_name: str = "results_*.json"
) -> tuple[DataFrame, DataFrame]:
    """Manifests, and the newest result file below each of them.

    An evaluation is the folder of its manifest. Files that cannot be read are left out. The
    newest result is chosen from the listing, so superseded ones are never opened.
    """
    manifests = (
        open_texts(read_file_listing(spark, root, manifest_name).select("path"))
        .select(_folder(F.col("path")).alias("evaluation"), F.from_json("content", EVALUATION_MANIFEST).alias("m"))
        .where(F.col("m").isNotNull())
        .select("evaluation", "m.*")
    )
    manifests = stage(manifests, "manifests")
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    files = read_file_listing(spark, root, result_name).select(
        "path", "mtime", F.explode(ancestors).alias("evaluation")
    )
    newest = latest_results(files.join(manifests.select("evaluation"), "evaluation", "left_semi"))
    newest = stage(newest.select("evaluation", "path"), "newest")
    opened = open_texts(newest.select("path").distinct())
    return manifests, opened.join(newest, "path").select("evaluation", "path", "content")
