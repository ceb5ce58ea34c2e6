"""Checkpoints, evaluation work lists and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.numbers import is_finite
from tokenloom.functions.text import slug

# The tasks of each suite, and those that generate text.
SUITES = {
    "pretrain": [
        "wikitext", "lambada_openai", "hellaswag", "piqa", "arc_easy", "winogrande", "mutual", "coqa", "arithmetic",
        "asdiv", "gsm8k",
    ],
    "instruct": ["ifeval", "eq_bench", "coqa", "mutual_plus", "asdiv_cot_llama", "gsm8k"],
    "instruct-retention": ["hellaswag", "piqa", "arc_easy", "winogrande", "arithmetic"],
}
GENERATIVE_TASKS = {
    "pretrain": ["coqa", "gsm8k"],
    "instruct": ["ifeval", "eq_bench", "coqa", "asdiv_cot_llama", "gsm8k"],
    "instruct-retention": [],
}

# Checkpoint directories, result files and counts that are no metrics.
CHECKPOINT_PATTERN = r"^(.*)/(epoch_(\d+)_step_(\d+))/model(?:/.*)?$"
CHECKPOINT_NAME = r"^epoch_(\d+)_step_(\d+)$"
NOT_METRICS = ("N", "n_samples")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def discover_checkpoints(listing: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Checkpoints below the given roots, with the run they belong to.

    ``listing`` holds the paths of files (or directories). A checkpoint named
    step 99 has completed 100 steps.
    """
    root = F.explode(F.array(*[F.lit(r.rstrip("/")) for r in roots])).alias("root")
    parts = {
        "container": F.regexp_extract("path", CHECKPOINT_PATTERN, 1),
        "name": F.regexp_extract("path", CHECKPOINT_PATTERN, 2),
        "epoch": F.regexp_extract("path", CHECKPOINT_PATTERN, 3),
        "step": F.regexp_extract("path", CHECKPOINT_PATTERN, 4),
    }
    found = (
        listing.where(F.col("path").rlike(CHECKPOINT_PATTERN))
        .select("path", root)
        .where(F.col("path").startswith(F.concat("root", F.lit("/"))))
        .select("root", *[column.alias(name) for name, column in parts.items()])
        .distinct()
    )
    parent = F.regexp_replace("container", r"/checkpoints$", "")
    run_path = F.col("run_path")
    below = run_path.startswith(F.concat("root", F.lit("/")))
    plain = (F.col("root") == F.col("container")) | (F.col("root") == run_path) | (_name(F.col("root")) == "checkpoints")
    relative = F.expr("substring(run_path, length(root) + 2)")
    named = found.withColumn("run_path", parent).withColumn(
        "run_name", F.when(plain | ~below, _name(run_path)).otherwise(relative)
    )
    return named.select(
        "root",
        "run_name",
        slug(F.replace("run_name", F.lit("/"), F.lit("--"))).alias("run_slug"),
        "run_path",
        F.concat_ws("/", "container", "name").alias("path"),
        F.col("epoch").cast("long").alias("epoch"),
        F.col("step").cast("long").alias("checkpoint_step"),
        (F.col("step").cast("long") + 1).alias("training_step"),
    )


def empty_roots(checkpoints: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Roots without any checkpoint."""
    wanted = checkpoints.sparkSession.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    return wanted.join(checkpoints.select("root").distinct(), "root", "left_anti")


def slug_collisions(checkpoints: DataFrame) -> DataFrame:
    """Slugs that stand for more than one run."""
    runs = checkpoints.groupBy("run_slug").agg(
        F.count_distinct("run_path").alias("runs"),
        F.min("run_path").alias("first_run"),
        F.max("run_path").alias("last_run"),
    )
    return runs.where(F.col("runs") > 1)


def latest_checkpoint(listing: DataFrame, pointers: DataFrame) -> DataFrame:
    """The training state each root resumes from.

    ``listing``: root, path; ``pointers``: root, target (what ``LATEST.txt``
    names). Only complete states count: the ``LATEST`` directory, then the
    pointer, then the highest step and epoch.
    """
    inside = F.expr("substring(path, length(root) + 2)")
    parts = listing.select("root", F.split(inside, "/").alias("p"))
    item = F.get("p", F.lit(1))
    states = (
        parts.select("root", F.get("p", F.lit(0)).alias("name"), item.alias("item"))
        .groupBy("root", "name")
        .agg(*[
            F.coalesce(F.bool_or(F.col("item") == wanted), F.lit(False)).alias(f"has_{i}")
            for i, wanted in enumerate(("step_scheduler.pt", "model", "optim"))
        ])
        .where(F.col("has_0") & F.col("has_1") & F.col("has_2"))
    )
    pointed = pointers.select("root", F.regexp_replace("target", r"^\s+|\s+$", "").alias("name"), F.lit(True).alias("pointed"))
    ranked = states.join(pointed, ["root", "name"], "left")
    step = F.try_to_number(F.nullif(F.regexp_extract("name", CHECKPOINT_NAME, 2), F.lit("")), F.lit("999999999999999999")).cast("long")
    epoch = F.try_to_number(F.nullif(F.regexp_extract("name", CHECKPOINT_NAME, 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    priority = F.when(F.col("name") == "LATEST", 3).when(F.col("pointed"), 2).when(step.isNotNull(), 1)
    choice = ranked.select("root", "name", priority.alias("priority"), step.alias("step"), epoch.alias("epoch"))
    best = F.max_by("name", F.when(F.col("priority").isNotNull(), F.struct("priority", "step", "epoch", "name")))
    return (
        listing.select("root").distinct()
        .join(choice.groupBy("root").agg(best.alias("name")), "root", "left")
        .select(
            "root",
            F.concat_ws("/", "root", "name").alias("path"),
            F.col("name").alias("name"),
            F.when(F.col("name").isNull(), "no training checkpoint found").alias("problem"),
        )
        .withColumn("path", F.when(F.col("problem").isNull(), F.col("path")))
    )


def requested_suites(suite: str) -> list[str]:
    """Instruction models are also measured with the retention suite."""
    return ["instruct", "instruct-retention"] if suite == "instruct" else [suite]


def suite_tasks(spark: SparkSession, suites: Sequence[str] = tuple(SUITES)) -> DataFrame:
    """Tasks of each suite in order; ``generative`` ones run in a smoke phase."""
    rows = [(s, i, t, t in GENERATIVE_TASKS[s]) for s in suites for i, t in enumerate(SUITES[s])]
    return spark.createDataFrame(rows, "suite string, position int, task string, generative boolean")


def evaluation_worklist(
    checkpoints: DataFrame,
    suites: Sequence[str],
    done: DataFrame,
    phase: str = "full",
    steps: Sequence[int] | None = None,
    force: bool = False,
) -> DataFrame:
    """Evaluations still to run, with their tasks.

    ``done``: run_slug, checkpoint, suite, phase, status, result_files. A
    finished pair is left out when it is complete and has result files.
    """
    chosen = GENERATIVE_TASKS if phase == "smoke" else SUITES
    wanted = checkpoints
    if steps is not None:
        wanted = wanted.where(F.col("training_step").isin(list(steps)))
        if not wanted.take(1):
            raise ValueError("none of the checkpoints match the requested steps")
    suite = F.explode(F.array(*[
        F.struct(F.lit(s).alias("suite"), F.array(*[F.lit(t) for t in chosen[s]]).cast("array<string>").alias("tasks"))
        for s in suites
    ])).alias("s")
    work = (
        wanted.select("run_slug", _name(F.col("path")).alias("checkpoint"), "training_step", suite)
        .select("run_slug", "checkpoint", "training_step", "s.suite", "s.tasks")
        .where(F.size("tasks") > 0)
        .withColumn("phase", F.lit(phase))
    )
    if force:
        return work
    finished = done.where((F.col("status") == "complete") & (F.col("result_files") > 0))
    return work.join(finished, ["run_slug", "checkpoint", "suite", "phase"], "left_anti")


def evaluation_status(attempts: DataFrame) -> DataFrame:
    """``attempts``: return_code and result_files; adds status and error."""
    success = F.coalesce(F.col("return_code") == 0, F.lit(False))
    complete = success & (F.col("result_files") > 0)
    return attempts.withColumn("status", F.when(complete, "complete").otherwise("failed")).withColumn(
        "error", F.when(success & ~complete, "finished without result files")
    )


def failure_count(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count_if(F.col("status") == "failed").alias("failures"), F.count("*").alias("evaluations"))


def latest_results(files: DataFrame) -> DataFrame:
    """The newest result file per evaluation. ``files``: evaluation, path, mtime."""
    newest = F.max_by("path", F.struct("mtime", "path")).alias("path")
    return files.groupBy("evaluation").agg(newest, F.max("mtime").alias("mtime"))


def _lenient_variant(text: Column) -> Column:
    """Parse JSON; when that fails, once more with bare NaN and Infinity quoted."""
    quoted = F.regexp_replace(text, r"([:,\[]\s*)(-?Infinity|NaN)(?=\s*[,}\]])", '$1"$2"')
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(quoted))


def result_entries(manifests: DataFrame, results: DataFrame, phase: str = "full") -> DataFrame:
    """Every number a completed evaluation reports.

    ``manifests``: evaluation, run_name, suite, phase, status, training_step,
    checkpoint; ``results``: evaluation, path, content (JSON text).
    """
    spark = results.sparkSession
    complete = manifests.where((F.col("status") == "complete") & (F.col("phase") == phase))
    tasks = results.select(
        "evaluation", "path", F.try_variant_get(_lenient_variant(F.col("content")), "$.results", "variant").alias("tasks")
    )
    by_task = tasks.lateralJoin(spark.tvf.variant_explode(F.col("tasks").outer()).select(
        F.col("key").alias("task"), F.col("value").alias("metrics")
    ))
    entries = by_task.lateralJoin(spark.tvf.variant_explode(F.col("metrics").outer()).select("pos", "key", "value"))
    kind = F.schema_of_variant("value")
    is_number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$")
    number = F.when(is_number, F.try_variant_get("value", "$", "double"))
    named = entries.where(F.col("metrics").isNotNull() & F.schema_of_variant("metrics").startswith("OBJECT"))
    return named.select("evaluation", "path", "task", "key", number.alias("value")).join(complete, "evaluation")


def _stem(key: Column) -> Column:
    return F.substring_index(key, ",", 1)


def extract_metrics(entries: DataFrame) -> DataFrame:
    """Entries that are metrics: finite numbers, no errors, no counts."""
    stem = _stem(F.col("key"))
    return entries.where(is_finite(F.col("value")) & ~stem.endswith("_stderr") & ~stem.isin(*NOT_METRICS))


def pair_stderr(entries: DataFrame) -> DataFrame:
    """Metrics with the error reported next to them.

    ``m,f`` and ``m_stderr,f`` share the key ``m,f``, so one grouping pairs
    them without reading the results twice.
    """
    stem = _stem(F.col("key"))
    rest = F.expr("substring(key, length(substring_index(key, ',', 1)) + 1)")
    is_error = stem.endswith("_stderr")
    metric = F.concat(F.regexp_replace(stem, "_stderr$", ""), rest)
    number = F.when(is_finite(F.col("value")), F.col("value"))
    keys = ["evaluation", "run_name", "suite", "training_step", "checkpoint", "path", "task"]
    paired = entries.groupBy(*keys, metric.alias("metric")).agg(
        F.max(F.when(~is_error & ~stem.isin(*NOT_METRICS), number)).alias("value"),
        F.max(F.when(is_error, number)).alias("stderr"),
    )
    return paired.where(F.col("value").isNotNull())


def metrics_table(metrics: DataFrame) -> DataFrame:
    """The result table, sorted."""
    return metrics.select(
        F.col("run_name").alias("run"), "suite", "task", "metric", F.col("training_step").alias("step"),
        "value", "stderr", "checkpoint", F.col("path").alias("result_file"),
    ).orderBy("suite", "task", "metric", "run", "step")


def metric_series(table: DataFrame) -> DataFrame:
    """Points of each run's line per metric, with error bars where any exist."""
    keys = ["suite", "task", "metric", "run"]
    has_bars = table.groupBy(*keys).agg(F.bool_or(F.col("stderr").isNotNull()).alias("has_bars"))
    bar = F.when(F.col("has_bars"), F.coalesce("stderr", F.lit(0.0)))
    return table.join(has_bars, keys).select(*keys, "step", "value", bar.alias("error_bar"))
