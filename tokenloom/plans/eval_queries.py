"""Checkpoint and evaluation queries over ``events`` read as files and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.text import slug as slug_of
from tokenloom.operators import evals as E
from tokenloom.plans import adapters as A

ROOTS = ["/runs"]
SUITES = ["pretrain", "instruct", "instruct-retention"]


def _checkpoints(spark, sf):
    return E.discover_checkpoints(A.checkpoint_files(spark, sf), ROOTS)


def _entries(spark, sf):
    return E.result_entries(*A.evaluations(spark, sf))


def _table(spark, sf):
    return E.metrics_table(E.pair_stderr(_entries(spark, sf)))


def slug(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", slug_of(F.col("url")).alias("url_slug"), F.md5(slug_of(F.col("html"), "metric")).alias("html_slug"))


def discover_checkpoints(spark, sf):
    return _checkpoints(spark, sf).drop("root")


def slug_collisions(spark, sf):
    return E.slug_collisions(_checkpoints(spark, sf))


def latest_checkpoint(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    item = F.when(F.col("event_type") == "click", "optim/x").when(
        F.col("event_type") == "error", "step_scheduler.pt"
    ).otherwise("model/x")
    name = F.when(e % 10 == 9, "LATEST").otherwise(F.format_string("epoch_%d_step_%d", u % 2, e % 12))
    root = F.format_string("/runs/u%d", u)
    events = A.table(spark, sf, "events")
    listing = events.select(root.alias("root"), F.concat_ws("/", root, name, item).alias("path"))
    pointers = events.where(u % 5 == 0).select(root.alias("root"), F.lit("epoch_0_step_3\n").alias("target")).distinct()
    return E.latest_checkpoint(listing, pointers)


def suite_tasks(spark, sf):
    """The task table, counted against the registered evaluations of ``events``."""
    tasks = E.suite_tasks(spark)
    seen = A.table(spark, sf, "events").select(
        F.element_at(F.array(*[F.lit(s) for s in SUITES]), (F.col("event_id") % 3 + 1).cast("int")).alias("suite")
    ).groupBy("suite").agg(F.count("*").alias("evaluations"))
    return tasks.join(seen, "suite").select("suite", "position", "task", "generative", "evaluations")


def _done(spark, sf):
    k = F.col("checkpoint_step")
    status = F.when(k % 3 == 0, "complete").otherwise("failed")
    return _checkpoints(spark, sf).select(
        "run_slug", F.substring_index("path", "/", -1).alias("checkpoint"), F.lit("pretrain").alias("suite"),
        F.lit("full").alias("phase"), status.alias("status"), (k % 2).alias("result_files"),
    )


def evaluation_worklist(spark, sf):
    work = E.evaluation_worklist(_checkpoints(spark, sf), SUITES, _done(spark, sf))
    return work.select("run_slug", "checkpoint", "training_step", "suite", "phase", F.array_join("tasks", ",").alias("tasks"))


def evaluation_worklist_smoke(spark, sf):
    work = E.evaluation_worklist(
        _checkpoints(spark, sf), SUITES, _done(spark, sf), phase="smoke", steps=list(range(1, 21)), force=True
    )
    return work.select("run_slug", "checkpoint", "training_step", "suite", "phase", F.array_join("tasks", ",").alias("tasks"))


def _attempts(spark, sf):
    e = F.col("event_id")
    code = F.when(e % 9 == 0, 127).when(e % 4 == 0, 1).otherwise(0)
    return A.table(spark, sf, "events").select(e.alias("evaluation"), code.alias("return_code"), (e % 5).alias("result_files"))


def evaluation_status(spark, sf):
    return E.evaluation_status(_attempts(spark, sf))


def failure_count(spark, sf):
    return E.failure_count(E.evaluation_status(_attempts(spark, sf)))


def latest_results(spark, sf):
    files = A.table(spark, sf, "events").select(
        F.col("user_id").alias("evaluation"), F.format_string("results_%d.json", "event_id").alias("path"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mtime"),
    )
    return E.latest_results(files)


def extract_metrics(spark, sf):
    return E.extract_metrics(_entries(spark, sf)).select("evaluation", "task", F.col("key").alias("metric"), "value")


def pair_stderr(spark, sf):
    return E.pair_stderr(_entries(spark, sf)).select("evaluation", "task", "metric", "value", "stderr")


def metrics_table(spark, sf):
    return _table(spark, sf)


def metric_series(spark, sf):
    return E.metric_series(_table(spark, sf))


QUERIES = {f.__name__: f for f in (
    slug, discover_checkpoints, slug_collisions, latest_checkpoint, suite_tasks, evaluation_worklist,
    evaluation_worklist_smoke, evaluation_status, failure_count, latest_results, extract_metrics, pair_stderr,
    metrics_table, metric_series,
)}


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _slug(column: str, fallback: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({column}, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), ''), '{fallback}')"


def _tasks(table: dict[str, list[str]]) -> str:
    return ", ".join(f"('{s}', '{','.join(table[s])}')" for s in SUITES if table[s])


ORACLES = {
    "slug": f"SELECT page_id, {_slug('url', 'run')} AS url_slug, md5({_slug('html', 'metric')}) AS html_slug FROM pages",
    "discover_checkpoints": _with(A.CHECKPOINT_FILES_SQL, """
        SELECT run_name, run_slug, run_path, path, epoch, checkpoint_step, training_step FROM checkpoints"""),
    "slug_collisions": _with(A.CHECKPOINT_FILES_SQL, """
        SELECT run_slug, count(DISTINCT run_path) AS runs, min(run_path) AS first_run, max(run_path) AS last_run
        FROM checkpoints GROUP BY run_slug HAVING count(DISTINCT run_path) > 1"""),
    "latest_checkpoint": """
        WITH f AS (
          SELECT '/runs/u' || user_id AS root, user_id AS u,
                 CASE WHEN event_id % 10 = 9 THEN 'LATEST' ELSE 'epoch_' || user_id % 2 || '_step_' || event_id % 12 END AS name,
                 CASE event_type WHEN 'click' THEN 'optim' WHEN 'error' THEN 'step' ELSE 'model' END AS item, event_id % 12 AS step
          FROM events),
        s AS (SELECT root, name, any_value(u) AS u, any_value(step) AS step FROM f GROUP BY root, name HAVING count(DISTINCT item) = 3),
        r AS (SELECT *, CASE WHEN name = 'LATEST' THEN 3 WHEN u % 5 = 0 AND name = 'epoch_0_step_3' THEN 2 ELSE 1 END AS priority FROM s),
        b AS (SELECT root, arg_max(name, (priority, step)) AS name FROM r GROUP BY root)
        SELECT root, root || '/' || name AS path, name, CASE WHEN name IS NULL THEN 'no training checkpoint found' END AS problem
        FROM (SELECT DISTINCT root FROM f) LEFT JOIN b USING (root)""",
    "suite_tasks": "WITH t AS (" + " UNION ALL ".join(
        f"SELECT '{s}' AS suite, {i} AS position, '{t}' AS task, {str(t in E.GENERATIVE_TASKS[s]).lower()} AS generative"
        for s in SUITES for i, t in enumerate(E.SUITES[s])
    ) + """)
        SELECT suite, position, task, generative, evaluations FROM t
        JOIN (SELECT ['pretrain', 'instruct', 'instruct-retention'][event_id % 3 + 1] AS suite, count(*) AS evaluations
              FROM events GROUP BY 1) USING (suite)""",
    "evaluation_worklist": _with(A.CHECKPOINT_FILES_SQL, f"""
        SELECT run_slug, checkpoint, training_step, suite, 'full' AS phase, tasks FROM (
          SELECT run_slug, regexp_extract(path, '[^/]*$') AS checkpoint, training_step, checkpoint_step,
                 suite, tasks FROM checkpoints, (VALUES {_tasks(E.SUITES)}) s(suite, tasks)) w
        WHERE NOT (suite = 'pretrain' AND (run_slug, checkpoint) IN (
          SELECT (run_slug, regexp_extract(path, '[^/]*$')) FROM checkpoints
          WHERE checkpoint_step % 3 = 0 AND checkpoint_step % 2 > 0))"""),
    "evaluation_worklist_smoke": _with(A.CHECKPOINT_FILES_SQL, f"""
        SELECT run_slug, regexp_extract(path, '[^/]*$') AS checkpoint, training_step, suite, 'smoke' AS phase, tasks
        FROM checkpoints, (VALUES {_tasks(E.GENERATIVE_TASKS)}) s(suite, tasks) WHERE training_step <= 20"""),
    "evaluation_status": """
        SELECT evaluation, return_code, result_files,
               CASE WHEN return_code = 0 AND result_files > 0 THEN 'complete' ELSE 'failed' END AS status,
               CASE WHEN return_code = 0 AND result_files = 0 THEN 'finished without result files' END AS error
        FROM (SELECT event_id AS evaluation, CASE WHEN event_id % 9 = 0 THEN 127 WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS return_code,
                     event_id % 5 AS result_files FROM events)""",
    "failure_count": """
        SELECT count(*) FILTER (event_id % 9 = 0 OR event_id % 4 = 0 OR event_id % 5 = 0) AS failures, count(*) AS evaluations FROM events""",
    "latest_results": """
        SELECT user_id AS evaluation, arg_max('results_' || event_id || '.json', (ts, 'results_' || event_id || '.json')) AS path,
               strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS mtime FROM events GROUP BY user_id""",
    "extract_metrics": _with(A.METRICS_SQL, "SELECT evaluation, task, metric, value FROM metrics"),
    "pair_stderr": _with(A.METRICS_SQL, "SELECT evaluation, task, metric, value, stderr FROM metrics"),
    "metrics_table": _with(A.METRICS_SQL, """
        SELECT run, suite, task, metric, step, value, stderr, checkpoint, result_file FROM metrics"""),
    "metric_series": _with(A.METRICS_SQL, """
        SELECT suite, task, metric, run, step, value,
               CASE WHEN bool_or(stderr IS NOT NULL) OVER (PARTITION BY suite, task, metric, run) THEN coalesce(stderr, 0) END AS error_bar
        FROM metrics"""),
}
