"""Views of the given tables in the shapes the operators take.

Every adapter exists twice, as a DataFrame and as DuckDB SQL over the same
tables, and uses whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import word_count
from tokenloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream. The table may be one file or a folder of files: a pattern,
    here one that fits this name alone, stands for both."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a word count as the supplied token count."""
    return as_corpus(documents(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def as_corpus(docs: DataFrame) -> DataFrame:
    """Words are counted by a generator: unlike a plain expression, its result
    is not computed again by every later filter."""
    counted = docs.select("doc_id", "text", "lang", "source", F.inline(F.array(F.struct(word_count(F.col("text")).alias("token_count")))))
    return counted.select("doc_id", "text", "lang", "source", F.struct("token_count").alias("metadata"))


CORPUS_SQL = r"""corpus AS (
  SELECT doc_id, text, lang, source,
         CAST(len(regexp_extract_all(text, '[^ \n\t\r]+', 0)) AS BIGINT) AS token_count
  FROM documents)"""


def bad_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with some token counts lost, negated or zeroed, and some ids lost or repeated."""
    case = F.pmod("doc_id", F.lit(50))
    identifier = F.when(case == 12, F.col("doc_id") + 1).when(case != 11, F.col("doc_id"))
    count = F.col("metadata.token_count")
    damaged = (
        F.when(case == 8, F.lit(None)).when(case == 9, -1 - count).when(case == 10, F.lit(0)).otherwise(count)
    )
    metadata = F.when(case != 7, F.struct(damaged.cast("long").alias("token_count")))
    return corpus(spark, sf_dir).withColumn("metadata", metadata).withColumn("doc_id", identifier)


BAD_CORPUS_SQL = CORPUS_SQL + """,
bad_corpus AS (
  SELECT CASE WHEN doc_id % 50 = 12 THEN doc_id + 1 WHEN doc_id % 50 <> 11 THEN doc_id END AS doc_id,
         text, doc_id % 50 <> 7 AS has_metadata,
         CASE WHEN doc_id % 50 IN (7, 8) THEN NULL
              WHEN doc_id % 50 = 9 THEN -1 - token_count
              WHEN doc_id % 50 = 10 THEN 0
              ELSE token_count END AS token_count
  FROM corpus)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a second corpus, one document per turn."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        "text",
        F.struct(word_count(F.col("text")).alias("token_count")).alias("metadata"),
    )


TURNS_SQL = r"""turns AS (
  SELECT conv_id * 1000 + turn AS doc_id, text,
         CAST(len(regexp_extract_all(text, '[^ \n\t\r]+', 0)) AS BIGINT) AS token_count
  FROM conversations)"""


def _pick(values: list, index) -> Column:
    """A value from a short list by a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as trials of 20 studies: 4 model sizes by 5 FLOP targets."""
    n, key = F.col("o_custkey") % 20, F.col("o_orderkey")
    size = F.floor(n / 5)
    return table(spark, sf_dir, "orders").select(
        F.format_string("m%d_%dp_1e+%dflops", size, 1_000_000 * (1 + size), 15 + n % 5).alias("study"),
        key.alias("trial"),
        F.when(F.col("o_orderstatus") == "O", "FAIL").otherwise("COMPLETE").alias("state"),
        (1 + F.col("o_totalprice") / 1e5).alias("value"),
        F.create_map(
            F.lit("learning_rate"), _pick([0.1, 0.01, 0.001, 0.0001], key % 4),
            F.lit("global_batch_size"), _pick([4.0, 8.0, 16.0, 32.0, 64.0], F.floor(key / 4) % 5),
        ).alias("params"),
        n.alias("study_no"),
    )


TRIALS_SQL = """trials AS (
  SELECT 'm' || n // 5 || '_' || 1000000 * (1 + n // 5) || 'p_1e+' || (15 + n % 5) || 'flops' AS study,
         o_orderkey AS trial, CASE WHEN o_orderstatus = 'O' THEN 'FAIL' ELSE 'COMPLETE' END AS state,
         1 + o_totalprice / 1e5 AS value,
         CAST([0.1, 0.01, 0.001, 0.0001][o_orderkey % 4 + 1] AS DOUBLE) AS learning_rate,
         CAST([4, 8, 16, 32, 64][o_orderkey // 4 % 5 + 1] AS DOUBLE) AS global_batch_size,
         n AS study_no, n // 5 AS size_no, 1000000 * (1 + n // 5) AS num_parameters,
         CAST('1e' || (15 + n % 5) AS DOUBLE) AS compute_flops
  FROM (SELECT *, o_custkey % 20 AS n FROM orders))"""

COMPUTE_FLOPS = [1e15, 1e16, 1e17, 1e18, 1e19]
LEARNING_RATES = [0.1, 0.01, 0.001, 0.0001, 0.00001]
BATCH_SIZES = [4, 8, 16, 32, 64, 128]


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model sizes of the studies."""
    size = F.floor((F.col("o_custkey") % 20) / 5)
    return table(spark, sf_dir, "orders").select(
        F.format_string("m%d", size).alias("model_size"), (1_000_000 * (1 + size)).alias("num_parameters")
    ).distinct()


POINTS_SQL = TRIALS_SQL + """,
points AS (
  SELECT s.num_parameters, s.model_size, c.compute_flops, c.label,
         s.model_size || '_' || c.label || 'flops' AS name,
         s.model_size || '_' || s.num_parameters || 'p_' || c.label || 'flops' AS study,
         greatest(1, CAST(round_even(c.compute_flops / (6.0::DOUBLE * s.num_parameters), 0) AS BIGINT)) AS num_tokens
  FROM (SELECT DISTINCT 'm' || size_no AS model_size, num_parameters FROM trials) s,
       (VALUES (1e15::DOUBLE, '1e+15'), (1e16, '1e+16'), (1e17, '1e+17'), (1e18, '1e+18'), (1e19, '1e+19')) c(compute_flops, label)),
grid AS (
  SELECT p.*, CAST(lr AS DOUBLE) AS learning_rate, batch AS global_batch_size
  FROM points p, (SELECT unnest([0.1, 0.01, 0.001, 0.0001, 0.00001]) AS lr), (SELECT unnest([4, 8, 16, 32, 64, 128]) AS batch))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user of ``events``, settings by arithmetic on the id."""
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    steps = 20 + u % 12
    return users.select(
        u.alias("run"),
        (4 * (1 + u % 3)).alias("global_batch"),
        (16 * (1 + u % 2)).alias("seq_len"),
        steps.alias("max_steps"),
        (u % 5).alias("warmup_steps"),
        steps.alias("decay_end"),
        (u % 6).alias("decay_steps"),
        _pick([0.001, 0.002, 0.003], u % 3).alias("lr"),
        F.when(u % 31 == 0, "cosine").otherwise("wsd").alias("decay_style"),
    )


RUNS_SQL = """runs AS (
  SELECT user_id AS run, 4 * (1 + user_id % 3) AS global_batch, 16 * (1 + user_id % 2) AS seq_len,
         20 + user_id % 12 AS max_steps, user_id % 5 AS warmup_steps, 20 + user_id % 12 AS decay_end,
         user_id % 6 AS decay_steps, CAST([0.001, 0.002, 0.003][user_id % 3 + 1] AS DOUBLE) AS lr,
         CASE WHEN user_id % 31 = 0 THEN 'cosine' ELSE 'wsd' END AS decay_style
  FROM (SELECT DISTINCT user_id FROM events))"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as validation records; steps repeat inside a run, some
    records are damaged and some losses are not finite."""
    return as_logs(table(spark, sf_dir, "events"))


def as_logs(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    step = F.dayofmonth("ts") - 1
    loss = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(e % 83 == 0, F.lit(None)).otherwise(
        2 + F.col("value") / 1000
    )
    base = _pick([0.001, 0.002, 0.003], u % 3)
    return events.select(
        u.alias("run"),
        e.alias("line_no"),
        F.when(e % 97 == 0, -1.0).when(e % 89 == 0, step + 0.5).otherwise(step).cast("double").alias("step"),
        loss.alias("val_loss"),
        F.when(e % 11 == 0, base * 1.5).when(e % 4 != 0, base).alias("lr"),
        (e % 79 == 0).alias("malformed"),
    )


LOGS_SQL = """logs AS (
  SELECT user_id AS run, event_id AS line_no,
         CAST(CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 89 = 0 THEN day(ts) - 0.5 ELSE day(ts) - 1 END AS DOUBLE) AS step,
         CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE WHEN event_id % 83 = 0 THEN NULL ELSE 2 + value / 1000 END AS val_loss,
         CASE WHEN event_id % 11 = 0 THEN [0.001, 0.002, 0.003][user_id % 3 + 1]::DOUBLE * 1.5::DOUBLE
              WHEN event_id % 4 <> 0 THEN [0.001, 0.002, 0.003][user_id % 3 + 1]::DOUBLE END AS lr,
         event_id % 79 = 0 AS malformed
  FROM events),
good AS (SELECT * FROM logs WHERE NOT malformed AND step >= 0 AND step = floor(step) AND val_loss IS NOT NULL),
latest AS (
  SELECT run, CAST(step AS BIGINT) AS step, arg_max(val_loss, line_no) AS val_loss,
         arg_max(struct_pack(lr := lr), line_no).lr AS lr
  FROM good GROUP BY run, step)"""


def law_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves that follow a known law: one point per active day of a user."""
    u = F.col("run")
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.to_date("ts").alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("run").orderBy("day"))
    floor, amplitude = 1 + (u % 5) * 0.25, 2 + (u % 7) * 0.5
    exponent = _pick([0.2, 0.3, 0.45, 0.6, 0.9], u % 5)
    return days.select("run", rank.alias("t")).select(
        "run",
        (F.col("t") * 1_000_000).cast("long").alias("tokens"),
        (floor + amplitude * F.pow(F.col("t").cast("double"), -exponent)).alias("loss"),
    )


LAW_POINTS_SQL = """days AS (
  SELECT run, row_number() OVER (PARTITION BY run ORDER BY day) AS t
  FROM (SELECT DISTINCT user_id AS run, CAST(ts AS DATE) AS day FROM events)),
laws AS (
  SELECT user_id AS run, 1 + (user_id % 5) * 0.25::DOUBLE AS floor, 2 + (user_id % 7) * 0.5::DOUBLE AS amplitude,
         CAST([0.2, 0.3, 0.45, 0.6, 0.9][user_id % 5 + 1] AS DOUBLE) AS exponent
  FROM (SELECT DISTINCT user_id FROM events)),
law_points AS (
  SELECT run, t * 1000000 AS tokens, floor + amplitude * pow(CAST(t AS DOUBLE), -exponent) AS loss
  FROM days JOIN laws USING (run))"""


def law_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits with known coefficients, ten studies of many runs."""
    u = F.col("run")
    return runs(spark, sf_dir).select(
        (u % 10).alias("study"),
        "run",
        u.alias("trial"),
        (1 + (u % 5) * 0.25).alias("floor"),
        (2 + (u % 7) * 0.5).alias("amplitude"),
        _pick([0.2, 0.3, 0.45, 0.6, 0.9], u % 5).alias("exponent"),
        F.lit(64.0).alias("reference_tokens"),
        F.when(u % 10 == 9, 0.5).otherwise(_pick([0.949999, 0.95, 0.99], u % 3)).alias("r_squared"),
    )


LAW_FITS_SQL = RUNS_SQL + """,
fits AS (
  SELECT run % 10 AS study, run, run AS trial, 1 + (run % 5) * 0.25::DOUBLE AS floor, 2 + (run % 7) * 0.5::DOUBLE AS amplitude,
         CAST([0.2, 0.3, 0.45, 0.6, 0.9][run % 5 + 1] AS DOUBLE) AS exponent, 64.0::DOUBLE AS reference_tokens,
         CASE WHEN run % 10 = 9 THEN 0.5::DOUBLE ELSE CAST([0.949999, 0.95, 0.99][run % 3 + 1] AS DOUBLE) END AS r_squared
  FROM runs)"""


def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as files of saved states; some run names collide as slugs."""
    u, e = F.col("user_id"), F.col("event_id")
    item = F.when(F.col("event_type") == "click", "optim/x").when(
        F.col("event_type") == "error", "step_scheduler.pt"
    ).otherwise("model/x")
    gap = F.when(e % 2 == 0, " ").otherwise("-")
    return table(spark, sf_dir, "events").select(
        F.concat(
            F.format_string("/runs/g%d/u", u % 7), gap, F.format_string("%d/checkpoints/epoch_%d_step_%d/", u % 40, e % 3, e % 50), item
        ).alias("path")
    )


CHECKPOINT_FILES_SQL = """files AS (
  SELECT '/runs/g' || user_id % 7 || '/u' || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '-' END || user_id % 40
         || '/checkpoints/epoch_' || event_id % 3 || '_step_' || event_id % 50 || '/'
         || CASE event_type WHEN 'click' THEN 'optim/x' WHEN 'error' THEN 'step_scheduler.pt' ELSE 'model/x' END AS path
  FROM events),
checkpoints AS (
  SELECT DISTINCT regexp_extract(path, '^/runs/(.*)/checkpoints/', 1) AS run_name,
         replace(replace(regexp_extract(path, '^/runs/(.*)/checkpoints/', 1), '/', '--'), ' ', '-') AS run_slug,
         regexp_extract(path, '^(.*)/checkpoints/', 1) AS run_path,
         regexp_extract(path, '^(.*)/model/', 1) AS path,
         CAST(regexp_extract(path, 'epoch_([0-9]+)_', 1) AS BIGINT) AS epoch,
         CAST(regexp_extract(path, '_step_([0-9]+)/', 1) AS BIGINT) AS checkpoint_step,
         CAST(regexp_extract(path, '_step_([0-9]+)/', 1) AS BIGINT) + 1 AS training_step
  FROM files WHERE path LIKE '%/model/%')"""


def evaluations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests and result files: one evaluation per event."""
    e, v = F.col("event_id"), F.col("value")
    events = table(spark, sf_dir, "events")
    manifests = events.select(
        e.alias("evaluation"),
        F.format_string("u%d", F.col("user_id")).alias("run_name"),
        F.lit("pretrain").alias("suite"),
        F.when(e % 7 == 0, "smoke").otherwise("full").alias("phase"),
        F.when(e % 5 == 0, "failed").otherwise("complete").alias("status"),
        (e % 1000 + 1).alias("training_step"),
        F.format_string("/runs/u%d/epoch_0_step_%d", F.col("user_id"), e % 1000).alias("checkpoint"),
    )
    body = F.concat(
        F.lit('{"results":{"'), F.col("event_type"), F.lit('":{"alias":"x","acc,none":'), v.cast("string"),
        F.lit(',"acc_stderr,none":'), F.when(e % 3 == 0, '"N/A"').otherwise((v / 2).cast("string")),
        F.lit(',"flag,none":true,"N":10,"count,strict":'), (e % 4).cast("string"),
        F.lit(',"lost,none":'), F.when(e % 6 == 0, "NaN").otherwise("null"), F.lit('},"note":"text"}}'),
    )
    results = events.select(
        e.alias("evaluation"), F.format_string("results_%d.json", e).alias("path"), body.alias("content")
    )
    return manifests, results


def user_evaluations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests and result texts, one evaluation for each user: every kind of
    event is a task, scored by its largest value."""
    u, task = F.col("user_id"), F.col("event_type")
    by_task = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.max("value").cast("string").alias("top"), F.min("value").cast("string").alias("low"), F.count("*").alias("n")
    )
    error = F.when(u % 3 == 0, '"N/A"').otherwise(F.col("low"))
    entry = F.concat(
        F.lit('"'), task, F.lit('":{"alias":"x","acc,none":'), F.col("top"), F.lit(',"acc_stderr,none":'), error,
        F.lit(',"N":'), F.col("n").cast("string"), F.lit("}"),
    )
    users = by_task.groupBy(u.alias("folder")).agg(
        F.sum("n").alias("training_step"), F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("tasks")
    )
    f = F.col("folder")
    manifests = users.select(
        f, F.format_string("u%d", f).alias("run_name"), F.lit("pretrain").alias("suite"),
        F.when(f % 7 == 0, "smoke").otherwise("full").alias("phase"),
        F.when(f % 5 == 0, "failed").otherwise("complete").alias("status"),
        "training_step", F.format_string("/runs/u%d", f).alias("checkpoint"),
    )
    return manifests, users.select(f, F.concat(F.lit('{"results":{'), "tasks", F.lit("}}")).alias("value"))


METRICS_SQL = """metrics AS (
  SELECT event_id AS evaluation, 'u' || user_id AS run, 'pretrain' AS suite, event_type AS task, m.metric,
         event_id % 1000 + 1 AS step, CASE m.metric WHEN 'acc,none' THEN value ELSE CAST(event_id % 4 AS DOUBLE) END AS value,
         CASE WHEN m.metric = 'acc,none' AND event_id % 3 <> 0 THEN value / 2 END AS stderr,
         '/runs/u' || user_id || '/epoch_0_step_' || event_id % 1000 AS checkpoint, 'results_' || event_id || '.json' AS result_file
  FROM events, (VALUES ('acc,none'), ('count,strict')) m(metric)
  WHERE event_id % 7 <> 0 AND event_id % 5 <> 0)"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training budget per order, for the schedule operators."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run"),
        F.concat(F.lit("0."), F.lpad((k + 1).cast("string"), 12, "0")).cast("decimal(28,18)").alias("billions"),
        (k % 100 * 977 + 1).alias("num_tokens"),
        (8 * (k % 5 - F.when(k % 101 == 0, 5).otherwise(-1))).alias("global_batch"),
        (128 * (k % 3 + 1)).alias("seq_len"),
        (k % 60 - 1).alias("warmup_cap"),
        ((k % 13) / 10.0).alias("decay_ratio"),
        _pick([0.0003, 0.001, 0.02], k % 3).alias("lr"),
        (k % 105 - 1.0).alias("lr_percentage"),
        (k % 7).alias("local_batch"),
    )


BUDGETS_SQL = """budgets AS (
  SELECT o_orderkey AS run, CAST('0.' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 12, '0') AS DECIMAL(28, 18)) AS billions,
         o_orderkey % 100 * 977 + 1 AS num_tokens,
         8 * (o_orderkey % 5 - CASE WHEN o_orderkey % 101 = 0 THEN 5 ELSE -1 END) AS global_batch,
         128 * (o_orderkey % 3 + 1) AS seq_len, o_orderkey % 60 - 1 AS warmup_cap, (o_orderkey % 13) / 10.0::DOUBLE AS decay_ratio,
         CAST([0.0003, 0.001, 0.02][o_orderkey % 3 + 1] AS DOUBLE) AS lr, o_orderkey % 105 - 1.0::DOUBLE AS lr_percentage,
         o_orderkey % 7 AS local_batch
  FROM orders)"""
