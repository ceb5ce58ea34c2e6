"""Scaling-study queries over ``orders`` read as trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import studies as H
from tokenloom.plans import adapters as A

MARGIN = 0.05


def _points(spark, sf):
    return H.scaling_points(A.sizes(spark, sf), A.COMPUTE_FLOPS)


def _grid(spark, sf):
    return H.search_grid(_points(spark, sf), A.LEARNING_RATES, A.BATCH_SIZES)


def _customer_trials(spark, sf):
    """All trials, with a study for each customer."""
    owner = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("trial"), F.format_string("c%d", "o_custkey").alias("study"))
    return A.trials(spark, sf).drop("study").join(owner, "trial")


def _customer_grid(trials):
    return H.search_grid(trials.select("study").distinct(), A.LEARNING_RATES, A.BATCH_SIZES)


def _settings(spark, sf):
    return H.best_settings(_points(spark, sf), A.trials(spark, sf), MARGIN)


def _params(names=H.PARAMETERS):
    return [F.col("params")[n].alias(n) for n in names]


def compute_budget(spark, sf):
    points = _points(spark, sf)
    return points.select("study", H.compute_budget(F.col("num_parameters"), F.col("num_tokens")).alias("budget"))


def tokens_for_compute(spark, sf):
    orders = A.table(spark, sf, "orders")
    cost, size = F.col("o_totalprice") * 3.0, F.col("o_custkey") + 1
    return orders.select("o_orderkey", H.tokens_for_compute(cost, size).alias("num_tokens"))


def scaling_points(spark, sf):
    return _points(spark, sf).select("name", "study", "model_size", "num_parameters", "compute_flops", "num_tokens")


def search_grid(spark, sf):
    return _grid(spark, sf).select("study", "learning_rate", "global_batch_size")


def remaining_trials(spark, sf):
    """What each customer, read as a study, may still add to its grid."""
    trials = _customer_trials(spark, sf)
    return H.remaining_trials(_customer_grid(trials), trials, 40)


def unvisited_cells(spark, sf):
    trials = _customer_trials(spark, sf)
    return H.unvisited_cells(_customer_grid(trials), trials).select("study", "learning_rate", "global_batch_size")


def local_batch_candidates(spark, sf):
    k = F.col("o_orderkey")
    rows = A.table(spark, sf, "orders").select(
        k.alias("run"),
        (k % 37).cast("int").alias("configured"),
        (8 * (1 + k % 16)).cast("int").alias("global_batch"),
        (1 + k % 4).cast("int").alias("world"),
    )
    text = F.array_join(F.col("candidates").cast("array<string>"), ",")
    return H.local_batch_candidates(rows).select("run", text.alias("candidates"), "problem")


def final_losses(spark, sf):
    return H.final_losses(A.logs(spark, sf)).select("run", "val_loss", "problem")


def completed_trials(spark, sf):
    return H.completed_trials(A.trials(spark, sf)).select("study", "trial", "value", *_params())


def store_problems(spark, sf):
    n = F.col("study_no")
    stores = A.trials(spark, sf).withColumn("store", F.when(n < 12, n).otherwise(n - n % 4))
    return H.store_problems(stores.withColumn("state", F.when(n % 6 == 5, "FAIL").otherwise(F.col("state"))))


def near_optimal(spark, sf):
    return H.near_optimal(A.trials(spark, sf), MARGIN).select("study", "trial", "value", "best_value")


def representative_params(spark, sf):
    medians = H.representative_params(H.near_optimal(A.trials(spark, sf), MARGIN))
    rounded = [F.round(F.ln(f"near_optimal_{n}"), 6).alias(f"ln_{n}") for n in H.PARAMETERS]
    return medians.select("study", *rounded)


def best_trials(spark, sf):
    return H.best_trials(A.trials(spark, sf)).select("study", "trial", "value", *_params())


def best_settings(spark, sf):
    rounded = [F.round(f"near_optimal_{n}", 9).alias(f"near_optimal_{n}") for n in H.PARAMETERS]
    settings = _settings(spark, sf)
    return settings.select(*[c for c in settings.columns if c not in ("near_optimal_learning_rate", "near_optimal_global_batch_size")], *rounded)


def missing_studies(spark, sf):
    archived = F.when(F.col("study_no") % 3 == 0, F.concat(F.lit("archive-"), "study")).otherwise(F.col("study"))
    return H.missing_studies(_points(spark, sf), A.trials(spark, sf).withColumn("study", archived)).select("name", "study")


def fit_power_law(spark, sf):
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date"))
    rows = A.table(spark, sf, "orders").select(
        "o_custkey", day.cast("double").alias("x"), (F.col("o_totalprice") - 2000).alias("y")
    )
    laws = H.fit_power_law(rows, ["o_custkey"], "x", "y")
    return laws.select(
        "o_custkey", "points", F.round("ln_coefficient", 5).alias("ln_coefficient"),
        F.round("exponent", 6).alias("exponent"), F.round("r_squared", 6).alias("r_squared"), "problem",
    )


def power_laws_by_size(spark, sf):
    laws = H.power_laws_by_size(_settings(spark, sf))
    return laws.select(
        "num_parameters", "variable", F.round("ln_coefficient", 6).alias("ln_coefficient"),
        (F.round("exponent", 6) + 0.0).alias("exponent"), F.round("r_squared", 6).alias("r_squared"),
    )


def predict_power_law(spark, sf):
    settings = _settings(spark, sf)
    curve = H.predict_power_law(H.power_laws_by_size(settings), settings)
    return curve.select(
        "num_parameters", "variable", "point", F.round(F.ln("compute_flops"), 6).alias("ln_compute"),
        F.round(F.ln("predicted"), 6).alias("ln_predicted"),
    )


def best_overall(spark, sf):
    return H.best_overall(_settings(spark, sf)).select(
        "name", "num_parameters", "num_tokens", "best_validation_loss", "best_learning_rate", "best_global_batch_size"
    )


def trial_series(spark, sf):
    return H.trial_series(A.trials(spark, sf), "global_batch_size", "learning_rate").select(
        "study", "group_value", "x_value", "trial", "point"
    )


def trial_series_by_batch(spark, sf):
    return H.trial_series(A.trials(spark, sf), "learning_rate", "global_batch_size").select(
        "study", "group_value", "x_value", "trial", "point"
    )


def law_report(spark, sf):
    laws = H.fit_power_law(
        A.trials(spark, sf).select("study", (F.col("trial") + 1.0).alias("x"), "value"), ["study"], "x", "value"
    )
    named = laws.select(F.col("study").alias("variable"), F.lit(1).alias("num_parameters"), "coefficient", "exponent", "r_squared", "problem")
    return H.law_report(named).select("variable", "equation")


QUERIES = {f.__name__: f for f in (
    compute_budget, tokens_for_compute, scaling_points, search_grid, remaining_trials, unvisited_cells,
    local_batch_candidates, final_losses, completed_trials, store_problems, near_optimal, representative_params,
    best_trials, best_settings, missing_studies, fit_power_law, power_laws_by_size, predict_power_law, best_overall,
    trial_series, trial_series_by_batch, law_report,
)}

NEAR = A.TRIALS_SQL + f""",
finished AS (SELECT * FROM trials WHERE state = 'COMPLETE' AND value IS NOT NULL AND isfinite(value)),
near AS (
  SELECT *, min(value) OVER (PARTITION BY study) AS best_value FROM finished
  QUALIFY value <= min(value) OVER (PARTITION BY study) * (1.0 + {MARGIN})::DOUBLE),
medians AS (
  SELECT study, median(ln(learning_rate)) AS ln_learning_rate, median(ln(global_batch_size)) AS ln_global_batch_size,
         count(*) AS near_optimal_trials
  FROM near GROUP BY study),
best AS (SELECT * FROM finished QUALIFY row_number() OVER (PARTITION BY study ORDER BY value, trial) = 1)"""

SETTINGS = A.POINTS_SQL + "," + NEAR.removeprefix(A.TRIALS_SQL + ",") + """,
settings AS (
  SELECT p.name, p.num_parameters, p.num_tokens, p.compute_flops, 6.0::DOUBLE * p.num_parameters * p.num_tokens AS actual_compute_flops,
         b.value AS best_validation_loss, m.near_optimal_trials, b.learning_rate AS best_learning_rate,
         0.1::DOUBLE AS fixed_weight_decay, CAST(b.global_batch_size AS BIGINT) AS best_global_batch_size,
         exp(m.ln_learning_rate) AS near_optimal_learning_rate, exp(m.ln_global_batch_size) AS near_optimal_global_batch_size
  FROM points p JOIN best b USING (study) JOIN medians m USING (study)),
laws AS (
  SELECT num_parameters, variable, regr_intercept(ln(v), ln(compute_flops)) AS a, regr_slope(ln(v), ln(compute_flops)) AS b,
         coalesce(regr_r2(ln(v), ln(compute_flops)), 1) AS r2
  FROM (SELECT num_parameters, compute_flops, 'learning_rate' AS variable, near_optimal_learning_rate AS v FROM settings
        UNION ALL SELECT num_parameters, compute_flops, 'global_batch_size', near_optimal_global_batch_size FROM settings
        UNION ALL SELECT num_parameters, compute_flops, 'validation_loss', best_validation_loss FROM settings)
  GROUP BY num_parameters, variable)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _series(x: str, group: str) -> str:
    return _with(NEAR, f"""
        SELECT study, {group} AS group_value, {x} AS x_value, trial,
               row_number() OVER (PARTITION BY study, {group} ORDER BY {x}, trial) AS point FROM finished""")


ORACLES = {
    "compute_budget": _with(A.POINTS_SQL, "SELECT study, 6.0::DOUBLE * num_parameters * num_tokens AS budget FROM points"),
    "tokens_for_compute": """
        SELECT o_orderkey, greatest(1, CAST(round_even(o_totalprice * 3.0::DOUBLE / (6.0::DOUBLE * (o_custkey + 1)), 0) AS BIGINT)) AS num_tokens
        FROM orders""",
    "scaling_points": _with(A.POINTS_SQL, "SELECT name, study, model_size, num_parameters, compute_flops, num_tokens FROM points"),
    "search_grid": _with(A.POINTS_SQL, "SELECT study, learning_rate, global_batch_size FROM grid"),
    "remaining_trials": """
        SELECT 'c' || o_custkey AS study, CAST(30 AS BIGINT) AS grid_size, count(*) AS trials, greatest(0, 30 - count(*)) AS remaining
        FROM orders GROUP BY o_custkey""",
    "unvisited_cells": _with(A.TRIALS_SQL, """
        SELECT 'c' || o_custkey AS study, CAST(lr AS DOUBLE) AS learning_rate, batch AS global_batch_size
        FROM (SELECT DISTINCT o_custkey FROM orders) c,
             (SELECT unnest([0.1, 0.01, 0.001, 0.0001, 0.00001]) AS lr), (SELECT unnest([4, 8, 16, 32, 64, 128]) AS batch)
        WHERE NOT EXISTS (SELECT 1 FROM trials t JOIN orders o ON o.o_orderkey = t.trial
                          WHERE o.o_custkey = c.o_custkey AND t.learning_rate = CAST(lr AS DOUBLE) AND t.global_batch_size = batch)"""),
    "local_batch_candidates": """
        WITH RECURSIVE r AS (SELECT o_orderkey AS run, o_orderkey % 37 AS configured, 8 * (1 + o_orderkey % 16) AS g, 1 + o_orderkey % 4 AS w FROM orders),
        halves AS (
          SELECT run, g, w, least(configured, g // w) AS b FROM r WHERE configured > 0 AND g % w = 0
          UNION ALL SELECT run, g, w, b // 2 FROM halves WHERE b > 1)
        SELECT run, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b DESC) FILTER (b >= 1 AND g % (b * w) = 0) AS candidates,
               any_value(CASE WHEN configured <= 0 THEN 'sizes must be positive'
                    WHEN r.g % r.w <> 0 THEN 'global batch size is not divisible by world size' END) AS problem
        FROM r LEFT JOIN halves h USING (run, g, w) GROUP BY run""",
    "final_losses": _with(A.LOGS_SQL, """
        SELECT run, arg_max(val_loss, line_no) FILTER (val_loss IS NOT NULL AND isfinite(val_loss)) AS val_loss,
               CASE WHEN count(*) FILTER (val_loss IS NOT NULL AND isfinite(val_loss)) = 0 THEN 'no finite val_loss' END AS problem
        FROM logs GROUP BY run"""),
    "completed_trials": _with(NEAR, "SELECT study, trial, value, learning_rate, global_batch_size FROM finished"),
    "store_problems": _with(A.TRIALS_SQL, """
        SELECT * FROM (
          SELECT CASE WHEN study_no < 12 THEN study_no ELSE study_no - study_no % 4 END AS store, count(DISTINCT study) AS studies,
                 count(*) FILTER (state = 'COMPLETE' AND study_no % 6 <> 5) AS completed,
                 CASE WHEN studies <> 1 THEN 'expected one study' WHEN completed = 0 THEN 'no completed trials' END AS problem
          FROM trials GROUP BY 1) WHERE problem IS NOT NULL"""),
    "near_optimal": _with(NEAR, "SELECT study, trial, value, best_value FROM near"),
    "representative_params": _with(NEAR, """
        SELECT study, round(ln_learning_rate, 6) AS ln_learning_rate, round(ln_global_batch_size, 6) AS ln_global_batch_size FROM medians"""),
    "best_trials": _with(NEAR, "SELECT study, trial, value, learning_rate, global_batch_size FROM best"),
    "best_settings": _with(SETTINGS, """
        SELECT * REPLACE (round(near_optimal_learning_rate, 9) AS near_optimal_learning_rate,
                          round(near_optimal_global_batch_size, 9) AS near_optimal_global_batch_size) FROM settings"""),
    "missing_studies": _with(A.POINTS_SQL, """
        SELECT name, study FROM points WHERE study NOT IN (SELECT CASE WHEN study_no % 3 = 0 THEN 'archive-' || study ELSE study END FROM trials)"""),
    "fit_power_law": """
        WITH r AS (SELECT o_custkey, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x,
                          o_totalprice - 2000 AS y FROM orders),
        f AS (SELECT o_custkey, count(*) AS points, count(*) FILTER (NOT (x > 0 AND y > 0)) AS invalid,
                     regr_slope(ln(y), ln(x)) FILTER (x > 0 AND y > 0) AS b, regr_intercept(ln(y), ln(x)) FILTER (x > 0 AND y > 0) AS a,
                     regr_r2(ln(y), ln(x)) FILTER (x > 0 AND y > 0) AS r2, count(DISTINCT x) AS xs
              FROM r GROUP BY o_custkey),
        p AS (SELECT *, CASE WHEN points < 2 THEN 'at least two points are required'
                             WHEN invalid > 0 THEN 'points must be finite and positive'
                             WHEN xs < 2 THEN 'all x are equal' END AS problem FROM f)
        SELECT o_custkey, points, CASE WHEN problem IS NULL THEN round(a, 5) END AS ln_coefficient,
               CASE WHEN problem IS NULL THEN round(b, 6) END AS exponent,
               CASE WHEN problem IS NULL THEN round(r2, 6) END AS r_squared, problem
        FROM p""",
    "power_laws_by_size": _with(SETTINGS, """
        SELECT num_parameters, variable, round(a, 6) AS ln_coefficient, round(b, 6) + 0.0::DOUBLE AS exponent, round(r2, 6) AS r_squared FROM laws"""),
    "predict_power_law": _with(SETTINGS, """
        SELECT num_parameters, variable, CAST(i AS INTEGER) AS point, round(lo + (hi - lo) * i / 199, 6) AS ln_compute,
               round(a + b * (lo + (hi - lo) * i / 199), 6) AS ln_predicted
        FROM laws JOIN (SELECT num_parameters, ln(min(compute_flops)) AS lo, ln(max(compute_flops)) AS hi FROM settings GROUP BY num_parameters)
             USING (num_parameters), range(200) t(i)"""),
    "best_overall": _with(SETTINGS, """
        SELECT name, num_parameters, num_tokens, best_validation_loss, best_learning_rate, best_global_batch_size
        FROM settings ORDER BY best_validation_loss, num_parameters, compute_flops LIMIT 1"""),
    "trial_series": _series("global_batch_size", "learning_rate"),
    "trial_series_by_batch": _series("learning_rate", "global_batch_size"),
    "law_report": _with(A.TRIALS_SQL, """
        SELECT study AS variable, study || ' = ' || printf('%.6g', exp(regr_intercept(ln(value), ln(trial + 1.0::DOUBLE)))) || ' * C^'
               || printf('%.6g', regr_slope(ln(value), ln(trial + 1.0::DOUBLE))) AS equation
        FROM trials GROUP BY study"""),
}
