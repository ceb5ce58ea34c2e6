"""Schedule queries over ``orders`` read as training budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import schedules as S
from tokenloom.plans import adapters as A


def _valid(spark, sf):
    """Budgets whose settings make a schedule; the others are schedule_errors."""
    budgets = A.budgets(spark, sf)
    return budgets.join(S.schedule_errors(budgets).select("run"), "run", "left_anti")


def billions_to_tokens(spark, sf):
    return A.budgets(spark, sf).select("run", S.billions_to_tokens(F.col("billions")).alias("num_tokens"))


def token_schedule(spark, sf):
    schedule = S.token_schedule(_valid(spark, sf))
    return schedule.select("run", "max_steps", "warmup_steps", "decay_steps", "decay_end", "validation_step", "min_lr")


def schedule_errors(spark, sf):
    return S.schedule_errors(A.budgets(spark, sf)).select("run", F.array_join("reasons", "; ").alias("reasons"))


def ablation_schedule(spark, sf):
    k = F.col("run")
    planned = S.token_schedule(_valid(spark, sf)).select(
        "run", F.when(k % 37 == 0, -F.col("global_batch")).otherwise(F.col("global_batch")).alias("global_batch"), "seq_len",
        F.when(k % 41 == 0, 0).otherwise(k * 131 + 5).alias("ablation_tokens"),
        F.when(k % 4 == 0, k % 9).alias("configured_decay"), F.col("decay_steps").alias("derived_decay"),
        F.when(k % 3 != 0, k % 20).alias("num_epochs"),
    )
    states = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"),
        (F.col("o_custkey") - F.when(F.col("o_custkey") % 50 == 0, 5000).otherwise(0)).alias("step"),
        (F.col("o_custkey") % 3).alias("epoch"),
    )
    return S.ablation_schedule(planned, states)


def lr_curve(spark, sf):
    return S.lr_curve(S.token_schedule(_valid(spark, sf)))


QUERIES = {f.__name__: f for f in (billions_to_tokens, token_schedule, schedule_errors, ablation_schedule, lr_curve)}

CHECKED = A.BUDGETS_SQL + """,
checked AS (
  SELECT *, concat_ws('; ',
      CASE WHEN NOT lr_percentage BETWEEN 0 AND 100 THEN 'lr percentage must be between 0 and 100' END,
      CASE WHEN NOT decay_ratio BETWEEN 0 AND 1 THEN 'decay ratio must be between 0 and 1' END,
      CASE WHEN num_tokens <= 0 THEN 'num tokens must be positive' END,
      CASE WHEN global_batch <= 0 THEN 'global batch must be positive' END,
      CASE WHEN seq_len <= 0 THEN 'seq len must be positive' END,
      CASE WHEN warmup_cap < 0 THEN 'warmup cap must not be negative' END,
      CASE WHEN local_batch <= 0 THEN 'local batch must be positive' END,
      CASE WHEN local_batch > 0 AND global_batch % local_batch <> 0 THEN 'local batch must divide global batch' END) AS reasons
  FROM budgets),
planned AS (
  SELECT *, least(CAST(ceil(max_steps * 0.2::DOUBLE) AS BIGINT), warmup_cap) AS warmup_steps,
         CASE WHEN decay_ratio > 0 THEN greatest(1, CAST(round_even(max_steps * decay_ratio, 0) AS BIGINT))
              ELSE CAST(round_even(max_steps * decay_ratio, 0) AS BIGINT) END AS decay_steps,
         lr * lr_percentage / 100 AS min_lr
  FROM (SELECT *, (num_tokens + global_batch * seq_len - 1) // (global_batch * seq_len) AS max_steps FROM checked WHERE reasons = ''))"""

ORACLES = {
    "billions_to_tokens": f"WITH {A.BUDGETS_SQL} SELECT run, CAST((run + 1 + 999) // 1000 AS BIGINT) AS num_tokens FROM budgets",
    "token_schedule": f"""WITH {CHECKED}
        SELECT run, max_steps, warmup_steps, decay_steps, max_steps AS decay_end, max_steps AS validation_step, min_lr FROM planned""",
    "schedule_errors": f"WITH {CHECKED} SELECT run, reasons FROM checked WHERE reasons <> ''",
    "ablation_schedule": f"""WITH {CHECKED}
        SELECT run, extra AS additional_steps, step + extra AS max_steps, least(decay, extra) AS decay_steps, 0 AS warmup_steps,
               greatest(epochs, epoch + extra + 1) AS num_epochs,
               CASE WHEN extra IS NULL THEN 'tokens, batch and length must be positive'
                    WHEN step < 0 THEN 'saved step must not be negative'
                    WHEN decay <= 0 THEN 'a positive decay duration is required' END AS problem
        FROM (SELECT p.run, CASE WHEN p.run % 37 <> 0 AND p.run % 41 <> 0
                          THEN (p.run * 131 + 5 + global_batch * seq_len - 1) // (global_batch * seq_len) END AS extra,
                     CASE WHEN p.run % 4 = 0 AND p.run % 9 > 0 THEN p.run % 9 ELSE decay_steps END AS decay,
                     CASE WHEN p.run % 3 <> 0 THEN p.run % 20 ELSE 1 END AS epochs,
                     o_custkey - CASE WHEN o_custkey % 50 = 0 THEN 5000 ELSE 0 END AS step, o_custkey % 3 AS epoch
              FROM planned p JOIN orders o ON o.o_orderkey = p.run)""",
    "lr_curve": f"""WITH {CHECKED}
        SELECT run, step, CASE WHEN step <= warmup_steps THEN lr * step / warmup_steps
                                     WHEN step > max_steps - decay_steps
                                     THEN lr + (min_lr - lr) * ((step - (max_steps - decay_steps)) / decay_steps::DOUBLE)
                                     ELSE lr END AS learning_rate
        FROM (SELECT *, unnest(range(1, max_steps + 1)) AS step FROM planned)""",
}
