"""Run schedules: token budgets to steps, warm-up and final decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numbers import ceil_div, finite_positive

WARMUP_SHARE = 0.2


def billions_to_tokens(billions: Column) -> Column:
    """Whole tokens of a budget in billions, exact, rounded up."""
    exact = billions.cast("decimal(28,18)")
    tokens = F.ceil(exact * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long")
    failed = F.raise_error("a token budget must be finite and positive").cast("long")
    return F.when(finite_positive(billions.cast("double")), tokens).otherwise(failed)


def token_schedule(runs: DataFrame) -> DataFrame:
    """Steps that spend ``num_tokens``, and the schedule over them.

    ``runs``: num_tokens, global_batch, seq_len, warmup_cap, decay_ratio, lr,
    lr_percentage. Validation runs once, at the last step.
    """
    per_step = F.col("global_batch").cast("long") * F.col("seq_len")
    decay = F.bround(F.col("max_steps") * F.col("decay_ratio"), 0).cast("long")
    return (
        runs.withColumn("max_steps", ceil_div(F.col("num_tokens"), per_step))
        .withColumn(
            "warmup_steps", F.least(F.ceil(F.col("max_steps") * F.lit(WARMUP_SHARE)), F.col("warmup_cap")).cast("long")
        )
        .withColumn("decay_steps", F.when(F.col("decay_ratio") > 0, F.greatest(decay, F.lit(1).cast("long"))).otherwise(decay))
        .withColumn("decay_end", F.col("max_steps"))
        .withColumn("min_lr", F.col("lr") * F.col("lr_percentage") / 100.0)
        .withColumn("validation_step", F.col("max_steps"))
    )


def _reasons(**checks: Column) -> Column:
    """Texts of the checks that fail; an undecided check has failed too."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(text.replace("_", " "))) for text, ok in checks.items()]
    return F.array_compact(F.array(*found))


def schedule_errors(runs: DataFrame) -> DataFrame:
    """Runs whose settings cannot make a schedule, with every reason."""
    local = F.col("local_batch")
    reasons = _reasons(
        lr_percentage_must_be_between_0_and_100=F.col("lr_percentage").between(0.0, 100.0),
        decay_ratio_must_be_between_0_and_1=F.col("decay_ratio").between(0.0, 1.0),
        num_tokens_must_be_positive=F.col("num_tokens") > 0,
        global_batch_must_be_positive=F.col("global_batch") > 0,
        seq_len_must_be_positive=F.col("seq_len") > 0,
        warmup_cap_must_not_be_negative=F.col("warmup_cap") >= 0,
        local_batch_must_be_positive=local > 0,
        local_batch_must_divide_global_batch=(local <= 0)
        | (F.pmod(F.col("global_batch").cast("long"), F.greatest(local.cast("long"), F.lit(1).cast("long"))) == 0),
    )
    return runs.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def ablation_schedule(runs: DataFrame, states: DataFrame, strict: bool = False) -> DataFrame:
    """Continue runs from a saved state for additional tokens.

    ``runs``: run, ablation_tokens, global_batch, seq_len, configured_decay
    (null or 0 when not set), derived_decay, num_epochs. ``states``: run,
    step, epoch. The decay keeps its length unless the budget is shorter.
    """
    joined = runs.join(states, "run")
    positive = (F.col("ablation_tokens") > 0) & (F.col("global_batch") > 0) & (F.col("seq_len") > 0)
    usable = F.coalesce(positive, F.lit(False))
    additional = F.when(usable, ceil_div(F.col("ablation_tokens"), F.col("global_batch").cast("long") * F.col("seq_len")))
    decay = F.when(F.col("configured_decay") > 0, F.col("configured_decay")).otherwise(
        F.coalesce("derived_decay", F.lit(0))
    ).cast("long")
    problem = F.when(~usable, "tokens, batch and length must be positive").when(
        F.coalesce(F.col("step") < 0, F.lit(True)), "saved step must not be negative"
    ).when(
        F.col("original_decay") <= 0, "a positive decay duration is required"
    )
    planned = (
        joined.withColumn("additional_steps", additional)
        .withColumn("original_decay", decay)
        .select(
            "run",
            "additional_steps",
            (F.col("step") + F.col("additional_steps")).cast("long").alias("max_steps"),
            F.least("original_decay", "additional_steps").alias("decay_steps"),
            F.lit(0).alias("warmup_steps"),
            F.greatest(
                F.coalesce("num_epochs", F.lit(1)).cast("long"), F.col("epoch") + F.col("additional_steps") + 1
            ).alias("num_epochs"),
            problem.alias("problem"),
        )
    )
    if strict:
        failed = planned.where(F.col("problem").isNotNull()).orderBy("run").take(1)
        if failed:
            raise ValueError(f"run {failed[0]['run']}: {failed[0]['problem']}")
    return planned


def lr_curve(runs: DataFrame) -> DataFrame:
    """The learning rate of every step: rise, plateau, linear final decay.

    ``runs``: run, max_steps, warmup_steps, decay_steps, lr, min_lr.
    """
    steps = runs.where(F.col("max_steps") > 0).withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_steps"))))
    decay_start = F.col("max_steps") - F.col("decay_steps")
    share = (F.col("step") - decay_start) / F.greatest(F.col("decay_steps"), F.lit(1))
    rate = (
        F.when(F.col("step") <= F.col("warmup_steps"), F.col("lr") * F.col("step") / F.greatest("warmup_steps", F.lit(1)))
        .when(F.col("step") > decay_start, F.col("lr") + (F.col("min_lr") - F.col("lr")) * share)
        .otherwise(F.col("lr"))
    )
    return steps.select("run", "step", rate.alias("learning_rate"))
