"""Scaling studies: grids, near-optimal trials and power laws.

``trials`` has one row per trial: study, trial, state, value and the map
``params``. All studies are analysed in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numbers import finite_positive, geometric_points, is_finite
from tokenloom.functions.text import general_number
from tokenloom.operators.prefix import running_total

PARAMETERS = ("learning_rate", "global_batch_size")
DEFAULT_MARGIN = 0.0025
CURVE_POINTS = 200
# Trials with equal parameters are numbered in ranges of this size.
TRIAL_RANGE = 65_536


def compute_budget(num_parameters: Column, num_tokens: Column) -> Column:
    """Training cost C = 6 N D."""
    valid = (num_parameters > 0) & (num_tokens > 0)
    failed = F.raise_error("model size and tokens must be positive").cast("double")
    return F.when(valid, F.lit(6.0) * num_parameters * num_tokens).otherwise(failed)


def tokens_for_compute(compute_flops: Column, num_parameters: Column) -> Column:
    """Tokens that a FLOP target pays for, at least one; halves go to even."""
    valid = finite_positive(compute_flops) & (num_parameters > 0)
    failed = F.raise_error("compute and model size must be positive").cast("long")
    nearest = F.bround(compute_flops / (F.lit(6.0) * num_parameters), 0).cast("long")
    return F.when(valid, F.greatest(F.lit(1).cast("long"), nearest)).otherwise(failed)


def scaling_points(sizes: DataFrame, compute_flops: Sequence[float]) -> DataFrame:
    """Every model size with every FLOP target.

    ``sizes``: model_size, num_parameters and any columns to carry along. The
    targets are a short configured list and are exploded, not joined.
    """
    targets = F.array(*[F.lit(float(c)) for c in compute_flops])
    points = sizes.withColumn("compute_flops", F.explode(targets))
    flops = F.concat(general_number(F.col("compute_flops")), F.lit("flops"))
    return (
        points.withColumn("num_tokens", tokens_for_compute(F.col("compute_flops"), F.col("num_parameters")))
        .withColumn("name", F.concat_ws("_", "model_size", flops))
        .withColumn(
            "study",
            F.concat_ws("_", "model_size", F.concat(F.col("num_parameters").cast("string"), F.lit("p")), flops),
        )
    )


def search_grid(points: DataFrame, learning_rates: Sequence[float], batch_sizes: Sequence[int]) -> DataFrame:
    """Every candidate of every study."""
    rates = F.array(*[F.lit(float(x)) for x in learning_rates])
    batches = F.array(*[F.lit(int(x)) for x in batch_sizes])
    return points.withColumn("learning_rate", F.explode(rates)).withColumn("global_batch_size", F.explode(batches))


def remaining_trials(grid: DataFrame, trials: DataFrame, cap: int) -> DataFrame:
    """Trials each study may still add; any state counts as used."""
    if cap < 0:
        raise ValueError("cap must not be negative")
    sizes = grid.groupBy("study").agg(F.count("*").alias("grid_size"))
    used = trials.groupBy("study").agg(F.count("*").alias("trials"))
    left = F.least(F.lit(cap), F.col("grid_size")) - F.coalesce("trials", F.lit(0))
    return sizes.join(used, "study", "left").select(
        "study", "grid_size", F.coalesce("trials", F.lit(0)).alias("trials"),
        F.greatest(left, F.lit(0)).cast("long").alias("remaining"),
    )


def unvisited_cells(grid: DataFrame, trials: DataFrame) -> DataFrame:
    """Grid cells no trial of the study has taken."""
    taken = trials.select(
        "study", *[F.try_element_at("params", F.lit(p)).alias(p) for p in PARAMETERS]
    ).distinct()
    return grid.join(taken, ["study", *PARAMETERS], "left_anti")


def local_batch_candidates(df: DataFrame) -> DataFrame:
    """Per-device batch sizes, halved down to one, that divide the global one.

    ``df``: configured, global_batch, world. ``problem`` says why a row has
    no candidates.
    """
    positive = (F.col("configured") > 0) & (F.col("global_batch") > 0) & (F.col("world") > 0)
    whole = positive & (F.pmod(F.col("global_batch"), F.greatest("world", F.lit(1))) == 0)
    start = F.least(F.col("configured"), F.floor(F.col("global_batch") / F.greatest("world", F.lit(1)))).cast("int")
    halved = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftright", start, i))
    usable = F.filter(
        halved, lambda b: (b >= 1) & (F.pmod(F.col("global_batch"), F.greatest(b * F.col("world"), F.lit(1))) == 0)
    )
    problem = F.when(~positive, "sizes must be positive").when(
        ~whole, "global batch size is not divisible by world size"
    )
    return df.withColumn("problem", problem).withColumn("candidates", F.when(problem.isNull(), usable))


def final_losses(logs: DataFrame) -> DataFrame:
    """The last finite loss of each run in line order; ``problem`` if none."""
    finite = is_finite(F.col("val_loss"))
    last = F.max_by("val_loss", F.when(finite, F.col("line_no"))).alias("val_loss")
    return logs.groupBy("run").agg(last).withColumn(
        "problem", F.when(F.col("val_loss").isNull(), "no finite val_loss")
    )


def _finished() -> Column:
    return (F.col("state") == "COMPLETE") & is_finite(F.col("value"))


def completed_trials(trials: DataFrame) -> DataFrame:
    """Finished trials with a finite loss and both searched parameters."""
    has_all = F.lit(True)
    for name in PARAMETERS:
        has_all = has_all & F.coalesce(F.map_contains_key("params", name), F.lit(False))
    return trials.where(_finished() & has_all)


def store_problems(trials: DataFrame) -> DataFrame:
    """Stores that do not hold exactly one study with completed trials."""
    usable = completed_trials(trials).groupBy("store").agg(F.count("*").alias("completed"))
    studies = trials.groupBy("store").agg(F.count_distinct("study").alias("studies"))
    problem = F.when(F.col("studies") != 1, "expected one study").when(
        F.col("completed").isNull(), "no completed trials"
    )
    return (
        studies.join(usable, "store", "left")
        .select("store", "studies", F.coalesce("completed", F.lit(0)).alias("completed"), problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def near_optimal(trials: DataFrame, margin: float = DEFAULT_MARGIN) -> DataFrame:
    """Finished trials within ``margin`` of the lowest loss of their study.

    The minimum is a partial aggregate joined back, so a study with most of
    the trials is not gathered in one task.
    """
    if margin < 0:
        raise ValueError("margin must not be negative")
    finished = trials.where(_finished())
    best = finished.groupBy("study").agg(F.min("value").alias("best_value"))
    return finished.join(best, "study").where(F.col("value") <= F.col("best_value") * F.lit(1.0 + margin))


def representative_params(trials: DataFrame, names: Sequence[str] = PARAMETERS) -> DataFrame:
    """Geometric median of each parameter per study.

    Equal values are counted first; the median then sees one row per distinct
    value, however many trials share it.
    """
    values = trials.select("study", F.explode("params").alias("name", "x")).where(F.col("name").isin(*names))
    counted = values.groupBy("study", "name", "x").agg(F.count("*").alias("n"))
    medians = counted.groupBy("study", "name").agg(F.exp(F.percentile(F.ln("x"), 0.5, F.col("n"))).alias("median"))
    wide = [F.max(F.when(F.col("name") == n, F.col("median"))).alias(f"near_optimal_{n}") for n in names]
    return medians.groupBy("study").agg(*wide)


def best_trials(trials: DataFrame) -> DataFrame:
    """Lowest loss per study, the earliest trial on ties."""
    best = F.min_by(F.struct("trial", "value", "params"), F.struct("value", "trial")).alias("best")
    return trials.where(_finished()).groupBy("study").agg(best).select("study", "best.*")


def missing_studies(points: DataFrame, trials: DataFrame) -> DataFrame:
    return points.join(trials.select("study").distinct(), "study", "left_anti")


def best_settings(
    points: DataFrame, trials: DataFrame, margin: float = DEFAULT_MARGIN, weight_decay: float = 0.1, strict: bool = False
) -> DataFrame:
    """One row per scale point: best trial and near-optimal region."""
    if strict:
        lost = missing_studies(points, trials).select("study").take(1)
        if lost:
            raise ValueError(f"study does not exist: {lost[0]['study']}")
    selected = near_optimal(trials, margin)
    sizes = selected.groupBy("study").agg(F.count("*").alias("near_optimal_trials"))
    best = best_trials(trials).withColumnRenamed("value", "best_validation_loss")
    joined = points.join(best, "study").join(sizes, "study").join(representative_params(selected), "study")
    return joined.select(
        "name",
        "num_parameters",
        "num_tokens",
        "compute_flops",
        compute_budget(F.col("num_parameters"), F.col("num_tokens")).alias("actual_compute_flops"),
        "best_validation_loss",
        "near_optimal_trials",
        F.col("params")["learning_rate"].alias("best_learning_rate"),
        F.lit(float(weight_decay)).alias("fixed_weight_decay"),
        F.col("params")["global_batch_size"].cast("long").alias("best_global_batch_size"),
        "near_optimal_learning_rate",
        "near_optimal_global_batch_size",
    )


def fit_power_law(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x per group: y = coefficient * x ** exponent.

    ``ln_coefficient`` is kept too: a steep law may have a coefficient beyond the range of doubles.
    ``problem`` replaces the fit of groups that cannot be fitted.
    """
    valid = finite_positive(F.col(x)) & finite_positive(F.col(y))
    log_x, log_y = F.when(valid, F.ln(x)), F.when(valid, F.ln(y))
    fits = df.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.count_if(~valid).alias("invalid"),
        F.regr_slope(log_y, log_x).alias("slope"),
        F.regr_intercept(log_y, log_x).alias("intercept"),
        F.regr_r2(log_y, log_x).alias("r2"),
    )
    problem = (
        F.when(F.col("points") < 2, "at least two points are required")
        .when(F.col("invalid") > 0, "points must be finite and positive")
        .when(F.col("slope").isNull(), "all x are equal")
    )
    fitted = problem.isNull()
    return fits.select(
        *by,
        "points",
        F.when(fitted, F.exp("intercept")).alias("coefficient"),
        F.when(fitted, F.col("intercept")).alias("ln_coefficient"),
        F.when(fitted, F.col("slope")).alias("exponent"),
        F.when(fitted, F.col("r2")).alias("r_squared"),
        problem.alias("problem"),
    )


LAW_VARIABLES = {
    "learning_rate": "near_optimal_learning_rate",
    "global_batch_size": "near_optimal_global_batch_size",
    "validation_loss": "best_validation_loss",
}


def power_laws_by_size(settings: DataFrame, strict: bool = False) -> DataFrame:
    """A law in C for each model size and variable."""
    variables = F.explode(F.map_from_arrays(
        F.array(*[F.lit(v) for v in LAW_VARIABLES]),
        F.array(*[F.col(c).cast("double") for c in LAW_VARIABLES.values()]),
    )).alias("variable", "value")
    long = settings.select("num_parameters", "compute_flops", variables)
    laws = fit_power_law(long, ["num_parameters", "variable"], "compute_flops", "value")
    if strict:
        failed = laws.where(F.col("problem").isNotNull()).orderBy("num_parameters").take(1)
        if failed:
            raise ValueError(f"{failed[0]['problem']} for model size {failed[0]['num_parameters']}")
    return laws


def predict_power_law(laws: DataFrame, settings: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """Each law along its model size's range of C."""
    ranges = settings.groupBy("num_parameters").agg(
        F.min("compute_flops").alias("low"), F.max("compute_flops").alias("high")
    )
    curve = geometric_points(F.col("low"), F.col("high"), points)
    return (
        laws.where(F.col("problem").isNull())
        .join(ranges, "num_parameters")
        .select("num_parameters", "variable", "ln_coefficient", "exponent", F.posexplode(curve).alias("point", "compute_flops"))
        .withColumn("predicted", F.exp(F.col("ln_coefficient") + F.col("exponent") * F.ln("compute_flops")))
        .drop("ln_coefficient", "exponent")
    )


def best_overall(settings: DataFrame, scale_order: Sequence[str] = ("num_parameters", "compute_flops")) -> DataFrame:
    """The scale point with the lowest loss, the first one on ties."""
    key = F.struct("best_validation_loss", *scale_order)
    return settings.agg(F.min_by(F.struct(*settings.columns), key).alias("best")).select("best.*")


def trial_series(trials: DataFrame, x: str, group: str) -> DataFrame:
    """Completed trials grouped by one parameter, numbered along the other."""
    series = completed_trials(trials).select(
        "study",
        "trial",
        "value",
        F.col("params")[group].alias("group_value"),
        F.col("params")[x].alias("x_value"),
    )
    ranged = series.withColumn("_range", F.struct("x_value", F.floor(F.col("trial") / TRIAL_RANGE).alias("part")))
    return running_total(
        ranged, group=["study", "group_value"], bucket="_range", order=["trial"], value=F.lit(1), name="point"
    ).drop("_range")


def law_report(laws: DataFrame) -> DataFrame:
    """Equation text of each law, and the payload as JSON."""
    equation = F.concat(
        F.col("variable"), F.lit(" = "), general_number(F.col("coefficient")), F.lit(" * C^"),
        general_number(F.col("exponent")),
    )
    payload = F.to_json(F.struct(
        "coefficient", "exponent", F.col("r_squared").alias("r_squared_log_space"), equation.alias("equation")
    ))
    return laws.where(F.col("problem").isNull()).select(
        "num_parameters", "variable", equation.alias("equation"), payload.alias("payload")
    )
