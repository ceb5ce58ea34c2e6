"""Validation-loss curves: cleaning, classification, fits and forecasts.

``logs`` has one row per record: run, line_no, step, val_loss, lr and
``malformed`` (the record could not be read). ``runs`` has one row per run
with its schedule. A run is one trial of a study.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.numbers import finite_positive, geometric_points
from tokenloom.session import stage

LR_TOLERANCE = 1e-5
MIN_FIT_POINTS = 4
LOWEST_EXPONENT, HIGHEST_EXPONENT = 0.01, 3.0
GRID_POINTS = 161
GRID_ROUNDS = 5
PIECE_POINTS = 100_000  # a longer curve is summed in several tasks
CHUNK_POINTS = 4096  # points of a curve that are raised to a grid of exponents at once
RUN_STATS = ("run", "n", "reference_tokens", "mean_loss", "var_loss")
MIN_R_SQUARED = 0.95
FORECAST_POINTS = 200
FITTED_POINTS = 100


def record_problem() -> Column:
    """Why a record cannot be used, or null."""
    step = F.col("step")
    return (
        F.when(F.col("malformed"), "record cannot be read")
        .when(step.isNull() | (step < 0) | (step != F.floor(step)), "step is no whole number from 0")
        .when(F.col("val_loss").isNull(), "val_loss must be a number")
    )


def invalid_records(logs: DataFrame) -> DataFrame:
    problem = record_problem()
    return logs.select("run", "line_no", problem.alias("problem")).where(F.col("problem").isNotNull())


def latest_by_step(logs: DataFrame) -> DataFrame:
    """One record per run and step: the last line supersedes earlier ones."""
    last = F.max_by(F.struct("val_loss", "lr"), "line_no").alias("last")
    good = logs.where(record_problem().isNull())
    return good.groupBy("run", F.col("step").cast("long").alias("step")).agg(last).select("run", "step", "last.*")


def curve_points(latest: DataFrame, runs: DataFrame, fit_start_fraction: float = 0.0) -> DataFrame:
    """Usable points in tokens, each with the reason it is or is not fitted."""
    if not 0 <= fit_start_fraction < 1:
        raise ValueError("fit_start_fraction must be in [0, 1)")
    schedule = runs.select(
        "run", "global_batch", "seq_len", "max_steps", "warmup_steps", "decay_end", "decay_steps",
        F.col("lr").alias("base_lr"),
    )
    joined = latest.where(finite_positive(F.col("val_loss"))).join(schedule, "run")
    completed = F.col("step") + 1
    lr = F.coalesce("lr", "base_lr")
    off_plateau = F.abs(lr - F.col("base_lr")) > F.lit(LR_TOLERANCE) * F.greatest(F.abs(lr), F.abs("base_lr"))
    reason = (
        F.when(completed > F.col("max_steps"), "outside_run")
        .when(completed <= F.col("warmup_steps"), "warmup")
        .when(completed > F.col("decay_end") - F.col("decay_steps"), "final_decay")
        .when(completed < F.lit(float(fit_start_fraction)) * F.col("max_steps"), "before_fit_start")
        .when(off_plateau, "non_plateau_lr")
        .otherwise("fit")
    )
    return joined.select(
        "run",
        "step",
        (completed * F.col("global_batch") * F.col("seq_len")).cast("long").alias("tokens"),
        F.col("val_loss").alias("loss"),
        (reason == "fit").alias("used_for_fit"),
        reason.alias("reason"),
    )


def invalid_runs(runs: DataFrame) -> DataFrame:
    """Runs whose schedule cannot be used, with every reason."""
    positive = F.lit(True)
    for name in ("global_batch", "seq_len", "max_steps", "decay_end"):
        positive = positive & (F.col(name) > 0)
    checks = {
        "schedule is not warm-up, plateau, decay": F.upper("decay_style") == "WSD",
        "batch, length, steps and decay end must be positive": positive,
        "decay must lie within the run": F.col("decay_steps").between(0, F.col("decay_end")),
        "warm-up must lie within the run": F.col("warmup_steps").between(0, F.col("decay_end")),
        "lr must be finite and positive": finite_positive(F.col("lr")),
    }
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()]
    return runs.select("run", F.array_compact(F.array(*found)).alias("reasons")).where(F.size("reasons") > 0)


def run_summary(runs: DataFrame) -> DataFrame:
    per_step = F.col("global_batch").cast("long") * F.col("seq_len")
    return runs.select(
        "run",
        (F.col("max_steps") * per_step).alias("planned_tokens"),
        ((F.col("decay_end") - F.col("decay_steps")) * per_step).alias("decay_start_tokens"),
    )


def select_attempt(configs: DataFrame, trials: DataFrame) -> DataFrame:
    """The saved configuration of each trial's successful attempt.

    ``configs``: study, trial, path (``.../attempt_NN_.../config.yaml``).
    ``trials``: study, trial and the map ``attrs``; a recorded
    ``batch_size_attempts`` fixes the attempt, otherwise the last path wins.
    """
    recorded = F.try_element_at("attrs", F.lit("batch_size_attempts")).cast("int")
    wanted = trials.select("study", "trial", F.format_string("attempt_%02d_", recorded - 1).alias("prefix"), recorded.alias("_k"))
    attempt = F.element_at(F.split("path", "/"), -2)
    matches = (
        configs.withColumn("attempt", attempt)
        .join(wanted, ["study", "trial"], "right")
        .withColumn("_ok", F.col("attempt").startswith("attempt_") & (F.col("_k").isNull() | F.col("attempt").startswith(F.col("prefix"))))
    )
    chosen = matches.groupBy("study", "trial").agg(F.max(F.when(F.col("_ok"), F.col("path"))).alias("path"))
    return chosen.withColumn(
        "problem", F.when(F.col("path").isNull(), "no saved configuration for the completed attempt")
    )


def fit_eligibility(points: DataFrame) -> DataFrame:
    """Whether the fit points of each run can determine a curve.

    ``points``: run, tokens, loss - the points used for fitting.
    """
    valid = finite_positive(F.col("tokens").cast("double")) & finite_positive(F.col("loss"))
    stats = points.groupBy("run").agg(
        F.count("*").alias("points"),
        F.count_distinct("tokens").alias("distinct_tokens"),
        F.count_if(~valid).alias("invalid"),
        F.covar_pop(F.when(valid, F.ln("tokens")), F.when(valid, F.col("loss"))).alias("trend"),
    )
    problem = (
        F.when(F.col("points") < MIN_FIT_POINTS, "need at least four points")
        .when(
            (F.col("invalid") > 0) | (F.col("distinct_tokens") < F.col("points")),
            "fit needs distinct tokens and positive finite values",
        )
        .when(F.col("trend") >= 0, "no decreasing trend")
    )
    return stats.select("run", "points", problem.isNull().alias("eligible"), problem.alias("problem"))


def eligible_points(points: DataFrame) -> DataFrame:
    fit = points.where(F.col("used_for_fit")).select("run", "tokens", "loss")
    return fit.join(fit_eligibility(fit).where("eligible").select("run"), "run", "left_semi")


def _pieces(points: DataFrame) -> DataFrame:
    """One row for each run, or for each piece of a long one: its points, and what is known of the whole run.

    ``points`` is a list of (log of tokens over the run's first, loss).
    """
    stats = points.groupBy("run").agg(
        F.count("*").alias("n"),
        F.min("tokens").cast("double").alias("reference_tokens"),
        F.avg("loss").alias("mean_loss"),
        F.var_pop("loss").alias("var_loss"),
    )
    log_ratio = F.ln(F.col("tokens") / F.col("reference_tokens")).alias("log_ratio")
    piece = F.pmod(F.hash("tokens"), F.ceil(F.col("n") / PIECE_POINTS))
    joined = points.join(stats, "run").withColumn("piece", piece)
    grouped = joined.groupBy(*RUN_STATS, "piece").agg(F.collect_list(F.struct(log_ratio, F.col("loss").cast("double").alias("loss"))).alias("points"))
    return grouped.select(*RUN_STATS, "points")


def _exponents(low: float, high: float) -> np.ndarray:
    grid = low + np.arange(GRID_POINTS) * ((high - low) / (GRID_POINTS - 1))
    grid[-1] = high
    return grid


@dataclass
class _Moments:
    """Sums over points, one for every exponent p of a grid, with x = (tokens / reference) ** -p.

    Co-moments are about the means, so that pieces can be put together.
    """

    n: int
    mean_y: float
    mean_x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    sum_xx: np.ndarray
    sum_xy: np.ndarray

    @classmethod
    def of(cls, log_ratio: np.ndarray, loss: np.ndarray, exponents: np.ndarray) -> _Moments:
        whole = None
        for first in range(0, len(loss), CHUNK_POINTS):
            y = loss[first : first + CHUNK_POINTS]
            x = np.exp(-np.multiply.outer(exponents, log_ratio[first : first + CHUNK_POINTS]))
            mean_x, mean_y = x.mean(axis=1), float(y.mean())
            apart = x - mean_x[:, None]
            own = cls(len(y), mean_y, mean_x, (apart * apart).sum(axis=1), (apart * (y - mean_y)).sum(axis=1), (x * x).sum(axis=1), (x * y).sum(axis=1))
            whole = own if whole is None else whole.with_(own)
        return whole

    def with_(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        weight, shift = self.n * other.n / n, other.mean_x - self.mean_x
        return _Moments(
            n,
            self.mean_y + (other.mean_y - self.mean_y) * other.n / n,
            self.mean_x + shift * (other.n / n),
            self.xx + other.xx + shift * shift * weight,
            self.xy + other.xy + shift * (other.mean_y - self.mean_y) * weight,
            self.sum_xx + other.sum_xx,
            self.sum_xy + other.sum_xy,
        )

    def best(self, mean_loss: float, var_loss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least error, floor and amplitude at every exponent.

        For a fixed exponent the model is linear: the best of a floor alone, an amplitude alone, and
        both where neither is negative. The error follows from the moments.
        """
        var_x, cov = self.xx / self.n, self.xy / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(var_x > 0, cov / var_x, np.nan)
        intercept = mean_loss - slope * self.mean_x
        none = np.zeros_like(var_x)
        floors = np.stack([none + mean_loss, none, intercept])
        amplitudes = np.stack([none, self.sum_xy / self.sum_xx, slope])
        miss = mean_loss - floors - amplitudes * self.mean_x
        errors = np.maximum(self.n * (miss * miss + var_loss - 2 * amplitudes * cov + amplitudes * amplitudes * var_x), 0.0)
        errors[2] = np.where((intercept >= 0) & (slope >= 0), errors[2], np.inf)
        first = np.lexsort((amplitudes, floors, errors), axis=0)[0]
        at = np.arange(len(var_x))
        return errors[first, at], floors[first, at], amplitudes[first, at]


def _points_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    points = batch.column("points")[i].values
    return points.field(0).to_numpy(), points.field(1).to_numpy()


_FIT = [(n, pa.float64()) for n in ("floor", "amplitude", "exponent", "sse")]


def _fit_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rounds of the fit of every run that is one row."""
    for batch in batches:
        rows = []
        for i, (mean, var) in enumerate(zip(batch.column("mean_loss").to_pylist(), batch.column("var_loss").to_pylist())):
            log_ratio, loss = _points_of(batch, i)
            low, high = LOWEST_EXPONENT, HIGHEST_EXPONENT
            for _ in range(GRID_ROUNDS):
                grid = _exponents(low, high)
                errors, floors, amplitudes = _Moments.of(log_ratio, loss, grid).best(mean, var)
                k = int(errors.argmin())
                low, high = float(grid[max(k - 1, 0)]), float(grid[min(k + 1, GRID_POINTS - 1)])
            rows.append((floors[k], amplitudes[k], grid[k], errors[k]))
        columns = list(zip(*rows)) if rows else [[]] * len(_FIT)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in RUN_STATS), *(pa.array(c, k) for c, (_, k) in zip(columns, _FIT))], [*RUN_STATS, *(n for n, _ in _FIT)]
        )


_VECTORS = ("mean_x", "xx", "xy", "sum_xx", "sum_xy")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of every piece over the grid of its run."""
    for batch in batches:
        found = []
        for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())):
            found.append(_Moments.of(*_points_of(batch, i), _exponents(low, high)))
        columns = [batch.column(c) for c in (*RUN_STATS, "low", "high")]
        columns += [pa.array([m.n for m in found], pa.int64()), pa.array([m.mean_y for m in found], pa.float64())]
        columns += [pa.array([getattr(m, v) for m in found], pa.list_(pa.float64())) for v in _VECTORS]
        yield pa.RecordBatch.from_arrays(columns, [*RUN_STATS, "low", "high", "count", "mean_y", *_VECTORS])


def _merged(table: pa.Table) -> tuple[_Moments, dict]:
    """The moments of one run from those of its pieces, and the run's own columns."""
    whole = None
    for r in table.select(["count", "mean_y", *_VECTORS]).to_pylist():
        own = _Moments(r["count"], r["mean_y"], *(np.array(r[v]) for v in _VECTORS))
        whole = own if whole is None else whole.with_(own)
    return whole, table.select([*RUN_STATS, "low", "high"]).slice(0, 1).to_pylist()[0]


def _round(table: pa.Table) -> pa.Table:
    """A run's best exponent of the grid, and the range of its neighbours."""
    moments, run = _merged(table)
    grid = _exponents(run["low"], run["high"])
    errors, floors, amplitudes = moments.best(run["mean_loss"], run["var_loss"])
    k = int(errors.argmin())
    values = [floors[k], amplitudes[k], grid[k], errors[k], grid[max(k - 1, 0)], grid[min(k + 1, GRID_POINTS - 1)]]
    own = table.select(list(RUN_STATS)).slice(0, 1)
    names = [*(n for n, _ in _FIT), "low", "high"]
    return pa.Table.from_arrays([*own.columns, *(pa.array([float(v)]) for v in values)], names=[*RUN_STATS, *names])


def _cells(table: pa.Table) -> pa.Table:
    """A run's error, floor and amplitude at every exponent of the grid."""
    moments, run = _merged(table)
    found = moments.best(run["mean_loss"], run["var_loss"])
    columns = [pa.array(np.arange(GRID_POINTS, dtype=np.int32)), pa.array(_exponents(run["low"], run["high"])), *map(pa.array, found)]
    own = pa.chunked_array([table.column("run").combine_chunks().take(pa.array([0] * GRID_POINTS))])
    return pa.Table.from_arrays([own, *columns], names=["run", "k", "exponent", "sse", "floor", "amplitude"])


def _stats_schema(pieces: DataFrame) -> str:
    return ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in RUN_STATS)


def _moment_rows(pieces: DataFrame) -> DataFrame:
    vectors = ", ".join(f"{v} array<double>" for v in _VECTORS)
    schema = f"{_stats_schema(pieces)}, low double, high double, count long, mean_y double, {vectors}"
    return pieces.select(*RUN_STATS, "low", "high", "points").mapInArrow(_vectors, schema)


def loss_fit_grid(points: DataFrame) -> DataFrame:
    """First round of the fit as a relation: every run and exponent."""
    pieces = _pieces(points.select("run", "tokens", "loss"))
    pieces = pieces.withColumns({"low": F.lit(LOWEST_EXPONENT), "high": F.lit(HIGHEST_EXPONENT)})
    run = pieces.schema["run"].dataType.simpleString()
    return _moment_rows(pieces).groupBy("run").applyInArrow(_cells, f"run {run}, k int, exponent double, sse double, floor double, amplitude double")


def _fit_long(pieces: DataFrame) -> DataFrame:
    """The fit of runs of several rows: in each round the moments of all pieces, a vector each, are put together by run."""
    fit = ", ".join(f"{n} double" for n, _ in _FIT)
    best = pieces.select(*RUN_STATS).distinct().withColumns({"low": F.lit(LOWEST_EXPONENT), "high": F.lit(HIGHEST_EXPONENT)})
    for _ in range(GRID_ROUNDS):
        ranges = best.select("run", "low", "high")
        rows = _moment_rows(pieces.join(ranges, "run"))
        best = stage(rows.groupBy("run").applyInArrow(_round, f"{_stats_schema(pieces)}, {fit}, low double, high double"), "fit-runs")
    return best.drop("low", "high")


def fit_loss_curve(points: DataFrame) -> DataFrame:
    """Fit loss = floor + amplitude * (tokens / reference) ** -exponent.

    ``points``: run, tokens, loss of eligible runs. Floor and amplitude are
    not negative, the exponent stays within its bounds. Each round narrows a
    grid of exponents to the neighbours of its best one. For a fixed exponent the error depends on a few
    moments only, which are taken for the whole grid at once. A run is one row and one
    task's work; a long run is several, whose moments are summed.
    """
    pieces = stage(_pieces(points.select("run", "tokens", "loss")), "fit-points")
    fit = ", ".join(f"{n} double" for n, _ in _FIT)
    best = pieces.where(F.col("n") <= PIECE_POINTS).mapInArrow(_fit_alone, f"{_stats_schema(pieces)}, {fit}")
    long = pieces.where(F.col("n") > PIECE_POINTS)
    if not long.isEmpty():
        best = best.union(_fit_long(long))
    p = F.col("exponent")
    return best.select(
        "run",
        F.col("n").alias("points"),
        "floor",
        "amplitude",
        "exponent",
        "reference_tokens",
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (1 - F.col("sse") / (F.col("n") * F.col("var_loss"))).alias("r_squared"),
        ((p <= LOWEST_EXPONENT + 1e-5) | (p >= HIGHEST_EXPONENT - 1e-5)).alias("exponent_at_bound"),
    )


def predicted_loss(tokens: Column) -> Column:
    """The fitted curve at ``tokens``, from the columns of a fit."""
    return F.col("floor") + F.col("amplitude") * F.pow(tokens / F.col("reference_tokens"), -F.col("exponent"))


def forecast_target(fits: DataFrame, points: DataFrame, summaries: DataFrame, target: float | None = None) -> DataFrame:
    """Where each study is forecast to, over its usable curves.

    ``fits``: study, run; ``points``: run, tokens (excluded ones too);
    ``summaries``: run, planned_tokens. A target inside the data is a problem.
    """
    if target is not None and not 0 < target < float("inf"):
        raise ValueError("target must be finite and positive")
    ends = points.groupBy("run").agg(F.max("tokens").alias("last_tokens"))
    curves = fits.select("study", "run").join(summaries, "run").join(ends, "run")
    wanted = F.lit(float(target)) if target is not None else 2.0 * F.max("planned_tokens")
    return (
        curves.groupBy("study")
        .agg(F.max("last_tokens").alias("observed_end"), wanted.alias("target_tokens"))
        .withColumn("problem", F.when(F.col("target_tokens") <= F.col("observed_end"), "target must exceed the last observation"))
    )


def forecast_curve(fits: DataFrame, fitted_points: DataFrame, targets: DataFrame) -> DataFrame:
    """Predicted losses along the fitted range and on to the target.

    ``fits``: study, run and the fit; ``fitted_points``: run, tokens;
    ``targets``: study, target_tokens.
    """
    ranges = fitted_points.groupBy("run").agg(
        F.min("tokens").cast("double").alias("first"), F.max("tokens").cast("double").alias("last")
    )
    joined = fits.join(ranges, "run").join(targets.select("study", F.col("target_tokens").cast("double").alias("target")), "study")
    parts = F.explode(F.create_map(
        F.lit("fitted"), geometric_points(F.col("first"), F.col("last"), FITTED_POINTS),
        F.lit("forecast"), geometric_points(F.col("last"), F.col("target"), FORECAST_POINTS),
    )).alias("part", "points")
    fit = ["floor", "amplitude", "exponent", "reference_tokens"]
    return (
        joined.select("study", "run", *fit, parts)
        .select("study", "run", *fit, "part", F.posexplode("points").alias("point", "tokens"))
        .withColumn("predicted_loss", predicted_loss(F.col("tokens")))
        .drop(*fit)
    )


def with_target_loss(fits: DataFrame, targets: DataFrame) -> DataFrame:
    joined = fits.join(targets.select("study", "target_tokens"), "study")
    return joined.withColumn("predicted_loss", predicted_loss(F.col("target_tokens")))


def select_best(fits: DataFrame) -> DataFrame:
    """Lowest predicted loss per study among good fits, earliest on ties.

    ``fits``: study, trial, predicted_loss, r_squared. Studies without a good
    fit keep a row of nulls.
    """
    good = F.col("r_squared") >= MIN_R_SQUARED
    best = F.min_by(
        F.struct("trial", "predicted_loss", "r_squared"), F.when(good, F.struct("predicted_loss", "trial"))
    ).alias("best")
    return fits.groupBy("study").agg(best).select("study", "best.*")


def forecast_guards(trials: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Why a study cannot be forecast.

    ``trials``: study, trial, model_size, compute_flops of completed trials;
    a missing value counts as one value. ``requested``: study, trial.
    """
    mixed = trials.groupBy("study").agg(
        F.count_distinct(F.coalesce(F.col("model_size").cast("string"), F.lit(""))).alias("sizes"),
        F.count_distinct(F.coalesce(F.col("compute_flops").cast("string"), F.lit(""))).alias("budgets"),
    )
    problems = mixed.where((F.col("sizes") != 1) | (F.col("budgets") != 1)).select(
        "study", F.lit(None).cast("long").alias("trial"), F.lit("more than one model size or budget").alias("problem")
    )
    if requested is None:
        return problems
    lost = requested.join(trials.select("study", "trial"), ["study", "trial"], "left_anti")
    return problems.unionByName(
        lost.select("study", F.col("trial").cast("long").alias("trial"), F.lit("trial is not completed").alias("problem"))
    )


def unfitted_runs(runs: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """``run, problem`` of every run that cannot be fitted: without a log line,
    without a point to fit, or with points that determine no curve."""
    present = logs.groupBy("run").agg(F.lit(True).alias("logged"))
    checked = runs.select("run").join(present, "run", "left").join(fit_eligibility(points), "run", "left")
    problem = (
        F.when(F.col("logged").isNull(), "no validation log")
        .when(F.col("points").isNull(), "no point to fit")
        .otherwise(F.col("problem"))
    )
    return checked.select("run", problem.alias("problem")).where(F.col("problem").isNotNull())


def skipped_trials(trials: DataFrame, reasons: Sequence[DataFrame]) -> DataFrame:
    """The first reason each trial was not fitted.

    ``trials``: run; ``reasons``: tables of run and problem in the order the
    checks are made.
    """
    ranked = None
    for priority, table in enumerate(reasons):
        rows = table.select("run", "problem", F.lit(priority).alias("priority"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    first = ranked.groupBy("run").agg(F.min_by("problem", F.struct("priority", "problem")).alias("reason"))
    return trials.select("run").join(first, "run")


@dataclass(frozen=True)
class Forecast:
    """What a forecast of whole studies gives."""

    fits: DataFrame  # study, trial, run, the fit and predicted_loss at the study's target
    skipped: DataFrame  # run, reason
    points: DataFrame  # of the trials that were fitted
    targets: DataFrame  # study, target_tokens, observed_end, problem
    best: DataFrame  # study, trial, predicted_loss, r_squared

    def curves(self) -> DataFrame:
        return forecast_curve(self.fits, self.points.where("used_for_fit"), self.targets)


def forecast_studies(
    trials: DataFrame,
    configs: DataFrame,
    runs: DataFrame,
    logs: DataFrame,
    fit_start_fraction: float = 0.0,
    target: float | None = None,
) -> Forecast:
    """From completed trials and their logs to the best trial of each study.

    ``trials``: study, trial, run, attrs; ``configs``: study, trial, path. A trial counts as a
    whole: without a saved configuration, with a schedule that cannot be used, without a log, with
    one bad record in it, or with points that determine no curve, it is skipped with that
    reason, and takes no part in the study's target. A study whose target lies inside its data is not forecast.
    """
    missing = select_attempt(configs, trials).where("problem IS NOT NULL").join(trials.select("study", "trial", "run"), ["study", "trial"])
    mine = trials.select("run").distinct()
    own_runs, own_logs = runs.join(mine, "run", "left_semi"), logs.join(mine, "run", "left_semi")
    schedules = invalid_runs(own_runs).select("run", F.get("reasons", F.lit(0)).alias("problem"))
    records = invalid_records(own_logs).groupBy("run").agg(F.min_by("problem", "line_no").alias("problem"))
    barred = stage(missing.select("run", "problem").union(schedules).union(records).select("run").distinct(), "barred")
    points = curve_points(
        latest_by_step(own_logs.join(barred, "run", "left_anti")), own_runs.join(barred, "run", "left_anti"), fit_start_fraction
    )
    points = stage(points, "points")
    fitted_points = points.where("used_for_fit").select("run", "tokens", "loss")
    unfit = unfitted_runs(own_runs, own_logs, fitted_points)
    skipped = stage(skipped_trials(mine, [missing.select("run", "problem"), schedules, records, unfit]), "skipped")
    fits = fit_loss_curve(fitted_points.join(skipped, "run", "left_anti"))
    fits = stage(trials.select("study", "trial", "run").join(fits, "run"), "fits")
    kept = stage(points.join(fits.select("run"), "run", "left_semi"), "fitted")
    targets = stage(forecast_target(fits, kept, run_summary(own_runs), target), "targets")
    forecast = stage(with_target_loss(fits, targets.where("problem IS NULL")), "forecast")
    return Forecast(forecast, skipped, kept, targets, select_best(forecast))
