import math

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import general_number, slug
from tokenloom.operators import studies as H

TRIALS = "study string, trial long, state string, value double, params map<string,double>"


def _trials(spark, rows):
    return spark.createDataFrame(rows, TRIALS)


def _grid_trials(spark, count):
    return _trials(spark, [("s", i, "FAIL" if i % 2 else "COMPLETE", 1.0, {}) for i in range(count)])


def test_budgets(spark):
    sizes = spark.createDataFrame([("tiny", 15, {"layers": "2"})], "model_size string, num_parameters long, architecture map<string,string>")
    points = H.scaling_points(sizes, [900.0, 2700.0]).orderBy("compute_flops").collect()
    assert [(p["num_tokens"], p["name"], p["study"]) for p in points] == [
        (10, "tiny_900flops", "tiny_15p_900flops"), (30, "tiny_2700flops", "tiny_15p_2700flops")
    ]
    assert points[0]["architecture"] == {"layers": "2"}
    row = spark.range(1).select(
        H.compute_budget(F.lit(3 * 10**8), F.lit(5 * 10**9)).alias("c"),
        H.tokens_for_compute(F.lit(15.0), F.lit(1)).alias("half_down"),
        H.tokens_for_compute(F.lit(21.0), F.lit(1)).alias("half_up"),
        H.tokens_for_compute(F.lit(1e-9), F.lit(1)).alias("least"),
        H.tokens_for_compute(F.lit(7e16), F.lit(98765432)).alias("real"),
    ).first()
    assert tuple(row) == (9e18, 2, 4, 1, round(7e16 / (6 * 98765432)))
    for bad in (H.compute_budget(F.lit(0), F.lit(1)), H.tokens_for_compute(F.lit(float("nan")), F.lit(1))):
        with pytest.raises(Exception, match="positive"):
            spark.range(1).select(bad).collect()


@pytest.mark.parametrize("count, cap, left", [(28, 35, 0), (26, 35, 2), (0, 9, 9), (11, 9, 0)])
def test_remaining(spark, count, cap, left):
    points = spark.createDataFrame([("s",)], "study string")
    grid = H.search_grid(points, [0.1, 0.2, 0.3, 0.4], [1, 2, 3, 4, 5, 6, 7])
    assert H.remaining_trials(grid, _grid_trials(spark, count), cap).first()["remaining"] == left
    with pytest.raises(ValueError):
        H.remaining_trials(grid, _grid_trials(spark, 1), -1)


def test_unvisited(spark):
    grid = H.search_grid(spark.createDataFrame([("s",)], "study string"), [0.1, 0.2], [4, 8])
    seen = _trials(spark, [("s", 0, "FAIL", None, {"learning_rate": 0.1, "global_batch_size": 8.0})])
    left = {(r["learning_rate"], r["global_batch_size"]) for r in H.unvisited_cells(grid, seen).collect()}
    assert left == {(0.1, 4), (0.2, 4), (0.2, 8)}


def test_local_batches(spark):
    rows = [(24, 96, 4), (20, 60, 3), (6, 9, 2), (-1, 8, 2), (5, 20, 1)]
    df = spark.createDataFrame(rows, "configured int, global_batch int, world int")
    got = [(r["candidates"], r["problem"]) for r in H.local_batch_candidates(df.coalesce(1)).collect()]
    assert got[0] == ([24, 12, 6, 3, 1], None) and got[1] == ([20, 10, 5, 2, 1], None)
    assert got[2][0] is None and "divisible" in got[2][1]
    assert got[3][0] is None and "positive" in got[3][1]
    assert got[4] == ([5, 2, 1], None)


def test_power_laws(spark):
    points = [("a", 2.0, 8.0), ("a", 4.0, 32.0), ("a", 8.0, 128.0), ("b", 3e15, 17.5), ("b", 9e15, 17.5),
              ("c", 1.0, 1.0), ("d", 2.0, 1.0), ("d", 2.0, 3.0), ("e", 1.0, -1.0), ("e", 2.0, 1.0)]
    laws = {r["g"]: r for r in H.fit_power_law(spark.createDataFrame(points, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for key, expected in (("a", (2, 2, 1)), ("b", (17.5, 0, 1))):
        got = (laws[key]["coefficient"], laws[key]["exponent"], laws[key]["r_squared"])
        assert got == pytest.approx(expected, abs=1e-9)
    assert [laws[k]["problem"] for k in "cde"] == [
        "at least two points are required", "all x are equal", "points must be finite and positive"
    ]
    assert all(laws[k]["coefficient"] is None for k in "cde")


def _settings(spark, rows):
    return spark.createDataFrame(
        rows, "num_parameters long, compute_flops double, near_optimal_learning_rate double, "
        "near_optimal_global_batch_size double, best_validation_loss double"
    )


def test_laws_by_size(spark):
    settings = _settings(spark, [(n, c, k * c, k * c, 1 / c) for n, k in ((12, 3.0), (40, 7.0)) for c in (2.0, 50.0)])
    laws = {(r["num_parameters"], r["variable"]): r for r in H.power_laws_by_size(settings, strict=True).collect()}
    assert laws[12, "learning_rate"]["coefficient"] == pytest.approx(3)
    assert laws[40, "global_batch_size"]["coefficient"] == pytest.approx(7)
    assert laws[40, "validation_loss"]["exponent"] == pytest.approx(-1)
    with pytest.raises(ValueError, match="12"):
        H.power_laws_by_size(_settings(spark, [(12, 1.0, 1.0, 1.0, 1.0)]), strict=True)
    curve = H.predict_power_law(H.power_laws_by_size(settings), settings).where("num_parameters = 12 and variable = 'learning_rate'")
    rows = curve.orderBy("point").collect()
    assert len(rows) == 200 and rows[0]["compute_flops"] == pytest.approx(2) and rows[-1]["compute_flops"] == pytest.approx(50)
    assert rows[-1]["predicted"] == pytest.approx(150)
    report = {r["variable"]: r["equation"] for r in H.law_report(H.power_laws_by_size(settings)).where("num_parameters = 40").collect()}
    assert report["learning_rate"].startswith("learning_rate = 7 * C^1")


def test_near_optimal(spark):
    params = [(2e-3, 16.0), (8e-3, 64.0), (1.0, 1.0)]
    rows = [("s", i, "COMPLETE", v, {"learning_rate": lr, "global_batch_size": b}) for i, (v, (lr, b)) in enumerate(zip((3.0, 3.006, 3.2), params))]
    rows += [("s", 3, "COMPLETE", float("nan"), {}), ("s", 4, "FAIL", 1.0, {}), ("s", 5, "COMPLETE", None, {})]
    trials = _trials(spark, rows)
    near = H.near_optimal(trials)
    assert sorted(r["trial"] for r in near.collect()) == [0, 1]
    row = H.representative_params(near).first()
    assert row["near_optimal_learning_rate"] == pytest.approx(4e-3)
    assert row["near_optimal_global_batch_size"] == pytest.approx(32)
    assert H.best_trials(trials).first()["trial"] == 0
    with pytest.raises(ValueError):
        H.near_optimal(trials, -0.1)
    assert sorted(r["trial"] for r in H.completed_trials(trials).collect()) == [0, 1, 2]


def test_settings_and_missing(spark):
    sizes = spark.createDataFrame([("m", 15)], "model_size string, num_parameters long")
    points = H.scaling_points(sizes, [900.0, 2700.0])
    trials = _trials(spark, [("m_15p_900flops", i, "COMPLETE", v, {"learning_rate": 0.1, "global_batch_size": 4.0}) for i, v in enumerate((2.0, 1.0))])
    rows = H.best_settings(points, trials).collect()
    assert len(rows) == 1 and rows[0]["best_validation_loss"] == 1.0 and len(rows[0]) == 12
    assert [r["study"] for r in H.missing_studies(points, trials).collect()] == ["m_15p_2700flops"]
    with pytest.raises(ValueError, match="2700"):
        H.best_settings(points, trials, strict=True)


def test_series(spark):
    rows = [("s", i, "COMPLETE", 1.0, {"learning_rate": lr, "global_batch_size": b})
            for i, (lr, b) in enumerate([(0.2, 8.0), (0.1, 8.0), (0.2, 4.0), (0.1, 4.0)])]
    trials = _trials(spark, rows)
    by_rate = {(r["group_value"], r["point"]): r["trial"] for r in H.trial_series(trials, "global_batch_size", "learning_rate").collect()}
    assert by_rate == {(0.1, 1): 3, (0.1, 2): 1, (0.2, 1): 2, (0.2, 2): 0}
    by_batch = {(r["group_value"], r["point"]): r["trial"] for r in H.trial_series(trials, "learning_rate", "global_batch_size").collect()}
    assert by_batch == {(4.0, 1): 3, (4.0, 2): 2, (8.0, 1): 1, (8.0, 2): 0}


def test_final_losses(spark):
    logs = spark.createDataFrame(
        [("a", 1, 3.75), ("a", 2, 3.5), ("a", 3, float("nan")), ("b", 1, float("inf"))], "run string, line_no long, val_loss double"
    )
    rows = {r["run"]: (r["val_loss"], r["problem"]) for r in H.final_losses(logs).collect()}
    assert rows == {"a": (3.5, None), "b": (None, "no finite val_loss")}


def test_numbers_and_slugs(spark):
    values = [0.0, 1.0, 3.0, 1e17, 123456.0, 1234567.0, 0.0001, 0.00001234, -2.5, 1 / 3, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r[0] for r in df.select(general_number(F.col("v"))).collect()] == [f"{v:.6g}" for v in values]
    texts = spark.createDataFrame([(t,) for t in ("a b/c", "--x--", "..", "é!ok", "-.a.-")], "t string").coalesce(1)
    assert [r[0] for r in texts.select(slug(F.col("t"))).collect()] == ["a-b-c", "x", "run", "ok", "a"]


def test_steep_laws_keep_their_intercept(spark):
    """x of 842 and 843 with exponents of +-400: coefficients of e^-2695 and e^+2695 are no doubles, their logarithms are."""
    points = [(k, x, math.exp(s * 400 * (math.log(x) - math.log(842)))) for k, s in ((12, 1), (40, -1)) for x in (842.0, 843.0)]
    laws = H.fit_power_law(spark.createDataFrame(points, "num_parameters long, x double, y double"), ["num_parameters"], "x", "y")
    rows = {r["num_parameters"]: r for r in laws.collect()}
    assert rows[12]["ln_coefficient"] == pytest.approx(-400 * math.log(842), rel=1e-6) == -rows[40]["ln_coefficient"]
    settings = _settings(spark, [(k, x, 1.0, 1.0, 1.0) for k in (12, 40) for x in (842.0, 843.0)])
    curve = H.predict_power_law(laws.withColumn("variable", F.lit("y")), settings).where("point = 0").collect()
    assert [r["predicted"] for r in curve] == pytest.approx([1.0, 1.0], rel=1e-6)
