import math

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import schedules as S

COLUMNS = ("run string, num_tokens long, global_batch long, seq_len long, warmup_cap long, decay_ratio double, lr double, "
           "lr_percentage double, local_batch long")


def _runs(spark, **changes):
    row = dict(run="r", num_tokens=10241, global_batch=16, seq_len=128, warmup_cap=10, decay_ratio=0.4, lr=3e-4,
               lr_percentage=10.0, local_batch=4)
    row.update(changes)
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in COLUMNS.split(", "))], COLUMNS)


@pytest.mark.parametrize("changes, expected", [
    ({}, (6, 2, 2, 3e-5)),
    ({"num_tokens": 10**9, "seq_len": 2048, "decay_ratio": 0.1, "lr_percentage": 1.0}, (30518, 10, 3052, 3e-6)),
    ({"num_tokens": 1, "decay_ratio": 0.1}, (1, 1, 1, 3e-5)),
    ({"num_tokens": 5 * 2048, "decay_ratio": 0.5, "warmup_cap": 0}, (5, 0, 2, 3e-5)),
    ({"num_tokens": 7 * 2048, "decay_ratio": 0.5}, (7, 2, 4, 3e-5)),
    ({"decay_ratio": 0.0}, (6, 2, 0, 3e-5)),
])
def test_schedule(spark, changes, expected):
    row = S.token_schedule(_runs(spark, **changes)).first()
    assert (row["max_steps"], row["warmup_steps"], row["decay_steps"]) == expected[:3]
    assert row["min_lr"] == pytest.approx(expected[3])
    assert row["decay_end"] == row["validation_step"] == row["max_steps"]


@pytest.mark.parametrize("billions, tokens", [("1", 10**9), ("0.000000001", 1), ("0.000010241", 10241), ("0.0000000001", 1),
                                              ("20", 20 * 10**9), ("0.000000001000000001", 2)])
def test_billions(spark, billions, tokens):
    value = F.lit(billions).cast("decimal(28,18)")
    assert spark.range(1).select(S.billions_to_tokens(value).alias("t")).first()["t"] == tokens


@pytest.mark.parametrize("value", [0.0, -1.0, math.inf, math.nan])
def test_bad_billions(spark, value):
    with pytest.raises(Exception, match="finite and positive"):
        spark.range(1).select(S.billions_to_tokens(F.lit(value))).collect()


@pytest.mark.parametrize("changes", [
    {"num_tokens": 0}, {"local_batch": 0}, {"local_batch": 3}, {"global_batch": 0}, {"seq_len": 0}, {"warmup_cap": -1},
    {"decay_ratio": 1.1}, {"lr_percentage": -1.0}, {"lr_percentage": math.nan}, {"num_tokens": None},
])
def test_errors(spark, changes):
    assert S.schedule_errors(_runs(spark)).count() == 0
    assert len(S.schedule_errors(_runs(spark, **changes)).first()["reasons"]) >= 1


def _ablation(spark, step=100, epoch=3, tokens=200 * 64, configured=None, derived=100, epochs=1):
    runs = spark.createDataFrame(
        [("r", tokens, 4, 16, configured, derived, epochs)],
        "run string, ablation_tokens long, global_batch long, seq_len long, configured_decay long, derived_decay long, num_epochs long")
    return S.ablation_schedule(runs, spark.createDataFrame([("r", step, epoch)], "run string, step long, epoch long"))


def test_ablation(spark):
    row = _ablation(spark).first()
    assert (row["max_steps"], row["decay_steps"], row["warmup_steps"], row["num_epochs"]) == (300, 100, 0, 204)
    assert _ablation(spark, configured=7).first()["decay_steps"] == 7
    assert _ablation(spark, tokens=64).first()["decay_steps"] == 1
    assert _ablation(spark, epochs=999).first()["num_epochs"] == 999
    assert _ablation(spark, derived=0).first()["problem"] and _ablation(spark, step=-1).first()["problem"]


def test_curve(spark):
    run = spark.createDataFrame([("r", 10, 2, 4, 1.0, 0.2)], "run string, max_steps long, warmup_steps long, decay_steps long, lr double, min_lr double")
    rates = [r["learning_rate"] for r in S.lr_curve(run).orderBy("step").collect()]
    assert rates == pytest.approx([0.5, 1, 1, 1, 1, 1, 0.8, 0.6, 0.4, 0.2])
