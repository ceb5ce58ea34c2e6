import json
import os
from pathlib import Path

import pytest

from tokenloom.operators import evals as E
from tokenloom.sources import run_files as R


def _paths(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_discovery(spark):
    files = [f"/d/{run}/checkpoints/epoch_0_step_{s}/model/x" for run, s in (("north", 24), ("north", 74), ("south", 11))]
    files += ["/d/west/checkpoints/epoch_0_step_5/optim/x", "/d/west/epoch_x_step_1/model/x", "/e/other/epoch_1_step_0/model"]
    found = E.discover_checkpoints(_paths(spark, *files, files[0]), ["/d/"])
    rows = [(r["run_name"], r["training_step"]) for r in found.orderBy("run_slug", "training_step").collect()]
    assert rows == [("north", 25), ("north", 75), ("south", 12)]
    names = {}
    for root in ("/d/north", "/d/north/checkpoints", "/d/north/checkpoints/epoch_0_step_24", "/e", "/"):
        got = E.discover_checkpoints(_paths(spark, *files), [root]).collect()
        names[root] = {r["run_name"] for r in got}
    assert names["/d/north"] == names["/d/north/checkpoints"] == names["/d/north/checkpoints/epoch_0_step_24"] == {"north"}
    assert names["/e"] == {"other"}
    assert [r["root"] for r in E.empty_roots(found, ["/d", "/nothing"]).collect()] == ["/nothing"]


def test_collisions(spark):
    files = _paths(spark, *[f"/d/{run}/checkpoints/epoch_0_step_1/model/x" for run in ("a b", "a-b", "c")])
    rows = E.slug_collisions(E.discover_checkpoints(files, ["/d"])).collect()
    assert [(r["run_slug"], r["runs"]) for r in rows] == [("a-b", 2)]


def _state(root, name, *missing):
    return [(root, f"{root}/{name}/{item}") for item in ("step_scheduler.pt", "model/w", "optim/w") if item.split("/")[0] not in missing]


def test_latest(spark):
    rows = _state("/r1", "epoch_0_step_9") + _state("/r1", "epoch_0_step_10") + _state("/r1", "epoch_1_step_10") + _state("/r1", "epoch_0_step_99", "optim")
    rows += _state("/r2", "epoch_0_step_9") + _state("/r2", "epoch_0_step_10")
    rows += _state("/r3", "LATEST") + _state("/r3", "epoch_0_step_10")
    rows += _state("/r4", "epoch_0_step_10", "model") + _state("/r5", "epoch_0_step_1") + _state("/r5", "LATEST", "model")
    listing = spark.createDataFrame(rows, "root string, path string")
    pointers = spark.createDataFrame(
        [("/r2", "epoch_0_step_9\n"), ("/r3", "epoch_0_step_10"), ("/r5", "epoch_0_step_7")], "root string, target string")
    got = {r["root"]: r["path"] for r in E.latest_checkpoint(listing, pointers).collect()}
    assert got == {"/r1": "/r1/epoch_1_step_10", "/r2": "/r2/epoch_0_step_9", "/r3": "/r3/LATEST", "/r4": None, "/r5": "/r5/epoch_0_step_1"}


def test_suites(spark):
    assert E.requested_suites("instruct") == ["instruct", "instruct-retention"] and E.requested_suites("pretrain") == ["pretrain"]
    counts = {r["suite"]: r["count"] for r in E.suite_tasks(spark).groupBy("suite").count().collect()}
    assert counts == {"pretrain": 11, "instruct": 6, "instruct-retention": 5}
    assert E.suite_tasks(spark).where("generative").count() == 7


def test_worklist(spark):
    files = _paths(spark, *[f"/d/r/checkpoints/epoch_0_step_{s}/model/x" for s in (9, 19)])
    found = E.discover_checkpoints(files, ["/d"])
    done = spark.createDataFrame(
        [("r", "epoch_0_step_9", "pretrain", "full", "complete", 1), ("r", "epoch_0_step_19", "pretrain", "full", "complete", 0)],
        "run_slug string, checkpoint string, suite string, phase string, status string, result_files long")
    suites = ["pretrain", "instruct-retention"]
    work = {(r["checkpoint"], r["suite"]) for r in E.evaluation_worklist(found, suites, done).collect()}
    assert work == {("epoch_0_step_9", "instruct-retention"), ("epoch_0_step_19", "pretrain"), ("epoch_0_step_19", "instruct-retention")}
    assert E.evaluation_worklist(found, suites, done, force=True).count() == 4
    smoke = E.evaluation_worklist(found, suites, done, phase="smoke", steps=[10]).collect()
    assert [(r["suite"], r["tasks"]) for r in smoke] == [("pretrain", ["coqa", "gsm8k"])]
    with pytest.raises(ValueError):
        E.evaluation_worklist(found, suites, done, steps=[7])


def test_status(spark):
    rows = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (None, 1)], "return_code int, result_files int").coalesce(1)
    got = E.evaluation_status(rows)
    assert [r["status"] for r in got.collect()] == ["complete", "failed", "failed", "failed"]
    assert got.collect()[1]["error"] and E.failure_count(got).first()["failures"] == 3


def _evaluation(root: Path, name: str, results, **manifest):
    folder = root / name
    folder.mkdir(parents=True)
    base = {"checkpoint": "/c", "phase": "full", "run_name": "run", "status": "complete", "suite": "pretrain", "training_step": 60}
    (folder / "evaluation.json").write_text(json.dumps({**base, **manifest}))
    for age, (file, content) in enumerate(results):
        path = folder / file
        path.parent.mkdir(exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content))
        os.utime(path, (1_000_000 + age, 1_000_000 + age))
    return folder


def test_metrics_from_files(spark, tmp_path):
    metrics = {"alias": "piqa", "acc_norm,none": 0.375, "acc_norm_stderr,none": 0.02, "flag": True, "N": 5, "n_samples,x": 4,
               "text": "0.5", "plain": 3, "plain_stderr": "N/A"}
    old = {"results": {"piqa": {"acc_norm,none": 0.1}}}
    new = {"results": {"piqa": metrics, "group": 7, "none": None}}
    _evaluation(tmp_path, "a/full", [("results_z.json", old), ("deep/results_a.json", new)])
    _evaluation(tmp_path, "b/full", [("results_1.json", new)], status="failed")
    _evaluation(tmp_path, "c/smoke", [("results_1.json", new)], phase="smoke")
    _evaluation(tmp_path, "d/full", [("results_1.json", '{"results": {"t": {"m": NaN, "k": -Infinity, "note": "a, NaN", "ok": 1.5, "ok_stderr": Infinity}}}')])
    _evaluation(tmp_path, "e/full", [("results_1.json", "{broken")])
    _evaluation(tmp_path, "f/full", [])
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "evaluation.json").write_text("{broken")
    entries = E.result_entries(*R.read_eval_results(spark, str(tmp_path)))
    table = E.metrics_table(E.pair_stderr(entries))
    got = [(r["task"], r["metric"], r["step"], r["value"], r["stderr"]) for r in table.collect()]
    assert got == [("piqa", "acc_norm,none", 60, 0.375, 0.02), ("piqa", "plain", 60, 3.0, None), ("t", "ok", 60, 1.5, None)]
    assert E.extract_metrics(entries).count() == 3
    assert table.columns == ["run", "suite", "task", "metric", "step", "value", "stderr", "checkpoint", "result_file"]
    assert table.first()["result_file"].endswith("deep/results_a.json")
    smoke = E.result_entries(*R.read_eval_results(spark, str(tmp_path)), phase="smoke")
    assert E.pair_stderr(smoke).count() == 2


def test_series(spark):
    rows = [("a", 1, 1.0, None), ("a", 2, 2.0, 0.5), ("b", 1, 1.0, None)]
    table = spark.createDataFrame([("s", "t", "m", *r) for r in rows],
                                  "suite string, task string, metric string, run string, step long, value double, stderr double")
    got = {(r["run"], r["step"]): r["error_bar"] for r in E.metric_series(table).collect()}
    assert got == {("a", 1): 0.0, ("a", 2): 0.5, ("b", 1): None}


def test_listing(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    (tmp_path / "x y" / "f.txt").write_text("1")
    rows = R.read_file_listing(spark, str(tmp_path)).collect()
    assert [r["path"] for r in rows] == [f"{tmp_path}/x y/f.txt"] and rows[0]["mtime"] is not None
