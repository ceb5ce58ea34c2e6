import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.ordering import seeded_key
from tokenloom.operators import corpus as C
from tokenloom.sources import corpus_files as IO

SCHEMA = "doc_id long, text string, metadata struct<token_count:long>"


def _docs(spark, counts):
    rows = [(i, f"document-{i}", None if c is None else (c,)) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, SCHEMA)


def _in_order(spark, docs):
    keyed = docs.select("doc_id", seeded_key(F.col("doc_id")).alias("k"), F.col("metadata.token_count").alias("n"))
    return [(r["doc_id"], r["n"]) for r in keyed.orderBy("k").collect() if r["n"]]


def _greedy(ordered, budgets, size):
    """Brute force: fill shards and splits document by document."""
    placed, names = {}, list(budgets)
    split = shard = in_split = in_shard = 0
    for doc, n in ordered:
        if split == len(names):
            break
        placed[doc] = (names[split], shard)
        in_split, in_shard = in_split + n, in_shard + n
        if in_shard >= size or in_split >= budgets[names[split]]:
            shard, in_shard = shard + 1, 0
        if in_split >= budgets[names[split]]:
            split, shard, in_split = split + 1, 0, 0
    return placed


def test_small_build(spark):
    docs = _docs(spark, [3] * 5)
    budgets = {"train": 5, "validation": 4}
    plan = C.plan_shards(docs, budgets, 100)
    order = [d for d, _ in _in_order(spark, docs)]
    rows = {r["doc_id"]: (r["split"], r["shard"]) for r in plan.placements().collect()}
    assert rows == {order[0]: ("train", 0), order[1]: ("train", 0), order[2]: ("validation", 0), order[3]: ("validation", 0)}
    manifest = {r["split"]: r for r in C.corpus_manifest(plan.placements(), budgets).collect()}
    assert manifest["train"]["actual_tokens"] == manifest["validation"]["actual_tokens"] == 6
    assert manifest["total"]["target_tokens"] == 5 and manifest["total"]["actual_tokens"] == 12


@pytest.mark.parametrize("seed, size", [(1, 50), (2, 7), (3, 400), (4, 1)])
@pytest.mark.parametrize("rows", [500_000, 3])
def test_shards_match_brute_force(spark, monkeypatch, seed, size, rows):
    monkeypatch.setattr(C, "CANDIDATE_ROWS", rows)
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 5, 30, 90, 0]) for _ in range(120)]
    docs = _docs(spark, counts).repartition(5)
    total = sum(counts)
    budgets = {"train": total * 6 // 10, "validation": total // 5} if size > 10 else {"train": 60, "validation": 25}
    plan = C.plan_shards(docs, budgets, size)
    placed = {r["doc_id"]: (r["split"], r["shard"]) for r in plan.placements().collect()}
    assert placed == _greedy(_in_order(spark, docs), budgets, size)
    assert plan.complete


def test_order_does_not_depend_on_layout(spark):
    docs = _docs(spark, list(range(1, 80)))
    a = {r["doc_id"]: r["cum_tokens"] for r in C.running_tokens(docs, digits=1).collect()}
    b = {r["doc_id"]: r["cum_tokens"] for r in C.running_tokens(docs.repartition(7), digits=4).collect()}
    assert a == b and max(a.values()) == sum(range(1, 80))


def test_bad_documents(spark):
    docs = _docs(spark, [1, -2, 0]).union(spark.createDataFrame([(7, "x", None), (8, "y", (None,))], SCHEMA))
    assert {(r["doc_id"], r["problem"]) for r in C.bad_documents(docs).collect()} == {
        (1, "negative token_count"), (7, "missing metadata"), (8, "missing token_count")
    }
    with pytest.raises(Exception, match="negative token_count"):
        C.checked_documents(docs).collect()
    assert [r["doc_id"] for r in C.usable_documents(docs).collect()] == [0]


def test_missing_and_repeated_ids(spark):
    rows = [(1, "a", (2,)), (1, "b", (2,)), (2, "c", (2,)), (None, "d", (3,)), (3, "e", (4,))]
    docs = spark.createDataFrame(rows, SCHEMA)
    problems = sorted((r["doc_id"] or 0, r["problem"]) for r in C.bad_documents(docs).collect())
    assert problems == [(0, "missing doc_id"), (1, "repeated doc_id"), (1, "repeated doc_id")]
    with pytest.raises(Exception, match="missing doc_id"):
        C.plan_shards(docs, {"train": 5}, 2)
    with pytest.raises(ValueError, match="repeated doc_id"):
        C.plan_shards(docs.where("doc_id IS NOT NULL"), {"train": 5}, 2)
    plan = C.plan_shards(docs, {"train": 6}, 2, strict=False)
    placed = plan.placements().collect()
    assert sorted(r["doc_id"] for r in placed) == [2, 3] and sum(r["token_count"] for r in placed) == 6


def test_shortfall(spark):
    docs = C.running_tokens(_docs(spark, [3] * 5))
    rows = C.budget_shortfall(docs, {"train": 5, "validation": 40}).collect()
    assert [tuple(r) for r in rows] == [("validation", 9, 40)]
    assert C.budget_shortfall(docs, {"train": 5, "validation": 9}).count() == 0
    assert [tuple(r) for r in C.budget_shortfall(docs, {"train": 99, "validation": 9}).collect()] == [("train", 15, 99)]
    with pytest.raises(ValueError, match="validation"):
        C.budget_shortfall(docs, {"train": 5, "validation": 40}, strict=True)


def test_files_round_trip(spark, tmp_path):
    docs = _docs(spark, [3, 4, 5, 6, 7, 8, 9, 10])
    plan = C.plan_shards(docs, {"train": 30, "validation": 10}, 12)
    path = f"{tmp_path}/corpus"
    placed = C.sharded_documents(docs, plan)
    IO.write_shards(placed, path)
    with pytest.raises(Exception, match="already exists"):
        IO.write_shards(placed, path)
    train = [r["doc_id"] for r in placed.where("split = 'train'").orderBy("shard", "order_key").collect()]
    for limit in (0, 1, 3, len(train), 99):
        got = IO.read_split(spark, path, "train", limit).orderBy("shard", "order_key").collect()
        assert [r["doc_id"] for r in got] == train[:limit]
    assert IO.read_split(spark, path).count() == len(train)
    files = placed.select("split", "shard").distinct().count()
    read = spark.read.parquet(path).select(F.count_distinct("_metadata.file_path")).first()[0]
    assert read == files
    for bad, error in ((True, TypeError), (-1, ValueError), ("x", TypeError)):
        with pytest.raises(error):
            IO.read_split(spark, path, "train", bad)
    with pytest.raises(FileNotFoundError):
        IO.read_split(spark, path, "test")
    with pytest.raises(FileNotFoundError):
        IO.read_split(spark, path + "-missing")
    placed.drop("text").write.partitionBy("split", "shard").parquet(path + "-no-text")
    with pytest.raises(ValueError, match="text"):
        IO.read_split(spark, path + "-no-text")


def test_manifests(spark, tmp_path):
    docs = _docs(spark, [3] * 5)
    root = str(tmp_path)
    budgets = {"train": 5, "validation": 4}
    plan = C.plan_shards(docs, budgets, 100)
    IO.write_manifest(C.corpus_manifest(plan.placements(), budgets), f"{root}/a/manifest", 42, docs)
    with open(f"{root}/b.json", "w") as stream:
        stream.write("{broken")
    good = IO.read_manifests(spark, f"{root}/a/manifest/*.json").first()
    assert good["readable"] and good["folder"].endswith("/a") and good["splits"]["train"]["actual_tokens"] == 6
    assert not IO.read_manifests(spark, f"{root}/b.json").first()["readable"]
    text = spark.read.text(f"{root}/a/manifest").first()[0]
    assert json.loads(text)["seed"] == 42


def test_audit(spark):
    manifests = spark.createDataFrame(
        [("a", True, 2), ("b", True, 3), ("c", True, None), ("d", False, None), ("e", True, 1)],
        "folder string, readable boolean, parquet_shards long",
    )
    files = spark.createDataFrame([(f, str(i)) for f in "abcdf" for i in range(2)], "folder string, path string")
    assert {r["folder"]: r["status"] for r in C.audit_shards(manifests, files).collect()} == {
        "a": "complete", "b": "shard count differs", "c": "complete", "d": "unreadable manifest",
        "e": "incomplete", "f": "incomplete",
    }


def test_progress(spark):
    docs = _docs(spark, [7] * 20)
    plan = C.plan_shards(docs, {"train": 70, "validation": 30}, 1000)
    rows = sorted((r["progress_tokens"], r["split"]) for r in C.corpus_progress(plan, 20).collect())
    assert rows == [(20, "train"), (40, "train"), (60, "train"), (80, "validation"), (100, "validation")]


@pytest.mark.parametrize("shards", [60, 1000])
def test_jobs_grow_with_the_logarithm_of_shards(spark, shards):
    """One document of a million tokens makes windows useless; the table of successors needs few jobs."""
    rng = random.Random(shards)
    counts = [rng.randint(1, 40) for _ in range(shards * 10)]
    counts[len(counts) // 3] = 1_000_000
    docs = _docs(spark, counts)
    order = C.store_order(docs)
    rows = order.orderBy("cum_tokens").collect()
    in_order = [r["token_count"] for r in rows]
    budgets = {"train": 1_000_000 + sum(counts[: shards * 7]) - counts[0], "validation": 15 * shards}
    spark.sparkContext.setJobGroup(f"shards-{shards}", "")
    plan = C.find_ranges(order, budgets, 150)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shards-{shards}"))
    spark.sparkContext.setJobGroup("other", "")
    expected = list(_greedy(enumerate(in_order), budgets, 150).values())
    assert [(r.split, r.shard) for r in plan.ranges] == sorted(set(expected), key=expected.index)
    totals = {}
    for n, place in zip(in_order, expected):
        totals[place] = totals.get(place, 0) + n
    assert {(r.split, r.shard): r.last_total - r.after_total for r in plan.ranges} == totals
    assert jobs <= 30 + 12 * math.log2(len(plan.ranges)), jobs


@pytest.mark.parametrize("seed", range(3))
def test_successors_against_greedy(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "WINDOW_JOBS", 0)
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 3, 50, 400]) for _ in range(300)]
    order = C.store_order(_docs(spark, counts))
    in_order = [r["token_count"] for r in order.orderBy("cum_tokens").collect()]
    for budgets, carry in (({"train": 5000, "validation": 900}, C.Carry()), ({"train": 10**9}, C.Carry()), ({"a": 60, "b": 70, "c": 10**6}, C.Carry())):
        plan = C.find_ranges(order, budgets, 77, carry)
        expected = list(_greedy(enumerate(in_order), budgets, 77).values())
        assert [(r.split, r.shard) for r in plan.ranges] == sorted(set(expected), key=expected.index)
    plan = C.find_ranges(order, {"train": 3000, "validation": 500}, 77, C.Carry(0, 40, 3, 40))
    assert plan.ranges[0].shard == 3 and plan.ranges[0].last_total >= 37
