from pyspark.sql import functions as F

from tokenloom.operators import corpus as C
from tokenloom.operators.curves import latest_by_step
from tokenloom.streaming import ingest, losses

DOCS = "doc_id long, text string, metadata struct<token_count:long>"
BUDGETS = {"train": 200, "validation": 60}


def _docs(spark, low, high):
    return spark.createDataFrame([(i, f"t{i}", (i % 7 + 1,)) for i in range(low, high)], DOCS)


def _stream(spark, folder):
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(spark, tmp_path):
    query = ingest.stream_ingest(_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", BUDGETS, 25)
    query.awaitTermination()


def _result(spark, tmp_path):
    rows = ingest.ingested_documents(spark, f"{tmp_path}/out").collect()
    return {r["doc_id"]: (r["split"], r["shard"]) for r in rows}


def test_batches_continue_each_other(spark, tmp_path):
    _docs(spark, 0, 30).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    folder = f"{tmp_path}/in/*"
    spark_rows = []
    start = lambda: ingest.stream_ingest(
        _stream(spark, folder), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp", BUDGETS, 25)
    start().awaitTermination()
    assert ingest.open_budgets(spark, f"{tmp_path}/state", BUDGETS)["train"] > 0
    _docs(spark, 30, 60).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    start().awaitTermination()
    _docs(spark, 60, 90).coalesce(1).write.parquet(f"{tmp_path}/in/c")
    start().awaitTermination()
    placed = _result(spark, tmp_path)
    # Brute force: batches one after another, each in seeded order.
    order = []
    for low in (0, 30, 60):
        order += [(r["doc_id"], r["token_count"]) for r in C.running_tokens(_docs(spark, low, low + 30)).orderBy("cum_tokens").collect()]
    expected, names = {}, list(BUDGETS)
    split = shard = in_split = in_shard = 0
    for doc, n in order:
        if split == len(names):
            break
        expected[doc] = (names[split], shard)
        in_split, in_shard = in_split + n, in_shard + n
        if in_shard >= 25 or in_split >= BUDGETS[names[split]]:
            shard, in_shard = shard + 1, 0
        if in_split >= BUDGETS[names[split]]:
            split, shard, in_split = split + 1, 0, 0
    assert placed == expected and split == 2
    assert ingest.open_budgets(spark, f"{tmp_path}/state", BUDGETS) == {}
    # A repeated batch, and a restart without new files, change nothing.
    ingest.ingest_batch(_docs(spark, 30, 60), 1, f"{tmp_path}/out", f"{tmp_path}/state", BUDGETS, 25)
    start().awaitTermination()
    assert _result(spark, tmp_path) == placed and not spark_rows


def test_one_batch_equals_the_batch_job(spark, tmp_path):
    docs = _docs(spark, 0, 90)
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    _run(spark, tmp_path)
    plan = C.plan_shards(docs, BUDGETS, 25)
    assert _result(spark, tmp_path) == {r["doc_id"]: (r["split"], r["shard"]) for r in plan.placements().collect()}


def _logs(spark, rows):
    schema = "run string, line_no long, step double, val_loss double, lr double, malformed boolean"
    return spark.createDataFrame(rows, schema)


def test_followed_logs(spark, tmp_path):
    first = [("r", i, float(i), 5.0 - i / 10, None, False) for i in range(10)]
    second = [("r", 10 + i, float(5 + i), 1.0, None, False) for i in range(10)]
    schema = _logs(spark, first).schema
    runs = spark.createDataFrame(
        [("r", 1, 1, 100, 0, 100, 0, 0.1)],
        "run string, global_batch long, seq_len long, max_steps long, warmup_steps long, decay_end long, decay_steps long, lr double")
    for part, rows in (("a", first), ("b", second)):
        _logs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        losses.write_updates(losses.stream_latest_losses(stream), f"{tmp_path}/out", f"{tmp_path}/cp", ["run", "step"]).awaitTermination()
    got = {r["step"]: r["val_loss"] for r in losses.read_updates(spark, f"{tmp_path}/out", ["run", "step"]).collect()}
    expected = {r["step"]: r["val_loss"] for r in latest_by_step(_logs(spark, first + second)).collect()}
    assert got == expected and got[5] == 1.0 and len(got) == 15
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    losses.write_updates(losses.stream_curve_points(stream, runs), f"{tmp_path}/points", f"{tmp_path}/cp2", ["run", "step"]).awaitTermination()
    points = losses.read_updates(spark, f"{tmp_path}/points", ["run", "step"])
    assert points.where(F.col("reason") == "fit").count() == 15


def test_remaining_work(spark):
    work = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    done = spark.createDataFrame([(1,), (1,)], "id int")
    assert [r["id"] for r in ingest.remaining_work(work, done, ["id"]).collect()] == [2]


def test_a_build_stops_at_its_budgets(spark, tmp_path):
    """One file a batch; once both budgets are met the stream ends, without state of later batches."""
    for k in range(8):
        _docs(spark, 20 * k, 20 * k + 20).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    paths = [f"{tmp_path}/{p}" for p in ("out", "state", "cp")]
    build = lambda: ingest.ingest_until_met(_stream(spark, f"{tmp_path}/in/*"), *paths, {"train": 200, "validation": 60}, 25)
    assert build()
    states = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch="))
    tokens = [sum(i % 7 + 1 for i in range(20 * k, 20 * k + 20)) for k in range(8)]
    assert states == [f"batch={k}" for k in range(4)] and sum(tokens[:3]) < 260 <= sum(tokens[:4])
    placed = _result(spark, tmp_path)
    assert build() and _result(spark, tmp_path) == placed
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")) == states
    assert not ingest.ingest_until_met(
        _stream(spark, f"{tmp_path}/in/*"), *[f"{tmp_path}/{p}2" for p in ("out", "state", "cp")], {"train": 10_000}, 25)


def test_update_folders_are_merged(spark, tmp_path):
    """Fifty batches leave a bounded number of folders, and a repeated batch changes nothing."""
    path = f"{tmp_path}/out"
    frame = lambda b: spark.createDataFrame([("r", float(b % 7), b), ("r", 100.0 + b, b)], "run string, step double, value int")

    class Batches:
        """Stands in for a stream's writer: keeps what write_updates does with a batch."""

        def __getattr__(self, name):
            return lambda *args, **kwargs: self

        def foreachBatch(self, keep):
            self.keep = keep
            return self

    stream = type("Stream", (), {"writeStream": Batches()})()
    losses.write_updates(stream, path, "", ["run", "step"])
    keep = stream.writeStream.keep
    for b in range(50):
        keep(frame(b), b)
        assert len(losses._folders(path)) <= 2 * (losses.FAN_IN - 1)
    rows = lambda: sorted(map(tuple, losses.read_updates(spark, path, ["run", "step"]).collect()))
    expected = sorted([("r", 100.0 + b, b) for b in range(50)] + [("r", float(k), max(b for b in range(50) if b % 7 == k)) for k in range(7)])
    assert rows() == expected
    before = losses._folders(path)
    keep(frame(49), 49)
    keep(frame(47), 47)
    assert rows() == expected and losses._folders(path) == before
