import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import packing, tokens as T
from tokenloom.session import stage
from tokenloom.sources import run_files as R
from tokenloom.sources import token_shard as TS


def _write(path, ids, width=2, magic=278895051):
    header = np.zeros(256, dtype="<i4")
    header[:4] = magic, 1, len(ids), width
    path.write_bytes(header.tobytes() + np.array(ids, dtype=f"<u{width}").tobytes())


def test_shard_vector(spark, tmp_path):
    _write(tmp_path / "train-00000.bin", [0, 61, 0, 62, 63, 64, 0, 65, 66])
    for block, size in ((4, 1), (8, 1000), (1 << 18, 1 << 20)):
        blocks = TS.read_token_shards(spark, str(tmp_path), 4, block_tokens=block, range_bytes=size)
        packs = packing.finish_packs(packing.cut_blocks(blocks, 4), 4, 0, 0).orderBy("pack").collect()
        assert [(p["input_ids"], p["labels"], p["attention_mask"], p["position_ids"]) for p in packs] == [
            ([0, 61, 0, 62], [61, 0, 62, 63], [1, 1, 2, 2], [0, 1, 0, 1]),
            ([63, 64, 0, 65], [64, 0, 65, 66], [1, 1, 2, 2], [0, 1, 0, 1]),
        ]


@pytest.mark.parametrize("count, width, top", [(0, 2, 9), (1, 2, 9), (5, 4, 2**32 - 1), (1000, 2, 65535), (1025, 4, 70000)])
def test_ranges_cover_files(spark, tmp_path, count, width, top):
    ids = np.random.default_rng(1).integers(0, top, count, endpoint=True)
    _write(tmp_path / "a.bin", ids, width)
    rows = TS.read_token_shards(spark, str(tmp_path / "a.bin"), 8, block_tokens=24, range_bytes=97).orderBy("start").collect()
    stream = []
    for r in rows:
        assert r["start"] % 24 == 0 and r["shard_tokens"] == count
        stream[r["start"]:] = r["tokens"]
    assert stream == list(ids)


def test_temporary_files_are_no_shards(spark, tmp_path):
    (tmp_path / "_temporary-1").mkdir()
    _write(tmp_path / "_temporary-1" / "b.bin", [1, 2, 3])
    _write(tmp_path / "a.bin", [4, 5, 6])
    assert [r["tokens"] for r in TS.read_token_shards(spark, str(tmp_path)).collect()] == [[4, 5, 6]]


def _batch(split, shard, docs):
    tokens = pa.array(docs, pa.list_(pa.int32()))
    total = sum(map(len, docs))
    return pa.RecordBatch.from_arrays(
        [pa.array([split] * len(docs)), pa.array([shard] * len(docs), pa.int32()), pa.array([total] * len(docs), pa.int64()), tokens],
        ["split", "shard", "shard_tokens", "tokens"])


def test_a_reader_never_sees_half_a_set(spark, tmp_path):
    """Shards appear by their commit record, all at once; before it, and after a failure, there are none."""
    tokens = lambda: sorted(r["tokens"] for r in TS.read_token_shards(spark, str(tmp_path)).collect())
    writer = TS.TokenShardWriter({"path": str(tmp_path), "itemSize": "2"})
    first = writer.write(iter([_batch("train", 0, [[0, 5], [0, 6, 7]])]))
    writer.write(iter([_batch("train", 1, [[0, 3]])]))  # a first run of a task whose second one counts
    second = writer.write(iter([_batch("train", 1, [[0, 8]]), _batch("validation", 0, [[0, 9]])]))
    with pytest.raises(Exception, match="no token shards"):
        tokens()
    writer.commit([first, None, second])
    assert tokens() == [[0, 5, 0, 6, 7], [0, 8], [0, 9]]
    with pytest.raises(FileExistsError):
        TS.TokenShardWriter({"path": str(tmp_path), "itemSize": "2"})
    again = TS.TokenShardWriter({"path": str(tmp_path), "itemSize": "2", "resume": "true"})
    again.write(iter([_batch("train", 2, [[0, 1]])]))
    assert len(tokens()) == 3
    again.abort([])
    assert len(tokens()) == 3 and len([f for f in tmp_path.iterdir() if f.name.startswith("_attempt")]) == 1
    TS.forget_shards(str(tmp_path), [("train", 1)])
    assert tokens() == [[0, 5, 0, 6, 7], [0, 9]]
    assert sorted((r["split"], r["shard"], r["stored_tokens"]) for r in TS.stored_shards(spark, str(tmp_path)).collect()) == [("train", 0, 5), ("validation", 0, 2)]


def test_resume_writes_what_is_missing(spark, tmp_path):
    encoded = _encoded(spark, range(30)).repartition(3)
    out = str(tmp_path / "out")
    TS.write_token_shards(encoded, out, 49)
    rows = lambda: sorted((r["file"].rsplit("/", 1)[1], r["start"], r["tokens"]) for r in TS.read_token_shards(spark, out).collect())
    before, attempts = rows(), {(r["split"], r["shard"]): r["attempt"] for r in TS.stored_shards(spark, out).collect()}
    assert TS.resume_token_shards(encoded, out, 49).where("status <> 'complete'").count() == 0
    TS.forget_shards(out, [("train", 1), ("validation", 0)])
    audit = {(r["split"], r["shard"]): r["status"] for r in TS.resume_token_shards(encoded, out, 49).collect()}
    assert audit == {("train", 0): "complete", ("train", 1): "missing", ("validation", 0): "missing", ("validation", 1): "complete"}
    after = {(r["split"], r["shard"]): r["attempt"] for r in TS.stored_shards(spark, out).collect()}
    assert rows() == before and after.keys() == attempts.keys() and after["train", 1] == after["validation", 0] != after["train", 0] == after["validation", 1]


def test_tokens_move_once(spark):
    """One exchange carries token arrays to ordered ranges, and one to the tasks of shards; edges of ranges meet in a small one."""
    encoded = stage(_encoded(spark, range(40)), "encoded")
    plan = T.bos_offsets(encoded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [sum(n_tokens") == 1
    physical = T.bos_offsets(encoded)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in physical.splitlines() if "Exchange hashpartitioning(split" in line and "_cell" in line]
    assert len(wide) <= 3  # the tokens, the totals of ranges and their offsets
    windows = {}
    for cell_tokens in (1 << 22, 64, 1):
        cut = packing.cut_packs(T.bos_offsets(encoded, cell_tokens), 4)
        windows[cell_tokens] = sorted((r["split"], r["shard"], r["pack"], r["window"]) for r in cut.collect())
    assert windows[1 << 22] == windows[64] == windows[1] and len(windows[1]) > 100
    shuffled = packing.cut_packs(T.bos_offsets(encoded).repartition(7), 4)
    assert sorted((r["split"], r["shard"], r["pack"], r["window"]) for r in shuffled.collect()) == windows[1]


def test_broken_shards(spark, tmp_path):
    _write(tmp_path / "a.bin", [1, 2], magic=5)
    with pytest.raises(Exception, match="not a token shard"):
        TS.read_token_shards(spark, str(tmp_path)).collect()
    _write(tmp_path / "a.bin", [1, 2])
    (tmp_path / "a.bin").write_bytes((tmp_path / "a.bin").read_bytes()[:-1])
    with pytest.raises(Exception, match="does not hold"):
        TS.read_token_shards(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no token shards"):
        TS.read_token_shards(spark, str(tmp_path / "none")).collect()


def _encoded(spark, lengths, max_id=50):
    rng = np.random.default_rng(2)
    rows = []
    for i, n in enumerate(lengths):
        ids = [0] + [int(x) for x in rng.integers(2, max_id, n)]
        key = f"{i:032x}"
        rows.append((i, "train" if i % 3 else "validation", i % 2, key, key[-3:], ids, len(ids)))
    return spark.createDataFrame(
        rows, "doc_id long, split string, shard int, order_key string, bucket string, tokens array<int>, n_tokens long")


def test_written_shards(spark, tmp_path):
    encoded = _encoded(spark, range(40)).repartition(6)
    target = tmp_path / "out"
    TS.write_token_shards(encoded, str(target), 49)
    names = {f.name: f for f in target.rglob("*") if f.name.endswith((".bin", ".bos.idx"))}
    assert sorted(names) == sorted(f"{s}-0000{n}.{e}" for s in ("train", "validation") for n in (0, 1) for e in ("bin", "bos.idx"))
    docs = sorted((r["split"], r["shard"], r["order_key"], r["tokens"]) for r in encoded.collect())
    for split in ("train", "validation"):
        for shard in (0, 1):
            mine = [d[3] for d in docs if d[:2] == (split, shard)]
            raw = names[f"{split}-0000{shard}.bin"].read_bytes()
            header = np.frombuffer(raw[:1024], "<i4")
            assert list(header[:4]) == [278895051, 1, sum(map(len, mine)), 2]
            assert list(np.frombuffer(raw[1024:], "<u2")) == [t for d in mine for t in d]
            starts = np.frombuffer(names[f"{split}-0000{shard}.bos.idx"].read_bytes(), "<i4")
            assert list(starts) == list(np.cumsum([0] + [len(d) for d in mine])[:-1])
    with pytest.raises(Exception, match="already exist"):
        TS.write_token_shards(encoded, str(target), 49)


def test_failed_write_leaves_nothing(spark, tmp_path):
    encoded = _encoded(spark, [3, 4, 5])
    wrong = encoded.withColumn("n_tokens", F.when(F.col("doc_id") == 1, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))
    with pytest.raises(Exception):
        TS.write_token_shards(wrong, str(tmp_path / "out"), 49)
    assert list((tmp_path / "out").iterdir()) == []


def test_logs(spark, tmp_path):
    for run in "ab":
        (tmp_path / run).mkdir()
        lines = ['{"step": 1, "val_loss": 2.5, "lr": 0.1}', "", '{"step": 1, "val_loss": NaN}', "{broken", '{"step": "x", "val_loss": 1}',
                 '{"step": 2, "val_loss": Infinity, "other": [1]}'] + [f'{{"step": {i}, "val_loss": {i}.5}}' for i in range(3, 400)]
        (tmp_path / run / "validation.jsonl").write_text("\n".join(lines) + "\n")
    for size in (1, 37, 1000, 1 << 20):
        rows = R.read_run_logs(spark, f"{tmp_path}/*/validation.jsonl", size).collect()
        mine = {r["line_no"]: r for r in rows if r["run"] == f"{tmp_path}/a"}
        assert len(rows) == 2 * len(mine) and sorted(mine) == [1] + list(range(3, 404))
        assert [n for n, r in mine.items() if r["malformed"]] and sorted(n for n, r in mine.items() if r["malformed"]) == [4, 5]
        assert mine[1]["val_loss"] == 2.5 and mine[3]["val_loss"] != mine[3]["val_loss"] and mine[6]["val_loss"] == float("inf")
        assert all(mine[n]["step"] == n - 4 for n in range(7, 404))


def test_byte_shards_end_to_end(spark, tmp_path):
    """Bytes to shards to packs: the files say the same as the table."""
    rows = [(i, f"text {i} " * (i % 5), "train", i % 2, f"{i:032x}", f"{i:032x}"[-3:]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string, shard int, order_key string, bucket string")
    encoder = T.byte_encoder()
    encoded = T.encode_documents(docs, encoder)
    TS.write_token_shards(encoded, str(tmp_path / "out"), encoder.max_id)
    blocks = TS.read_token_shards(spark, str(tmp_path / "out"), 8, block_tokens=16)
    from_files = {(r["file"][-5], r["pack"]): r["window"] for r in packing.cut_blocks(blocks, 8).collect()}
    from_table = {(str(r["shard"]), r["pack"]): r["window"] for r in packing.cut_packs(T.bos_offsets(encoded), 8).collect()}
    assert from_files == from_table and from_files


def test_superseded_results_are_not_opened(spark, tmp_path):
    import os

    for run in "ab":
        (tmp_path / run / "old").mkdir(parents=True)
        (tmp_path / run / "evaluation.json").write_text('{"run_name": "%s", "status": "complete"}' % run)
        for name, time in (("results_1.json", 1000), ("old/results_0.json", 500)):
            (tmp_path / run / name).write_text('{"results": {}}')
            os.utime(tmp_path / run / name, (time, time))
        (tmp_path / run / "old/results_0.json").write_bytes(b"\xff\xfe broken")
        os.utime(tmp_path / run / "old/results_0.json", (500, 500))
    manifests, results = R.read_eval_results(spark, str(tmp_path))
    assert sorted(r["run_name"] for r in manifests.collect()) == ["a", "b"]
    assert sorted((r["path"], r["content"]) for r in results.collect()) == [(f"{tmp_path}/{r}/results_1.json", '{"results": {}}') for r in "ab"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 100])
def test_lines_of_ranges(tmp_path, size):
    from tokenloom.sources.opened_files import lines_of

    for data in (b"a\nbb\n\nccc\r\nd", b"\n\n", b"x", b"no end of line\nlast\n", "é\nü\n".encode()):
        (tmp_path / "f").write_bytes(data)
        with open(tmp_path / "f", "rb") as stream:
            found = [line for first in range(0, len(data), size) for line in lines_of(stream, first, min(first + size, len(data)), len(data))]
        want = data.split(b"\n")
        want = want[:-1] if not want[-1] else want
        assert found == [w.removesuffix(b"\r") for w in want]


def test_lines_written_to_the_files_they_name(spark, tmp_path):
    """One file for each path, lines in order, nothing else beside them and nothing left to move."""
    from tokenloom.sources.opened_files import write_lines

    rows = [(f"{tmp_path}/run={r}/part-0.txt", f"é {i}", r, i) for i in range(40) for r in range(25)]
    lines = spark.createDataFrame(rows, "path string, value string, r int, i int").repartition(5)
    for _ in range(2):  # written again, they are the same
        write_lines(lines.repartition(3, "r").sortWithinPartitions("r", "i"))
        files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
        assert files == sorted(tmp_path / f"run={r}/part-0.txt" for r in range(25))
        assert all(f.read_text() == "".join(f"é {i}\n" for i in range(40)) for f in files)
