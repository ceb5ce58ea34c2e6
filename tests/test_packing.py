import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import packs as P
from tokenloom.operators import packing


def _ids(spark, *lists):
    return spark.createDataFrame([(list(x),) for x in lists], "x array<int>")


@pytest.mark.parametrize(
    "ids, bos, eos, segments, positions",
    [
        ([7, 31, 32, 33, 7, 40, 7], 7, 7, [1, 1, 1, 1, 2, 2, 3], [0, 1, 2, 3, 0, 1, 0]),
        ([3, 51, 52, 4, 3, 53, 4], 3, 4, [1, 1, 1, 1, 2, 2, 2], [0, 1, 2, 3, 0, 1, 2]),
        ([5], 1, None, [1], [0]),
        ([1, 1], 1, None, [1, 2], [0, 0]),
        ([9, 2, 9, 2, 1], None, [2], [1, 1, 2, 2, 3], [0, 1, 0, 1, 0]),
    ],
)
def test_segments_and_positions(spark, ids, bos, eos, segments, positions):
    row = _ids(spark, ids).select(
        P.segment_ids(F.col("x"), bos, eos).alias("s"), P.position_ids(F.col("x"), bos, eos).alias("p")
    ).first()
    assert (row["s"], row["p"]) == (segments, positions)


def test_markers_are_required(spark):
    with pytest.raises(ValueError):
        P.segment_ids(F.col("x"), None, None)


@pytest.mark.parametrize(
    "inputs, labels, bos, eos, expected",
    [
        ([7, 31, 7], [31, 7, 40], 7, 7, [31, 7, 40]),
        ([3, 51, 4, 3], [51, 4, 3, 53], 3, 4, [51, 4, -100, 53]),
    ],
)
def test_boundary_labels(spark, inputs, labels, bos, eos, expected):
    df = spark.createDataFrame([(inputs, labels)], "input_ids array<int>, labels array<int>")
    assert packing.mask_boundary_labels(df, bos, eos).first()["labels"] == expected


def _encoded(spark, docs):
    rows = [("train", s, f"{i:032x}", f"{i:032x}"[:3], i, t, len(t)) for i, (s, t) in enumerate(docs)]
    return spark.createDataFrame(
        rows, "split string, shard int, order_key string, bucket string, doc_id long, tokens array<int>, n_tokens long"
    )


def test_shard_vector(spark):
    encoded = _encoded(spark, [(0, [0, 61]), (0, [0, 62, 63, 64]), (0, [0, 65, 66])])
    rows = packing.pack_documents(encoded, 4, 0, 0).orderBy("pack").collect()
    assert [(r["input_ids"], r["labels"], r["attention_mask"], r["position_ids"]) for r in rows] == [
        ([0, 61, 0, 62], [61, 0, 62, 63], [1, 1, 2, 2], [0, 1, 0, 1]),
        ([63, 64, 0, 65], [64, 0, 65, 66], [1, 1, 2, 2], [0, 1, 0, 1]),
    ]


@pytest.mark.parametrize("seq_len", [1, 3, 7])
def test_packs_match_brute_force(spark, seq_len):
    rng = random.Random(seq_len)
    docs = [(rng.randrange(3), [0] + [rng.randrange(2, 50) for _ in range(rng.randrange(0, 40))]) for _ in range(60)]
    encoded = _encoded(spark, docs).repartition(5)
    got = {(r["shard"], r["pack"]): r for r in packing.pack_documents(encoded, seq_len, 0).collect()}
    count = 0
    for shard in range(3):
        stream = [t for s, tokens in docs if s == shard for t in tokens]
        position = 0
        while position + seq_len < len(stream):
            chunk = stream[position : position + seq_len + 1]
            row = got[shard, position // seq_len]
            assert row["input_ids"] == chunk[:-1]
            assert row["labels"] == [-100 if y == 0 else y for y in chunk[1:]]
            position += seq_len
            count += 1
    assert count == len(got)
    stats = packing.pack_stats(packing.pack_documents(encoded, seq_len, 0), encoded, seq_len).collect()
    for r in stats:
        assert r["tokens"] == r["packs"] * seq_len + 1 + r["tail_tokens"]


def test_numbers_caps_and_batches(spark):
    encoded = _encoded(spark, [(s, [0] + list(range(2, 20 + s))) for s in range(3) for _ in range(2)])
    packs, counts = packing.pack_documents(encoded, 4, 0), packing.shard_packs(encoded, 4)
    numbered = sorted((r["shard"], r["pack"], r["pack_number"]) for r in packing.pack_numbers(packs, counts).collect())
    assert [n for _, _, n in numbered] == list(range(len(numbered)))
    capped = packing.cap_packs(packs, counts, 5).collect()
    assert sorted(r["pack_number"] for r in capped) == [0, 1, 2, 3, 4]
    batches = packing.batch_packs(packs, counts, 4).orderBy("batch").collect()
    assert [len(b["input_ids"]) for b in batches] == [4] * (len(numbered) // 4) + ([len(numbered) % 4] if len(numbered) % 4 else [])
    assert batches[0]["packed_seq_ids"] == batches[0]["attention_mask"]
    order = packing.order_shards(packs, shuffle=True, seed=1)
    assert sorted(r["shard_order"] for r in order.collect()) == [0, 1, 2]


def test_bad_arguments(spark):
    encoded = _encoded(spark, [(0, [0, 1])])
    for call in (lambda: packing.cut_packs(encoded, 0), lambda: packing.cap_packs(encoded, encoded, 0), lambda: packing.batch_packs(encoded, encoded, 0)):
        with pytest.raises(ValueError):
            call()
