import pytest
from pyspark.sql import functions as F

from tokenloom.operators import tokens as T

TEXTS = ["a b  a\nc", "", "  ", "b zz\té", "a " * 500, "日本 語"]


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_vocab_and_both_encoders(spark):
    docs = _docs(spark)
    vocab = T.build_vocab(docs, 3)
    rows = {r["term"]: (r["n"], r["id"]) for r in vocab.collect()}
    assert rows == {"a": (502, 3), "b": (2, 4), "c": (1, 5)}
    ids = {t: i for t, (_, i) in rows.items()}
    expected = {d: [0] + [ids.get(w, 2) for w in text.split()] for d, text in enumerate(TEXTS)}
    for limit in (10, 0):
        encoder = T.vocab_encoder(vocab, broadcast_terms=limit)
        got = {r["doc_id"]: r["tokens"] for r in T.encode_documents(docs, encoder).collect()}
        assert got == expected
    again = docs.union(docs).union(spark.createDataFrame([(0, "b b a"), (None, "c")], docs.schema))
    both = [sorted(map(str, T.encode_documents(again, T.vocab_encoder(vocab, broadcast_terms=n)).select("doc_id", "tokens").collect())) for n in (10, 0)]
    assert both[0] == both[1] and len(both[0]) == 14
    assert T.encode_documents(docs, encoder).where(F.size("tokens") != F.col("n_tokens")).count() == 0


def test_bytes(spark):
    rows = T.encode_documents(_docs(spark).repartition(3), T.byte_encoder()).collect()
    assert {r["doc_id"]: r["tokens"] for r in rows} == {
        d: [0] + [b + 2 for b in text.encode()] for d, text in enumerate(TEXTS)
    }


def test_widths(spark):
    def width(*ids):
        return T.token_width(spark.createDataFrame([(i,) for i in ids], "id long")).first()["item_size"]

    assert (width(65_535), width(65_536), width(2**32 - 1)) == (2, 4, 4)
    assert T.token_width(spark.createDataFrame([], "id long")).first()["item_size"] == 2
    with pytest.raises(Exception, match="too large"):
        width(2**32)
    with pytest.raises(ValueError):
        T.item_size(2**32)


def test_bos_is_required(spark):
    encoder = T.column_encoder("none", lambda c: F.array().cast("array<int>"), 5, bos_id=None)
    with pytest.raises(ValueError, match="no BOS"):
        T.encode_documents(_docs(spark), encoder)


def test_headers(spark):
    rows = spark.createDataFrame([("train", 0, 5), ("train", 0, 6)], "split string, shard int, n_tokens long")
    header = T.shard_headers(rows, 70_000).first()
    assert (header["magic"], header["version"], header["token_count"], header["item_size"]) == (278895051, 1, 11, 4)
    big = spark.createDataFrame([("train", 0, 2**31)], "split string, shard int, n_tokens long")
    with pytest.raises(Exception, match="holds"):
        T.shard_headers(big, 5).collect()


@pytest.mark.parametrize("bos, eos, pad, first, last, fill", [(0, 1, None, 0, 1, 1), (None, 9, None, 9, 9, 9), (7, None, 8, 7, 7, 8)])
def test_samples(spark, bos, eos, pad, first, last, fill):
    encoder = T.column_encoder(
        "words", lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), F.length), 99,
        bos_id=bos, eos_id=eos, pad_id=pad,
    )
    docs = spark.createDataFrame([(0, "aaa bb"), (1, "a bb ccc dddd eeeee")], "doc_id long, text string")
    short, long = T.document_samples(docs, encoder, 4, padding=True, truncation=True).orderBy("doc_id").collect()
    assert (short["input_ids"], short["labels"], short["attention_mask"]) == (
        [first, 3, 2, fill], [3, 2, last, -100], [1, 1, 1, 0]
    )
    assert (long["input_ids"], long["labels"]) == ([first, 1, 2, 3], [1, 2, 3, 4])
    free = T.document_samples(docs, encoder).orderBy("doc_id").collect()[1]
    assert free["input_ids"] == [first, 1, 2, 3, 4, 5] and free["labels"] == [1, 2, 3, 4, 5, last]


def test_texts_are_encoded_in_parts_of_bounded_size(spark):
    """Parts hold SLICE_BYTES and one text more at most, in order; ids are the same as word by word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = [0, 3, T.SLICE_BYTES, 5, T.SLICE_BYTES // 2, T.SLICE_BYTES // 2, 7, None]
    texts = pa.array([None if n is None else "x " * (n // 2) for n in lengths]).slice(1)
    parts = T._slices(texts)
    assert pa.concat_arrays(parts).equals(texts) and len(parts) > 1
    sizes = [[n or 0 for n in pc.binary_length(p).to_pylist()] for p in parts]
    assert all(sum(n) - max(n) <= T.SLICE_BYTES for n in sizes)
    assert [len(p) for p in T._slices(pa.array([], pa.string()))] == [0]
    rows = [(i, " ".join(["a", "b", "zz"][j % 3] for j in range(n))) for i, n in enumerate((0, 400_000, 1, 300_000, 5))] + [(9, None)]
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "term string, id int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["tokens"] for r in T.encode_documents(docs, T.vocab_encoder(vocab)).collect()}
    assert got == {i: [0] + [{"a": 3, "b": 4}.get(w, 2) for w in (t or "").split()] for i, t in rows}


def test_words_are_looked_up_once_for_each_part_of_the_documents(spark):
    """With a vocabulary of any size too: what is joined does not grow with the uses of a word, nor with the texts that use it."""
    from collections import Counter

    import pyarrow as pa

    words = [f"w{i}" for i in range(30)]
    rows = [(i % 2900, " ".join(words[(i * j) % 30] for j in range(60))) for i in range(3000)] + [(None, None), (5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words[:20])], "term string, id int")
    encoded = T.encode_documents(docs, T.vocab_encoder(vocab, broadcast_terms=0))
    got = Counter((r["doc_id"], tuple(r["tokens"])) for r in encoded.collect())
    ids = {w: i + 3 for i, w in enumerate(words[:20])}
    assert got == Counter((d, (0, *(ids.get(w, 2) for w in (t or "").split()))) for d, t in rows)
    stored = [file for file in encoded.inputFiles() if "/parts-" in file]
    assert 0 < spark.read.parquet(*stored).agg(F.sum(F.size("_terms"))).first()[0] <= 3 * 30

    # A part ends after PART_BYTES, in the middle of a batch or after several.
    texts = ["x y " * (T.PART_BYTES // 16), "", "é y", None] * 9 + ["z"]
    batches = [pa.record_batch([pa.array(texts[a:b], pa.string()), pa.array(range(a, b), pa.int64())], ["text", "n"]) for a, b in ((0, 3), (3, 3), (3, 30), (30, 37))]
    out = pa.Table.from_batches(T._in_parts(0)(iter(batches)))
    assert out["n"].to_pylist() == list(range(37)) and out.column_names == ["n", "_part", "_places", "_terms"]
    parts = {}
    for part, places, terms, text in zip(*(out[c].to_pylist() for c in ("_part", "_places", "_terms")), texts):
        known = parts.setdefault(part, terms)
        assert terms in (known, []) and [known[p] for p in places] == (text or "").split()
    assert len(parts) == 3 and all(len(set(terms)) == len(terms) for terms in parts.values())
    assert list(T._in_parts(0)(iter([]))) == []
