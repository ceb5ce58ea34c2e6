"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import (
    fingerprints, mixing, near_dedup, passages, pii, piece_encoding, quality, token_counts, toxicity, url_filters,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, text_key string, toxicity double, "
    "row int, taken int, size int, copies int, spans string, kind string, node long, score double, "
    "n int, _id int, _key int, _d int, _s int, _h int, _r int, kept_id int, planned_doc_id int, term string"
)
LONG = " ".join(random.Random(3).choice("alpha beta gamma delta omega sigma".split()) for _ in range(30_000))
MAIL = "write to ann@mail.example.com or +1 (555) 555-0100 from 10.0.0.1 please "


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1.0, 2, 3, 4, 5, "s", "k", 6, 0.5, *range(9), "t")


@pytest.fixture(scope="module")
def odd(spark):
    words = [f"w{i}" for i in range(90)]
    base = " ".join(words)
    near = " ".join(words[:40] + ["changed"] + words[41:])
    rows = [
        _row(None, None, None, None), _row(None, "", None, None), _row(1, ""), _row(2, None), _row(3, " \t\n"),
        _row(4, base), _row(4, base), _row(5, near), _row(6, near, "xx"), _row(None, base, "de", None),
        _row(7, MAIL * 3), _row(8, LONG), _row(9, "one"), _row(9, "two words"), _row(10, "x" * 20_000), _row(11, "\u00e9\U0001f600 \u2581 z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (4, 1, 1), (5, None, None), (7, 0, 1), (None, 1, 1), (8, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "near": near_dedup.near_classes, "pii": pii.personal_data, "encode": piece_encoding.round_trips,
    "fingerprints": fingerprints.edited_fingerprints, "mixing": mixing.mixed_sizes, "quality": quality.judge,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, none, name):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](none).count() == 0


def test_near_classes(odd):
    rows = near_dedup.near_classes(odd).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["root"], []).append(r["doc_id"])
    groups = sorted((sorted(i or -1 for i in g) for g in by_key.values()), key=str)
    assert [-1, 4, 4, 5, 6] in groups and [-1, -1, 1, 2] in groups
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_near_without_clashes_at_the_threshold():
    a = " ".join(f"t{i}" for i in range(49))
    b = " ".join(f"t{i}" for i in range(44)) + " " + " ".join(f"u{i}" for i in range(5))
    assert near_dedup.similarity(a, a) == 1 and near_dedup.similarity("", "") == 1
    assert near_dedup.similarity(a, b) == pytest.approx(40 / 50)
    assert near_dedup.similarity("x y", "x y z") == 0


def test_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    m = 4096
    doc = np.repeat([0, 1], 60)
    s = near_dedup.bag_min_hash(np.concatenate([keys, keys]), np.concatenate([a, b]), doc, 2, m)
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_bucket_of_unlike_members_is_settled(spark):
    """Chains of near texts whose ends are unlike form one class."""
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(24):
        for j in range(i):
            words[8 * j] = f"z{j}"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.near_classes(docs).collect()} == {100}


def test_personal_data_terms(spark):
    rows = [(i, f"note {i} reach Zanzibarius at ann@mail.example.com soon {i}") for i in range(6)]
    rows += [(50 + i, f"note {i} reach nobody at home soon {i}") for i in range(40)]
    rows += [(100 + i, f"mail p{i}@mail.example.com now") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert "term:13:24" in found[0] and found[60] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "note 0 reach [TERM] at [EMAIL] soon 0" and clean[60] == "note 10 reach nobody at home soon 10"


def test_redaction_of_overlaps(spark):
    docs = spark.createDataFrame([(1, "call +371449635398431 or 4111 1111-1111 1111 now", 1)], "doc_id long, text string, n_chars long")
    text = pii.sanitised(docs).first()["text"]
    assert text == "call [PHONE] or [CARD] now"


def test_encoding_round_trip(odd):
    encoded = piece_encoding.encode_documents(odd.where("doc_id IN (9, 10, 11)"))
    texts = sorted(r["text"] for r in piece_encoding.decode_documents(encoded).collect())
    assert texts == sorted(["one", "two words", "x" * 20_000, "\u00e9\U0001f600   z"])


def test_fingerprints_are_homomorphic(spark):
    docs = spark.createDataFrame([("One. Two.\nThree.", "Three.One. Two.\n", "One. Two.\n", "Three.")], "a string, b string, c string, d string")
    lanes = {c: fingerprints.fingerprint_lanes(F.col(c)) for c in docs.columns}
    row = docs.select(
        (lanes["a"] == fingerprints.combine(lanes["c"], lanes["d"])).alias("sum"),
        (lanes["c"] == fingerprints.combine(lanes["a"], lanes["d"], -1)).alias("difference"),
        (lanes["a"] == lanes["b"]).alias("order"), (lanes["a"] == lanes["c"]).alias("other"),
    ).first()
    assert row["sum"] and row["difference"] and row["order"] and not row["other"]


def test_token_counts(odd, none):
    table = token_counts.context_lengths(odd)
    assert table.agg(F.sum("n_docs")).first()[0] == odd.count()
    lengths = sorted(token_counts.count_tokens(r["text"]) for r in odd.collect())
    totals = {r["context"]: r["tokens"] for r in token_counts.truncated_totals(table, [0, 1, 50, 10**6]).collect()}
    assert totals == {n: sum(min(n, x) for x in lengths) for n in totals}
    got = {r["quantile"]: r["n_tokens"] for r in token_counts.length_quantiles(table, [0.5, 1.0]).collect()}
    assert got == {0.5: lengths[len(lengths) // 2 - 1], 1.0: lengths[-1]}
    assert token_counts.context_lengths(none).count() == 0


def test_mixing(odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = mixing.mixed_sizes(odd).agg(F.sum("taken")).first()[0]
    words = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    assert mixed.agg(words).first()[0] == taken
    assert sorted(map(tuple, mixing.mixed_sizes(odd).collect()), key=str) == sorted(map(tuple, mixing.mixed_sizes(odd.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("claims, seats", [([50, 30, 20, 1, 0], 11), ([7.5, 7.5, 7.5], 4), ([1000, 1, 1, 1, 1, 1], 40), ([3, 2], 0)])
def test_apportionment(spark, claims, seats):
    won = [0] * len(claims)
    for _ in range(seats):
        best = max(range(len(claims)), key=lambda i: (claims[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    parties = spark.createDataFrame([(i, float(c), 1) for i, c in enumerate(claims)], "party int, claim double, g int")
    rows = mixing.apportion(parties, F.lit(seats), "claim", ["g"], "seats").collect()
    assert [r["seats"] for r in sorted(rows, key=lambda r: r["party"])] == won


def test_passages(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(80)]
    fuzzy = [w if i % 12 else word() for i, w in enumerate(passage)]
    fill = lambda n: [word() for _ in range(n)]
    rows = [
        (1, " ".join(fill(100) + passage + fill(30))), (2, " ".join(fill(10) + passage)), (3, " ".join(fuzzy + fill(200))),
        (4, " ".join(fill(300))), (5, " ".join(fill(60) + passage[:30] + fill(60))), (6, " ".join(passage[:49])),
        (7, None), (8, ""), (None, " ".join(fill(40) + passage)),
    ]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (2, rows[1][1])]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    touched = {i for r in found for i in (r["doc_id"], r["other_id"])}
    assert {1, 2, 3, None} <= touched and not touched & {4, 5, 6, 7, 8}
    assert {(r["doc_id"], r["other_id"]) for r in found if r["kind"] == "copy"} == {(20, 1), (21, 1)}
    exact = [r for r in found if r["kind"] == "passage" and 3 not in (r["doc_id"], r["other_id"])]
    assert all(r["end"] - r["start"] == 80 and r["similarity"] == 1 for r in exact)
    assert passages.repeated_passages(none).count() == 0


def test_common_passage_gives_links_in_proportion(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20))) for i in range(60)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for r in found for i in (r["doc_id"], r["other_id"])} == set(range(60)) and len(found) == 59


def test_deobfuscation(spark):
    text = "the idiot and the stupid moron said that this is not the idiot moron stupid " * 30
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    decoder = toxicity.Decoder.of([tuple(r) for r in toxicity.gram_counts(docs).collect()])
    for written, plain in {"1d10t": "idiot", "s7upid": "stupid", "m0r0n": "moron", "idiooooot": "idiot", "!d!ot": "idiot", "i.d.i.o.t": "idiot",
                           "the i d i o t said": "the idiot said", "42.1.1.1": "42.1.1.1", "plain words": "plain words"}.items():
        assert decoder.restore(written) == plain


def test_toxicity(spark, odd, none, labels):
    rows = toxicity.scores(odd, labels)
    assert rows.count() == odd.count() and rows.where("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.scores(none, labels).count() == 0
    assert toxicity.scores(odd, labels.where("false")).agg(F.max("score")).first()[0] < 1e-6
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns


def test_urls(spark):
    rows = [(1, None, None), (2, "", "<p>x"), (3, "no scheme", None), (4, "HTTP://WWW.Example.COM/en/1?a=b#c", "<p>spam farm cheap pills</p>"),
            (5, "http://x.net/es/", "spam"), (6, "http://x.net/e", "spam"), (6, "http://x.net/e", "spam"), (None, "a://b://c/d", ""), (7, "http://spamfarm.org?x=/en/", "farm farm spam")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("x")).withColumn("host", F.lit(1))
    got = [tuple(r)[:5] for r in url_filters.filter_urls(pages).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[4] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by_id[5][2:] == ("net/es/", "block")
    assert by_id[1][:3] == ("", "", None) and by_id[None][:2] == ("b:", "//c/d") and by_id[7][:2] == ("spamfarm.org", "")
    assert url_filters.filter_urls(pages.where("false")).count() == 0
    costs = {"spam": 3.0, "farm": 3.0, "far": 4.0, "m": 9.0}
    assert url_filters.segment("spamfarmqq", costs) == ["spam", "farm", "qq"]


def test_quality_distances(spark):
    text = "the of and to in a is that for it as was with be by on not he his but " * 20
    rows = [(i, text, "en") for i in range(10)] + [(50, "zq xw vv kj " * 3 + "#### $$$$ &&&& %%%% " * 30 + text[:160], "en"), (51, text, None)]
    rows = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split()))), lang) for i, t, lang in rows]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50]["character_distance"] > quality.MAX_CHARACTER_DISTANCE > got[0]["character_distance"]
    assert not got[50]["kept"] and got[51]["word_distance"] is None


def test_pipeline_stages_keep_columns(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd, none):
        docs = start.select(*columns)
        for n, (name, step) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{start is none}-{n}"
            step(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if n + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns, name
    assert docs.columns == ["doc_id", "ids"] and docs.count() == 0
