"""Long texts, whole corpora of occurrences, and matches that other texts get in the way of."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import fingerprints, passages, pii


@pytest.mark.parametrize("n", [2_000, 20_000, 100_000])
def test_likeness_of_long_texts(spark, n):
    text = lambda name, k=n: "".join(f"{name} {i}. " for i in range(k))
    rows = [(text("a"), text("b"), text("a", n - n // 3) + text("c", n // 3), "One.")]
    docs = spark.createDataFrame(rows, "a string, other string, edited string, short string")
    lanes = docs.select(*(fingerprints.fingerprint_lanes(F.col(c)).alias(c) for c in docs.columns))
    near = lanes.select(*(fingerprints.likeness(F.col("a"), F.col(c)).alias(f"near_{c}") for c in docs.columns)).first()
    assert near["near_a"] == 1 and near["near_other"] < 0.4 and 0.5 < near["near_edited"] < 0.85 and near["near_short"] < 0.01


def test_every_occurrence_of_a_revealing_term(spark):
    rows = [(i, f"note {i} reach Zan\\Eib at ann@mail.example.com soon {i}; a b c d e f g h\tZan\\Eib\n\U0001f600 Zan\\Eib") for i in range(6)]
    rows += [(30, "met Zan\\Eib today, not Zan\\Eibs"), (31, "nobody here")]
    rows += [(40 + i, f"note {i} reach nobody at home soon {i}; a b c d e f g h") for i in range(40)]
    rows += [(100 + i, f"mail p{i}@mail.example.com now") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "note 0 reach [TERM] at [EMAIL] soon 0; a b c d e f g h\t[TERM]\n\U0001f600 [TERM]"
    assert clean[30] == "met [TERM] today, not Zan\\Eibs" and clean[31] == "nobody here"
    spans = {r["doc_id"]: (r["spans"], r["n_term"]) for r in pii.personal_data(docs).collect()}
    assert spans[30] == ("term:4:11", 1) and spans[0][1] == 3


def test_terms_of_copied_and_frequent_entities(spark):
    copies = [(i, "reach Zanzibarius at ann@mail.example.com soon") for i in range(200)]
    copies += [(300 + i, f"n{i} Zanzibarius uses ann@mail.example.com often {i}") for i in range(3)]
    copies += [(400 + i, f"other text number {i}") for i in range(50)]
    frequent = [(i, f"n{i} reach Quorum at ann@mail.example.com soon {i}") for i in range(10)]
    frequent += [(50 + i, f"m{i} at p{i}@mail.example.com soon") for i in range(20)]
    for rows, name in ((copies, "Zanzibarius"), (frequent, "Quorum")):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        terms = {r["term"] for r in pii.revealing_terms(docs, pii.found_spans(docs)).collect()}
        assert name.lower() in terms and "soon" not in terms


def test_passage_twice_in_one_of_two_texts(spark):
    rng = random.Random(5)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    for _ in range(4):  # either text may be the hub
        passage = fill(80)
        rows = [(1, " ".join(passage + fill(200) + passage + fill(9))), (2, " ".join(fill(30) + passage))]
        found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        sides = {s for r in found for s in ((r["doc_id"], r["start"], r["end"]), (r["other_id"], r["other_start"], r["other_end"]))}
        assert sides == {(1, 0, 80), (1, 280, 360), (2, 30, 110)}


def test_page_with_open_tags(spark):
    """A megabyte of tags that never close is read once; words with accents count without them."""
    from tokenloom.llm import url_filters

    html = ["<script>" * 130_000, "<style " * 150_000, "<" * 1_000_000, "<p>Éclair été</p><script>var hidden;</script> naïve" + "<script>tail " * 1000]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    counts = {r["word"]: r["n"] for r in url_filters.unigram_counts(pages).collect()}
    assert counts["eclair"] == counts["ete"] == counts["naive"] == 1 and not {"hidden", "script", "tail"} & counts.keys()
    assert url_filters.filter_urls(pages).count() == len(html)


def test_long_words_of_hosts(spark):
    from tokenloom.llm import url_filters

    word = "incomprehensibilities" + "x" * 9
    pages = spark.createDataFrame([(1, f"http://the{word}.org/", f"<b>{word} the the {word}</b>")], "page_id long, url string, html string")
    labels = url_filters.segmented_labels(pages.select(url_filters.split_url(F.col("url"))[0].alias("host")), url_filters.unigram_counts(pages))
    assert {r["label"]: r["words"] for r in labels.collect()}[f"the{word}"] == ["the", word]


def test_check_lanes_rest_on_two_hashes(spark):
    """Lanes of both halves add up by paragraph, and differ where paragraphs do."""
    row = spark.createDataFrame([("One. Two.", "One. ", "Two.")], "a string, b string, c string").select(
        *(fingerprints.fingerprint_lanes(F.col(c)).alias(c) for c in "abc")).first()
    half = 1 + fingerprints.CHECKS // 2
    for lanes in (slice(1, half), slice(half, 1 + fingerprints.CHECKS)):
        assert row["b"][lanes] != row["c"][lanes] and len(set(row["b"][lanes])) == fingerprints.CHECKS // 2
