"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from tokenloom.llm import (
    cutting_stock, fingerprints, hard_negatives, mixing, near_dedup, passages, pii, piece_encoding, quality, token_counts, toxicity, treap_search,
    url_filters,
)
from tokenloom.llm.hashing import read_table


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def near_duplicates(spark, sf_dir):
    return near_dedup.near_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "n_links")


def personal_data(spark, sf_dir):
    return pii.personal_data(_documents(spark, sf_dir))


def piece_round_trips(spark, sf_dir):
    return piece_encoding.round_trips(_documents(spark, sf_dir))


def document_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def token_lengths(spark, sf_dir):
    return token_counts.context_lengths(_documents(spark, sf_dir))


def mixed_documents(spark, sf_dir):
    return mixing.mixed_sizes(_documents(spark, sf_dir))


def repeated_passages(spark, sf_dir):
    return passages.repeated_passages(_documents(spark, sf_dir))


def toxicity_scores(spark, sf_dir):
    return toxicity.scores(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def url_verdicts(spark, sf_dir):
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages"))


def quality_verdicts(spark, sf_dir):
    return quality.judge(_documents(spark, sf_dir))


def ranked_documents(spark, sf_dir):
    return treap_search.ranked_search(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def packed_documents(spark, sf_dir):
    return cutting_stock.packed_pieces(_documents(spark, sf_dir)).drop("text_key")


def mined_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_near_duplicates": near_duplicates,
    "op2_personal_data": personal_data,
    "op3_piece_round_trips": piece_round_trips,
    "op4_document_fingerprints": document_fingerprints,
    "op5_token_lengths": token_lengths,
    "op6_mixed_documents": mixed_documents,
    "op7_repeated_passages": repeated_passages,
    "op8_toxicity_scores": toxicity_scores,
    "op9_url_verdicts": url_verdicts,
    "op10_quality_verdicts": quality_verdicts,
    "op11_ranked_documents": ranked_documents,
    "op12_packed_documents": packed_documents,
    "op13_hard_negatives": mined_negatives,
}
ORACLES: dict[str, str] = {"op11_ranked_documents": treap_search.SQL, "op13_hard_negatives": hard_negatives.SQL}
