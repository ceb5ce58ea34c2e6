"""Registered queries against brute force over the smallest given tables."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

from tokenloom.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(DATA / "documents.parquet").sort_values("doc_id")


def result(spark, name):
    frame = QUERIES[name](spark, str(DATA)).toPandas()
    return frame.sort_values(frame.columns[0]).reset_index(drop=True)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else False,
        "card": 12 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def base_spans(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(spans)


def test_personal_data(spark, documents):
    found = result(spark, "op2_personal_data")
    assert list(found["doc_id"]) == list(documents["doc_id"])
    for (_, row), text in zip(found.iterrows(), documents["text"]):
        spans = base_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert row["base_sha256"] == sha(base)
        counts = Counter(k for _, _, k, _ in spans)
        assert all(row[f"n_{k}"] == counts[k] for k in PATTERNS)
        others = [s for s in row["spans"].split(",") if s and not s.startswith("term:")]
        assert ",".join(others) == base


def test_piece_round_trips(spark, documents):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = result(spark, "op3_piece_round_trips")
    for (_, row), text in zip(found.iterrows(), documents["text"]):
        ids = library.encode(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha(",".join(map(str, ids)))
        assert row["decoded_sha256"] == sha(library.decode(ids))


def test_document_fingerprints(spark, documents):
    found = result(spark, "op4_document_fingerprints")
    texts = list(documents["text"])
    for k, (_, row) in enumerate(found.iterrows()):
        text, following = texts[k], texts[k - 1]
        n = len(text) // 3
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == sha(text[: len(text) - n] + following[:n])
    assert found["near_edited"].median() > 0.5 > found["near_next"].quantile(0.9)
    same = found.assign(text=texts).groupby("text")["fingerprint"].nunique()
    assert (same == 1).all() and found["fingerprint"].nunique() == len(same)


def test_mixed_documents(spark, documents):
    found = result(spark, "op6_mixed_documents")
    sizes = [len(WORD.findall(t or "")) for t in documents["text"]]
    assert list(found["size"]) == sizes
    by_source = pd.Series(sizes, index=documents["source"]).groupby(level=0).sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by_source.index))}
    share, open_sources, target = 1.5 * sum(sizes), set(by_source.index), {}
    while True:
        level = share / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > 2 * by_source[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by_source[s]
            share -= target[s]
        open_sources -= over
    target |= {s: level * weight[s] for s in open_sources}
    found["source"] = list(documents["source"])
    for source, rows in found.groupby("source"):
        assert rows["source_size"].eq(by_source[source]).all()
        assert rows["target"].sub(target[source]).abs().max() < 1e-6 * target[source]
        assert abs(rows["taken"].sum() - target[source]) <= 0.02 * target[source]
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()


def test_toxicity_scores(spark, documents):
    found = result(spark, "op8_toxicity_scores")
    assert list(found["held_out"]) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in documents["doc_id"]]
    assert found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= 0.7)).all()


def test_url_verdicts(spark):
    pages = pd.read_parquet(DATA / "pages.parquet").sort_values("page_id")
    rules = [("allow", "com", ""), ("block", "example.com", "en/"), ("allow", "www.example.com", "en/"), ("block", "net", "es/"), ("block", "net", "fr/")]
    found = result(spark, "op9_url_verdicts")
    for (_, row), url in zip(found.iterrows(), pages["url"]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (row["host"], row["path"]) == (host, path)
        fit = [(len(h + p), v, f"{h}/{p}") for v, h, p in rules
               if (host == h or host.endswith("." + h)) and (not p or path.startswith("/" + p))]
        if fit:
            _, verdict, rule = max(fit)
            assert (row["rule"], row["verdict"]) == (rule, verdict)
        else:
            assert row["rule"] is None and row["verdict"] in ("allow", "block")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_verdicts(spark, documents):
    found = result(spark, "op10_quality_verdicts")
    for (_, row), text in zip(found.iterrows(), documents["text"]):
        counts = quality(text)
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == counts
        assert row["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (row["base_failed"] and row["kept"])


def test_token_lengths(spark, documents):
    from tokenloom.llm.token_counts import count_tokens

    found = result(spark, "op5_token_lengths")
    lengths = sorted(count_tokens(t) for t in documents["text"])
    assert found["n_docs"].sum() == len(lengths) and list(found["n_tokens"]) == sorted(set(lengths))
    for _, row in found.iterrows():
        limit = row["n_tokens"]
        assert row["docs_over"] == sum(n > limit for n in lengths)
        assert row["tokens_over"] == sum(n for n in lengths if n > limit)
        assert row["truncated_tokens"] == sum(min(n, limit) for n in lengths)


def test_near_duplicates(spark, documents):
    from tokenloom.llm.near_dedup import THRESHOLD, similarity

    texts = dict(zip(documents["doc_id"], documents["text"]))
    ids, root = sorted(texts), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if texts[a] == texts[b] or similarity(texts[a], texts[b]) >= THRESHOLD:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = result(spark, "op1_near_duplicates")
    assert list(found["class_id"]) == [find(i) for i in ids]
    assert sum(i != find(i) for i in ids) > 0
