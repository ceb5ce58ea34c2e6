"""Ranked search, packing and hard negatives against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from tokenloom.llm import cutting_stock, hard_negatives, treap_search

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, count=10):
    """The whole ranking by the contract's formulas, with exact numbers."""
    terms = [Counter(TERM.findall((t or "").translate(FOLD))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n_docs, n_terms = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item_id, text in {(i, tuple(sorted(set(TERM.findall((t or "").translate(FOLD)))))) for i, t in items}:
        hits = []
        for (doc_id, _), held, n in zip(docs, terms, sizes):
            score = 0
            for term in text:
                if tf := held.get(term, 0):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))
            if score > 0:
                hits.append((-score, doc_id is None, doc_id))
        hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        out += [(item_id, rank, h[2], -h[0]) for rank, h in enumerate(hits[:count], 1)]
    return sorted(out, key=str)


def test_ranked_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"W{i}" for i in range(60)] + ["Été", "naïve", "42", "x"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(None, text(30)), (None, text(5)), (7, text(9)), (500, None), (501, ""), (502, "?! --")]
    docs += [(600 + i, docs[3][1]) for i in range(30)] + [(700, " ".join(words * 400))]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(25, None), (26, "?"), (27, "unknown"), (None, "W1 W2"), (3, "w0 w0"), (3, "w0 w0")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "score": F.lit("x"), "terms": F.lit(2)}), \
        spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "doc_id": F.lit("x"), "weight": F.lit(2)})
    expected = ranked(docs, items)
    assert sorted(map(tuple, treap_search.ranked_search(*frames).collect()), key=str) == expected
    monkeypatch.setattr(treap_search, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, treap_search.ranked_search(*(f.repartition(3) for f in frames)).collect()), key=str) == expected
    assert treap_search.ranked_search(frames[0].where("false"), frames[1]).count() == 0
    assert treap_search.ranked_search(frames[0], frames[1].where("false")).count() == 0


def test_treap_holds_every_cell_and_finds_the_best(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(120):
        rows_n, columns_n = rng.integers(1, 60, 2)
        cells = rng.choice(rows_n * columns_n, rng.integers(1, rows_n * columns_n + 1), replace=False)
        values = rng.integers(1, 50 if trial % 2 else 10**6, len(cells))
        grid = np.zeros((rows_n, columns_n), np.int64)
        grid[cells // columns_n, cells % columns_n] = values
        height = max(1, int(max(rows_n, columns_n) - 1).bit_length())
        treap = treap_search.Treap.read(treap_search.build_treap(cells // columns_n, cells % columns_n, values, height))
        back = np.zeros_like(grid)
        back[treap.row, treap.column] = treap.value
        assert len(treap.value) == len(cells) and (back == grid).all()
        rows = np.sort(rng.choice(rows_n, rng.integers(1, rows_n + 1), replace=False))
        weights = rng.integers(1, 9, len(rows))
        monkeypatch.setattr(treap_search, "STEP_NODES", int(rng.choice([1, 64, 16384])))
        sums = (grid[rows] * weights[:, None]).sum(axis=0)
        least = max(1, np.sort(sums)[::-1][4] if columns_n > 4 else 1)
        found = {(int(c), int(s)) for c, s in zip(*treap.best(rows, weights, columns_n, 5)) if s >= least}
        assert found == {(int(c), int(sums[c])) for c in np.flatnonzero(sums >= least)}


def negatives(rows):
    """All steps of the contract on a list of rows."""
    kept = set()
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.add((vec_id, label, tuple(math.floor(256 * float(x)) for x in vector), tuple(vector)))
    kept = sorted(kept, key=str)
    out = []
    for anchor in kept:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(anchor[2], r[2])), r) for r in kept if r[0] != anchor[0] and len(r[2]) == len(anchor[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for ps, p in [s for s in scored if s[1][1] == anchor[1]][:5]:
            fitting = [s for s in scored if s[1][1] != anchor[1] and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(anchor[0], p[0], rank, n[0], ps, ns) for rank, (ns, n) in enumerate(fitting, 1)]
    return sorted(out, key=str)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vector = lambda n=6: [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(n)]
    rows = [(i, rng.randint(0, 9), vector()) for i in range(0, 1500, 3)] + [(i * 100, 4, vector()) for i in range(-3, 8)]
    common = vector()
    rows += [(2000 + i, rng.randint(0, 9), common) for i in range(200)] + [(None, 4, common), (None, 5, common)]
    rows += [(100, None, common), (200, 3, None), (300, 3, [1.0, None] + vector(4)), (400, 3, [float("nan")] + vector(5)), (500, 3, [float("inf")] + vector(5))]
    rows += [(600, 4, vector(3)), (601, 5, vector(3)), (700, 4, []), (800, 3, [0.0] * 6), (900, 3, [3e6, -3e6] + vector(4)), (903, 3, [3e6, 2e6] + vector(4)), (905, 2, [2e6, -2e6] + vector(4))]
    rows = list({r[0]: r for r in rows if r[0] is not None}.values()) + [r for r in rows if r[0] is None]
    frame = spark.createDataFrame(rows + rows[:40], "vec_id long, label int, embedding array<double>").withColumns({"rank": F.lit(0), "score": F.lit("x")})
    expected = negatives(rows)
    assert sorted(map(tuple, hard_negatives.hard_negatives(frame).collect()), key=str) == expected
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 4)
    assert sorted(map(tuple, hard_negatives.hard_negatives(frame).collect()), key=str) == expected
    assert hard_negatives.hard_negatives(frame.where("false")).count() == 0


def whole_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = whole_ids.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_packing(pieces, texts, capacity=2048):
    """Every id in one piece, sequences without gaps; gives the share of padding."""
    pieces = pieces.sort_values(["doc_id", "start"]) if len(pieces) else pieces
    left = Counter()
    for doc_id, text in texts:
        left[doc_id, tuple(whole_ids(text))] += 1
    at, seen = {}, Counter()
    for r in pieces.itertuples():
        matching = [ids for (doc_id, ids), _ in left.items() if (doc_id == r.doc_id or (doc_id is None and pd.isna(r.doc_id))) and len(ids) == r.doc_tokens
                    and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert matching and r.length > 0
        seen[None if pd.isna(r.doc_id) else r.doc_id] += r.length
    want = Counter()
    for (doc_id, ids), n in left.items():
        want[doc_id] += n * len(ids)
    assert seen == want
    padding = total = 0
    for _, group in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (group.offset.to_numpy() == np.cumsum(group.length) - group.length).all()
        size = int(group.length.sum())
        assert size <= capacity
        total += size
        padding += cutting_stock.padded(size, capacity) - size
    return padding / max(total, 1)


def test_packing_against_whole_encodings(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "House", "stran­ge", "Été", "x.", "naïve,", "42", "it's", "#!?", "ét", " ", "日本"])
    texts = [(i, rng.choice([" ", "\n"]).join(word() for _ in range(int(rng.expovariate(1 / 300))))) for i in range(300)]
    texts += [(None, None), (None, "two words"), (5, "two words"), (5, "two words"), (901, ""), (902, "a<|endoftext|>b"), (903, "x" * 30_000), (904, " ".join(["long"] * 9000))]
    texts += [(1000 + i, "same text here") for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"start": F.lit(1), "length": F.lit("x"), "bucket": F.lit(2), "parts": F.lit(3)})
    pieces = cutting_stock.packed_pieces(docs)
    stored = pieces.toPandas()
    assert check_packing(stored, texts) < 0.005
    assert cutting_stock.packed_pieces(docs.where("false")).count() == 0
    sequences = {r["sequence_id"]: r["ids"] for r in cutting_stock.packed_sequences(docs, pieces).collect()}
    for r in pieces.collect():
        assert zlib.crc32(np.array(sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("seed", range(4))
def test_program_reaches_its_bound(seed):
    """Fractional uses meet the orders exactly; the value lies between the tokens and the first basis."""
    rng = random.Random(seed)
    orders = dict(Counter(rng.randint(1, 63) for _ in range(rng.choice([3, 50, 3000]))))
    program = cutting_stock.StockProgram(orders, capacity=64, gap=1e-9, pivots=4000)
    first = float(program.costs @ program.uses)
    solution = program.solve()
    made = Counter()
    for pattern, uses in solution:
        assert sum(n * k for n, k in pattern.items()) <= 64
        for n, k in pattern.items():
            made[n] += k * uses
    assert all(made[n] == pytest.approx(k, rel=1e-6) for n, k in orders.items())
    value = sum(cutting_stock.padded(sum(n * k for n, k in p.items()), 64) * x for p, x in solution)
    assert program.tokens - 1e-6 <= program.bound <= value + 1e-6 <= first + 2e-6
    assert value <= program.bound * 1.02 + 1e-6
    patterns, left = cutting_stock.rounded(solution, orders)
    whole = Counter(left)
    for pattern, uses in patterns:
        for n, k in pattern.items():
            whole[n] += k * uses
    assert whole == Counter(orders)


def test_knapsack_against_all_sets():
    rng = random.Random(1)
    for _ in range(30):
        lengths = rng.sample(range(1, 13), rng.randint(1, 5))
        prices = np.full(13, -np.inf)
        prices[lengths] = [rng.uniform(-2, 9) for _ in lengths]
        best, taken = cutting_stock.knapsack(prices, 12)
        brute = [0.0] + [-math.inf] * 12
        for total in range(1, 13):
            brute[total] = max([brute[total - n] + prices[n] for n in lengths if n <= total], default=-math.inf)
        assert np.allclose(best, brute)
