"""Repeated passages against brute force: third texts in the way, edits, long and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import passages


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def touching(found, a, b, low, high, share=0.9):
    """Whether a row of a names words [low, high) of it, all but a small share, and b or a text linked with it."""
    return any(
        {r["doc_id"], r["other_id"]} == {a, b} and min(s[1], high) - max(s[0], low) >= share * (high - low)
        for r in found
        for s in [(r["start"], r["end"]) if r["doc_id"] == a else (r["other_start"], r["other_end"])]
    )


def found_of(spark, rows):
    return passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_third_texts_that_hold_a_part(spark):
    """A and B share a passage; others hold its first words, or one half each."""
    rng = random.Random(1)
    rows, cases = [], []
    for n in range(60):
        passage = words_of(rng, 55)
        a, b = 100 * n, 100 * n + 1
        rows += [(a, " ".join(words_of(rng, 20) + passage + words_of(rng, 20))), (b, " ".join(words_of(rng, 30) + passage + words_of(rng, 7)))]
        for k in range(4):
            rows.append((a + 10 + k, " ".join(words_of(rng, 15) + passage[:45] + words_of(rng, 30))))
        cases.append((a, b, 20, 75))
    for n in range(60, 120):
        passage = words_of(rng, 60)
        a, b = 100 * n, 100 * n + 1
        rows += [(a, " ".join(words_of(rng, 20) + passage + words_of(rng, 20))), (b, " ".join(words_of(rng, 30) + passage + words_of(rng, 7)))]
        for k in range(3):
            rows.append((a + 10 + k, " ".join(words_of(rng, 15) + passage[:30] + words_of(rng, 30))))
            rows.append((a + 20 + k, " ".join(words_of(rng, 15) + passage[30:] + words_of(rng, 30))))
        cases.append((a, b, 20, 80))
    found = found_of(spark, rows)
    assert [c for c in cases if not touching(found, *c, share=1.0)] == []
    linked = {i for r in found for i in (r["doc_id"], r["other_id"])}
    assert linked == {i for c in cases for i in c[:2]}


def test_recall_of_edited_copies(spark):
    """Passages with one word in n replaced, at every similarity from 0.8 up, or with words left out and added."""
    rng = random.Random(2)
    rows, cases, number = [], {}, 0
    for length in (60, 100, 200):
        for n in (20, 12, 9, 7, 6, 5):
            for _ in range(25):
                passage = words_of(rng, length)
                edited = [w if i % n != n // 2 else words_of(rng, 1)[0] for i, w in enumerate(passage)]
                rows += [(number, " ".join(words_of(rng, 20) + passage + words_of(rng, 20))), (number + 1, " ".join(words_of(rng, 30) + edited + words_of(rng, 9)))]
                cases.setdefault((length, n), []).append((number, number + 1, 20, 20 + length))
                number += 2
        for _ in range(25):
            passage = words_of(rng, length)
            edited = list(passage)
            for _ in range(length // 12):
                at = rng.randrange(len(edited))
                if rng.random() < 0.5:
                    del edited[at]
                else:
                    edited.insert(at, words_of(rng, 1)[0])
            rows += [(number, " ".join(words_of(rng, 20) + passage + words_of(rng, 20))), (number + 1, " ".join(words_of(rng, 30) + edited + words_of(rng, 9)))]
            cases.setdefault((length, "shifted"), []).append((number, number + 1, 20, 20 + length))
            number += 2
    found = found_of(spark, rows)
    recall = {k: sum(touching(found, *c, share=0.7) for c in cs) / len(cs) for k, cs in cases.items()}
    assert min(recall.values()) >= 0.88 and sum(recall.values()) / len(recall) >= 0.95, recall
    for r in found:
        assert r["similarity"] >= 0.8 and {r["doc_id"] // 2, r["other_id"] // 2} == {r["doc_id"] // 2}


def test_exact_passages_against_brute_force(spark):
    """Random texts that quote each other: every common run of 50 words or more is found, but for less than 50 words at its ends."""
    rng = random.Random(3)
    pool = [words_of(rng, rng.randint(20, 90)) for _ in range(14)]
    texts = {}
    for i in range(40):
        parts = [rng.choice(pool)[rng.randint(0, 8) :] if rng.random() < 0.5 else words_of(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        texts[i] = [w for p in parts for w in p]
    found = found_of(spark, [(i, " ".join(t)) for i, t in texts.items()])
    covered = {i: set() for i in texts}
    for r in found:
        for who, a, b in ((r["doc_id"], r["start"], r["end"]), (r["other_id"], r["other_start"], r["other_end"])):
            covered[who].update(range(a, b) if r["kind"] == "passage" else range(len(texts[who])))
    runs = 0
    for i in texts:
        for j in texts:
            if i >= j:
                continue
            at = {}
            for y, w in enumerate(texts[j]):
                at.setdefault(w, []).append(y)
            for x in range(len(texts[i])):
                for y in at.get(texts[i][x], []):
                    if x and y and texts[i][x - 1] == texts[j][y - 1]:
                        continue
                    n = 0
                    while x + n < len(texts[i]) and y + n < len(texts[j]) and texts[i][x + n] == texts[j][y + n]:
                        n += 1
                    if n >= 50:
                        runs += 1
                        for who, first in ((i, x), (j, y)):
                            inside = [first + k in covered[who] for k in range(n)]
                            assert sum(inside) >= max(50, n - 50) - 8 and any(inside), (i, j, x, y, n)
    assert runs > 30


def test_long_and_odd_texts(spark):
    rng = random.Random(4)
    long = words_of(rng, 30_000)
    rows = [(1, " ".join(long)), (2, " ".join(words_of(rng, 500) + long[9_000:29_000] + words_of(rng, 3))), (3, " ".join(["same"] * 5_000)), (4, " ".join(["same"] * 300 + words_of(rng, 60))),
            (5, None), (6, ""), (None, " ".join(long[100:400])), (7, "x" * 100_000), (8, "é ퟿ " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "seed", "place", "owner", "n", "least", "text_key")})
    found = passages.repeated_passages(docs).collect()
    assert touching(found, 2, 1, 500, 20_500, share=1.0) and touching(found, None, 1, 0, 300, share=1.0) and touching(found, 4, 3, 0, 300)
    assert not {5, 6, 7, 8} & {i for r in found for i in (r["doc_id"], r["other_id"])}


@pytest.mark.parametrize("seed", range(6))
def test_chains_against_all_chains(seed):
    rng = random.Random(seed)
    points = list({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)})
    points.sort(key=lambda x: (x[0], -x[1]))
    best = []
    for i, (p, h) in enumerate(points):
        best.append(1 + max([0.0, *(best[j] - passages.GAP_COST * (p - q + h - g) for j, (q, g) in enumerate(points[:i]) if q < p and g < h)]))
    found = passages.chains(points)
    first = found[0]
    score = 1 + sum(1 - passages.GAP_COST * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(first, first[1:]))
    assert score == pytest.approx(max(best)) and sorted(x for c in found for x in c) == sorted(points)
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))


def test_seeds_with_many_holders_of_unlike_surroundings(spark):
    """Two texts share a seed in like surroundings; three others with lower ids hold it elsewhere."""
    from tokenloom.llm.passages import Hubs, _is_alike

    rng = random.Random(5)
    sides = [0b1111 << 4 * k for k in range(4)]
    sketches = [a | b << 16 for a, b in zip(sides, sides[1:] + sides[:1])]
    signed = [s - (s >> 31 << 32) for s in sketches]
    rows = [(n, [7], [n], [signed[n]]) for n in range(4)] + [(9, [7], [90], [signed[3]])]
    seeded = spark.createDataFrame(rows, "node long, seeds array<long>, places array<int>, sketches array<int>")
    assert [tuple(r) for r in passages.seed_matches(seeded).collect()] == [(9, 3, 90, 3)]
    # Brute force: every holder is like the hub it is matched with, or is a hub, or waits with its own text's hub.
    for _ in range(50):
        hubs, held = Hubs(), sorted((rng.randrange(30), place, rng.getrandbits(32) & rng.getrandbits(32)) for place in range(60))
        of = {(n, p): s for n, p, s in held}
        found = [m for h in held for m in hubs.meet(*h)]
        assert all(a != b and (_is_alike(of[a, p], of[b, q]) or any(a == n for n in hubs.nodes)) for a, b, p, q in found)
        linked = {(a, p) for a, _, p, _ in found} | {(b, q) for _, b, _, q in found}
        for a, p, s in held:
            others = [(b, q) for b, q, t in held if b != a and _is_alike(s, t)]
            assert (a, p) in linked or not others or all(o in linked for o in others)


def test_seeds_are_matched_in_one_pass_and_texts_cut_in_one():
    """Matches in order are those of a plain search, wherever batches end; a text is cut for its links and as a hub in one row."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted({(rng.randrange(-9, 9), rng.randrange(6), rng.randrange(40)): rng.getrandbits(32) - 2**31 for _ in range(300)}.items())
    rows = [(*key, sketch) for key, sketch in rows] + [(99, 1, 2, 3)]
    expected = []
    for seed in {r[0] for r in rows}:
        held = [r for r in rows if r[0] == seed]
        low, high = held[0], min(r for r in held if r[1] == held[-1][1])
        for r in held if low[1] != high[1] else []:
            if r[1] != low[1] or r[2] > low[2]:
                other = high if r[1] == low[1] else low
                expected.append((*r, other[1], other[2], passages._is_alike(r[3] & 2**32 - 1, other[3] & 2**32 - 1)))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    for cut in (1, 7, 1000):
        batches = [
            pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + cut]), kinds)], ["seed", "node", "place", "sketch"])
            for i in range(0, len(rows), cut)
        ]
        got = [tuple(r.values()) for b in passages._paired(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(expected)
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    link = pa.list_(pa.struct([("hub", pa.int64()), ("points", passages._POINTS), *((n, pa.int32()) for n in ("p_lo", "p_hi", "h_lo", "h_hi"))]))
    points = [{"place": 1, "hub_place": 2}]
    links = [[{"hub": 9, "points": points, "p_lo": 1, "p_hi": 3, "h_lo": 0, "h_hi": 2}], None, []]
    spans = [None, [{"lo": 0, "hi": 2}, {"lo": 2, "hi": 9}], [{"lo": 0, "hi": 1}]]
    batch = pa.record_batch([pa.array([7, 8, 9]), pa.array(spans, span), pa.array(links, link), pa.array(["A b\tc", "d e f g", "h"])], ["node", "spans", "links", "text"])
    out = [tuple(r.values()) for b in passages._cut(iter([batch])) for r in b.to_pylist()]
    nothing = (None,) * 4
    assert sorted(out, key=lambda r: r[:2]) == [
        (7, 1, 3, "b c", 9, points, 0, 2), (8, 0, 2, "d e", *nothing), (8, 2, 9, "f g", *nothing), (9, 0, 1, "h", *nothing)
    ]


def test_what_a_stage_shuffled_leaves_the_disk(spark):
    """Within, the files go with the write; the setting is as before afterwards, also after an error."""
    import glob
    import os

    from tokenloom import session

    folder = spark.conf.get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp"))
    files = lambda: {f for f in glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}
    before, known = spark.conf.get(session._DROPS_SHUFFLES), files()
    with pytest.raises(KeyError), session.shuffles_dropped(spark):
        assert session.stage(spark.range(50_000).repartition("id"), "dropped").count() == 50_000
        left = files() - known
        raise KeyError
    assert not [f for f in left if os.path.exists(f) and os.path.getsize(f) > 20_000]
    assert spark.conf.get(session._DROPS_SHUFFLES) == before
    known = files()
    session.stage(spark.range(50_000).repartition("id"), "kept")
    assert [f for f in files() - known if os.path.getsize(f) > 20_000]
    rounds = session.Rounds("rounds")
    assert [rounds.add(spark.range(n)).count() for n in (2, 0, 5)] == [2, 0, 5]
    assert rounds.all().count() == 7 and rounds.all(1).count() == 5


def test_seeds_of_texts_together_and_links_dealt_out(spark):
    """Texts side by side have the seeds that each has alone; links of a hub beyond a share go to several groups, none lost."""
    rng = random.Random(6)
    texts = [" ".join(words_of(rng, n)) for n in (60, 3, 0, 50, 400)] + [" ".join(["same"] * 200), " ".join(words_of(rng, 49))]
    *found, counts, sizes = passages.seeds(texts)
    end = 0
    for text, n, size in zip(texts, counts, sizes):
        alone = passages.seeds([text])
        assert size == alone[4][0] == len(text.split()) and n == alone[3][0] and (n > 0) == (size >= 50)
        assert all((a[end : end + n] == b).all() for a, b in zip(found, alone))
        end += n
    passage = words_of(rng, 60)
    rows = [(i, " ".join(words_of(rng, rng.randint(3, 30)) + passage + words_of(rng, 5))) for i in range(150)]
    linked = {i for r in found_of(spark, rows) for i in (r["doc_id"], r["other_id"])}
    assert linked == set(range(150))
