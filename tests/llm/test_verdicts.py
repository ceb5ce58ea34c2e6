"""Learned verdicts and likenesses against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import fingerprints, quality, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_likeness_against_shared_paragraphs(spark):
    """The estimate follows the true share of paragraphs that two texts have in common."""
    rng = random.Random(1)
    rows, true = [], []
    for n in (5, 40, 300, 2000):
        for share in (0.0, 0.3, 0.67, 0.9, 0.99, 1.0):
            a = [f"p{rng.randrange(10**9)}. " for _ in range(n)]
            kept = a[: round(n * share)]
            b = kept + [f"q{rng.randrange(10**9)}. " for _ in range(n - len(kept))]
            rng.shuffle(b)
            rows.append(("".join(a), "".join(b)))
            x, y = Counter(_paragraphs(rows[-1][0])), Counter(_paragraphs(rows[-1][1]))
            true.append(1 - (sum((x - y).values()) + sum((y - x).values())) / (sum(x.values()) + sum(y.values())))
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    near = {r["i"]: r["near"] for r in docs.select(
        "i", fingerprints.likeness(fingerprints.fingerprint_lanes(F.col("a")), fingerprints.fingerprint_lanes(F.col("b"))).alias("near")).collect()}
    off = [abs(near[i] - t) for i, t in enumerate(true)]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.06, list(zip(near.values(), true))


def _paragraphs(text):
    return re.findall(r"[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+", text)


def test_evidence_and_curve_against_brute_force(spark):
    """Weights are the log-odds of pieces, the curve is where the gradient vanishes, a score is the curve at the sum."""
    rng = random.Random(2)
    plain, bad = [f"word{chr(97 + i)}" for i in range(20)], ["stupid", "moron", "idiot"]
    docs, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.4
        words = rng.choices(plain, k=20) + (rng.choices(bad, k=rng.choice([0, 1, 2, 3])) if toxic else rng.choices(bad, k=int(rng.random() < 0.03)))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, marks)
    held = {r["doc_id"] for r in frame.where(toxicity.held_out()).collect()}
    train = [(t, y) for (i, t), (_, y) in zip(docs, labels) if i not in held]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    seen, hits = Counter(), Counter()
    for text, y in train:
        pieces = {p for w in set(re.findall("[a-z]+", model.decoder.restore(text))) for p in toxicity.pieces_of(w)}
        seen.update(pieces)
        hits.update(pieces if y else ())
    weights = {p: math.log((hits[p] + 0.5) / (n1 + 1)) - math.log((seen[p] - hits[p] + 0.5) / (n0 + 1)) for p in hits if hits[p] >= toxicity.MIN_DOCUMENTS}
    weights = {p: w for p, w in weights.items() if w >= toxicity.MIN_LOG_ODDS}
    assert weights and model.weights == pytest.approx(weights)
    evidence = lambda t: sum(max((weights.get(p, 0.0) for p in toxicity.pieces_of(w)), default=0.0) for w in set(re.findall("[a-z]+", model.decoder.restore(t))))
    curve = lambda x: 1 / (1 + math.exp(-(model.slope * x + model.offset)))
    points = [(min(round(evidence(t), 1), 100.0), y) for t, y in train]
    assert abs(sum(curve(x) - y for x, y in points) + 0.01 * model.offset) < 0.05
    assert abs(sum(x * (curve(x) - y) for x, y in points) + 0.01 * model.slope) < 0.05
    for r in toxicity.scores(frame, marks).collect():
        assert r["score"] == pytest.approx(curve(evidence(docs[r["doc_id"]][1])), abs=1e-6) and r["held_out"] == (r["doc_id"] in held)


def test_url_verdicts_against_brute_force(spark):
    """Segmentation by all splits, and naive Bayes by counting."""
    rng = random.Random(3)
    vocabulary = ["cheap", "pills", "news", "farm", "the", "best", "store", "spam", "daily", "port", "export", "ex"]
    pages = []
    for i in range(220):
        bad = rng.random() < 0.5
        host = "".join(rng.choices(vocabulary[:2] + vocabulary[3:4] + vocabulary[7:8] if bad else vocabulary[2:], k=2)) + rng.choice(["", "qz"])
        zone = rng.choice(["net", "org", "com", "example.com"])
        path = "/" + rng.choice(["es/", "fr/", "en/", ""]) + rng.choice(vocabulary)
        pages.append((i, f"http://{host}.{zone}{path}?q=1", "<p>" + " ".join(rng.choices(vocabulary, range(12, 0, -1), k=30)) + "</p>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    counts = Counter(w for _, _, h in pages for w in re.findall("[a-z]{2,}", re.sub("<[^>]*>", " ", h)))
    size = sum(counts.values()) + len(counts) + 1
    costs = {w: math.log(size) - math.log(n + 1) for w, n in counts.items()}

    def cheapest(label):
        best = {0: 0.0}
        for end in range(1, len(label) + 1):
            best[end] = min([best[end - 1] + url_filters.UNKNOWN_LETTER, *(best[b] + costs[label[b:end]] for b in range(end) if label[b:end] in costs)])
        return best[len(label)]

    split = lambda u: re.match(r"http://([^/]*)(/[^?]*)", u).groups()
    labels = {label for _, u, _ in pages for label in re.split("[^a-z]+", split(u)[0]) if label}
    segmented = {r["label"]: r["words"] for r in url_filters.segmented_labels(frame.select(url_filters.split_url(F.col("url"))[0].alias("host")).distinct(), url_filters.unigram_counts(frame)).collect()}
    assert segmented.keys() == labels
    for label, words in segmented.items():
        cost = sum(costs[w] if w in costs else url_filters.UNKNOWN_LETTER * len(w) for w in words)
        assert "".join(words) == label and cost == pytest.approx(cheapest(label))

    def rule(host, path):
        fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
        return max(fits, key=lambda r: len(r.text)).verdict if fits else None

    urls = {split(u) for _, u, _ in pages}
    tokens = {(h, p): Counter(f"h:{w}" for label in re.split("[^a-z]+", h) if label for w in segmented[label]) + Counter(f"p:{w}" for w in re.split("[^a-z]+", p) if w)
              for h, p in urls}
    learned = {k: defaultdict(int) for k in ("allow", "block")}
    priors = Counter(filter(None, (rule(*u) for u in urls)))
    for url, found in tokens.items():
        if verdict := rule(*url):
            for t, n in found.items():
                learned[verdict][t] += n
    known = learned["allow"].keys() | learned["block"].keys()
    total = {k: sum(v.values()) + len(known) for k, v in learned.items()}
    for r in url_filters.filter_urls(frame).collect():
        url = (r["host"], r["path"])
        odds = math.log(priors["block"] / priors["allow"]) + sum(
            n * (math.log((learned["block"][t] + 1) / total["block"]) - math.log((learned["allow"][t] + 1) / total["allow"])) for t, n in tokens[url].items() if t in known)
        if rule(*url) is None:
            assert r["log_odds"] == pytest.approx(odds) and r["verdict"] == ("block" if odds > 0 else "allow")
        else:
            assert r["verdict"] == rule(*url)
    assert sum(rule(*u) is None for u in urls) > 20


def test_quality_distances_against_brute_force(spark):
    rng = random.Random(4)
    common = quality.COMMON_WORDS["en"]
    rows = []
    for i in range(60):
        words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(40, 260))]
        rows.append((i, " ".join(words), "en"))
    rows += [(100, " ".join(rng.choice("#$%&") * 4 + rng.choice("XYZ") for _ in range(200)), "en"), (101, " ".join(["the"] * 60 + [f"w{k}" for k in range(200)]), "en")]
    classes = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?]", "sign": r"[#*$%&|<>@+=_/\\~^{}()\[\]-]", "other": r"[^\x00-\x7F]"}

    def bins(text):
        found = [len(re.findall(p, text)) for p in classes.values()]
        letters = sum(map(len, WORD.findall(text)))
        return [*found, len(text) - letters, max(0, letters - sum(found))]

    def hits(text):
        words = WORD.findall(text)
        own = [words.count(w) for w in common]
        return own + [0] * (quality.COMMON_SLOTS - len(own)) + [len(words) - sum(own)]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        term = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum((term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2 for x, y in zip(p, q))))

    def failed(text):
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
        return len(words) < 50 or 100 * len(repeated) > 50 * len(words)

    sound = [t for _, t, _ in rows if not failed(t)]
    characters = [sum(c) for c in zip(*map(bins, sound))]
    words = [sum(c) for c in zip(*map(hits, sound))]
    assert sum(words[:-1]) >= quality.MIN_REFERENCE_WORDS
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        far = distance(bins(text), characters) if len(text) >= quality.MIN_CHARACTERS else None
        apart = distance(hits(text), words) if len(WORD.findall(text)) >= quality.MIN_JUDGED_WORDS else None
        assert got[i]["character_distance"] == (far if far is None else pytest.approx(far, abs=1e-9))
        assert got[i]["word_distance"] == (apart if apart is None else pytest.approx(apart, abs=1e-9))
        kept = not failed(text) and (far or 0) <= quality.MAX_CHARACTER_DISTANCE and (apart or 0) <= quality.MAX_WORD_DISTANCE
        assert got[i]["base_failed"] == failed(text) and got[i]["kept"] == kept
    assert not got[100]["kept"] and {r["kept"] for r in got.values()} == {True, False}
