"""Revealing terms against brute force: punctuation, case, long words and whole texts."""

import math
import random
import re
from collections import defaultdict

import pytest
import regex

from tokenloom.llm import pii

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CORE = regex.compile(r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def cores(text):
    """(start, end, lower-case word) of every run between white space that has a letter or digit."""
    found = []
    for run in RUN.finditer(text):
        if core := CORE.search(run.group()):
            found.append((run.start() + core.start(), run.start() + core.end(), core.group().lower()))
    return found


def brute_force(texts):
    """Term spans of texts whose only entities are mail addresses."""
    distinct = sorted(set(texts))
    near, mentions, holds = defaultdict(set), defaultdict(set), defaultdict(set)
    contexts = defaultdict(set)
    for text in distinct:
        spans = [m.span() for m in MAIL.finditer(text)]
        words = [w for w in cores(text) if all(w[1] <= a or b <= w[0] for a, b in spans)]
        for _, _, word in cores(text):
            holds[word].add(text)
        for a, b in spans:
            entity = text[a:b]
            mentions[entity].add(text)
            runs = [m.span() for m in RUN.finditer(text)]
            before = [r for r in runs if r[1] <= a and any(c in " \t\n\x0b\x0c\r" for c in text[r[1] : a])][-pii.CONTEXT_WORDS :]
            after = [r for r in runs if r[0] >= b and any(c in " \t\n\x0b\x0c\r" for c in text[b : r[0]])][: pii.CONTEXT_WORDS]
            own = frozenset(w for x, y, w in words if any(p <= x and y <= q for p, q in before + after))
            contexts[entity].add(own)
            for word in own:
                near[entity, word].add(text)
    terms = set()
    for (entity, word), held in near.items():
        if sum(word in c for c in contexts[entity]) < pii.MIN_CONTEXTS:
            continue
        posterior = len(held) / len(holds[word])
        own = math.log2(len(distinct) / len(mentions[entity]))
        bits = math.log2(posterior) + own
        if posterior >= pii.MIN_POSTERIOR and bits > 0 and bits >= pii.MIN_INFORMATION * own:
            terms.add(word)
    out = {}
    for text in distinct:
        spans = [m.span() for m in MAIL.finditer(text)]
        out[text] = [(a, b) for a, b, w in cores(text) if w in terms and all(b <= x or y <= a for x, y in spans)]
    return out, terms


@pytest.mark.parametrize("mark", ["", ",", ".", ";", "!", ":", "?", ")…", "»"])
def test_marks_after_a_name(spark, mark):
    names = ["Zanzibarius", "zanzibarius", "ZANZIBARIUS"]
    rows = [(i, f"note {i} reach {names[i % 3]}{mark} at ann@mail.example.com soon {i}") for i in range(12)]
    rows += [(100 + i, f"mail p{i}@mail.example.com at once soon") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:12]:
        at = text.lower().index("zanzibarius")
        assert f"term:{at}:{at + 11}" in found[i].split(",")
    assert not any("term" in found[100 + i] for i in range(60))


def test_term_spans_against_brute_force(spark):
    rng = random.Random(8)
    people = {f"p{i}@mail.example.com": [f"Name{i}ér", f"O'Neil{i}", f"x-{i}-y"] for i in range(6)}
    common = ["the", "and", "of", "house", "x" * 400, "--", "(see", "note)", "„quote“", "1,5", "A\\Eb", "Été"]
    texts = []
    for _ in range(260):
        words = []
        for _ in range(rng.randint(0, 25)):
            kind = rng.random()
            mail, names = rng.choice(list(people.items()))
            if kind < 0.08:
                words += rng.sample([rng.choice(names) + rng.choice(["", ",", ".", "!?"]), rng.choice(["", "mail:", "("]) + mail + rng.choice(["", ",", ")"])], 2)
            elif kind < 0.12:
                words.append(rng.choice(["", "«"]) + rng.choice(names).upper() + rng.choice([";", ""]))
            else:
                words.append(rng.choice(common) + rng.choice(["", "", ".", ","]))
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected, terms = brute_force(texts)
    assert len(terms) > 4
    for r in pii.personal_data(docs).collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
        assert spans == expected[texts[r["doc_id"]]], texts[r["doc_id"]]
