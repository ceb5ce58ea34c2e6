"""The deobfuscation lattice against brute force over all its paths."""

import itertools
import random

import numpy as np
import pytest

from tokenloom.llm import toxicity as X

TEXT = "you are an idiot and a stupid moron said the y of it is in the house y idiota que la casa de " * 40


@pytest.fixture(scope="module")
def decoder():
    counts = np.zeros(27**4, np.int64)
    classes = list(X._classes(TEXT))
    for a, b, c, d in zip(classes, classes[1:], classes[2:], classes[3:]):
        counts[((a * 27 + b) * 27 + c) * 27 + d] += 1
    return X.Decoder.of([(int(i), int(counts[i])) for i in np.flatnonzero(counts)])


def all_paths(token):
    """(cost without the model, spelling) of every path."""
    runs = [(sign, len(list(same))) for sign, same in itertools.groupby(token)]
    spaced = " " in token or X._PIECES.fullmatch(token) is not None
    choices = []
    for sign, n in runs:
        if spaced and X._GAP.match(sign):
            choices.append([(X.GAP_COST, ""), (0.0, " ")])
            continue
        plain = "a" <= sign <= "z"
        letters = [(sign, 0.0)] if plain else [(c, X.SIGN_COST) for c in X.LOOK_ALIKE.get(sign, "")]
        options = [(extra * n**0.5 + X.REPEAT_COST * max(0, n - 2) ** 0.5, c * k) for c, extra in letters for k in (1, 2) if k <= n]
        if not plain:
            options.append((X.DIGIT_DROP_COST if sign.isdigit() else X.DROP_COST if letters else 0.0, ""))
        choices.append(options)
    for path in itertools.product(*choices):
        yield sum(c for c, _ in path), "".join(s for _, s in path)


def model_cost(decoder, spelling):
    classes = [0, 0, 0, *(0 if c == " " else ord(c) - 96 for c in spelling), 0]
    return sum(decoder.cost[((a * 27 + b) * 27 + c) * 27 + d] for a, b, c, d in zip(classes, classes[1:], classes[2:], classes[3:]))


def test_viterbi_finds_the_least_cost(decoder):
    rng = random.Random(2)
    tokens = ["1d1ot", "s7uuupid", "!d!ot", "m0r0n$", "st upid", "a s t u p i d", "i d i o t a", "y 1 d", "o.f.a", "x-y", "555", "aaa@"]
    tokens += ["".join(rng.choice("aido1!07 .s") for _ in range(rng.randint(1, 8))).strip(" .") or "a" for _ in range(60)]
    for token in tokens:
        token = " ".join(token.split())
        best = min(cost + model_cost(decoder, spelling) for cost, spelling in all_paths(token))
        found = decoder._decode(token)
        ours = min(cost for cost, spelling in all_paths(token) if spelling == found) + model_cost(decoder, found)
        assert ours == pytest.approx(best, abs=1e-4), token


@pytest.mark.parametrize("written, words", [
    ("you are a s t u p i d", {"stupid", "a", "are"}), ("y o u s t u p i d", {"stupid"}), ("x s t u p i d m o r o n y", {"stupid", "moron"}),
    ("stu pid", {"stupid"}), ("y i d i o t a", {"idiota"}), ("s.t.u.p.i.d", {"stupid"}), ("the i-d-i-o-t said", {"idiot", "the", "said"}),
    ("of it is in the", {"of", "it", "is", "in", "the"}),
])
def test_spaced_words(decoder, written, words):
    found = decoder.restore(written).split()
    if written.startswith("y i d"):
        assert "".join(found) in ("yidiota",) and {"idiota", "idiot"} & set(found)
    else:
        assert words <= set(found), found


def test_numbers_and_plain_words_stay(decoder):
    for text in ("call 12 34 56 now", "42.1.1.1", "plain words of the house", ""):
        assert decoder.restore(text) == text


def test_model_is_a_distribution(decoder):
    table = np.exp(-np.array(decoder.cost).reshape(-1, 27))
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
