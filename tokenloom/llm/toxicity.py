"""Toxicity by noisy-channel deobfuscation and a scored restored text.

Channel: a writer may replace letters by look-alike signs, repeat letters, and
put single spaces or marks between the letters of a word. A Viterbi search over
the lattice of possible letters, under a character model of the whole corpus (four-gram
counts, backed off to shorter ones), gives the most likely plain words. A gap between short
pieces is an edge of the lattice too: it ends a word or is dropped, whichever the model
finds likelier. Words without such signs, and runs of common short words, have one path,
themselves. Four-grams over 27 classes are a table of bounded size; longer ones would
have to grow with the corpus in every task's memory.

Score: restored words and their openings are evidence with log-odds from
labelled training documents; a logistic curve turns the sum over a document
into a score from 0 to 1.

Cases: a null or empty text scores the curve at no evidence (near 0); a null
``doc_id`` has no label and is not held out; repeated rows score alike, and an
id with several labels is learned once for each; a labels table without a
usable row gives the score 0 everywhere; other columns are never inputs.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.hashing import free_name, let_go, text_or_empty

# Look-alike signs and the letters they may stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy") | {ord("ß"): "ss"}
# Cost, in nats, of one look-alike sign, one extra repetition, one dropped mark, one dropped digit and one dropped gap.
SIGN_COST, REPEAT_COST, DROP_COST, DIGIT_DROP_COST, GAP_COST = 1.0, 0.7, 2.5, 9.0, 2.0
# Letters of a piece whose gaps may be dropped, and the share of all words from which on a short word is common.
PIECE, COMMON_SHARE = 3, 2e-5
TRAIN_DOCUMENTS = 20_000
REJECT = 0.7
PREFIXES = (4, 5, 6)
# Evidence needs this many toxic training documents and this log-odds.
MIN_DOCUMENTS, MIN_LOG_ODDS = 4, 2.5
# Entries of a worker's memo of restored tokens; bytes counted at a time.
DECODED, COUNTED = 20_000, 1 << 20

# Classes of Latin-1 bytes: letters without their accents, and 0 for all else.
_CLASS = bytes(ord(c) - 96 if "a" <= (c := chr(b).translate(ACCENTS)[0]) <= "z" else 0 for b in range(256))

_RUN = re.compile(r"(.)\1\1")
_GAP = re.compile(r"[ ._*\-]")
_PIECES = re.compile(rf"(?<!\S)[^\s._*\-]{{1,{PIECE}}}(?:[ ._*\-][^\s._*\-]{{1,{PIECE}}})+(?!\S)")
_EDGES = ",;:!?\"'()[]"
_SIGNS = re.compile("[" + re.escape("".join(LOOK_ALIKE)) + "]")
_PLAIN = re.compile(r"[a-z]+")


def _classes(text: str) -> bytes:
    """0 for a word edge, 1 to 26 for letters; three edges before the text and one behind it."""
    return b"\0\0\0" + text.lower().encode("latin-1", "replace").translate(_CLASS) + b"\0"


def _plain(text: str | None) -> str:
    """The text in lower case without accents."""
    text = (text or "").lower()
    return text if text.isascii() else text.translate(ACCENTS)


def _count_grams(batches):
    """Four-gram counts of the letters of a task's texts: at most 27^4 rows."""
    counts = np.zeros(27**4, np.int64)
    for batch in batches:
        held, size = [], 0
        for i in range(batch.num_rows):
            held.append(_classes(batch.column(0)[i].as_py()))
            size += len(held[-1])
            if size > COUNTED or i + 1 == batch.num_rows:
                c = np.frombuffer(b"".join(held), np.uint8).astype(np.int32)
                counts += np.bincount(c[:-3] * 19683 + c[1:-2] * 729 + c[2:-1] * 27 + c[3:], minlength=27**4)
                held, size = [], 0
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["gram", "n"])
    let_go()


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(gram, n)`` over every text; a gram is the number of its four classes to the base 27, so there are 531,441 at most."""
    counted = docs.select(text_or_empty().alias("text")).mapInArrow(_count_grams, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _model(counts: np.ndarray) -> np.ndarray:
    """Costs of the last class given three, each order smoothed by the next shorter one."""
    grams = counts.reshape((27,) * 4).astype(float)
    likely = np.full(27, 1 / 27)
    for order in (1, 2, 3, 4):
        own = grams.sum(axis=tuple(range(4 - order)))
        weight = 20.0 if order > 1 else 1.0
        likely = (own + weight * likely) / (own.sum(axis=-1, keepdims=True) + weight)
    return -np.log(likely)


def _common(counts: np.ndarray) -> frozenset[str]:
    """Short words of the corpus that are frequent; of words of three letters as many as begin, or end, like them."""
    grams = counts.reshape((27,) * 4)
    least = max(5.0, COMMON_SHARE * float(grams[:, :, 1:, 0].sum()))
    letters = "abcdefghijklmnopqrstuvwxyz"
    single = np.flatnonzero(grams[:, 0, 1:, 0].sum(axis=0) >= least)
    double = np.argwhere(grams[0, 1:, 1:, 0] >= least)
    triple = np.argwhere(np.minimum(grams[0, 1:, 1:, 1:], grams[1:, 1:, 1:, 0]) >= least)
    return frozenset([letters[i] for i in single] + ["".join(letters[i] for i in w) for w in (*double, *triple)])


@dataclass
class Decoder:
    """Viterbi decoder with a bounded memo."""

    cost: array
    common: frozenset[str]
    memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: list[tuple[int, int]]) -> Decoder:
        table = np.zeros(27**4, np.int64)
        for gram, n in counts:
            table[gram] += n
        return cls(array("f", _model(table).ravel().astype(np.float32).tobytes()), _common(table))

    def __getstate__(self):
        return {"cost": self.cost, "common": self.common, "memo": {}}

    def word(self, token: str) -> str:
        """The most likely plain spelling of one token, or of pieces with gaps between them."""
        if token not in self.memo:
            if len(self.memo) > DECODED:
                self.memo.clear()
            self.memo[token] = self._decode(token)
        return self.memo[token]

    def _decode(self, token: str) -> str:
        # The lattice as runs of equal signs: each run is dropped or spelled once or twice, a gap ends the word or is dropped.
        # A state is the number of the last three classes.
        spaced = " " in token or _PIECES.fullmatch(token) is not None
        paths = {0: (0.0, "")}
        i, cost = 0, self.cost
        while i < len(token):
            sign, j = token[i], i
            while j < len(token) and token[j] == sign:
                j += 1
            n, i = j - i, j
            steps: dict = {}
            if spaced and _GAP.match(sign):
                for state, (spent, text) in paths.items():
                    if spent + GAP_COST < steps.get(state, (1e18,))[0]:
                        steps[state] = (spent + GAP_COST, text)
                    ended, after = state % 729 * 27, spent + cost[state * 27]
                    if after < steps.get(ended, (1e18,))[0]:
                        steps[ended] = (after, text + " ")
                paths = steps
                continue
            plain = "a" <= sign <= "z"
            options = [(sign, 0.0)] if plain else [(c, SIGN_COST) for c in LOOK_ALIKE.get(sign, "")]
            for state, (spent, text) in paths.items():
                if not plain:
                    drop = spent + (DIGIT_DROP_COST if sign.isdigit() else DROP_COST if options else 0.0)
                    if drop < steps.get(state, (1e18,))[0]:
                        steps[state] = (drop, text)
                for letter, extra in options:
                    c, at, change = ord(letter) - 96, state, extra * n**0.5 + REPEAT_COST * max(0, n - 2) ** 0.5
                    for copies in (1, 2):
                        if copies > n:
                            break
                        change += cost[at * 27 + c]
                        at = at % 729 * 27 + c
                        if spent + change < steps.get(at, (1e18,))[0]:
                            steps[at] = (spent + change, text + letter * copies)
            paths = steps
        return min((spent + cost[state * 27], text) for state, (spent, text) in paths.items())[1]

    def restore(self, text: str | None) -> str:
        """The text in lower case without accents, with obfuscated words restored."""
        text = _PIECES.sub(self._joined, _plain(text))
        if not _SIGNS.search(text) and not _RUN.search(text):
            return text
        return " ".join(self.word(w) if _suspect(w) else w for w in text.split())

    def _joined(self, found: re.Match) -> str:
        """A run of short pieces as words; runs of common words and of numbers stay as they are."""
        run = found.group()
        pieces = _GAP.split(run)
        if all(p.strip(_EDGES) in self.common for p in pieces) or 2 * sum(map(str.isalpha, run)) < sum(map(len, pieces)):
            return run
        return self.word(run)


def _suspect(word: str) -> bool:
    """Whether the lattice of a token has more than one path worth a search: it has
    letters, and a sign between or beside them or a letter three times in a row."""
    if word.isalpha():
        return _RUN.search(word) is not None
    letters = sum(c.isalpha() for c in word)
    return letters * 3 >= len(word) and (_RUN.search(word) is not None or _SIGNS.search(word) is not None)


def pieces_of(word: str) -> tuple[str, ...]:
    """Pieces of evidence of a restored word: itself and its openings."""
    return (word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)) if len(word) > 2 else ()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    decoder: Decoder
    weights: dict[str, float]
    slope: float
    offset: float

    def __post_init__(self):
        # Words that open like no piece need not be looked at.
        self.openings = frozenset(p.removeprefix("^")[: PREFIXES[0]] for p in self.weights)

    def evidence(self, text: str | None) -> float:
        """Log-odds of the distinct words, each with its strongest piece of evidence."""
        openings, weights, n = self.openings, self.weights, PREFIXES[0]
        words = {w for w in _PLAIN.findall(self.decoder.restore(text)) if w[:n] in openings}
        return math.fsum(max((weights.get(p, 0.0) for p in pieces_of(w)), default=0.0) for w in words)

    def score(self, text: str | None) -> float:
        z = self.slope * self.evidence(text) + self.offset
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _evidence_counts(decoder: Decoder):
    def count(batches):
        for batch in batches:
            pieces, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {p for w in set(_PLAIN.findall(decoder.restore(text))) for p in pieces_of(w)}
                pieces.extend(found)
                toxic.extend([label] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(toxic, pa.int32())], ["piece", "toxic"])
        decoder.memo.clear()
        let_go()

    return count


def _evidence_sums(model: ToxicityModel):
    def add(batches):
        for batch in batches:
            sums = [model.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], ["x", "toxic"])

    return add


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset fitted to (x, label, n) by Newton steps with a small ridge."""
    x, y, n = (np.array(c, float) for c in zip(*points))
    w = np.array([0.1, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (p - y)) + 1e-2 * w
        hessian = (design.T * (n * p * (1 - p) + 1e-9)) @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> ToxicityModel:
    """Learn from the whole corpus (characters) and labelled rows that are not held out.

    At most about ``train_documents`` labelled documents are used, chosen by a hash
    of the id. The driver gets 531,441 gram counts, the weights of pieces that ``MIN_DOCUMENTS`` of these documents hold,
    and a histogram of evidence sums at most.
    """
    grams = gram_counts(docs).toArrow()
    decoder = Decoder.of(list(zip(grams["gram"].to_pylist(), grams["n"].to_pylist())))
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = train_documents / max(1, usable.count())
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = docs.select("doc_id", text_or_empty().alias("text")).join(usable, "doc_id")
    # By the id: copies of one text do not meet in one task.
    train = train.repartition(F.xxhash64("doc_id")).select("text", "toxic").persist()
    try:
        by_label = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
        if not n1 or not n0:
            return ToxicityModel(decoder, {}, 0.0, -60.0)
        pieces = train.mapInArrow(_evidence_counts(decoder), "piece string, toxic int")
        counted = pieces.groupBy("piece").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n0 + 1))
        kept = (
            counted.where(f"t >= {MIN_DOCUMENTS}").withColumn("w", odds).where(f"w >= {MIN_LOG_ODDS}").select("piece", "w")
        )
        model = ToxicityModel(decoder, {r["piece"]: r["w"] for r in kept.collect()}, 1.0, 0.0)
        sums = train.mapInArrow(_evidence_sums(model), "x double, toxic int").groupBy(F.least(F.round("x", 1), F.lit(100.0)).alias("x"), "toxic")
        model.slope, model.offset = _logistic([tuple(r) for r in sums.agg(F.count("*").alias("n")).collect()])
        return model
    finally:
        train.unpersist()


def with_scores(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def score(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = [shared.value.score(batch.column(at)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])
        # Workers are used again: what a task remembers ends with it.
        shared.value.decoder.memo.clear()
        let_go()

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    name = free_name(docs, "toxicity")
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
