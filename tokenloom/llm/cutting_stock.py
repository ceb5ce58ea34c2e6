"""Packing of encoded documents into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences of ``CAPACITY`` and a rest. The rests, as a
histogram of lengths (``CAPACITY - 1`` rows at most, whatever the corpus), are the orders
of a cutting-stock problem: a pattern is a set of lengths that share a sequence, a linear
program says how often each pattern is used, and its columns are made on demand by a
knapsack dynamic program over the lengths, priced by the program's duals. A sequence costs
what it takes after padding: ``CAPACITY``, or its own length at a power of two.

The fractional solution is rounded down, then up where the orders allow it. Spark numbers
the rests of each length, and a rest's number says which use of which pattern takes it and
where. What rounding leaves over, less than one use of each pattern, stands in one stream
cut at every ``CAPACITY`` tokens, its end at powers of two, without padding.

Texts are encoded once, by their chunks between blanks, which the tokenizer never joins;
a bounded memo holds frequent chunks.

Cases: a null or empty text has the end token only; null and repeated ids are told apart
by a hash of the text, and equal rows are interchangeable; an empty table gives no
row; other columns are never looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_key, text_or_empty
from tokenloom.operators.prefix import running_total
from tokenloom.session import stage

TOKENIZER, END_ID = "word_bpe_49k.json", 1
CAPACITY = 2048
# The linear program ends this close, as a share, to a bound from its duals, or after so many pivots.
GAP, PIVOTS = 1e-4, 400
# Columns that one run of the knapsack program may offer.
COLUMNS = 24
# Chunks in one generation of a worker's memo (200 bytes each, about), the longest such chunk, and documents encoded together.
MEMO, MEMO_CHARS, BLOCK = 300_000, 32, 1024
# Rests of one length that one window numbers.
BUCKET_ROWS = 1 << 16


# Texts with marks that may join a letter, or with special tokens, are not cut into chunks.
_WHOLE = r"[\x{300}-\x{37F}]|<\|"
# A chunk of one word, as the tokenizer cuts and normalises it, with at most one mark behind it.
_SIMPLE = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, tokenizer: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Two generations: what is used again moves from the older one to the younger.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = dict(zip(".,;:!?", self._each(list(".,;:!?")))) | {"": b""}

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words: they are encoded as one text, in which tokens that end a word tell them apart."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._each(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: list[str]) -> None:
        """Put new chunks into the memo."""
        memo, simple, odd, words = self.memo, [], [], []
        for chunk in chunks:
            known = self.older.get(chunk)
            if known is not None:
                memo[chunk] = known
            elif found := _SIMPLE.fullmatch(chunk):
                simple.append((chunk, *found.groups()))
            else:
                odd.append(chunk)
        memo.update(zip(odd, self._each(odd)))
        for word in {word for _, word, _ in simple}:
            known = memo.get(word) or self.older.get(word)
            if known is None:
                words.append(word)
            else:
                memo[word] = known
        memo.update(zip(words, self._words(words)))
        for chunk, word, mark in simple:
            if mark:
                memo[chunk] = memo[word] + self.marks[mark]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        whole = pc.match_substring_regex(texts, _WHOLE)
        plain = pc.replace_substring(pc.ascii_lower(pc.if_else(whole, "", texts)), "\n", " ")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.memo.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([chunks[i] for i in new])
        for i in new:
            found[i] = self.memo[chunks[i]]
        for i in new:
            if len(chunks[i]) > MEMO_CHARS:
                self.memo.pop(chunks[i], None)
        # Ids of all chunks in turn, from a pool of the different ones.
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[at]
        bounds = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(starts[at] - bounds[:-1], each) + np.arange(bounds[-1])]
        cuts = bounds[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = self._each([texts[i].as_py()])[0]
        return out


@lru_cache(1)
def _encoder(tokenizer: str) -> Encoder:
    """One encoder for a worker's tasks: its memo is bounded."""
    return Encoder(tokenizer)


def _blocks(texts: pa.Array):
    """Consecutive texts, ``BLOCK`` at most and few when they are long."""
    sizes = pc.binary_length(texts).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if i + 1 == len(sizes) or i + 1 - begin == BLOCK or size > 1 << 22:
            yield begin, i + 1
            begin, size = i + 1, 0


def _encoded(handle, names, tokenizer, end_id):
    """A map over batches (doc_id, text_key, text): ``handle(doc_id, key, ids)`` gives rows."""

    def run(batches):
        encoder, last = _encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            for begin, end in _blocks(texts):
                rows = []
                for i, data in zip(range(begin, end), encoder.encode(texts.slice(begin, end - begin))):
                    rows.extend(handle(ids[i].as_py(), keys[i].as_py(), data + last))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, names)], [n for n, _ in names])

    return run


_KEYED = [("doc_id", pa.int64()), ("text_key", pa.binary())]
_PIECES = [*_KEYED, ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def encoded_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, text_key, doc_tokens, start, length, ids_crc32)``: full pieces and the rest of every document."""

    def cut(doc_id, key, data):
        n = len(data) // 4
        return [
            (doc_id, key, n, at, min(capacity, n - at), zlib.crc32(data[4 * at : 4 * (at + capacity)])) for at in range(0, n, capacity)
        ]

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_or_empty().alias("text")).mapInArrow(
        _encoded(cut, _PIECES, tokenizer, end_id), "doc_id long, text_key binary, doc_tokens long, start long, length long, ids_crc32 long"
    )


def padded(total: int, capacity: int = CAPACITY) -> int:
    """What a sequence of ``total`` tokens takes."""
    return total if total & (total - 1) == 0 else capacity


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every total, the best sum of prices (by length, -inf: none) that reaches it, and a length to take for it."""
    best, taken = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    backwards = np.full(capacity + 1, -np.inf)  # best, mirrored: backwards[capacity - s] = best[s]
    backwards[capacity] = 0.0
    worth = np.full(capacity + 1, -np.inf)
    worth[: min(len(prices), capacity + 1)] = prices[: capacity + 1]
    for total in range(1, capacity + 1):
        sums = backwards[capacity - total + 1 :] + worth[1 : total + 1]
        at = int(sums.argmax())
        best[total] = backwards[capacity - total] = sums[at]
        taken[total] = at + 1
    return best, taken


@dataclass
class StockProgram:
    """The linear program: every rest in one pattern, least padded tokens; a revised simplex over generated columns."""

    orders: dict[int, int]
    capacity: int = CAPACITY
    gap: float = GAP
    pivots: int = PIVOTS
    used: int = field(default=0, init=False)

    def __post_init__(self):
        self.lengths = sorted(self.orders)
        self.place = {n: i for i, n in enumerate(self.lengths)}
        self.tokens = sum(n * k for n, k in self.orders.items())
        self.patterns, self.uses = [{}] * len(self.lengths), np.zeros(len(self.lengths))
        order = self._begin()
        # The first basis is triangular in this order, so its inverse comes row by row.
        self.inverse = np.zeros((len(order),) * 2)
        holders = [[] for _ in order]
        for row in order:
            for n, k in self.patterns[row].items():
                holders[self.place[n]].append((row, k))
        for row in order:
            self.inverse[row, row] = 1.0
            for other, k in holders[row]:
                if other != row:
                    self.inverse[row] -= k * self.inverse[other]
            self.inverse[row] /= self.patterns[row][self.lengths[row]]
        self.costs = np.array([self._cost(p) for p in self.patterns], float)
        self.duals = np.einsum("i,ij->j", self.costs, self.inverse)
        self.bound = float(self.tokens)

    def _begin(self) -> list[int]:
        """A first basis: the longest open length with what fills its sequence, as often as the orders allow.

        Each step uses up one length, and later patterns do without it, so the basis is triangular
        in the order returned.
        """
        left = np.zeros(self.capacity + 1)
        left[self.lengths] = [self.orders[n] for n in self.lengths]
        settled: dict[int, None] = {}
        while len(open_lengths := np.flatnonzero(left)):
            pattern = self._filled(int(open_lengths[-1]), left)
            lengths = np.array(list(pattern))
            ratios = left[lengths] / np.array(list(pattern.values()))
            i = int(ratios.argmin())
            left[lengths] -= ratios[i] * np.array(list(pattern.values()))
            left[lengths[left[lengths] < 1e-9]] = 0.0
            left[lengths[i]] = 0.0
            row = self.place[int(lengths[i])]
            self.patterns[row], self.uses[row] = pattern, ratios[i]
            settled[row] = None
        for row, n in enumerate(self.lengths):
            if row not in settled:  # used up together with another length
                self.patterns[row] = {n: self.capacity // n}
                settled[row] = None
        return list(settled)

    def _filled(self, first: int, left: np.ndarray) -> dict[int, int]:
        """A pattern with ``first`` that fills a sequence with open lengths, if a few of them can; else as full as may be."""

        def of(*lengths: int) -> dict[int, int]:
            return {n: lengths.count(n) for n in lengths}

        def pair(total: int) -> tuple[float, int]:
            """The shorter side of the most plentiful two lengths that add up to ``total``."""
            half = total // 2
            if half < 1:
                return 0.0, 0
            both = np.minimum(left[1 : half + 1], left[total - 1 : total - half - 1 : -1])
            at = int(both.argmax())
            return float(both[at]), at + 1

        rest = self.capacity - first
        if not rest:
            return {first: 1}
        options = [(left[rest], (first, rest))]
        much, a = pair(rest)
        options.append((much, (first, a, rest - a)))
        for b in np.argsort(-left[:rest])[:6] if rest > 2 else ():
            if left[b]:
                much, a = pair(rest - int(b))
                options.append((min(much, left[b]), (first, int(b), a, rest - int(b) - a)))
        much, best = max(options)
        if much > 0:
            return of(*best)
        worth = np.where(left > 0, np.arange(self.capacity + 1.0), -np.inf)
        sums, taken = knapsack(worth, rest)
        total = int(np.flatnonzero(sums > -np.inf)[-1])
        if padded(first + total, self.capacity) > first + total and first & (first - 1) == 0:
            total = 0
        lengths = [first]
        while total:
            lengths.append(int(taken[total]))
            total -= lengths[-1]
        return of(*lengths)

    def _cost(self, pattern: dict[int, int]) -> int:
        return padded(sum(n * k for n, k in pattern.items()), self.capacity)

    def _offers(self) -> list[dict[int, int]]:
        """Patterns that lower the padding at the present duals, best first."""
        prices = np.full(self.capacity + 1, -np.inf)
        prices[self.lengths] = self.duals
        best, taken = knapsack(prices, self.capacity)
        # Duals divided by the worst overpricing are feasible, and so bound the optimum.
        over = max([1.0, *(best[1:] / np.array([padded(s, self.capacity) for s in range(1, self.capacity + 1)]))])
        self.bound = max(self.bound, float(self.costs @ self.uses) / over)

        def read(total: int, first: int = 0) -> dict[int, int]:
            pattern = {first: 1} if first else {}
            total -= first
            while total:
                pattern[int(taken[total])] = pattern.get(int(taken[total]), 0) + 1
                total -= int(taken[total])
            return pattern

        ends = [self.capacity] + [1 << i for i in range(self.capacity.bit_length() - 1)]
        offers = [(best[s] - padded(s, self.capacity), read(s)) for s in ends if best[s] > -np.inf]
        short = int(best.argmax())
        offers.append((best[short] - padded(short, self.capacity), read(short)))
        # The best full pattern that holds each length.
        full = prices[self.lengths] + best[self.capacity - np.array(self.lengths)] - self.capacity
        for i in np.argsort(-full)[:COLUMNS]:
            if full[i] > -np.inf:
                offers.append((full[i], read(self.capacity, self.lengths[i])))
        distinct = {tuple(sorted(p.items())): v for v, p in offers if v > 1e-6 * self.capacity}
        return [dict(p) for p, _ in sorted(distinct.items(), key=lambda x: -x[1])]

    def _enter(self, pattern: dict[int, int]) -> bool:
        at = [self.place[n] for n in pattern]
        column = np.array(list(pattern.values()), float)
        reduced = self._cost(pattern) - self.duals[at] @ column
        if reduced > -1e-7 * self.capacity:
            return False
        direction = (self.inverse[:, at] * column).sum(axis=1)
        able = np.flatnonzero(direction > 1e-9)
        if not len(able):
            return False
        ratios = self.uses[able] / direction[able]
        row = able[int(ratios.argmin())]
        step = max(0.0, float(ratios.min()))
        self.uses -= step * direction
        np.maximum(self.uses, 0.0, out=self.uses)
        self.uses[row] = step
        base = self.inverse[row] / direction[row]
        rows, columns = np.flatnonzero(np.abs(direction) > 1e-12), np.flatnonzero(base)
        rows = rows[rows != row]
        self.inverse[np.ix_(rows, columns)] -= np.outer(direction[rows], base[columns])
        self.inverse[row] = base
        self.duals += reduced * base
        self.patterns[row], self.costs[row] = pattern, self._cost(pattern)
        return True

    def solve(self) -> list[tuple[dict[int, int], float]]:
        """Patterns of the basis with their fractional uses."""
        while self.lengths and self.used < self.pivots and self.costs @ self.uses > (1 + self.gap) * self.bound:
            offers = self._offers()
            entered = sum(self._enter(p) for p in offers)
            self.used += entered
            if not entered:
                break
        return [(p, float(x)) for p, x in zip(self.patterns, self.uses) if x > 1e-9]


def rounded(solution: list[tuple[dict[int, int], float]], orders: dict[int, int]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole uses of patterns, and the orders that they leave open."""
    open_orders = dict(orders)
    uses = []
    for pattern, x in solution:
        n = min([int(x + 1e-6), *(open_orders[length] // k for length, k in pattern.items())])
        uses.append(n)
        for length, k in pattern.items():
            open_orders[length] -= n * k
    for i in sorted(range(len(solution)), key=lambda i: int(solution[i][1] + 1e-6) - solution[i][1]):
        pattern = solution[i][0]
        if all(open_orders[length] >= k for length, k in pattern.items()):
            uses[i] += 1
            for length, k in pattern.items():
                open_orders[length] -= k
    return [(p, n) for (p, _), n in zip(solution, uses) if n], {n: k for n, k in open_orders.items() if k}


@dataclass
class Layout:
    """Where the rests of each length go, by their number among them.

    ``slots[length]`` has, in order of the first number of each, (first number, sequence of that
    number, offset). Numbers from ``placed[length]`` on stand in the stream from ``stream[length]``.
    """

    capacity: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    placed: dict[int, int]
    stream: dict[int, int]
    stream_sequence: int
    bounds: np.ndarray

    @classmethod
    def of(cls, orders: dict[int, int], capacity: int = CAPACITY) -> Layout:
        """``orders`` counts the pieces of every length up to ``capacity``."""
        full = orders.get(capacity, 0)
        rests = {n: k for n, k in orders.items() if n < capacity}
        patterns, left = rounded(StockProgram(rests, capacity).solve(), rests)
        next_number, slots, sequence = dict.fromkeys(orders, 0), {n: [] for n in orders}, full
        if full:
            slots[capacity], next_number[capacity] = [(0, 0, 0)], full
        for pattern, uses in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                for _ in range(pattern[length]):
                    slots[length].append((next_number[length], sequence, offset))
                    next_number[length] += uses
                    offset += length
            sequence += uses
        stream, total = {}, 0
        for length in sorted(left):
            stream[length] = total
            total += length * left[length]
        # The stream's sequences: full ones, then the powers of two of its end.
        bounds = list(range(0, total - capacity + 1, capacity))
        at = len(bounds) * capacity
        while at < total:
            bounds.append(at)
            at += 1 << ((total - at).bit_length() - 1)
        packed = {n: tuple(np.array(c, np.int64) for c in zip(*s)) for n, s in slots.items() if s}
        return cls(capacity, packed, next_number, stream, sequence, np.array([*bounds, total], np.int64))

    def place(self, length: int, number: int, start: int) -> list[tuple[int, int, int, int, bool]]:
        """(start, length, sequence, offset, whether whole) of the parts of one piece."""
        if number < self.placed[length]:
            firsts, sequences, offsets = self.slots[length]
            i = int(np.searchsorted(firsts, number, "right")) - 1
            return [(start, length, int(sequences[i]) + number - int(firsts[i]), int(offsets[i]), True)]
        at = self.stream[length] + (number - self.placed[length]) * length
        end, parts, begin = at + length, [], at
        while begin < end:
            i = int(np.searchsorted(self.bounds, begin, "right")) - 1
            stop = min(end, int(self.bounds[i + 1]))
            parts.append((start + begin - at, stop - begin, self.stream_sequence + i, begin - int(self.bounds[i]), stop - begin == length))
            begin = stop
        return parts


_PLACED = [*_KEYED, ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _place(shared):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, tokens, start, length, crc, number in zip(*(c.to_pylist() for c in batch.columns)):
                for at, n, sequence, offset, whole in shared.value.place(length, number, start):
                    rows.append((doc_id, key, tokens, at, n, crc if whole else None, sequence, offset))
            columns = list(zip(*rows)) if rows else [[]] * len(_PLACED)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _PLACED)], [n for n, _ in _PLACED])

    return run


def _part_ids(docs: DataFrame, parts: DataFrame, tokenizer: str, end_id: int, few: bool = False) -> DataFrame:
    """``(doc_id, text_key, start, length, ids)`` of the wanted parts ``(doc_id, text_key, start, length)``.

    ``few`` says that the parts are bounded and may be broadcast.
    """
    wanted = parts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    wanted = wanted.select(F.col("doc_id").alias("of"), F.col("text_key").alias("key"), "parts")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_or_empty().alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("key"))
    found = keyed.join(F.broadcast(wanted) if few else wanted, same).select("doc_id", "text_key", "parts", "text")

    def run(batches):
        encoder, last = _encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, key, spans, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(encoder.encode(pa.array([text]))[0] + last, "<u4").astype(np.int32)
                rows.extend((doc_id, key, s["start"], s["length"], data[s["start"] : s["start"] + s["length"]]) for s in spans)
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "text_key", "start", "length", "ids"])

    schema = "doc_id long, text_key binary, start long, length long, ids array<int>"
    return found.mapInArrow(run, schema).dropDuplicates(["doc_id", "text_key", "start", "length"])


def _crc(ids):
    """CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(batches):
        for batch in batches:
            sums = [zlib.crc32(np.array(v.as_py(), "<u4").tobytes()) for v in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "text_key", "start", "length", "crc"])

    return ids.mapInArrow(run, "doc_id long, text_key binary, start long, length long, crc long")


def packed_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, text_key, doc_tokens, start, length, ids_crc32, sequence_id, offset)``, one row for each piece."""
    pieces = stage(encoded_pieces(docs, tokenizer, end_id, capacity), "pieces")
    orders = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Bounded by the patterns of the basis, one for each length at most, and their slots.
    shared = docs.sparkSession.sparkContext.broadcast(Layout.of(orders, capacity))
    buckets = -(-max(orders.values(), default=1) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(buckets)))
    order = ["doc_id", "text_key", "start"]
    numbered = running_total(dealt, group=["length"], bucket="bucket", order=order, value=F.lit(1), name="number", stored=True)
    columns = ["doc_id", "text_key", "doc_tokens", "start", "length", "ids_crc32"]
    placed = numbered.select(*columns, (F.col("number") - 1).alias("number")).mapInArrow(
        _place(shared), "doc_id long, text_key binary, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    placed = stage(placed, "placed")
    cut = placed.where(F.col("ids_crc32").isNull())
    # Cut pieces cross a bound of the stream, which is shorter than one use of every pattern.
    sums = _crc(_part_ids(docs, cut, tokenizer, end_id, few=True))
    sums = F.broadcast(sums.select(*(F.col(c).alias(f"_{c}") for c in sums.columns)))
    same = cut["doc_id"].eqNullSafe(sums["_doc_id"]) & (cut["text_key"] == sums["_text_key"]) & (cut["start"] == sums["_start"]) & (cut["length"] == sums["_length"])
    summed = cut.join(sums, same).withColumn("ids_crc32", F.col("_crc")).select(*placed.columns)
    return placed.where(F.col("ids_crc32").isNotNull()).union(summed)


def packed_sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of every sequence, without padding.

    ``pieces`` are those of :func:`packed_pieces` for the same documents.
    """
    ids = _part_ids(docs, pieces, tokenizer, end_id)
    keyed = ids.select(*(F.col(c).alias(f"_{c}") for c in ids.columns))
    same = (
        pieces["doc_id"].eqNullSafe(keyed["_doc_id"]) & (pieces["text_key"] == keyed["_text_key"])
        & (pieces["start"] == keyed["_start"]) & (pieces["length"] == keyed["_length"])
    )
    parts = pieces.join(keyed, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("_ids").alias("ids")))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
