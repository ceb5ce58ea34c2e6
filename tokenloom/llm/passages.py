"""Passages that repeat across documents, found by collinear chains of shared seeds.

Seeds are hashes of runs of ``SEED`` words, sampled by the hash itself, so equal runs are seeds
in every text; where ``GUARD`` runs have none, the least of them is one. A seed row also carries a sketch of the words before and behind it. For each
seed the least text that holds it, the hub, is joined with every other holder, so a
passage in n documents gives n - 1 links however many share it; holders whose surroundings are
unlike the hub's are joined with a next hub among themselves, ``HUBS`` in all; those that are unlike all
of these pass once, in order, through as many further hubs as they need, so every holder is
compared until a hub is like it or it is one itself. Every place of a
seed is matched, with the first one in the hub; the hub's own further places are matched with
the first one in the greatest holder. The matches of a text and a hub are chained in
order with gap costs by a Fenwick tree, and the chains are aligned word by word, with
more text around them where an alignment meets the end of what was fetched.

Texts may share a passage with each other of which their hub has a part only. What they have in common
then goes on for long enough on one side of that part: all that leave the hub at the same
of its words and go on alike, or come alike from before, are compared with a hub of their own
from there on, and so forth until no two do: no text need be paired with all others.

Words are lower-case runs between white space. Rows of the result:

- kind ``passage``: words [start, end) of ``doc_id`` repeat words [other_start,
  other_end) of ``other_id`` with the given similarity (equal words over the longer
  side, ``MIN_SIMILARITY`` or more, ``MIN_WORDS`` words or more);
- kind ``copy``: the whole text of ``doc_id`` equals that of ``other_id``, the least id
  with this text; passages are given for that one only.

An exact passage of ``GUARD + SEED`` words or more has a seed in common. Of passages
with edits those are missed whose every run between edits misses the sample, or whose surroundings
are unlike by the sketches at all shared seeds.

Cases: null and empty texts and texts under ``MIN_WORDS`` words give no row; a null
``doc_id`` stays null in a row; repeated rows are copies; other columns are ignored.
Repeats inside one document are not looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_key, text_or_empty, windows_hash, word_hashes
from tokenloom.session import Rounds, shuffles_dropped, stage

# Words of a seed, the share of runs that are seeds (one in so many), runs of which one is a seed at least, and hubs of a seed.
SEED, SAMPLE, GUARD, HUBS = 4, 4, 32, 3
MIN_WORDS, MIN_SIMILARITY = 50, 0.8
# Words on a side that a sketch covers, bits of a side, and the share of the smaller side's bits, in hundredths, that surroundings must have in common.
AROUND, SIDE_BITS, ALIKE = 8, 16, 75
# Cost of a word of gap on either side of two chained seeds: seeds further apart than 48 words on both sides are better off alone.
GAP_COST = 1 / 96
# An alignment gives up when its score falls so far below its best; a changed word costs so much, an equal one gains 1;
# most words by which the sides may be shifted.
DROP, EDIT_COST, SHIFT = 15, 3, 8
# Words fetched around a chain at first, and how much more each time an alignment meets their end.
MARGIN, WIDER, TILE = 32, 8, 32
# Characters of texts whose seeds are made together, one text's more at most.
SEEDED_CHARACTERS = 1 << 20
# Characters of cut words that go on as one batch, one text's more at most.
CUT_CHARACTERS = 1 << 22
# Most words that chains fetched together may span.
TOGETHER = 4096
# Words of a stretch that lies in a passage as a whole or not.
CELL = 16
# Numbers of words that go on alike where texts are compared beyond their hub: the more, the shorter the part that the hub has.
BEYOND = (1, 2, 4, 8, 16)
# Seeds with more than one in so many of all rows are matched on the map side: there are few of them.
HOT_SHARE = 4096
# What more than one in so many of all links ask of a hub is dealt out with them.
LINK_SHARE = 1024
# Texts whose names (a long) may be broadcast to find them without moving the others.
BROADCAST_TEXTS = 200_000


def seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled seed hashes of texts, one text after the other, with their word positions and sketches; how many of
    them each text has, and its number of words."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    held = np.flatnonzero(sizes >= MIN_WORDS)
    counts = np.zeros(len(texts), np.int64)
    if not len(held):
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), counts, sizes
    h = word_hashes([w for i in held for w in split[i]])
    long = sizes[held]
    ends = np.cumsum(long)
    starts = ends - long
    runs = windows_hash(h, SEED)
    sampled = runs % np.uint64(SAMPLE) == 0
    # Runs that begin in one text and end in the next are none.
    sampled[(ends[:-1, None] - np.arange(1, SEED)).ravel()] = False
    at = np.flatnonzero(sampled)
    around = np.sort(np.concatenate([at, starts - 1, ends - SEED + 1]))
    extra = []
    for gap in np.flatnonzero(np.diff(around) > GUARD):
        first, last = int(around[gap]) + 1, int(around[gap + 1])
        least = np.lib.stride_tricks.sliding_window_view(runs[first:last], GUARD).argmin(axis=1)
        extra.append(first + least + np.arange(len(least)))
    if extra:
        at = np.unique(np.concatenate([at, *extra]))
    # Texts lie apart here, so that nothing around a seed is of another text.
    apart = AROUND * np.arange(1, len(held) + 1)
    near = np.zeros(len(h) + AROUND * (len(held) + 1), np.uint16)
    near[np.arange(len(h)) + np.repeat(apart, long)] = np.uint16(1) << ((h >> np.uint64(7)) % np.uint64(SIDE_BITS)).astype(np.uint16)
    width = 1
    while width < AROUND:
        step = min(width, AROUND - width)
        near, width = near[:-step] | near[step:], width + step
    of = np.searchsorted(starts, at, "right") - 1
    side = lambda first: near[at + apart[of] + first].astype(np.uint32)
    sketch = (side(-AROUND) | side(SEED) << np.uint32(SIDE_BITS)).view(np.int32)
    counts[held] = np.bincount(of, minlength=len(held))
    return runs[at], (at - starts[of]).astype(np.int32), sketch, counts, sizes


def _seed(batches):
    for batch in batches:
        texts, begin = batch.column(3).to_pylist(), 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and end - begin < 512 and size < SEEDED_CHARACTERS:
                size += len(texts[end])
                end += 1
            *found, counts, sizes = seeds(texts[begin:end])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (found[0].view(np.int64), *found[1:])]
            part = batch.slice(begin, end - begin)
            names = ["doc_id", "node", "text_key", "n_words", "seeds", "places", "sketches"]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes.astype(np.int32)), *lists], names)
            begin = end


def _frequent(batches):
    """Seeds with a fair share of a batch's rows, and, without a seed, how many rows a batch has.

    A seed with a share of 1 / HOT_SHARE of all rows has half of these in batches that report it.
    """
    for batch in batches:
        values, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        total = int(counts.sum())
        often = np.flatnonzero(counts > max(16, total // (2 * HOT_SHARE)))
        arrays = [pa.array([*values[often].tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), total], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["seed", "n"])


class Fenwick:
    """Running maximum over positions: best (score, item) at or before a position."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        found, at = (-1e18, -1), at + 1
        while at > 0:
            if self.best[at] > found:
                found = self.best[at]
            at -= at & -at
        return found


def chains(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of (place, other place) matches, best first.

    A chain's score is its number of seeds less GAP_COST for each word from seed to seed on
    either side. Points come in order of place, later other places first, and the
    tree holds, by other place, score + GAP_COST * (place + other place): its best entry
    before a point's other place is the point's best predecessor.
    """
    points = sorted(set(points), key=lambda x: (x[0], -x[1]))
    if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(points, points[1:])):
        return _traced(points, *_in_line(points))
    rank = {h: i for i, h in enumerate(sorted({h for _, h in points}))}
    tree, score, before = Fenwick(len(rank)), [], []
    for i, (p, h) in enumerate(points):
        value, j = tree.upto(rank[h] - 1)
        value -= GAP_COST * (p + h)
        if j < 0 or value <= 0:
            value, j = 0.0, -1
        score.append(value + 1)
        before.append(j)
        tree.put(rank[h], (score[i] + GAP_COST * (p + h), i))
    return _traced(points, score, before)


def _in_line(points) -> tuple[list[float], list[int]]:
    """Scores and predecessors of points that rise on both sides: there the point before is the best predecessor,
    since score + GAP_COST * (place + other place) rises from each point to the next."""
    score, before, entry = [], [], -1e18
    for i, (p, h) in enumerate(points):
        value = entry - GAP_COST * (p + h)
        before.append(i - 1 if value > 0 else -1)
        score.append(max(value, 0.0) + 1)
        entry = score[i] + GAP_COST * (p + h)
    return score, before


def _traced(points, score, before) -> list[list[tuple[int, int]]]:
    """Chains from the points with the best scores back, each point in one of them."""
    used, found = set(), []
    for i in sorted(range(len(points)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(points[i])
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def _apart(points) -> list[tuple[int, int]]:
    """Points without those that match a place of the hub once more less than a passage further on: a text that
    repeats itself there gets its passage from the first."""
    kept, last = [], {}
    for p, h in sorted(points):
        if h not in last or p - last[h] >= MIN_WORDS:
            last[h] = p
            kept.append((p, h))
    return kept


def _near(found: list[list[tuple[int, int]]]) -> list[list[list[tuple[int, int]]]]:
    """Chains, best first, with those put together that lie close to each other on both sides: what
    one of them is aligned with need not be aligned again for the others."""
    groups: list[tuple[list[int], list]] = []
    for chain in found:
        ends = [min(x[0] for x in chain), max(x[0] for x in chain), min(x[1] for x in chain), max(x[1] for x in chain)]
        for span, members in groups:
            both = [min(span[0], ends[0]), max(span[1], ends[1]), min(span[2], ends[2]), max(span[3], ends[3])]
            near = ends[0] - span[1] <= MARGIN and span[0] - ends[1] <= MARGIN and ends[2] - span[3] <= MARGIN and span[2] - ends[3] <= MARGIN
            if near and both[1] - both[0] <= TOGETHER and both[3] - both[2] <= TOGETHER:
                span[:] = both
                members.append(chain)
                break
        else:
            groups.append((ends, [chain]))
    return [members for _, members in groups]


_POINTS = pa.list_(pa.struct([("place", pa.int32()), ("hub_place", pa.int32())]))


def _chain(batches):
    for batch in batches:
        nodes, hubs, lists = (batch.column(i) for i in range(3))
        flat = pc.list_flatten(lists)
        points = list(zip(*(pc.struct_field(flat, name).to_pylist() for name in ("place", "hub_place"))))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).tolist()
        of, sizes, out = [], [0], []
        for i in range(batch.num_rows):
            for together in _near(chains(_apart(points[ends[i] : ends[i + 1]]))):
                for chain in together:
                    out += chain
                of.append(i)
                sizes.append(len(out))
        sides = np.array(out, np.int32).reshape(-1, 2).T
        places = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in sides], fields=list(_POINTS.value_type))
        taken = pa.array(of, pa.int64())
        arrays = [nodes.take(taken), hubs.take(taken), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), places)]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "hub", "points"])


def _cut(batches):
    """The words of a text that its links to hubs name, each with its link, and those that links to it as a hub name."""
    for batch in batches:
        nodes, texts = batch.column(0).to_numpy(), batch.column(3)
        counts = [pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy() for i in (1, 2)]
        spans, links = (pc.list_flatten(batch.column(i)) for i in (1, 2))
        sides = [[pc.struct_field(flat, name).to_pylist() for name in names] for flat, names in ((spans, ("lo", "hi")), (links, ("p_lo", "p_hi")))]
        ends = [np.concatenate(([0], np.cumsum(n))).tolist() for n in counts]
        parts, size, begin = ([], []), 0, 0
        for i in range(batch.num_rows):
            words = texts[i].as_py().lower().split()
            for (low, high), end, part in zip(sides, ends, parts):
                more = [" ".join(words[x:y]) for x, y in zip(low[end[i] : end[i + 1]], high[end[i] : end[i + 1]])]
                part += more
                size += sum(map(len, more))
            if size < CUT_CHARACTERS and i + 1 < batch.num_rows:
                continue
            for flat, count, end, part, is_link in zip((spans, links), counts, ends, parts, (False, True)):
                if part:
                    rows = flat.slice(end[begin], len(part))
                    lo, hi = ("p_lo", "p_hi") if is_link else ("lo", "hi")
                    rest = [pc.struct_field(rows, n) if is_link else pa.nulls(len(part), k) for n, k in (
                        ("hub", pa.int64()), ("points", _POINTS), ("h_lo", pa.int32()), ("h_hi", pa.int32()))]
                    arrays = [pa.array(np.repeat(nodes[begin : i + 1], count[begin : i + 1])), pc.struct_field(rows, lo), pc.struct_field(rows, hi),
                              pa.array(part, pa.string()), *rest]
                    yield pa.RecordBatch.from_arrays(arrays, ["node", "lo", "hi", "part", "hub", "points", "h_lo", "h_hi"])
            parts, size, begin = ([], []), 0, i + 1


def _run(a: list[str], b: list[str], x: int, y: int) -> int:
    """The number of equal words from a[x], b[y] on."""
    start, end = x, x + min(len(a) - x, len(b) - y)
    while x + 16 <= end and a[x : x + 16] == b[y : y + 16]:
        x, y = x + 16, y + 16
    while x < end and a[x] == b[y]:
        x, y = x + 1, y + 1
    return x - start


def extend(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """The best extensions of a match over more and more edits, from the first words on.

    Gives (words of a, words of b, equal words) after 0, 1, 2 ... edits, each at the end of a run of
    equal words. For each number of edits the furthest place on every diagonal follows from those
    of one edit less: a changed, a left-out or an added word, then equal words.
    """
    n, m = len(a), len(b)
    equal = _run(a, b, 0, 0)
    # By diagonal y - x: x and the equal words, as one number that is greater the further x is.
    word, low = 1 << 32, (1 << 32) - 1
    reached, found = {0: equal * (word + 1)}, [(equal, equal, equal)]
    best, edits = equal, 0
    while reached:
        # So many edits more are tried if no equal word follows, and none does where the words within their reach differ.
        more = -((best - DROP - max(v & low for v in reached.values())) // EDIT_COST) - edits
        xs, ys = [v >> 32 for v in reached.values()], [(v >> 32) + d for d, v in reached.items()]
        if set(a[min(xs) : max(xs) + more + 1]).isdisjoint(b[min(ys) : max(ys) + more + 1]):
            break
        edits += 1
        further: dict[int, int] = {}
        get = further.get
        for d, v in reached.items():
            x, w = v >> 32, v + word
            if x < n:
                if x + d < m and get(d, -1) < w:
                    further[d] = w
                if d > -SHIFT and get(d - 1, -1) < w:
                    further[d - 1] = w
            if d < SHIFT and x + d < m and get(d + 1, -1) < v:
                further[d + 1] = v
        reached, least = {}, best - DROP + EDIT_COST * edits
        top = (-1, -1, 0)
        for d, v in further.items():
            x = v >> 32
            y = x + d
            if x < n and y < m and a[x] == b[y]:
                v += (1 + _run(a, b, x + 1, y + 1)) * (word + 1)
            equal = v & low
            if equal > least:
                reached[d] = v
                x = v >> 32
                if equal > top[0] or (equal == top[0] and x > top[1]):
                    top = equal, x, d
        if reached:
            equal, x, d = top
            if equal > found[-1][2]:
                found.append((x, x + d, equal))
            best = max(best, equal - EDIT_COST * edits)
    return found


def align(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int, int, int, int]:
    """The longest alignment through the match at a[i], b[j] with MIN_SIMILARITY, or the plain run of equal words.

    Gives (start, end, other start, other end, equal words).
    """
    right, left = extend(a[i:], b[j:]), extend(a[:i][::-1], b[:j][::-1])
    chosen = (-1,)
    for x1, y1, e1 in right:
        for x0, y0, e0 in left:
            length = max(x1 + x0, y1 + y0)
            if length >= chosen[0] and e1 + e0 >= MIN_SIMILARITY * length:
                chosen = max(chosen, (length, e1 + e0, x0, x1, y0, y1))
    _, equal, x0, x1, y0, y1 = chosen
    return i - x0, i + x1, j - y0, j + y1, equal


_ALIGNED = [
    ("node", pa.int64()), ("hub", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other_start", pa.int64()), ("other_end", pa.int64()),
    ("similarity", pa.float64()), ("before", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("cut", pa.bool_()), ("place", pa.int32()), ("hub_place", pa.int32()),
]


def _goes_on(words: list[str], missing: int, from_end: bool = False) -> list[int | None] | None:
    """Hashes of the next words, for each number of BEYOND, nulls where a passage cannot need them; none if it lacks nothing.

    An alignment that lacks ``missing`` words of a passage is a part of one only if that goes on for half
    of them on one side. Longer numbers are kept, to meet texts with shorter parts.
    """
    need = -(-missing // 2)
    if need <= 0:
        return None
    own = max(k for k in BEYOND if k <= need)
    keys = []
    for k in BEYOND:
        if k < own or len(words) < k:
            keys.append(None)
            continue
        near = words[len(words) - k :] if from_end else words[:k]
        keys.append(xxhash.xxh64_intdigest(" ".join(near).encode("utf-8", "surrogatepass")) - (1 << 63))
    return keys


def _align(batches):
    """One row for each alignment: its place, hashes of the words that come before and behind it in the
    text, and whether it met the end of what was fetched. What is cut from a hub comes before its links."""
    far = BEYOND[-1] + SHIFT
    at, b = None, []
    for batch in batches:
        rows = []
        nodes, lows, highs, parts, hubs, others, tops = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7))
        lists = batch.column(5)
        flat = pc.list_flatten(lists)
        points = list(zip(*(pc.struct_field(flat, name).to_pylist() for name in ("place", "hub_place"))))
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))).tolist()
        for row, (node, lo, hi, part, hub, other_lo, other_hi) in enumerate(zip(nodes, lows, highs, parts, hubs, others, tops)):
            if hub is None:
                at, b = (node, lo, hi), part.split(" ")
                continue
            if at != (hub, other_lo, other_hi):
                raise ValueError(f"words [{other_lo}, {other_hi}) of text {hub} are missing")
            a, done = part.split(" "), []
            a_goes_on, b_goes_on = len(a) == hi - lo, len(b) == other_hi - other_lo
            for place, hub_place in points[ends[row] : ends[row + 1]]:
                i, j = place - lo, hub_place - other_lo
                # Inside a passage that was found, or inside another alignment on both sides.
                if any(x0 <= i < x1 and (passage or y0 <= j < y1) for x0, x1, y0, y1, passage in done):
                    continue
                x0, x1, y0, y1, equal = align(a, b, i, j)
                length = max(x1 - x0, y1 - y0)
                done.append((x0, x1, y0, y1, length >= MIN_WORDS and equal >= MIN_SIMILARITY * length))
                cut = (
                    (a_goes_on and x1 + far > len(a)) or (b_goes_on and y1 + far > len(b))
                    or (lo > 0 and x0 < far) or (other_lo > 0 and y0 < far)
                )
                missing = max(0, MIN_WORDS - length)
                rows.append((node, hub, lo + x0, lo + x1, other_lo + y0, other_lo + y1, equal / max(length, 1),
                             _goes_on(a[max(0, x0 - BEYOND[-1]) : x0], missing, True), _goes_on(a[x1 : x1 + BEYOND[-1]], missing),
                             cut, place, hub_place))
        columns = zip(*rows) if rows else [[]] * len(_ALIGNED)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ALIGNED)], [n for n, _ in _ALIGNED])


def _alike(sketch: Column, other: Column) -> Column:
    """Whether the words before, or those behind, are alike by their sketches."""

    def side(shift: int) -> Column:
        a, b = (F.shiftrightunsigned(s, shift).bitwiseAND((1 << SIDE_BITS) - 1) for s in (sketch, other))
        least = F.least(F.bit_count(a), F.bit_count(b))
        return (least > 0) & (F.bit_count(a.bitwiseAND(b)) * 100 >= least * ALIKE)

    return side(0) | side(SIDE_BITS)


def _are_alike(sketch: np.ndarray, other: np.ndarray) -> np.ndarray:
    """:func:`_alike` of many rows in a task."""
    found = np.zeros(len(sketch), bool)
    for shift in (0, SIDE_BITS):
        a, b = ((s.view(np.uint32) >> np.uint32(shift)) & np.uint32((1 << SIDE_BITS) - 1) for s in (sketch, other))
        least = np.minimum(np.bitwise_count(a), np.bitwise_count(b)).astype(np.int64)
        found |= (least > 0) & (np.bitwise_count(a & b).astype(np.int64) * 100 >= least * ALIKE)
    return found


def _is_alike(a: int, b: int) -> bool:
    """:func:`_alike` of two sketches in a task."""
    for shift in (0, SIDE_BITS):
        x, y = a >> shift & (1 << SIDE_BITS) - 1, b >> shift & (1 << SIDE_BITS) - 1
        least = min(x.bit_count(), y.bit_count())
        if least and (x & y).bit_count() * 100 >= least * ALIKE:
            return True
    return False


class Hubs:
    """All hubs of one seed. Holders come in order; each is matched with the first hub of another text that is like it.

    One that is like none is a hub itself. A further place of a hub's own text waits for the next text that is matched
    with this hub. Hubs of different texts are unlike each other and those of one text differ in their sketches, so
    there are no more than sketches have room for, however many texts hold the seed.
    """

    def __init__(self):
        self.nodes, self.places, self.sketches, self.waiting, self.known = [], [], [], [], {}

    def meet(self, node: int, place: int, sketch: int) -> list[tuple[int, int, int, int]]:
        """(node, hub, place, hub place) of what is matched now."""
        hub = self.known.get(sketch)
        if hub is None or self.nodes[hub] == node:
            like = [i for i, s in enumerate(self.sketches) if _is_alike(s, sketch)]
            hub = next((i for i in like if self.nodes[i] != node), None)
            own = [i for i in like if self.nodes[i] == node]
            if hub is None:
                same = [i for i in own if self.sketches[i] == sketch]
                if own:
                    self.waiting[(same or own)[0]].append(place)
                if not same:
                    self.nodes.append(node)
                    self.places.append(place)
                    self.sketches.append(sketch)
                    self.waiting.append([])
                return []
            self.known[sketch] = hub
        found = [(self.nodes[hub], node, at, place) for at in self.waiting[hub]]
        self.waiting[hub].clear()
        return [(node, self.nodes[hub], place, self.places[hub]), *found]


def _led(batches):
    """Matches of holders in order of seed, node and place with all hubs of their seeds."""
    last, hubs = None, Hubs()
    for batch in batches:
        found = []
        for seed, node, place, sketch in zip(*(c.to_pylist() for c in batch.columns)):
            if seed != last:
                last, hubs = seed, Hubs()
            found += hubs.meet(node, place, sketch & (1 << 2 * SIDE_BITS) - 1)
        columns = list(zip(*found)) if found else [[]] * 4
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "hub", "place", "hub_place"])


def _ends(held: DataFrame) -> DataFrame:
    """The least and the greatest holder of each seed that several hold, each with its first place of it."""
    ends = held.groupBy("seed").agg(
        F.min(F.struct("node", "place", "sketch")).alias("low"), F.max(F.struct("node", (-F.col("place")).alias("back"), "sketch")).alias("high")
    )
    return ends.where("low.node < high.node")


def _matched(held: DataFrame, ends: DataFrame) -> DataFrame:
    """Every place of a seed next to its hub's first place, or, for the hub's further places, to the greatest holder's."""
    is_hub = F.col("node") == F.col("low.node")
    partner = F.when(is_hub, F.struct(F.col("high.node").alias("node"), (-F.col("high.back")).alias("place"), F.col("high.sketch").alias("sketch"))).otherwise(
        F.col("low")
    )
    rows = held.join(ends, "seed").where("node != low.node OR place > low.place").withColumn("other", partner)
    return rows.select(
        "seed", "node", "place", "sketch", F.col("other.node").alias("hub"), F.col("other.place").alias("hub_place"),
        _alike(F.col("sketch"), F.col("other.sketch")).alias("alike"),
    )


_PAIRED = ["seed", "node", "place", "sketch", "hub", "hub_place", "alike"]
_MATCH = ["node", "hub", "place", "hub_place"]


def _pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
    """:func:`_matched` of whole seeds, whose rows come in order of seed."""

    def begins(*columns):
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.flatnonzero(new)

    first = begins(rows[0])
    sizes = np.diff(np.append(first, len(rows[0])))
    rows = [c[np.repeat(sizes > 1, sizes)] for c in rows]
    if not len(rows[0]):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows, *rows[1:3], np.empty(0, bool))], _PAIRED)
    rows = [c[np.lexsort(rows[2::-1])] for c in rows]
    seed, node = rows[:2]
    sizes = sizes[sizes > 1]
    first = np.cumsum(sizes) - sizes
    several = node[first] != node[first + sizes - 1]
    seed, node, place, sketch = (c[np.repeat(several, sizes)] for c in rows)
    sizes = sizes[several]
    last = np.cumsum(sizes)
    low = np.repeat(last - sizes, sizes)
    holders = begins(seed, node)
    high = np.repeat(holders[np.searchsorted(holders, last - 1, "right") - 1], sizes)
    is_hub = node == node[low]
    taken = np.flatnonzero(~is_hub | (place > place[low]))
    other = np.where(is_hub, high, low)[taken]
    columns = [seed[taken], node[taken], place[taken], sketch[taken], node[other], place[other], _are_alike(sketch[taken], sketch[other])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _PAIRED)


def _paired(batches):
    """:func:`_pairs` of rows in order of seed; what the last seed of a batch has waits for the next."""
    waiting = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if waiting is None else [np.concatenate(c) for c in zip(waiting, rows)]
        if not len(rows[0]):
            continue
        begin = int(np.searchsorted(rows[0], rows[0][-1]))
        waiting = [c[begin:] for c in rows]
        if begin:
            yield _pairs([c[:begin] for c in rows])
    if waiting is not None:
        yield _pairs(waiting)


def _hubbed(batches):
    """Matches of all holders of seeds that come in order: with the first HUBS hubs, then with all further ones."""
    kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["seed", "node", "place", "sketch"]
    for batch in _paired(batches):
        for left in range(HUBS, 0, -1):
            alike = batch.column(6)
            yield pa.RecordBatch.from_arrays([c.filter(alike) for c in (batch.column(1), batch.column(4), batch.column(2), batch.column(5))], _MATCH)
            unlike = [c.filter(pc.invert(alike)) for c in batch.columns[:4]]
            if left > 1:
                batch = _pairs([c.to_numpy() for c in unlike])
        yield from _led([pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(unlike, kinds)], names)])


def seed_matches(seeded: DataFrame) -> DataFrame:
    """``(node, hub, place, hub_place)`` of seeds in like surroundings. ``seeded`` has each text once."""
    held = seeded.select("node", "places", "sketches", F.posexplode("seeds").alias("number", "seed")).select(
        "seed", "node", F.get("places", "number").alias("place"), F.get("sketches", "number").alias("sketch")
    )
    counted = seeded.select("seeds").mapInArrow(_frequent, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    counted = stage(counted, "frequent")
    total = counted.where("seed IS NULL").first()
    # 2 * HOT_SHARE rows at most.
    often = F.col("seed").isNotNull() & (F.col("n") > (total["n"] if total else 0) // (2 * HOT_SHARE))
    hot = counted.where(often).select("seed")
    matched = "node long, hub long, place int, hub_place int"
    if hot.isEmpty():
        return held.repartition("seed").sortWithinPartitions("seed").mapInArrow(_hubbed, matched)
    matches = held.join(F.broadcast(hot), "seed", "left_anti").repartition("seed").sortWithinPartitions("seed").mapInArrow(_hubbed, matched)
    rest, found = stage(held.join(F.broadcast(hot), "seed", "left_semi"), "held"), Rounds("matches")
    for _ in range(HUBS):
        ends = _ends(rest)
        rest = found.add(_matched(rest, F.broadcast(ends))).where("NOT alike").select("seed", "node", "place", "sketch")
    # What is unlike all of these hubs, of which there may be any number.
    further = rest.repartition("seed").sortWithinPartitions("seed", "node", "place").mapInArrow(_led, matched)
    return matches.union(found.all().where("alike").select(*_MATCH)).union(further)


def _fetched(chained: DataFrame, texts: DataFrame, margin: int) -> DataFrame:
    """Chains with the words around them, from one row of each text, in order behind what is cut from their hubs.

    A text moves once, what is cut from it once more. What many links ask of a hub is dealt out with them over several groups."""

    def tile(side, name):
        first, last = F.array_min(f"points.{side}"), F.array_max(f"points.{side}")
        return [
            F.greatest(F.floor((first - margin) / TILE) * TILE, F.lit(0)).cast("int").alias(f"{name}_lo"),
            (F.ceil((last + SEED + margin) / TILE) * TILE).cast("int").alias(f"{name}_hi"),
        ]

    chained = stage(chained.select("node", "hub", "points", *tile("place", "p"), *tile("hub_place", "h")), "chains")
    span, link = F.struct(F.col("h_lo").alias("lo"), F.col("h_hi").alias("hi")), F.struct("hub", "points", "p_lo", "p_hi", "h_lo", "h_hi")
    sides = F.explode(F.array(
        F.struct("node", F.when(F.lit(False), span).alias("span"), link.alias("link")),
        F.struct(F.col("hub").alias("node"), span.alias("span"), F.when(F.lit(False), link).alias("link")),
    ))
    wanted = chained.select(sides.alias("side")).groupBy("side.node").agg(F.collect_set("side.span").alias("spans"), F.collect_list("side.link").alias("links"))
    wanted = stage(wanted, "wanted")
    if wanted.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(wanted.select("node")), "node", "left_semi")
    whole = texts.groupBy("node").agg(F.first("text").alias("text"))
    schema = "node long, lo int, hi int, part string, hub long, points array<struct<place:int,hub_place:int>>, h_lo int, h_hi int"
    parts = whole.join(wanted, "node").select("node", "spans", "links", "text").mapInArrow(_cut, schema)
    of = [F.coalesce(a, b).alias(name) for name, a, b in (("of", "hub", "node"), ("of_lo", "h_lo", "lo"), ("of_hi", "h_hi", "hi"))]
    parts = parts.select("*", *of)
    most = chained.count() // LINK_SHARE + 64
    # LINK_SHARE rows at most.
    asked = chained.groupBy(F.col("hub").alias("of"), F.col("h_lo").alias("of_lo"), F.col("h_hi").alias("of_hi")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    groups = F.coalesce(F.ceil(F.col("n") / most), F.lit(1))
    dealt = F.when(F.col("hub").isNull(), F.sequence(F.lit(0).cast("long"), groups - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), groups)))
    parts = parts.join(F.broadcast(asked), ["of", "of_lo", "of_hi"], "left").withColumn("group", F.explode(dealt))
    ends = ["of", "of_lo", "of_hi", "group"]
    return parts.repartition(*ends).sortWithinPartitions(*ends, F.col("hub").asc_nulls_first()).select(
        "node", "lo", "hi", "part", "hub", "points", "h_lo", "h_hi"
    )


def _aligned(chained: DataFrame, texts: DataFrame, rounds: Rounds) -> DataFrame:
    """Alignments of chains, none of them cut short by what was fetched. All go to ``rounds``."""
    schema = (
        "node long, hub long, start long, end long, other_start long, other_end long, similarity double, "
        "before array<long>, behind array<long>, cut boolean, place int, hub_place int"
    )
    margin, first = MARGIN, rounds.number
    while True:
        found = rounds.add(_fetched(chained, texts, margin).mapInArrow(_align, schema))
        point = F.array(F.struct(F.col("place"), F.col("hub_place")))
        chained = found.where("cut").select("node", "hub", point.alias("points"))
        if chained.isEmpty():
            return rounds.all(first).where("NOT cut")
        margin *= WIDER


def _passages(aligned: DataFrame) -> DataFrame:
    long_enough = F.greatest(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start")) >= MIN_WORDS
    return aligned.where(long_enough & (F.col("similarity") >= MIN_SIMILARITY))


def _covered(aligned: DataFrame) -> DataFrame:
    """``(node, cell)`` of stretches of CELL words that lie in a passage of the text."""
    found = _passages(aligned)
    sides = found.select("node", "start", "end").union(found.select("hub", "other_start", "other_end"))
    first, last = F.ceil(F.col("start") / CELL), F.floor(F.col("end") / CELL) - 1
    return sides.where(first <= last).select("node", F.explode(F.sequence(first, last)).alias("cell")).distinct()


def _beyond(found: DataFrame, covered: DataFrame) -> DataFrame:
    """Points from which texts go on alike, or came alike, where they leave their hub by the alignments ``found``,
    and at least one of them has no passage there yet by the stretches ``covered``."""
    ways = [
        F.struct(F.lit(True).alias("behind"), F.col("other_end").alias("at"), F.col("end").cast("int").alias("place"), F.col("behind").alias("keys")),
        F.struct(F.lit(False).alias("behind"), F.col("other_start").alias("at"), (F.col("start") - 1).cast("int").alias("place"), F.col("before").alias("keys")),
    ]
    left = found.where("behind IS NOT NULL").select("hub", "node", F.explode(F.array(*ways)).alias("way")).select("hub", "node", "way.*")
    left = left.withColumn("cell", F.floor(F.col("place") / CELL).cast("long"))
    left = left.join(covered.distinct().withColumn("known", F.lit(True)), ["node", "cell"], "left").withColumn("new", F.col("known").isNull())
    left = left.select("hub", "behind", "at", "node", "place", "new", F.posexplode("keys").alias("words", "key")).where("key IS NOT NULL")
    ends = ["hub", "behind", "at", "words", "key"]
    first = left.groupBy(*ends).agg(F.min(F.struct("new", "node", "place")).alias("low"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    return left.where("new").join(first, ends).where("node != low.node").select(
        "node", F.col("low.node").alias("hub"), F.array(F.struct("place", F.col("low.place").alias("hub_place"))).alias("points")
    ).distinct()


def _texts(keyed: DataFrame) -> DataFrame:
    """``(node, owner, n, clash)``: the least id and the rows of each text, and whether different texts share its 64-bit hash."""
    key = F.xxhash64("text_key")
    return keyed.groupBy("node").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), (F.min(key) != F.max(key)).alias("clash"))


def _clashes(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """``(node, least)`` of 64-bit hashes that different texts share, with the least key: next to none, and none as a rule."""
    return stage(keyed.join(F.broadcast(shared), "node").groupBy("node").agg(F.min("text_key").alias("least")), "clashes")


def _named(keyed: DataFrame, clashes: DataFrame) -> DataFrame:
    """``keyed`` with a node of its own for every text: of texts with one hash all but the least get another."""
    joined = keyed.join(F.broadcast(clashes), "node", "left")
    again = F.col("least").isNotNull() & (F.col("least") != F.col("text_key"))
    return joined.withColumn("node", F.when(again, F.xxhash64("text_key", F.lit("again"))).otherwise(F.col("node"))).drop("least")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, start, end, other_id, other_start, other_end, similarity)``."""
    with shuffles_dropped(docs.sparkSession):
        return _repeated(docs)


def _repeated(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("node"), text_key().alias("text_key"), text_or_empty().alias("text"))
    schema = "doc_id long, node long, text_key binary, n_words int, seeds array<long>, places array<int>, sketches array<int>"
    seeded = stage(keyed.mapInArrow(_seed, schema), "seeds")
    texts, least = keyed, stage(_texts(seeded), "texts")
    shared = least.where("clash").select("node")
    if not shared.isEmpty():
        clashes = _clashes(seeded, shared)
        seeded, texts = _named(seeded, clashes), _named(keyed, clashes)
        least = stage(_texts(seeded), "texts")
    several = least.where("n > 1")
    # One row of each text: its owner's. Rows that repeat id and text repeat points, which count once.
    owned = several.select(F.col("node").alias("of"), "owner")
    owned = F.broadcast(owned) if owned.count() <= BROADCAST_TEXTS else owned
    distinct = seeded.join(owned, F.col("node") == F.col("of"), "left").where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("owner")))
    distinct = distinct.where(F.size("seeds") > 0).select("node", "seeds", "places", "sketches")
    matches = seed_matches(distinct)
    grouped = matches.groupBy("node", "hub").agg(F.collect_list(F.struct("place", "hub_place")).alias("points"))
    chained = grouped.mapInArrow(_chain, "node long, hub long, points array<struct<place:int,hub_place:int>>")
    rounds, covered = Rounds("aligned"), Rounds("covered")
    while True:
        found = _aligned(chained, texts, rounds)
        covered.add(_covered(found))
        chained = stage(_beyond(found, covered.all()), "beyond")
        if chained.isEmpty():
            break
    aligned = _passages(rounds.all().where("NOT cut")).select("node", "hub", "start", "end", "other_start", "other_end", "similarity").distinct()
    owner = least.select("node", F.col("owner").alias("doc_id"))
    passages = aligned.join(owner, "node").join(owner.select(F.col("node").alias("hub"), F.col("doc_id").alias("other_id")), "hub").select(
        "doc_id", F.lit("passage").alias("kind"), "start", "end", "other_id", "other_start", "other_end", "similarity"
    )
    whole = F.col("n_words").cast("long")
    copies = (
        seeded.where(f"n_words >= {MIN_WORDS}").join(several, "node").where("NOT doc_id <=> owner")
        .select("doc_id", F.lit("copy").alias("kind"), F.lit(0).cast("long").alias("start"), whole.alias("end"),
                F.col("owner").alias("other_id"), F.lit(0).cast("long").alias("other_start"), whole.alias("other_end"), F.lit(1.0).alias("similarity"))
    )
    return passages.union(copies)
