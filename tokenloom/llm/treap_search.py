"""Ranked lexical search over K2-treaps of the term-document grid.

The corpus is indexed in tiles: a task's documents, some thousands at a time, are the
columns of a grid whose rows are their terms, and a cell holds the impact of the term in the
document. A tile is stored as a K2-treap, a quadtree without empty cells whose every node
holds the greatest impact left in its square: that cell's place inside the square, the drop
of its impact below the parent's, and a mask of the quarters that hold more. So every
cell of the grid is one node, and a node bounds all below it.

A query follows the row paths of its terms through all document ranges together: a range
is worth at most the best sum of cells found so far in one of its columns, and for each term the
greatest impact below the term's node. The ranges of greatest worth are halved first, many
at a time, and a range that cannot reach the scores already known is dropped. No document
is dropped that could be among the first, equal scores included.

Scores: weight(term) * impact(term, document) over an item's different terms, in whole
numbers; see :func:`item_terms` and :func:`impacts`.

Cases: null texts have no terms; documents and items without terms are in no result, and
empty tables give no row; repeated documents are documents of their own; a null ``doc_id``
comes last among equal scores; repeated items (equal id and text) count once, and items that
share an id are ranked apart; other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_or_empty
from tokenloom.session import stage

TOP = 10
# A tile ends at so many documents or terms (with repeats).
TILE_DOCS, TILE_TERMS = 8192, 2_000_000
# Items that one pass over the index answers; they and their terms go to every task.
ITEM_BLOCK = 4096
# Nodes that one step of a search looks at, about.
STEP_NODES = 16_384

# Letters, digits and everything beyond ASCII belong to terms; only A-Z change their case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split()


def impacts(tf: np.ndarray, n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """Impact of a term that stands ``tf`` times in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * all_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at the even places."""
    x = x.astype(np.uint64)
    for shift, kept in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(kept)
    return x


def _even_bits(x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(0x5555555555555555)
    for shift, kept in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0xFFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(kept)
    return x.astype(np.int64)


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> dict:
    """The stored form of the treap over cells of a grid of side ``2 ** height``, in one level after another."""
    code = (_spread_bits(rows) << np.uint64(1)) | _spread_bits(columns)
    order = np.argsort(code)
    code, left = code[order], values[order]
    sizes, masks, places, drops, widths = [], [], [], [], []
    above_cells = above_values = None
    for level in range(height + 1):
        if not len(code):
            break
        shift = np.uint64(2 * (height - level))
        cell = code >> shift
        starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        counts = np.diff(np.append(starts, len(cell)))
        greatest = np.maximum.reduceat(left, starts)
        at = np.flatnonzero(left == np.repeat(greatest, counts))
        group = np.repeat(np.arange(len(starts)), counts)[at]
        at = at[np.concatenate([[True], group[1:] != group[:-1]])]
        cells = cell[starts]
        if level:
            parent = np.searchsorted(above_cells, cells >> np.uint64(2))
            mask = np.zeros(len(above_cells), np.uint8)
            np.bitwise_or.at(mask, parent, np.left_shift(1, (cells & np.uint64(3)).astype(np.uint8)).astype(np.uint8))
            masks.append(mask)
            drop = above_values[parent] - greatest
        else:
            drop = greatest
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(drop.max()) <= np.iinfo(k).max)
        inside = (code[at] & ((np.uint64(1) << shift) - np.uint64(1))).astype("<u8")
        sizes.append(len(cells))
        widths.append(np.dtype(kind).itemsize)
        drops.append(drop.astype(kind).tobytes())
        places.append(inside.view(np.uint8).reshape(-1, 8)[:, : (int(shift) + 7) // 8].tobytes())
        kept = np.ones(len(code), bool)
        kept[at] = False
        code, left = code[kept], left[kept]
        above_cells, above_values = cells, greatest
    if sizes:
        masks.append(np.zeros(sizes[-1], np.uint8))
    return {
        "height": height, "sizes": sizes, "widths": widths,
        "masks": b"".join(m.tobytes() for m in masks), "places": b"".join(places), "drops": b"".join(drops),
    }


_BITS = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int32)


@dataclass
class Treap:
    """A treap read for search: nodes are numbered level after level."""

    height: int
    mask: np.ndarray
    first: np.ndarray  # number of the first child
    below: np.ndarray  # greatest value under the node, without its own
    value: np.ndarray
    row: np.ndarray
    column: np.ndarray

    @classmethod
    def read(cls, stored: dict) -> Treap:
        height, sizes = stored["height"], stored["sizes"]
        mask = np.frombuffer(stored["masks"], np.uint8)
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        place_at = drop_at = begin = 0
        cells, values = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        for level, (n, width) in enumerate(zip(sizes, stored["widths"])):
            shift = 2 * (height - level)
            own = mask[begin : begin + n]
            drop = np.frombuffer(stored["drops"], f"<u{width}", n, drop_at).astype(np.int64)
            drop_at += n * width
            values = np.repeat(values, counts) - drop if level else drop
            bytes_each = (shift + 7) // 8
            inside = np.zeros((n, 8), np.uint8)
            inside[:, :bytes_each] = np.frombuffer(stored["places"], np.uint8, n * bytes_each, place_at).reshape(n, bytes_each)
            place_at += n * bytes_each
            code = (cells << np.uint64(shift)) | inside.view("<u8").ravel()
            quarters = np.flatnonzero(np.unpackbits(own[:, None], axis=1, bitorder="little")[:, :4])
            counts = np.bincount(quarters // 4, minlength=n)
            first = begin + n + np.cumsum(counts) - counts
            for part, x in zip(parts, (first, values, _even_bits(code >> np.uint64(1)), _even_bits(code))):
                part.append(x)
            cells = (cells[quarters // 4] << np.uint64(2)) | (quarters % 4).astype(np.uint64)
            begin += n
        first, value, row, column = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts[:4])
        below = np.zeros(begin, np.int64)
        inner = np.flatnonzero(mask)
        if len(inner):
            below[inner] = np.maximum.reduceat(value, first[inner])
        return cls(height, mask, first, below, value, row, column)

    def best(self, rows: np.ndarray, weights: np.ndarray, columns: int, count: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns with the ``count`` best sums of weight * value over the given rows, every equal
        last one included, and their sums; sums under ``least`` may be left out."""
        sums = np.zeros(columns + 1, np.int64)
        finished = np.zeros(columns, bool)
        if not len(self.value) or not len(rows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = rows == self.row[0]
        sums[self.column[0]] += int(weights[found].sum() * self.value[0])
        worth = np.array([sums.max() + int(weights.sum()) * int(self.below[0])])
        level, prefix, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
        step = max(4, STEP_NODES // len(rows))
        while len(worth):
            if len(worth) > step:  # the best ranges first
                cut = np.argpartition(-worth, step)
                now, later = cut[:step], cut[step:]
            else:
                now, later = np.arange(len(worth)), np.empty(0, np.int64)
            new_level = np.repeat(level[now] + 1, 2)
            new_prefix = (prefix[now, None] * 2 + np.arange(2)).ravel()
            row_bit = (rows[None, :] >> (self.height - 1 - level[now])[:, None]) & 1
            quarter = (2 * row_bit[:, None, :] + np.arange(2)[None, :, None]).reshape(-1, len(rows))
            parent = np.repeat(nodes[now], 2, axis=0)
            mask = np.where(parent >= 0, self.mask[parent], 0)
            child = np.where((mask >> quarter) & 1, self.first[parent] + _BITS[mask, quarter], -1)
            inside = child >= 0
            hit = inside & (self.row[child] == rows[None, :])
            which, term = np.nonzero(hit)
            if len(which):
                at = child[which, term]
                np.add.at(sums, self.column[at], weights[term] * self.value[at])
            rest = np.where(inside, self.below[child], 0) @ weights
            width = 1 << (self.height - new_level)
            begin = np.minimum(new_prefix * width, columns)
            end = np.minimum(begin + width, columns)
            some = end > begin
            top = np.zeros(len(begin), np.int64)
            order = np.flatnonzero(some)[np.argsort(begin[some])]
            if len(order):
                top[order] = np.maximum.reduceat(sums, np.stack([begin[order], end[order]], 1).ravel())[::2]
            # A range with nothing left below is finished, whatever its width.
            over = some & (rest == 0)
            for b, e in zip(begin[over], end[over]):
                finished[b:e] = True
            done = sums[:-1][finished]
            if len(done) > count:
                least = max(least, int(np.partition(done, len(done) - count)[len(done) - count]))
            alive = some & (rest > 0)
            worth = np.concatenate([worth[later], (top + rest)[alive]])
            level = np.concatenate([level[later], new_level[alive]])
            prefix = np.concatenate([prefix[later], new_prefix[alive]])
            nodes = np.concatenate([nodes[later], child[alive]])
            kept = worth >= least
            if not kept.all():
                worth, level, prefix, nodes = worth[kept], level[kept], prefix[kept], nodes[kept]
        at = np.flatnonzero(finished & (sums[:-1] >= least))
        return at, sums[at]


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches):
        for batch in batches:
            sizes = [len(terms_of(t)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], ["docs", "terms"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(count, "docs long, terms long")
    total = counted.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return total["docs"], total["terms"]


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _tile(ids: list, sizes: list[int], numbers: list[np.ndarray], vocabulary: _Numbers, all_docs: int, all_terms: int) -> dict:
    n = np.array(sizes, np.int64)
    keys, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(vocabulary) + np.concatenate(numbers), return_counts=True)
    doc, term = keys // len(vocabulary), keys % len(vocabulary)
    df = np.bincount(term, minlength=len(vocabulary))
    # Frequent terms and short documents first: neighbours have like impacts.
    by_df, by_size = np.argsort(-df, kind="stable"), np.argsort(n, kind="stable")
    row_of, column_of = np.empty_like(by_df), np.empty_like(by_size)
    row_of[by_df], column_of[by_size] = np.arange(len(by_df)), np.arange(len(by_size))
    height = max(1, int(max(len(df), len(n)) - 1).bit_length())
    treap = build_treap(row_of[term], column_of[doc], impacts(tf, n[doc], all_docs, all_terms), height)
    terms = list(vocabulary)
    return {"doc_ids": [ids[i] for i in by_size], "terms": [terms[i] for i in by_df], "dfs": df[by_df].tolist(), **treap}


_TILE = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("height", pa.int32()),
    ("sizes", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())), ("masks", pa.binary()), ("places", pa.binary()), ("drops", pa.binary()),
])
_TILE_SPARK = (
    "doc_ids array<long>, terms array<binary>, dfs array<int>, height int, sizes array<int>, widths array<int>, "
    "masks binary, places binary, drops binary"
)


def build_index(docs: DataFrame, all_docs: int, all_terms: int) -> DataFrame:
    """One row for each tile. Every document with a term is in one tile; no text moves."""

    def build(batches):
        ids, sizes, numbers, vocabulary, terms = [], [], [], _Numbers(), 0

        def flush():
            tile = _tile(ids, sizes, numbers, vocabulary, all_docs, all_terms)
            return pa.RecordBatch.from_pylist([tile], _TILE)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                if not (found := terms_of(texts[i].as_py())):
                    continue
                ids.append(batch.column(0)[i].as_py())
                sizes.append(len(found))
                numbers.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                terms += len(found)
                if len(ids) == TILE_DOCS or terms >= TILE_TERMS:
                    yield flush()
                    ids, sizes, numbers, vocabulary, terms = [], [], [], _Numbers(), 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(build, _TILE_SPARK)


def _distinct_terms(text: Column) -> Column:
    """Different terms of a text, in order."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def item_terms(items: DataFrame, index: DataFrame, all_docs: int) -> DataFrame:
    """``(item_id, item_key, terms)``: each item's terms that occur, with their weights.

    Weights are floor(1000 ln((2 N + 2) / (2 df + 1))) for N documents with terms, df of them with this one.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), _distinct_terms(text_or_empty()).alias("terms"))
    asked = asked.select("item_id", F.xxhash64("item_id", "terms").alias("item_key"), F.explode("terms").alias("term")).distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").cast("string").alias("term"), F.col("t.dfs").alias("df"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.log((2 * F.lit(all_docs) + 2).cast("double") / (2 * F.col("df") + 1)) * 1000).cast("long")
    weighed = asked.join(held.select("term", weight.alias("weight")), "term").where("weight > 0")
    return weighed.groupBy("item_id", "item_key").agg(F.collect_list(F.struct(F.col("term").cast("binary").alias("term"), "weight")).alias("terms"))


_HITS = "item_id long, item_key long, doc_id long, score long"


def _search(shared, count: int):
    """Best documents of a task's tiles for every item; what earlier tiles gave bounds the later ones."""

    def run(batches):
        items = shared.value
        wanted = {t for _, _, terms in items for t, _ in terms}
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, without id, id)
        for batch in batches:
            for i in range(batch.num_rows):
                tile = {name: batch.column(name)[i].as_py() for name in _TILE.names if name not in ("terms", "dfs")}
                place = {t: r for r, t in enumerate(batch.column("terms")[i].as_py()) if t in wanted}
                treap, ids = Treap.read(tile), tile["doc_ids"]
                for n, (_, _, terms) in enumerate(items):
                    here = sorted((place[t], w) for t, w in terms if t in place)
                    if not here:
                        continue
                    rows, weights = (np.array(x, np.int64) for x in zip(*here))
                    least = -best[n][-1][0] if len(best[n]) == count else 1
                    columns, sums = treap.best(rows, weights, len(ids), count, least)
                    new = [(-int(s), ids[c] is None, ids[c] or 0) for c, s in zip(columns, sums)]
                    best[n] = sorted(best[n] + new)[:count]
        hits = [(a, b, None if missing else doc, -s) for (a, b, _), found in zip(items, best) for s, missing, doc in found]
        columns = list(zip(*hits)) if hits else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "item_key", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, count: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the first ``count`` documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    all_docs, all_terms = corpus_size(docs)
    index = stage(build_index(docs, all_docs, all_terms), "tiles")
    asked = stage(item_terms(items, index, all_docs), "items")
    blocks = -(-max(asked.count(), 1) // ITEM_BLOCK)
    hits = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = [(r["item_id"], r["item_key"], [(bytes(t["term"]), t["weight"]) for t in r["terms"]]) for r in mine.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        found = stage(index.mapInArrow(_search(shared, count), _HITS), "hits")
        hits = found if hits is None else hits.union(found)
    place = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= count).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, {_CASE}), '{_TERM}') AS terms FROM documents
), sizes AS (
  SELECT count(*)::BIGINT AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM docs WHERE len(terms) > 0
), tfs AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM docs) GROUP BY k, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs CROSS JOIN sizes GROUP BY term
), items AS (
  SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all(translate(text, {_CASE}), '{_TERM}'))) AS terms FROM benchmark
), asked AS (SELECT item_id, terms, unnest(terms) AS term FROM items),
scores AS (
  SELECT item_id, asked.terms, k, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(docs.terms)::BIGINT * all_docs) // all_terms)))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (k) CROSS JOIN sizes
  GROUP BY item_id, asked.terms, k, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, terms ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
