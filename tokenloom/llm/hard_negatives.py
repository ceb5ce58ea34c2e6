"""Hard negatives for anchors, mined by a secondary sort of scored pairs.

Anchors (rows whose id a stride divides) meet all rows in tiles: anchors and rows are
dealt into blocks by a hash, and each pair of blocks is one bounded group whose scores
are one matrix product. A first pass keeps the best positives of each tile, and of all
tiles. With their scores known, a second pass keeps, of each tile, only the best rows of
another label inside each positive's window. These few scored pairs are keyed by
(anchor, descending score, positives first, id), dealt by anchor and sorted within their
partitions, and one streaming pass opens a window at each positive and hands out the
negatives that follow; it holds no more than an anchor's open windows. Repartitioning
and sorting are the DataFrame form of ``repartitionAndSortWithinPartitions``, so keys
stay on the JVM side and spill there.

A component x counts as floor(SCALE * x); a score is an exact integer inner product.

Cases: rows with a null label or vector, or a null or non-finite component, take no part;
only vectors of one length are paired (empty ones score 0); a null id is no anchor and comes last
among equal scores; equal rows count once; rows that share an id but differ take part
each, and are never paired with each other; scores beyond 64 bits are held at its ends;
an empty table gives no row; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import stage

SCALE = 256
ANCHOR_STRIDE = 100
POSITIVES, NEGATIVES = 5, 5
# A negative's score lies between this share of the positive's, in hundredths, and the positive's.
LOW_PERCENT = 80
# Rows and anchors of one tile.
TILE_ROWS, TILE_ANCHORS = 8192, 1024

_LIMIT = 2**63 - 1
_SCORED = "anchor_id long, anchor_key long, score long, vec_id long, row_key long"
_SCORED_ARROW = pa.schema([(n, pa.int64()) for n in ("anchor_id", "anchor_key", "score", "vec_id", "row_key")])


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, vector, row_key)`` of the rows that take part, equal rows once."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    vectors = kept.select("vec_id", moved.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    return vectors.withColumn("row_key", F.xxhash64("label", "vector"))


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and quantised vectors by length, rows in rising id, null ids last."""
    ids = table.column("vec_id").combine_chunks()
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    vectors = table.column("vector").combine_chunks()
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    found = {}
    for size in np.unique(sizes):
        at = order[sizes[order] == size]
        found[int(size)] = at, flat[starts[at][:, None] + np.arange(size)]
    return found


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two blocks of whole-numbered vectors."""
    if a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -_LIMIT, _LIMIT).astype(np.int64)


def _tiles(pick):
    """A tile's function: ``pick(scores, allowed, positives)`` gives the places of an anchor's rows to keep.

    Rows of the anchor's label are allowed, or, once anchors carry positives, the others.
    """

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        kept_parts = []
        if rows.num_rows and anchors.num_rows:
            ids = rows.column("vec_id").combine_chunks()
            id_of, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            labels, keys = (rows.column(c).to_numpy() for c in ("label", "row_key"))
            anchor_ids, anchor_keys, anchor_labels = (anchors.column(c).to_numpy() for c in ("vec_id", "row_key", "label"))
            positives = anchors.column("positives").to_pylist() if "positives" in anchors.column_names else None
            row_side, anchor_side = _matrices(rows), _matrices(anchors)
            for size in row_side.keys() & anchor_side.keys():
                (at, vectors), (which, queries) = row_side[size], anchor_side[size]
                for scores, n in zip(_products(queries, vectors), which):
                    others = ~known[at] | (id_of[at] != anchor_ids[n])
                    same = labels[at] == anchor_labels[n]
                    kept = pick(scores, others & same if positives is None else others & ~same, positives and positives[n])
                    back = at[kept]
                    whose = (np.full(len(kept), x[n]) for x in (anchor_ids, anchor_keys))
                    kept_parts.append((*whose, scores[kept], id_of[back], keys[back], ~known[back]))
        *columns, missing = map(np.concatenate, zip(*kept_parts)) if kept_parts else [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)]
        arrays = [pa.array(c, pa.int64(), mask=missing if n == "vec_id" else None) for n, c in zip(_SCORED_ARROW.names, columns)]
        return pa.Table.from_arrays(arrays, schema=_SCORED_ARROW)

    return run


def _best(scores: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest allowed scores; equal ones in their order, which is by id."""
    at = np.flatnonzero(allowed)
    if len(at) > count:
        least = np.partition(scores[at], len(at) - count)[len(at) - count]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:count]


def _pick_positives(count: int):
    return lambda scores, allowed, _: _best(scores, allowed, count)


def window_floor(score: int, low_percent: int = LOW_PERCENT) -> int:
    """The least negative score of a positive's window."""
    return -(-low_percent * score // 100)


def _pick_negatives(count: int, low_percent: int):
    def pick(scores, allowed, positives):
        kept = [
            _best(scores, allowed & (scores >= window_floor(s, low_percent)) & (scores <= s), count) for s in set(positives or ()) if s >= 0
        ]
        return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)

    return pick


def _in_tiles(vectors: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, pick) -> DataFrame:
    """Scored pairs that ``pick`` keeps of each tile; a block is copied once for each block of the other side."""
    place = F.xxhash64("vec_id", "row_key")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("*", F.pmod(place, F.lit(row_blocks)).cast("int").alias("row_block"), copies(anchor_blocks).alias("anchor_block"))
    # Columns of their own: both sides come from one table.
    own = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))
    right = own.select("*", F.pmod(place, F.lit(anchor_blocks)).cast("int").alias("anchor_block"), copies(row_blocks).alias("row_block"))
    keys = ("row_block", "anchor_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tiles(pick), _SCORED)


def _hand_out(count: int, low_percent: int):
    """The streaming pass over sorted pairs: windows open at positives and close below their floor."""

    def run(batches):
        current, windows = None, []
        for batch in batches:
            out = []
            for anchor, key, down, kind, vec_id in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (anchor, key) != current:
                    current, windows = (anchor, key), []
                if kind == 0:
                    windows.append([vec_id, -down, 0])
                    continue
                for window in windows:
                    if low_percent * window[1] <= -100 * down:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], vec_id, window[1], -down))
                    else:
                        window[2] = count
                windows = [w for w in windows if w[2] < count]
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def hard_negatives(
    rows: DataFrame, stride: int = ANCHOR_STRIDE, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has vec_id, label and embedding. Anchors are the rows whose id ``stride`` divides.
    """
    vectors = stage(usable_vectors(rows), "vectors")
    anchors = vectors.where(F.col("vec_id") % stride == 0)
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % stride == 0).alias("a")).first()
    row_blocks, anchor_blocks = -(-max(sizes["n"], 1) // TILE_ROWS), -(-max(sizes["a"], 1) // TILE_ANCHORS)
    scored = _in_tiles(vectors, anchors, row_blocks, anchor_blocks, _pick_positives(positives))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "row_key"]
    first = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key").orderBy(*order))
    best = stage(scored.withColumn("place", first).where(F.col("place") <= positives).drop("place"), "positives")
    opened = best.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("row_key")).agg(F.collect_set("score").alias("positives"))
    found = _in_tiles(vectors, anchors.join(opened, ["vec_id", "row_key"]), row_blocks, anchor_blocks, _pick_negatives(negatives, low_percent))
    pairs = best.withColumn("kind", F.lit(0)).union(found.withColumn("kind", F.lit(1)))
    keyed = pairs.select("anchor_id", "anchor_key", (-F.col("score")).alias("down"), "kind", "vec_id", "row_key")
    key = ["anchor_id", "anchor_key", "down", "kind", F.asc_nulls_last("vec_id"), "row_key"]
    placed = keyed.repartition("anchor_id", "anchor_key").sortWithinPartitions(*key)
    return placed.select("anchor_id", "anchor_key", "down", "kind", "vec_id").mapInArrow(
        _hand_out(negatives, low_percent),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )


SQL = """
WITH taking AS (
  SELECT DISTINCT vec_id, label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM taking
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS row_id,
    list_dot_product(a.q, r.q)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id)::INTEGER AS rank,
  row_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
