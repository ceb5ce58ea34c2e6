"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

The bag of a text is its five-word shingles with their counts (words: lower-case
runs between white space; a text of one to four words is one shingle). Two
texts are near when the weighted Jaccard similarity of their bags, the sum of
the smaller counts over the sum of the larger ones, is at least ``THRESHOLD``.
Classes are the connected components of that relation over distinct texts.

Cases: a null text counts as empty; empty texts are copies of each other and
near to nothing else; a null ``doc_id`` is classified like any other row;
repeated rows are copies; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.components import connected
from tokenloom.llm.hashing import GOLDEN, free_name, let_go, mix, text_key, text_or_empty, unit, windows_hash, word_hashes
from tokenloom.session import stage

SHINGLE, THRESHOLD = 5, 0.8
# 40 bands of 7 components: a pair at the threshold is missed with probability 8e-5, and texts that
# share one passage only (similarity 0.2) meet with probability 5e-4.
BANDS, ROWS = 40, 7
# Turns in which a bucket with separate components offers one more text for comparison, before
# the texts that are still apart meet in a prefix-filtered join.
HUB_TURNS = 3
# Words that one block of documents holds in a task.
BLOCK_WORDS = 50_000


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and their counts."""
    return np.unique(windows_hash(word_hashes((text or "").lower().split()), SHINGLE), return_counts=True)


def similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard similarity of the bags of two texts."""
    (ka, ca), (kb, cb) = bag(a), bag(b)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[i], cb[j]).sum())
    total = int(ca.sum() + cb.sum()) - shared
    return shared / total if total else float(a == b)


def bag_min_hash(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """BagMinHash registers (docs, m) of many bags at once.

    The weight axis is discretised at the integers. Each element owns Poisson
    processes over [0,1), [1,2), [2,4), [4,8) ...; a point falls on a register
    and counts when its place lies below the element's weight. A process that
    straddles the weight is halved: the point goes to one half, the other half
    starts anew behind it. Points come in rising order and a process ends once
    it passes the largest register of its document, so heavy elements cost
    only the logarithm of their weight.
    """
    registers = np.full(docs * m, np.inf)

    def fresh(key, x, size, index_of=np.uint64(m)):
        r = mix(key)
        return mix(r + GOLDEN), x - np.log(unit(r)) / size, (mix(r ^ GOLDEN) % index_of).astype(np.int64)

    roots = [(keys, weights, doc, np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64))]
    low = 1
    while len(heavy := np.flatnonzero(weights > low)):
        start = np.full(len(heavy), low, np.int64)
        roots.append((keys[heavy] + start.astype(np.uint64) * GOLDEN, weights[heavy], doc[heavy], start, start.copy()))
        low *= 2
    key, weight, doc, start, size = (np.concatenate(c) for c in zip(*roots))
    stream, x, index = fresh(mix(key), np.zeros(len(key)), size)
    while len(key):
        counts = start + size <= weight
        np.minimum.at(registers, doc[counts] * m + index[counts], x[counts])
        limit = registers.reshape(docs, m).max(axis=1)
        live = (x < limit[doc]) & (start < weight)
        key, weight, doc, start, size, stream, x, index = (c[live] for c in (key, weight, doc, start, size, stream, x, index))
        wide = size > 1
        if not wide.any():
            stream, x, index = fresh(stream, x, size)
            continue
        leaf = ~wide
        parts = [(key[leaf], weight[leaf], doc[leaf], start[leaf], size[leaf], *fresh(stream[leaf], x[leaf], size[leaf]))]
        half, right = size[wide] // 2, (stream[wide] >> np.uint64(63)).astype(np.int64)
        for side in (0, 1):
            begin = start[wide] + half * side
            child = mix(key[wide] + begin.astype(np.uint64) * GOLDEN + half.astype(np.uint64))
            owner = right == side
            s, later, other = fresh(child, x[wide], half)
            parts.append((child, weight[wide], doc[wide], begin, half, s, np.where(owner, x[wide], later), np.where(owner, index[wide], other)))
        key, weight, doc, start, size, stream, x, index = (np.concatenate(c) for c in zip(*parts))
    return registers.reshape(docs, m)


def band_hashes(texts: list[str | None], bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """The band hashes of each text; none for an empty one."""
    bags = [bag(t) for t in texts]
    sizes = [len(k) for k, _ in bags]
    if not sum(sizes):
        return [np.empty(0, np.int64)] * len(texts)
    doc = np.repeat(np.arange(len(bags)), sizes)
    keys, counts = (np.concatenate(c) for c in zip(*bags))
    signature = bag_min_hash(keys, counts.astype(np.int64), doc, len(bags), bands * rows).view(np.uint64)
    signature = signature.reshape(len(bags), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), signature.shape[:2]).copy()
    for i in range(rows):
        h = mix(h ^ signature[:, :, i]) + GOLDEN
    h = h.view(np.int64)
    return [h[i] if n else np.empty(0, np.int64) for i, n in enumerate(sizes)]


def _sign(batches):
    for batch in batches:
        ids, keys, texts = (batch.column(i) for i in range(3))
        begin, words = 0, 0
        for i in range(batch.num_rows):
            words += 1 + len(texts[i].as_py()) // 6
            if words < BLOCK_WORDS and i + 1 < batch.num_rows:
                continue
            found = band_hashes(texts.slice(begin, i + 1 - begin).to_pylist())
            offsets = np.cumsum([0, *(len(b) for b in found)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            span = (begin, i + 1 - begin)
            yield pa.RecordBatch.from_arrays([ids.slice(*span), keys.slice(*span), bands], ["doc_id", "text_key", "bands"])
            begin, words = i + 1, 0
    let_go()


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, bands)`` of every document, without moving a text."""
    return docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text")).mapInArrow(
        _sign, "doc_id long, text_key binary, bands array<long>"
    )


def _verify(batches):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        sims = [similarity(a[i].as_py(), b[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["u", "v", "sim"])
    let_go()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    joined = (
        pairs.join(texts.select(F.col("text_key").alias("u"), F.col("text").alias("a")), "u")
        .join(texts.select(F.col("text_key").alias("v"), F.col("text").alias("b")), "v")
        .select("u", "v", "a", "b")
    )
    return stage(joined.mapInArrow(_verify, "u binary, v binary, sim double").where(F.col("sim") >= threshold), "links")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _elements(batches):
    for batch in batches:
        found = []
        for text in batch.column(1):
            keys, counts = bag(text.as_py())
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append(mix(np.repeat(keys, counts) + nth.astype(np.uint64) * GOLDEN).view(np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["text_key", "elements"])


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``nodes (text_key, root)`` in different components that may be near.

    The n-th copy of a shingle is an element of its own, so bags are sets. With elements in
    order of rising frequency, near sets share one among their first
    n - ceil(threshold n) + 1, with enough elements left behind it on both sides. A passage that many texts share is frequent, so texts
    with enough of their own do not meet by it.
    """
    bags = stage(texts.join(nodes, "text_key").select("text_key", "text").mapInArrow(_elements, "text_key binary, elements array<long>"), "bags")
    spread = bags.select("text_key", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = spread.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    ranked = spread.join(often, "e", "left").groupBy("text_key", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "e"))).alias("ranked")
    )
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    first = ranked.select("text_key", "n", F.posexplode(F.slice("ranked", F.lit(1), length)).alias("at", "p")).where("p.f > 1")
    left = (F.col("n") - F.col("at")).alias("left")  # elements from this one on
    first = stage(first.join(nodes, "text_key").select("text_key", "n", left, "root", F.col("p.e").alias("e")), "prefixes")
    other = first.select("e", F.col("text_key").alias("v"), F.col("n").alias("m"), F.col("left").alias("v_left"), F.col("root").alias("v_root"))
    # No more than what follows their first shared element can be shared.
    enough = F.least("left", "v_left") >= (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-9
    fits = (F.col("root") != F.col("v_root")) & (F.col("v") < F.col("text_key")) & enough
    return _pairs(first.join(other, "e").where(fits), "text_key", "v")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_key, root, class_id, class_size, n_links)`` of every document.

    ``class_id`` is the least ``doc_id`` of the class. Candidates of a bucket are
    not paired with each other: all are compared with the bucket's hub, the text
    that meets the most others over all its buckets (near copies meet their
    original most often); what is linked is contracted, and only members of still separate components
    are compared further: one text of the bucket at a time for ``HUB_TURNS``
    turns, then all texts that are still apart, by a prefix filter. So every two members of a bucket are in
    one component or were compared, and components are those of all candidate pairs. ``n_links`` counts the
    verified links of the document's text.
    """
    signed = stage(signatures(docs), "signed")
    distinct = signed.groupBy("text_key").agg(F.first("bands").alias("bands"))
    banded = distinct.select("text_key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    in_buckets = stage(banded.join(shared, "band"), "buckets")
    central = in_buckets.groupBy("text_key").agg((-F.sum("n")).alias("place"))
    members = stage(in_buckets.select("band", "text_key").join(central, "text_key").select("band", "text_key", "place"), "members")
    first = F.min(F.struct("place", "text_key"))["text_key"].alias("hub")
    star = members.join(members.groupBy("band").agg(first), "band").where("text_key != hub")
    pairs = stage(_pairs(star, "text_key", "hub"), "pairs")
    wanted = members.select("text_key").distinct()
    texts = stage(
        docs.select(text_key().alias("text_key"), text_or_empty().alias("text"))
        .join(wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text")),
        "texts",
    )
    links = _verified(pairs, texts, threshold)
    roots = connected(links.select("u", "v"))
    # Buckets of two were settled by their only pair.
    open_rows = star
    for turn in range(HUB_TURNS + 1):
        placed = open_rows.join(roots.select(F.col("node").alias("text_key"), "root"), "text_key", "left").select(
            "band", "text_key", "place", F.coalesce("root", "text_key").alias("root")
        )
        split = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), first).where("a != b")
        rows = stage(placed.join(split.select("band", "hub"), "band"), "open")
        if rows.isEmpty():
            break
        if turn < HUB_TURNS:
            own = rows.where("text_key = hub").select("band", F.col("root").alias("hub_root"))
            pairs = _pairs(rows.join(own, "band").where("root != hub_root"), "text_key", "hub")
        else:
            pairs = _prefix_pairs(rows.select("text_key", "root").distinct(), texts, threshold)
        more = _verified(pairs, texts, threshold)
        if not more.isEmpty():
            links = links.union(more)
            roots = connected(links.select("u", "v"))
        open_rows = rows.where("text_key != hub").select("band", "text_key", "place")
    both = links.select(F.col("u").alias("text_key")).union(links.select(F.col("v").alias("text_key")))
    counted = both.groupBy("text_key").agg(F.count("*").alias("n_links"))
    root_of = roots.select(F.col("node").alias("text_key"), "root")
    placed = (
        signed.select("doc_id", "text_key")
        .join(counted.join(root_of, "text_key", "left"), "text_key", "left")
        .select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(least, "root").select("doc_id", "text_key", "root", "class_id", "class_size", "n_links")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns: the least ``doc_id``,
    and for equal ids the least text."""
    classes = stage(near_classes(docs, threshold), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    kept = classes.groupBy("root").agg(F.min(rank).alias("k"), F.max("class_size").alias("n"))
    key, copies, kept_id, kept_key = (free_name(docs, n) for n in ("text_key", "copies", "kept_id", "kept_key"))
    kept = kept.select(F.col("k.doc_id").alias(kept_id), F.col("k.text_key").alias(kept_key), F.col("n").alias(copies))
    keyed = docs.withColumn(key, text_key())
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))).drop(kept_id, kept_key)
    single = joined.where(F.col(copies) == 1)
    rest = joined.where(F.col(copies) > 1).dropDuplicates(["doc_id", key])
    return single.union(rest).drop(key, copies)
