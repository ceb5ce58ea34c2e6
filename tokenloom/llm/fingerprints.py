"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is a stretch up to the end of a sentence or line, and at most
``MAX_PARAGRAPH`` characters. A fingerprint is a vector of sums of paragraph hashes, each
modulo 2^32, so order does not matter and paragraphs are put in or taken out by adding
or subtracting their vectors:

- lane 0 counts paragraphs;
- ``CHECKS`` lanes sum hashes of every paragraph, for equality, half of them from each of two
  independent 64-bit hashes;
- ``LEVELS`` x ``WIDTH`` lanes sum each paragraph's hash in one lane of one level, level i with
  probability 2^-(i+1) (the last level holds the rest), for likeness: lanes
  that differ tell how many paragraphs two texts do not share. The last level
  holds 2^-23 of the paragraphs, so no text is long enough to fill it.

Cases: a null or empty text has no paragraphs and the fingerprint of zeros; two such
texts have likeness 1; null or repeated ids and repeated rows are put in one total
order by id, text hash and a row number, so each row has one next document; a
single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.hashing import text_or_empty
from tokenloom.session import stage

MAX_PARAGRAPH = 64
CHECKS, LEVELS, WIDTH = 6, 24, 16
# Levels from this one on are looked for among the hashes that belong to them only.
DEEP = 6
LANES = 1 + CHECKS + LEVELS * WIDTH
_MODULUS = 1 << 32
SECOND = 7
# Rows in one part of the order by id.
ORDER_ROWS = 50_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum32(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) % F.lit(_MODULUS)


def fingerprint_lanes(text: Column) -> Column:
    """The fingerprint of a text as an array of longs."""
    paragraphs = F.regexp_extract_all(text, F.lit(r"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % MAX_PARAGRAPH), F.lit(0))
    low = lambda h: h.bitwiseAND(F.lit(_MODULUS - 1))

    def _seeded(seed: int):
        return lambda h: low(F.xxhash64(h, F.lit(seed)))

    def vector(hashes: Column) -> Column:
        count = F.size(hashes).cast("long") % F.lit(_MODULUS)
        # Half of the check lanes come from a hash of its own: a clash of one hash is none of the other.
        own = [F.transform(hashes, _seeded(i)) for i in range(CHECKS // 2)]
        other = F.transform(paragraphs, lambda p: F.xxhash64(F.lit(SECOND), p))
        rest_checks = _let(other, lambda h: F.array(*(_sum32(F.transform(h, _seeded(i))) for i in range(CHECKS // 2, CHECKS))))
        levels = [_level(hashes, level) for level in range(DEEP)]
        rest = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - DEEP) == 0)
        deep = _let(rest, lambda own: F.concat(*(_level(own, level) for level in range(DEEP, LEVELS))))
        return F.concat(F.array(count, *map(_sum32, own)), rest_checks, *levels, deep)

    def _level(hashes: Column, level: int) -> Column:
        # The top 23 bits choose the level, bits 36 to 39 the lane, the low half is summed.
        mask = (1 << (LEVELS - 1)) - 1
        bits = lambda h: F.shiftrightunsigned(h, 64 - LEVELS + 1).bitwiseAND(F.lit(mask))
        if level == LEVELS - 1:
            chosen = F.filter(hashes, lambda h: bits(h) == 0)
        else:
            least = 1 << (LEVELS - 2 - level)
            chosen = F.filter(hashes, lambda h: bits(h).between(least, 2 * least - 1))
        lane = lambda h: F.shiftrightunsigned(h, 36).bitwiseAND(F.lit(WIDTH - 1))
        return _let(chosen, lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.aggregate(
                own, F.lit(0).cast("long"), lambda a, h: F.when(lane(h) == j, (a + low(h)) % F.lit(_MODULUS)).otherwise(a)
            )
        ))

    return _let(F.transform(paragraphs, lambda p: F.xxhash64(p)), vector)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or of ``a`` without ``b`` for sign -1."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(_MODULUS)))


def as_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs in common, 0 to 1, from two fingerprints.

    Each level with a lane left over gives the number of paragraphs that differ,
    -W ln(1 - d / W) for d of W lanes; the first levels hold most paragraphs, so the
    first unsaturated one and those after it are scaled up by their share. At least
    as many differ as the numbers of paragraphs do.
    """
    levels = []
    for level in range(LEVELS):
        begin = 1 + CHECKS + level * WIDTH
        pairs = F.arrays_zip(F.slice(a, begin + 1, WIDTH).alias("x"), F.slice(b, begin + 1, WIDTH).alias("y"))
        levels.append(F.size(F.filter(pairs, lambda p: p["x"] != p["y"])))

    def estimate(d: Column) -> Column:
        found = None
        for first in reversed(range(LEVELS)):
            share = 2.0**-first
            total = sum((-WIDTH * F.log1p(-F.least(F.get(d, F.lit(i)), F.lit(WIDTH - 0.5)) / WIDTH) for i in range(first, LEVELS)), F.lit(0.0)) / share
            found = total if found is None else F.when(F.get(d, F.lit(first)) <= 0.8 * WIDTH, total).otherwise(found)
        return found

    paragraphs = F.get(a, F.lit(0)) + F.get(b, F.lit(0))
    apart = F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0)))
    close = _let(F.array(*levels), lambda d: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.greatest(estimate(d), apart) / paragraphs)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(close, F.lit(0.9999)))


def with_fingerprints(docs: DataFrame, column: str = "lanes") -> DataFrame:
    """All columns of ``docs`` and the lanes of each whole text."""
    return docs.withColumn(column, fingerprint_lanes(text_or_empty()))


def next_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, row)`` of every row with ``next_*`` of the row after it in
    descending order of id (null last; the first one follows the last).

    Ids are cut into ranges; the order runs inside a range, and the first row of the
    next range is joined to a range's last row, so no task sees all ids.
    """
    same = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))
    keys = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.length(text_or_empty()).alias("n"))
    keys = keys.withColumn("row", F.row_number().over(same))
    count = docs.count()
    order = [F.desc_nulls_last("doc_id"), F.asc("text_hash"), F.asc("row")]
    ranged = keys.repartitionByRange(max(1, -(-count // ORDER_ROWS)), *order)
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), "order")
    following = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("row"))
    inside = ranged.withColumn("next", F.lead(following).over(Window.partitionBy("part").orderBy(*order)))
    first = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where("k = 1")
    parts = first.select("part", following.alias("head"))
    everything = Window.orderBy("part")
    wrap = F.first("head").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = parts.select("part", F.coalesce(F.lead("head").over(everything), wrap).alias("after"))
    linked = inside.join(heads, "part").select("doc_id", "text_hash", "row", "n", F.coalesce("next", "after").alias("next"))
    return linked.select("doc_id", "text_hash", "row", "n", *(F.col(f"next.{c}").alias(f"next_{c}") for c in ("id", "hash", "row")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint and that of its edited text, and likenesses to it and to the next document.

    The next document travels as its fingerprint and the prefix that is needed.
    """
    order = stage(next_documents(docs), "next")
    same = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    repeated = not order.where("row > 1").isEmpty()
    texts = texts.withColumn("row", F.row_number().over(same) if repeated else F.lit(1))

    def matched(left: DataFrame, names: tuple[str, str, str]) -> Column:
        return texts["doc_id"].eqNullSafe(left[names[0]]) & (texts["text_hash"] == left[names[1]]) & (texts["row"] == left[names[2]])

    sent = order.join(texts, matched(order, ("next_id", "next_hash", "next_row"))).select(
        order["doc_id"].alias("to_id"), order["text_hash"].alias("to_hash"), order["row"].alias("to_row"), order["n"].alias("n"),
        F.col("text").substr(F.lit(1), F.floor(order["n"] / 3).cast("int")).alias("prefix"), fingerprint_lanes(F.col("text")).alias("next_lanes"),
    )
    joined = texts.join(sent, matched(sent, ("to_id", "to_hash", "to_row")))
    kept = F.col("text").substr(F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    lanes = joined.select(
        "doc_id", "n", "next_lanes", fingerprint_lanes(F.col("text")).alias("lanes"), F.concat(kept, F.col("prefix")).alias("edited"),
    )
    both = lanes.withColumn("edited_lanes", fingerprint_lanes(F.col("edited")))
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
