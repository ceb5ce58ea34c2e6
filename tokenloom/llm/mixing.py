"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Sources in code-point order, null last, weigh 5, 2, 1, repeating,
and share ``SHARE`` times all words. A target stops at ``MAX_REPEAT`` times its source's size;
the excess goes to the others by weight until none is above.

Blocks of equal size are given to sources by the highest quotients
target / (2 seats + 1), and a source's blocks to its shards in the same way by shard
size. A shard is a hash slice of a source's documents of about ``SHARD_WORDS`` words, so
a hot source has more shards, not larger ones. In a shard, documents stand in a seeded order
on a circle of words, and its blocks are taken one after another from a seeded start;
more blocks than fit go round again, twice at most.

Cases: a null or empty text has size 0 and nothing is taken; a null source is a source;
null or repeated ids are told apart by a hash of the text, and equal rows take equal
shares of their place by a row number; no words at all give targets of 0; other columns
do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.hashing import free_name, text_or_empty
from tokenloom.session import stage

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEAT = 1.5, 2
SHARD_WORDS = 1_000_000
MAX_BLOCK = 256
SEED = 17
# Sources whose targets may be broadcast to documents (a short row each).
BROADCAST_SOURCES = 10_000

_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    """Words of a text: starts of words, so that none is materialised."""
    return F.regexp_count(text_or_empty(column), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, max_repeat: int = MAX_REPEAT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    With sources sorted by cap over weight, the ones that stop at their cap are a
    prefix; the level of the rest is what remains over the weight that remains.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights)).cast("int"))
    ranked = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest_w"),
    ).withColumn("level", F.greatest(F.lit(0.0), F.col("all_size") * share - F.col("caps")) / F.col("rest_w"))
    # The first source that is not capped at its own level sets the level of all after it.
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))
    fixed = level.withColumn("final", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return fixed.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), "cap").alias("target"))


def apportion(parties: DataFrame, seats: Column, claim: str, within: list[str], name: str) -> DataFrame:
    """Sainte-Lague: ``seats`` (one number for each group ``within``) go to the highest
    quotients claim / (2 s + 1), ties to the first party in the order of ``party``.

    With n parties and fair shares q, an exact result lies within n q / (2 seats) + 1/2 of q,
    so only quotients of that band, about 2 n + 2 in all, are ranked; seats
    below the band are certain.
    """
    group = Window.partitionBy(*within)
    fair = parties.withColumn("_seats", seats.cast("long")).select(
        "*", F.sum(claim).over(group).alias("_all"), F.count("*").over(group).alias("_n"),
        F.sum(F.when(F.col(claim) > 0, 1).otherwise(0)).over(group).alias("_some"),
    ).withColumn("_q", F.when(F.col("_all") > 0, F.col("_seats") * F.col(claim) / F.col("_all")).otherwise(0.0))
    slack = F.ceil(F.col("_n") * F.col("_q") / (2 * F.greatest(F.col("_seats"), F.lit(1)))) + 1
    low = F.greatest(F.lit(0), F.floor(F.col("_q")) - slack).cast("long")
    high = (F.ceil(F.col("_q")) + slack).cast("long")
    banded = fair.withColumn("_low", F.when(F.col(claim) > 0, low).otherwise(F.lit(0))).withColumn("_high", high)
    banded = banded.withColumn("_left", F.col("_seats") - F.sum("_low").over(group))
    quotients = banded.where(F.col(claim) > 0).select(*within, "party", "_left", F.col(claim).alias("_c"), F.explode(F.sequence("_low", "_high")).alias("_s"))
    order = Window.partitionBy(*within).orderBy(F.desc(F.col("_c") / (2 * F.col("_s") + 1)), "party")
    won = quotients.withColumn("_rank", F.row_number().over(order)).where("_rank <= _left").groupBy(*within, "party").agg(F.count("*").alias("_won"))
    return banded.join(won, [*within, "party"], "left").withColumn(
        name, F.when(F.col(claim) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)).cast("long")
    ).drop("_seats", "_all", "_n", "_some", "_q", "_low", "_high", "_left", "_won")


def plan_mix(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, ``source``, ``text_hash``, ``row`` (number among equal rows), ``size``, ``source_size``,
    ``target``, ``taken``, and ``first`` (words before the first taken one), for every document."""
    text_hash = F.xxhash64(text_or_empty())
    measured = stage(docs.select("doc_id", "source", text_hash.alias("text_hash"), word_count().alias("size")), "sizes")
    targets = stage(source_targets(measured), "targets")
    least = targets.where("target > 0").agg(F.min("target"), F.sum("target"), F.count("*")).first()
    if not least[2]:
        return measured.select("doc_id", "source", "text_hash", F.lit(1).alias("row"), "size", F.lit(0).cast("long").alias("source_size"),
                               F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("first"))
    block = max(1, min(MAX_BLOCK, int(least[0] / 256)))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    parties = targets.withColumn("party", number).withColumn("everyone", F.lit(1))
    quotas = apportion(parties, F.lit(int(round(least[1] / block))), "target", ["everyone"], "blocks")
    quotas = stage(quotas.withColumn("shards", F.ceil(F.col("source_size") / shard_words).cast("long")), "quotas")
    keys = quotas.select(F.col("source").alias("_source"), "party", "source_size", "target", "blocks", "shards")
    if quotas.count() <= BROADCAST_SOURCES:
        keys = F.broadcast(keys)
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.greatest("shards", F.lit(1)))
    placed = measured.join(keys, measured["source"].eqNullSafe(keys["_source"])).withColumn("shard", shard).drop("_source")
    cells = placed.groupBy("party", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    cells = cells.withColumnsRenamed({"party": "source_no", "shard": "party"})
    shared = apportion(cells, F.col("blocks"), "shard_size", ["source_no"], "shard_blocks")
    shared = stage(shared.select(F.col("source_no").alias("party"), F.col("party").alias("shard"), "shard_size", "shard_blocks"), "shard_quotas")
    whole = placed.join(shared, ["party", "shard"])
    order = Window.partitionBy("party", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), "doc_id", "text_hash")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("party", "shard", "doc_id", "text_hash").orderBy("size"))
    lined = whole.withColumn("at", before).withColumn("row", row)
    # Words asked of the shard, at most MAX_REPEAT rounds; the circle begins at a seeded word.
    asked = F.least(F.col("shard_blocks") * block, F.col("shard_size") * MAX_REPEAT)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "party", "shard"), F.greatest("shard_size", F.lit(1)))
    placed_at = lined.withColumn("asked", asked).withColumn("at", F.pmod(F.col("at") - start, F.greatest("shard_size", F.lit(1))))
    rounds = F.floor(F.col("asked") / F.greatest("shard_size", F.lit(1)))
    rest = F.col("asked") - rounds * F.col("shard_size")
    # A document that lies across the start of the circle is taken at both of its ends.
    head = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("at")))
    tail = F.least(F.greatest(F.lit(0), F.col("at") + F.col("size") - F.col("shard_size")), rest)
    part = F.least(F.col("size"), head + tail)
    return placed_at.select(
        "doc_id", "source", "text_hash", "row", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"),
        F.when(head > 0, 0).otherwise(F.col("size") - tail).cast("long").alias("first"),
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a whole copy for each full round, and
    a copy cut to the words of a part taken. Untaken documents go. ``n_chars`` follows the text."""
    names = {n: free_name(docs, n) for n in ("text_hash", "row", "taken", "size", "first", "copy")}
    plan = stage(plan_mix(docs, seed).where("taken > 0"), "mix")
    keyed = docs.withColumn(names["text_hash"], F.xxhash64(text_or_empty()))
    same = Window.partitionBy("doc_id", "source", names["text_hash"]).orderBy(F.lit(0))
    repeated = not plan.where("row > 1").isEmpty()
    numbered = keyed.withColumn(names["row"], F.row_number().over(same) if repeated else F.lit(1))
    keys = {k: free_name(docs, f"planned_{k}") for k in ("doc_id", "source", "text_hash", "row")}
    renamed = plan.select(*(F.col(k).alias(v) for k, v in keys.items()), *(F.col(c).alias(names[c]) for c in ("taken", "size", "first")))
    on = reduce(lambda a, b: a & b, (numbered[names.get(k, k)].eqNullSafe(renamed[v]) for k, v in keys.items()))
    taken, size = F.col(names["taken"]), F.col(names["size"])
    copies = numbered.join(renamed, on).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    words = F.least(size, taken - (F.col(names["copy"]) - 1) * size)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)), F.col(names["first"]).cast("int") + 1, words.cast("int")), " ")
    text = F.when(words >= size, F.col("text")).otherwise(cut)
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")
