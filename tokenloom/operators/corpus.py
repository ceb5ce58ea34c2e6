"""Token-budgeted, seeded, disjoint splits cut into bounded shards.

The order of documents is fixed by a seeded key, so a shard is a range of
keys. Finding the ranges needs only (key, token count) pairs; the texts are
then placed map-side by comparing keys, and move once, to their shard.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.ordering import BUCKET_DIGITS, DEFAULT_SEED, with_seeded_key
from tokenloom.operators.prefix import running_total
from tokenloom.session import stage

PROGRESS_STEP_TOKENS = 10_000

# The driver looks at no more than this many (total, key) pairs at a time.
CANDIDATE_ROWS = 500_000
MAX_WINDOWS = 200
# Jobs that look at windows; what is left after them is found by a table of successors.
WINDOW_JOBS = 4
# Ranges of running totals in which successors are found.
SUCCESSOR_CELLS = 4096
# Key ranges are one row per shard and bucket; beyond this they are not broadcast.
BROADCAST_RANGE_ROWS = 1_000_000

AFTER_EVERY_KEY = "~"


def document_problem() -> Column:
    """Why a document cannot be used by itself, or null."""
    count = F.col("metadata.token_count")
    return (
        F.when(F.col("doc_id").isNull(), "missing doc_id")
        .when(F.col("metadata").isNull(), "missing metadata")
        .when(count.isNull(), "missing token_count")
        .when(count < 0, "negative token_count")
    )


def _with_problems(df: DataFrame) -> DataFrame:
    """``df`` with ``problem``, ids that occur more than once included."""
    repeated = df.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    again = F.when(F.col("_n") > 1, "repeated doc_id")
    return df.join(repeated, "doc_id", "left").withColumn("problem", F.coalesce(document_problem(), again)).drop("_n")


def bad_documents(df: DataFrame) -> DataFrame:
    """Documents a build refuses, each with its first problem."""
    return _with_problems(df).where(F.col("problem").isNotNull())


def sound_documents(df: DataFrame) -> DataFrame:
    """The rest of :func:`bad_documents`: what a build takes that sets bad documents aside."""
    return _with_problems(df).where(F.col("problem").isNull()).drop("problem")


def checked_documents(df: DataFrame) -> DataFrame:
    """Strict form of :func:`bad_documents`: the job fails on the first one.

    Repeated ids are found in the stored order, see :func:`store_order`.
    """
    problem = document_problem()
    message = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.lit(": "), problem)
    return df.withColumn("metadata", F.when(problem.isNull(), F.col("metadata")).otherwise(F.raise_error(message)))


def usable_documents(df: DataFrame) -> DataFrame:
    """Documents that count towards a budget."""
    return df.where((F.col("metadata.token_count") > 0) & (F.length("text") > 0))


def _ledger(df: DataFrame, seed: int, digits: int) -> DataFrame:
    narrow = usable_documents(df).select("doc_id", F.col("metadata.token_count").alias("token_count"))
    return with_seeded_key(narrow, seed=seed, digits=digits)


def seeded_order(df: DataFrame, seed: int = DEFAULT_SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Every document with its place (from 1) in the seeded order."""
    keyed = with_seeded_key(df.select("doc_id"), seed=seed, digits=digits)
    return running_total(
        keyed, bucket="bucket", order=["order_key", "doc_id"], value=F.lit(1), name="position"
    ).drop("bucket")


def running_tokens(df: DataFrame, seed: int = DEFAULT_SEED, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Usable documents with the tokens up to and including each of them."""
    return running_total(
        _ledger(df, seed, digits),
        bucket="bucket",
        order=["order_key", "doc_id"],
        value=F.col("token_count"),
        name="cum_tokens",
    )


@dataclass(frozen=True)
class Carry:
    """Where a build stands: the open split and shard and what they hold."""

    split: int = 0
    split_tokens: int = 0
    shard: int = 0
    shard_tokens: int = 0


@dataclass(frozen=True)
class KeyRange:
    """One shard: keys in ``(after_key, last_key]``, totals likewise."""

    split: str
    shard: int
    after_key: str
    last_key: str
    after_total: int
    last_total: int
    closed: bool


@dataclass(frozen=True)
class ShardPlan:
    """Shards of one pass over an order, and the state that follows it."""

    order: DataFrame
    ranges: list[KeyRange]
    carry: Carry
    budgets: Mapping[str, int]

    @property
    def complete(self) -> bool:
        return self.carry.split >= len(self.budgets)

    @property
    def shards(self) -> list[tuple[str, int]]:
        return [(r.split, r.shard) for r in self.ranges]

    def placements(self) -> DataFrame:
        """Narrow rows: document, tokens, split, shard, running total."""
        return place_documents(self.order, self.ranges)


class _Totals:
    """Answers "first running total at or past t" for many ascending t at once."""

    def __init__(self, order: DataFrame):
        self.order = order
        row = order.agg(
            F.max("token_count").alias("largest"), F.max("cum_tokens").alias("total"), F.count("*").alias("n")
        ).first()
        self.largest = row["largest"] or 0
        self.total = row["total"] or 0
        self.rows_per_token = row["n"] / self.total if self.total else 0.0

    def windows(self, base: int, size: int | None, end: int) -> list[tuple[int, int]]:
        """Ranges of totals that must hold the next closing documents.

        Each earlier shard overshoots by less than the largest document, so
        the j-th closing total lies in a range that widens with j.
        """
        slack = self.largest - 1
        found: list[tuple[int, int]] = []
        expected = 0.0
        for j in range(1, MAX_WINDOWS + 1):
            low = end if size is None else min(base + j * size, end)
            high = (end if size is None else min(base + j * size + (j - 1) * slack, end)) + slack
            expected += (high - low + 1) * self.rows_per_token
            if found and expected > CANDIDATE_ROWS / 2:
                break
            found.append((low, high))
            if low >= end or low > self.total:
                break
        return found

    def fetch(self, windows: Sequence[tuple[int, int]]) -> list[tuple[int, str]] | None:
        """(total, key) pairs inside the windows, or None when there are too many."""
        inside = F.lit(False)
        for low, high in _merged(windows):
            inside = inside | F.col("cum_tokens").between(low, high)
        rows = self.order.where(inside).select("cum_tokens", "order_key").limit(CANDIDATE_ROWS + 1).collect()
        if len(rows) > CANDIDATE_ROWS:
            return None
        return sorted((r["cum_tokens"], r["order_key"]) for r in rows)

    def first(self, target: int) -> list[tuple[int, str]]:
        """The one pair that closes a shard at ``target``, found by Spark."""
        row = self.order.where(F.col("cum_tokens") >= target).agg(
            F.min(F.struct("cum_tokens", "order_key")).alias("hit")
        ).first()
        return [tuple(row["hit"])] if row["hit"] else []


    def successors(self, size: int) -> DataFrame:
        """``(at, next)``: for a shard that closes at total ``at``, the total at which the one after it closes.

        Totals and the totals at which the next shard is full meet in ranges of totals, in
        falling order: the last document seen is the first one at or past a total.
        """
        width = max(1, -(-self.total // SUCCESSOR_CELLS))
        cell = F.floor(F.col("value") / width).cast("long")
        sums = self.order.select(F.col("cum_tokens").alias("value"))
        rows = sums.select("value", F.col("value").alias("document"), F.lit(None).cast("long").alias("at")).union(
            sums.select(F.col("value") + size, F.lit(None).cast("long"), F.col("value"))
        )
        cells = sums.groupBy(cell.alias("cell")).agg(F.min("value").alias("first"))
        firsts = {r["cell"]: r["first"] for r in cells.collect()}
        # For every range, at most 2 * SUCCESSOR_CELLS of them, the first document of the later ones.
        after, behind = [], None
        for number in range(int((self.total + min(size, self.total)) // width), -1, -1):
            after.append(behind)
            behind = firsts.get(number, behind)
        table = pa.table({"cell": pa.array(range(len(after)), pa.int64()), "after": pa.array(after[::-1], pa.int64())})
        falling = Window.partitionBy("cell").orderBy(F.desc("value"), F.col("document").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumn("cell", cell).withColumn("here", F.min("document").over(falling)).where(F.col("at").isNotNull())
        bounds = self.order.sparkSession.createDataFrame(table)
        joined = found.join(F.broadcast(bounds), "cell", "left")
        return joined.select("at", F.coalesce("here", "after").alias("next")).where(F.col("next").isNotNull())

    def closings(self, size: int, starts: Sequence[int], last: int) -> list[tuple[int, str]]:
        """(total, key) of every shard end that follows from the first ones ``starts``, up to ``last``.

        Round k knows the first 2^k shards of each chain and a table that leads 2^k shards on; so the rounds grow
        with the logarithm of the number of shards, whatever the documents.
        """
        spark = self.order.sparkSession
        leap = stage(self.successors(size).where(F.col("next") <= last), "successors")
        reached = set(starts)
        while True:
            known = spark.createDataFrame(pa.table({"at": pa.array(sorted(reached), pa.int64())}))
            few = F.broadcast(known) if len(reached) <= BROADCAST_RANGE_ROWS else known
            new = {r["next"] for r in leap.join(few, "at").select("next").collect()} - reached
            if not new:
                break
            reached |= new
            onward = leap.select(F.col("at").alias("next"), F.col("next").alias("then"))
            leap = stage(leap.join(onward, "next").select("at", F.col("then").alias("next")), "successors")
        ends = spark.createDataFrame(pa.table({"cum_tokens": pa.array(sorted(reached), pa.int64())}))
        few = F.broadcast(ends) if len(reached) <= BROADCAST_RANGE_ROWS else ends
        return sorted((r["cum_tokens"], r["order_key"]) for r in self.order.join(few, "cum_tokens").select("cum_tokens", "order_key").collect())


def _merged(windows: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(windows):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def find_ranges(
    order: DataFrame, budgets: Mapping[str, int], tokens_per_shard: int | None, carry: Carry = Carry()
) -> ShardPlan:
    """Close shards greedily along ``order`` (the output of store_order).

    A shard closes with the first document that brings it to
    ``tokens_per_shard`` or its split to its budget; the next one starts from
    zero. The driver holds one range per shard and looks up many closing
    documents per job, over windows that are certain to contain them. Where a few such jobs do
    not suffice, as with documents larger than shards, a table of successors gives the rest.
    """
    totals = _Totals(order)
    names = list(budgets)
    ranges: list[KeyRange] = []
    split, shard = carry.split, carry.shard
    after_key, after_total = "", 0
    split_base, shard_base = -carry.split_tokens, -carry.shard_tokens
    looked, known = 0, None
    while split < len(names):
        end = split_base + budgets[names[split]]
        target = end if tokens_per_shard is None else min(shard_base + tokens_per_shard, end)
        if target > totals.total:
            break
        if known is None and looked >= WINDOW_JOBS and tokens_per_shard is not None:
            known = _chained(totals, [budgets[n] for n in names[split:]], tokens_per_shard, shard_base, split_base)
        windows = totals.windows(shard_base, tokens_per_shard, end) if known is None else []
        pairs = totals.fetch(windows) if known is None else known
        while pairs is None and len(windows) > 1 and (looked := looked + 1) < WINDOW_JOBS:
            windows = windows[: len(windows) // 2]
            pairs = totals.fetch(windows)
        if pairs is None:
            pairs, windows = totals.first(target), windows[:1]
        looked += 1
        sums = [p[0] for p in pairs]
        for _ in windows or range(len(pairs)):
            target = end if tokens_per_shard is None else min(shard_base + tokens_per_shard, end)
            at = bisect_left(sums, target)
            if at == len(pairs):
                break
            last_total, last_key = pairs[at]
            ranges.append(KeyRange(names[split], shard, after_key, last_key, after_total, last_total, True))
            after_key, after_total, shard_base, shard = last_key, last_total, last_total, shard + 1
            if last_total >= end:
                split, shard, split_base = split + 1, 0, last_total
                break
    if split < len(names) and totals.total > after_total:
        ranges.append(KeyRange(names[split], shard, after_key, AFTER_EVERY_KEY, after_total, totals.total, False))
    left = Carry(split, totals.total - split_base, shard, totals.total - shard_base) if split < len(names) else Carry(split)
    return ShardPlan(order, ranges, left, budgets)


def _chained(totals: _Totals, wanted: Sequence[int], size: int, shard_base: int, split_base: int) -> list[tuple[int, str]]:
    """All shard ends from ``shard_base`` on. The ends of splits follow from the budgets alone, and each split begins a chain."""
    ends, starts, base = [], [], split_base
    for budget in wanted:
        first = totals.first(min((shard_base if not ends else base) + size, base + budget))
        starts += [total for total, _ in first]
        end = totals.first(base + budget)
        if not end:
            break
        ends += end
        base = end[0][0]
    last = ends[-1][0] if len(ends) == len(wanted) else totals.total
    return sorted({*totals.closings(size, starts, last), *ends})


def store_order(df: DataFrame, seed: int = DEFAULT_SEED, digits: int = BUCKET_DIGITS, strict: bool = True) -> DataFrame:
    """running_tokens as a stored table, sorted so that a range of totals is
    found by the statistics of its row groups.

    A bad document stops the build here; without ``strict`` bad ones are set
    aside, see :func:`bad_documents` (then place :func:`sound_documents`). With
    ids present and unique, ranges of keys hold exactly what was planned.
    """
    taken = checked_documents(df) if strict else sound_documents(df)
    order = stage(running_tokens(taken, seed, digits).sortWithinPartitions("cum_tokens"), "order")
    again = order.groupBy("order_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").take(1)
    if again:
        raise ValueError(f"document {again[0]['doc_id']}: repeated doc_id")
    return order


def plan_shards(
    df: DataFrame,
    budgets: Mapping[str, int],
    tokens_per_shard: int | None,
    seed: int = DEFAULT_SEED,
    digits: int = BUCKET_DIGITS,
    strict: bool = True,
) -> ShardPlan:
    """Store the narrow order once, then find the shard ranges in it."""
    return find_ranges(store_order(df, seed, digits, strict), budgets, tokens_per_shard)


def _range_table(df: DataFrame, ranges: Sequence[KeyRange], digits: int) -> DataFrame:
    """One row per (bucket, range) pair that can meet."""
    columns: dict[str, list] = {"bucket": [], "after_key": [], "last_key": [], "split": [], "shard": []}
    for r in ranges:
        first = int(r.after_key[:digits] or "0", 16)
        last = 16**digits - 1 if r.last_key == AFTER_EVERY_KEY else int(r.last_key[:digits], 16)
        for bucket in range(first, last + 1):
            for name, item in zip(columns, (f"{bucket:0{digits}x}", r.after_key, r.last_key, r.split, r.shard)):
                columns[name].append(item)
    table = pa.table({
        "bucket": pa.array(columns["bucket"], pa.string()),
        "after_key": pa.array(columns["after_key"], pa.string()),
        "last_key": pa.array(columns["last_key"], pa.string()),
        "split": pa.array(columns["split"], pa.string()),
        "shard": pa.array(columns["shard"], pa.int32()),
    })
    ranges_df = df.sparkSession.createDataFrame(table)
    return F.broadcast(ranges_df) if table.num_rows <= BROADCAST_RANGE_ROWS else ranges_df


def place_documents(keyed: DataFrame, ranges: Sequence[KeyRange], digits: int = BUCKET_DIGITS) -> DataFrame:
    """Give each keyed document its split and shard; unused ones are dropped.

    Works on any DataFrame with ``order_key`` and ``bucket``, wide ones too:
    the ranges are small, so documents stay where they are.
    """
    table = _range_table(keyed, ranges, digits)
    inside = (F.col("order_key") > F.col("after_key")) & (F.col("order_key") <= F.col("last_key"))
    return keyed.join(table, "bucket").where(inside).drop("after_key", "last_key")


def split_by_budget(
    df: DataFrame, train_tokens: int, validation_tokens: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Train takes documents until its budget is reached, validation goes on."""
    budgets = {"train": train_tokens, "validation": validation_tokens}
    plan = plan_shards(df, budgets, None, seed)
    return plan.placements().drop("shard", "bucket")


def assign_shards(df: DataFrame, budgets: Mapping[str, int], tokens_per_shard: int, seed: int = DEFAULT_SEED) -> DataFrame:
    return plan_shards(df, budgets, tokens_per_shard, seed).placements()


def sharded_documents(df: DataFrame, plan: ShardPlan, seed: int = DEFAULT_SEED) -> DataFrame:
    """Whole documents with split and shard, ready for the shard sink."""
    return place_documents(with_seeded_key(usable_documents(df), seed=seed), plan.ranges)


def budget_shortfall(order: DataFrame, budgets: Mapping[str, int], strict: bool = False) -> DataFrame:
    """The split the documents ran out in, if any: what it got and wanted.

    ``order`` is the output of store_order.
    """
    plan = find_ranges(order, budgets, None)
    rows = []
    if not plan.complete:
        name = list(budgets)[plan.carry.split]
        rows.append((name, plan.carry.split_tokens, budgets[name]))
        if strict:
            raise ValueError(f"split {name!r} needs {rows[0][2]} tokens but got {rows[0][1]}")
    return order.sparkSession.createDataFrame(rows, "split string, got_tokens long, wanted_tokens long")


def corpus_manifest(placements: DataFrame, budgets: Mapping[str, int]) -> DataFrame:
    """Tokens, documents and shards per split, and over both."""
    by_shard = placements.groupBy("split", "shard").agg(
        F.sum("token_count").alias("tokens"), F.count("*").alias("documents")
    )
    totals = by_shard.rollup("split").agg(
        F.sum("tokens").alias("actual_tokens"),
        F.sum("documents").alias("documents"),
        F.count("*").alias("parquet_shards"),
    )
    target = F.lit(None).cast("long")
    for name, wanted in budgets.items():
        target = F.when(F.col("split") == name, F.lit(wanted).cast("long")).otherwise(target)
    overall = F.lit(next(iter(budgets.values()))).cast("long")
    return totals.select(
        F.coalesce("split", F.lit("total")).alias("split"),
        F.when(F.col("split").isNull(), overall).otherwise(target).alias("target_tokens"),
        "actual_tokens",
        "documents",
        "parquet_shards",
    )


def audit_shards(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Compare recorded and stored shard counts of many corpus folders.

    ``manifests``: folder, readable, parquet_shards (null when not recorded).
    ``files``: folder, path.
    """
    stored = files.groupBy("folder").agg(F.count("*").alias("stored_shards"))
    both = manifests.withColumn("has_manifest", F.lit(True)).join(stored, "folder", "full_outer")
    status = (
        F.when(F.col("has_manifest").isNull() | F.col("stored_shards").isNull(), "incomplete")
        .when(~F.col("readable"), "unreadable manifest")
        .when(F.col("parquet_shards") != F.col("stored_shards"), "shard count differs")
        .otherwise("complete")
    )
    return both.select(
        "folder",
        F.col("parquet_shards").alias("recorded_shards"),
        F.coalesce("stored_shards", F.lit(0)).cast("long").alias("stored_shards"),
        status.alias("status"),
    )


def split_overlap(placed: DataFrame) -> DataFrame:
    """Document ids and texts present in both splits.

    ``placed`` has doc_id, text and split. Ids must give no rows; equal texts
    under different ids may.
    """
    kinds = F.explode(F.create_map(
        F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("text"), F.md5(F.col("text"))
    )).alias("kind", "key")
    counts = placed.select("split", kinds).groupBy("kind", "key").agg(
        F.count_if(F.col("split") == "train").alias("train_documents"),
        F.count_if(F.col("split") == "validation").alias("validation_documents"),
    )
    return counts.where((F.col("train_documents") > 0) & (F.col("validation_documents") > 0))


def corpus_progress(plan: ShardPlan, step: int = PROGRESS_STEP_TOKENS) -> DataFrame:
    """The document at which each whole step of progress is first shown.

    Progress counts tokens towards the budgets of all splits, each capped at
    its own target; the end shows the exact total.
    """
    names = list(plan.budgets)
    starts = {r.split: r.after_total for r in reversed(plan.ranges)}
    progress = F.lit(None).cast("long")
    before = 0
    for name in names:
        if name in starts:
            inside = F.least(F.col("cum_tokens") - starts[name], F.lit(plan.budgets[name]))
            progress = F.when(F.col("split") == name, inside + before).otherwise(progress)
        before += plan.budgets[name]
    whole = (F.floor(F.col("progress") / step) * step).cast("long")
    shown = F.when(F.col("progress") == before, F.lit(before).cast("long")).otherwise(whole)
    return (
        plan.placements()
        .withColumn("progress", progress)
        .select("doc_id", "split", "cum_tokens", shown.alias("progress_tokens"))
        .where(F.col("progress_tokens") > 0)
        .groupBy("progress_tokens")
        .agg(F.min_by(F.struct("doc_id", "split"), "cum_tokens").alias("at"))
        .select("progress_tokens", "at.doc_id", "at.split")
    )
