"""Corpus, token and pack queries over ``documents`` and ``conversations``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import corpus as C
from tokenloom.operators import packing as K
from tokenloom.operators import tokens as T
from tokenloom.plans import adapters as A
from tokenloom.session import stage, stage_root
from tokenloom.sources import corpus_files as IO

VOCAB_SIZE = 2000
SEQ_LEN = 128
BATCH = 16


def digest(ids: str | Column) -> Column:
    """One string for a whole list of ids."""
    column = F.col(ids) if isinstance(ids, str) else ids
    return F.md5(F.array_join(column.cast("array<string>"), " "))


def _plan(spark: SparkSession, sf: str) -> C.ShardPlan:
    """The shard plan, from one pass over the texts: budgets are shares of the
    total, which the stored order already holds."""
    order = C.store_order(A.corpus(spark, sf))
    total = order.agg(F.max("cum_tokens")).first()[0]
    budgets = {"train": total * 7 // 10, "validation": total // 10}
    return C.find_ranges(order, budgets, total // 20)


def _sharded(spark: SparkSession, sf: str) -> DataFrame:
    return C.sharded_documents(A.corpus(spark, sf), _plan(spark, sf))


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return stage(T.build_vocab(A.documents(spark, sf), VOCAB_SIZE), "vocab")


def _encoder(spark: SparkSession, sf: str) -> T.Encoder:
    return T.vocab_encoder(_vocab(spark, sf))


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["doc_id", "text", "order_key", "bucket", "split", "shard"]
    return stage(T.encode_documents(_sharded(spark, sf).select(*columns), _encoder(spark, sf)), "tokens")


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return K.cut_packs(T.bos_offsets(_encoded(spark, sf)), SEQ_LEN)


def _numbered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Packs, and how many each shard has."""
    encoded = _encoded(spark, sf)
    return K.pack_documents(encoded, SEQ_LEN, T.BOS_ID), K.shard_packs(encoded, SEQ_LEN)


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).placements().select("split", "shard").distinct()


# ---- corpus ---------------------------------------------------------------

def read_corpus(spark, sf):
    docs = IO.read_corpus(spark, f"{sf}/documents.parquet", A.table(spark, sf, "documents").schema)
    return docs.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def read_split(spark, sf):
    path = f"{stage_root(spark)}/tokenloom/corpus-{uuid.uuid4().hex}"
    plan = _plan(spark, sf)
    docs = C.sharded_documents(A.corpus(spark, sf), plan).drop("lang", "source")
    IO.write_shards(docs, path, plan.shards)
    return IO.read_split(spark, path, "train", limit=300).select("doc_id", "shard", F.md5("text").alias("text_md5"))


def bad_documents(spark, sf):
    return C.bad_documents(A.bad_corpus(spark, sf)).select("doc_id", "problem")


def usable_documents(spark, sf):
    usable = C.usable_documents(A.bad_corpus(spark, sf))
    return usable.select("doc_id", F.col("metadata.token_count").alias("token_count"))


def seeded_order(spark, sf):
    return C.seeded_order(A.table(spark, sf, "documents"))


def running_tokens(spark, sf):
    return C.running_tokens(A.corpus(spark, sf)).select("doc_id", "token_count", "cum_tokens")


def split_by_budget(spark, sf):
    order = C.store_order(A.corpus(spark, sf))
    total = order.agg(F.max("cum_tokens")).first()[0]
    plan = C.find_ranges(order, {"train": total * 7 // 10, "validation": total // 10}, None)
    return plan.placements().select("doc_id", "token_count", "cum_tokens", "split")


def sound_build(spark, sf):
    """A build over a damaged corpus that sets its bad documents aside."""
    order = C.store_order(A.bad_corpus(spark, sf), strict=False)
    total = order.agg(F.max("cum_tokens")).first()[0]
    plan = C.find_ranges(order, {"train": total * 7 // 10, "validation": total // 10}, None)
    return plan.placements().select("doc_id", "token_count", "cum_tokens", "split")


def assign_shards(spark, sf):
    return _plan(spark, sf).placements().select("doc_id", "token_count", "split", "shard")


def budget_shortfall(spark, sf):
    order = C.store_order(A.corpus(spark, sf))
    total = order.agg(F.max("cum_tokens")).first()[0]
    return C.budget_shortfall(order, {"train": total * 7 // 10, "validation": 4 * (total // 10)})


def corpus_manifest(spark, sf):
    plan = _plan(spark, sf)
    return C.corpus_manifest(plan.placements(), plan.budgets)


def audit_shards(spark, sf):
    user = F.col("user_id")
    events = A.table(spark, sf, "events")
    expected = F.when(F.col("folder") % 5 == 0, None).when(F.col("folder") % 11 == 0, 3).otherwise(5).cast("long")
    moved = lambda n: F.when(user % n == 0, user + 1_000_000).otherwise(user)
    folders = events.select(moved(7).alias("folder")).distinct()
    manifests = folders.select("folder", (F.col("folder") % 13 != 0).alias("readable"), expected.alias("parquet_shards"))
    files = events.select(moved(17).alias("folder"), F.col("event_type").alias("path")).distinct()
    return C.audit_shards(manifests, files)


def split_overlap(spark, sf):
    return C.split_overlap(_sharded(spark, sf).select("doc_id", "text", "split"))


def corpus_progress(spark, sf):
    return C.corpus_progress(_plan(spark, sf))


# ---- tokens ---------------------------------------------------------------

def build_vocab(spark, sf):
    return T.build_vocab(A.documents(spark, sf), VOCAB_SIZE)


def encode_documents(spark, sf):
    docs = A.documents(spark, sf).select("doc_id", "text")
    encoded = T.encode_documents(docs, _encoder(spark, sf))
    return encoded.select("doc_id", "n_tokens", digest("tokens").alias("tokens_md5"))


def encode_documents_joined(spark, sf):
    """As encode_documents, with a vocabulary that is taken to be too large to broadcast."""
    docs = A.documents(spark, sf).select("doc_id", "text")
    encoded = T.encode_documents(docs, T.vocab_encoder(_vocab(spark, sf), broadcast_terms=0))
    return encoded.select("doc_id", "n_tokens", digest("tokens").alias("tokens_md5"))


def encode_bytes(spark, sf):
    docs = A.documents(spark, sf).select("doc_id", "text")
    encoded = T.encode_documents(docs, T.byte_encoder())
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"),
        F.element_at("tokens", -1).alias("last_id"),
    )


def token_width(spark, sf):
    return T.token_width(_vocab(spark, sf))


def bos_offsets(spark, sf):
    starts = T.bos_offsets(_encoded(spark, sf))
    return starts.select("doc_id", "split", "shard", F.col("start").alias("start_token"))


def shard_headers(spark, sf):
    encoder = _encoder(spark, sf)
    docs = _sharded(spark, sf).select("doc_id", "text", "split", "shard")
    return T.shard_headers(T.encode_documents(docs, encoder), encoder.max_id)


def tokenization_manifest(spark, sf):
    encoder = _encoder(spark, sf)
    docs = _sharded(spark, sf).select("doc_id", "text", "split", "shard")
    return T.tokenization_manifest(T.encode_documents(docs, encoder), encoder)


def document_samples(spark, sf):
    turns = A.turns(spark, sf)
    encoder = T.vocab_encoder(stage(T.build_vocab(turns, VOCAB_SIZE), "vocab"))
    samples = T.document_samples(turns.select("doc_id", "text"), encoder, 64, padding=True, truncation=True)
    return samples.select(
        "doc_id",
        digest("input_ids").alias("input_ids"),
        digest("labels").alias("labels"),
        digest("attention_mask").alias("attention_mask"),
    )


# ---- packs ----------------------------------------------------------------

def cut_packs(spark, sf):
    return _windows(spark, sf).select(
        "split", "shard", "pack", F.element_at("window", -1).alias("look_ahead"), digest("window").alias("window_md5")
    )


def shift_labels(spark, sf):
    return K.shift_labels(_windows(spark, sf), SEQ_LEN).select(
        "split", "shard", "pack", digest("input_ids").alias("input_ids"), digest("labels").alias("labels")
    )


def segment_ids(spark, sf):
    packs = K.segment_ids(K.shift_labels(_windows(spark, sf), SEQ_LEN), T.BOS_ID)
    return packs.select(
        "split", "shard", "pack", F.array_max("attention_mask").alias("segments"), digest("attention_mask").alias("segment_ids")
    )


def position_ids(spark, sf):
    packs = K.position_ids(K.shift_labels(_windows(spark, sf), SEQ_LEN), T.BOS_ID)
    return packs.select("split", "shard", "pack", digest("position_ids").alias("position_ids"))


def mask_boundary_labels(spark, sf):
    packs = K.mask_boundary_labels(K.shift_labels(_windows(spark, sf), SEQ_LEN), T.BOS_ID)
    return packs.select("split", "shard", "pack", digest("labels").alias("labels"))


def pack_with_ends(spark, sf):
    """Packs of documents that begin with one marker and end with another: segments, positions and masked labels."""
    encoded = _encoded(spark, sf)
    ended = encoded.withColumn("tokens", F.concat("tokens", F.array(F.lit(T.EOS_ID)))).withColumn("n_tokens", F.col("n_tokens") + 1)
    packs = K.pack_documents(ended, SEQ_LEN, T.BOS_ID, T.EOS_ID)
    return packs.select(
        "split", "shard", "pack", digest("attention_mask").alias("segment_ids"), digest("position_ids").alias("position_ids"),
        digest("labels").alias("labels"),
    )


def cap_packs(spark, sf):
    """The first packs of each split along its shuffled shards."""
    encoded = _encoded(spark, sf)
    order = K.order_shards(encoded, shuffle=True)
    return K.first_packs(encoded, SEQ_LEN, 500, T.BOS_ID, shard_order=order).select(
        "split", "shard", "pack", "pack_number", digest("input_ids").alias("input_ids")
    )


def order_shards(spark, sf):
    return K.order_shards(_shards(spark, sf), shuffle=True)


def batch_packs(spark, sf):
    batches = K.batch_packs(*_numbered(spark, sf), BATCH)
    return batches.select(
        "split",
        "batch",
        F.size("input_ids").alias("packs"),
        digest(F.flatten("input_ids")).alias("input_ids"),
        digest(F.flatten("packed_seq_ids")).alias("packed_seq_ids"),
    )


def pack_stats(spark, sf):
    encoded = _encoded(spark, sf)
    return K.pack_stats(K.pack_documents(encoded, SEQ_LEN, T.BOS_ID), encoded, SEQ_LEN)


QUERIES = {f.__name__: f for f in (
    read_corpus, read_split, bad_documents, usable_documents, seeded_order, running_tokens, split_by_budget, sound_build,
    assign_shards, budget_shortfall, corpus_manifest, audit_shards, split_overlap, corpus_progress,
    build_vocab, encode_documents, encode_documents_joined, encode_bytes, token_width, bos_offsets, shard_headers, tokenization_manifest,
    document_samples, cut_packs, shift_labels, segment_ids, position_ids, mask_boundary_labels, pack_with_ends, cap_packs,
    order_shards, batch_packs, pack_stats,
)}


# ---- the same results in SQL ----------------------------------------------

ORDERED = A.CORPUS_SQL + """,
ordered AS MATERIALIZED (
  SELECT doc_id, text, token_count, md5('42:' || doc_id) AS order_key,
         CAST(sum(token_count) OVER (ORDER BY md5('42:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
  FROM corpus WHERE token_count > 0 AND length(text) > 0),
budget AS (
  SELECT CAST(sum(token_count) AS BIGINT) * 7 // 10 AS train, CAST(sum(token_count) AS BIGINT) // 10 AS validation,
         CAST(sum(token_count) AS BIGINT) // 20 AS per_shard
  FROM corpus)"""

PLACED = ORDERED + """,
closings AS (
  SELECT 0 AS split_no, 0 AS shard, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS after_total, min(cum_tokens) AS last_total
  FROM ordered, budget WHERE cum_tokens >= least(per_shard, train)
  UNION ALL
  SELECT n.split_no, n.shard, n.base, n.after_total, min(o.cum_tokens)
  FROM (
    SELECT CASE WHEN ended THEN split_no + 1 ELSE split_no END AS split_no,
           CASE WHEN ended THEN 0 ELSE shard + 1 END AS shard,
           CASE WHEN ended THEN last_total ELSE base END AS base,
           last_total AS after_total
    FROM (SELECT c.*, last_total - base >= CASE split_no WHEN 0 THEN train ELSE validation END AS ended
          FROM closings c, budget)
  ) n, budget b, ordered o
  WHERE n.split_no < 2
    AND o.cum_tokens >= least(n.after_total + b.per_shard,
                              n.base + CASE n.split_no WHEN 0 THEN b.train ELSE b.validation END)
  GROUP BY ALL),
placed AS MATERIALIZED (
  SELECT o.*, CASE c.split_no WHEN 0 THEN 'train' ELSE 'validation' END AS split, c.shard, c.base
  FROM ordered o JOIN closings c ON o.cum_tokens > c.after_total AND o.cum_tokens <= c.last_total)"""


def _vocab_sql(source: str) -> str:
    return rf"""
vocab AS MATERIALIZED (
  SELECT term, n, CAST(2 + row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS id FROM (
    SELECT term, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(text, '[^ \n\t\r]+', 0)) AS term FROM {source})
    GROUP BY term ORDER BY n DESC, term LIMIT {VOCAB_SIZE}))"""


def _ids_sql(source: str, name: str) -> str:
    """(doc_id, place from 1, id) for every word."""
    return rf"""
{name} AS MATERIALIZED (
  SELECT doc_id, place, coalesce(v.id, 2) AS id
  FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS place
        FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n\t\r]+', 0) AS w FROM {source}))
  LEFT JOIN vocab v USING (term))"""


VOCAB = A.CORPUS_SQL + "," + _vocab_sql("corpus")
STREAM = PLACED + "," + _vocab_sql("corpus") + "," + _ids_sql("placed", "word_ids") + """,
stream AS MATERIALIZED (
  SELECT doc_id, split, shard, place, id,
         row_number() OVER (PARTITION BY split, shard ORDER BY order_key, doc_id, place) - 1 AS spot
  FROM (SELECT doc_id, place, id FROM word_ids UNION ALL SELECT doc_id, 0, 0 FROM placed)
  JOIN (SELECT doc_id, split, shard, order_key FROM placed) USING (doc_id))"""
CELLS = STREAM + f""",
fed AS (
  SELECT split, shard, spot // {SEQ_LEN} AS pack, spot % {SEQ_LEN} AS i, id FROM stream
  UNION ALL
  SELECT split, shard, spot // {SEQ_LEN} - 1, {SEQ_LEN}, id FROM stream WHERE spot % {SEQ_LEN} = 0 AND spot > 0),
cells AS MATERIALIZED (
  SELECT * FROM fed QUALIFY count(*) OVER (PARTITION BY split, shard, pack) = {SEQ_LEN} + 1),
inputs AS MATERIALIZED (
  SELECT *, 1 + sum(CASE WHEN i > 0 AND id = 0 THEN 1 ELSE 0 END) OVER w AS segment,
         i - max(CASE WHEN i = 0 OR id = 0 THEN i ELSE 0 END) OVER w AS position
  FROM cells WHERE i < {SEQ_LEN} WINDOW w AS (PARTITION BY split, shard, pack ORDER BY i)),
numbered AS (
  SELECT split, shard, pack, row_number() OVER (PARTITION BY split ORDER BY shard, pack) - 1 AS pack_number
  FROM (SELECT DISTINCT split, shard, pack FROM cells))"""


def _joined(value: str, order: str) -> str:
    return f"md5(string_agg(CAST({value} AS VARCHAR), ' ' ORDER BY {order}))"


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


_PER_PACK = "GROUP BY split, shard, pack"

_ENCODED = _with(VOCAB + "," + _ids_sql("corpus", "word_ids"), f"""
        SELECT doc_id, count(*) AS n_tokens, {_joined("id", "place")} AS tokens_md5
        FROM (SELECT * FROM word_ids UNION ALL SELECT doc_id, 0, 0 FROM corpus) GROUP BY doc_id""")

ORACLES = {
    "read_corpus": "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents",
    "read_split": _with(PLACED, """
        SELECT doc_id, shard, md5(text) AS text_md5 FROM placed WHERE split = 'train'
        QUALIFY row_number() OVER (ORDER BY shard, order_key) <= 300"""),
    "bad_documents": _with(A.BAD_CORPUS_SQL, """
        SELECT doc_id, problem FROM (
          SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'missing doc_id' WHEN NOT has_metadata THEN 'missing metadata'
                              WHEN token_count IS NULL THEN 'missing token_count' WHEN token_count < 0 THEN 'negative token_count'
                              WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'repeated doc_id' END AS problem
          FROM bad_corpus) WHERE problem IS NOT NULL"""),
    "sound_build": _with(A.BAD_CORPUS_SQL, """,
        sound AS (SELECT doc_id, token_count FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM bad_corpus)
                  WHERE doc_id IS NOT NULL AND n = 1 AND token_count > 0 AND length(text) > 0),
        ordered AS (SELECT *, CAST(sum(token_count) OVER (ORDER BY md5('42:' || doc_id) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
                    FROM sound),
        budget AS (SELECT max(cum_tokens) * 7 // 10 AS train, max(cum_tokens) // 10 AS validation FROM ordered),
        base AS (SELECT min(cum_tokens) AS base FROM ordered, budget WHERE cum_tokens >= train)
        SELECT doc_id, token_count, cum_tokens,
               CASE WHEN cum_tokens - token_count < train THEN 'train' ELSE 'validation' END AS split
        FROM ordered, budget, base
        WHERE cum_tokens - token_count < train OR cum_tokens - token_count - base < validation""".lstrip()),
    "usable_documents": _with(A.BAD_CORPUS_SQL, """
        SELECT doc_id, token_count FROM bad_corpus WHERE token_count > 0 AND length(text) > 0"""),
    "seeded_order": """
        SELECT doc_id, md5('42:' || doc_id) AS order_key, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position
        FROM documents""",
    "running_tokens": _with(ORDERED, "SELECT doc_id, token_count, cum_tokens FROM ordered"),
    "split_by_budget": _with(ORDERED, """,
        base AS (SELECT min(cum_tokens) AS base FROM ordered, budget WHERE cum_tokens >= train)
        SELECT doc_id, token_count, cum_tokens,
               CASE WHEN cum_tokens - token_count < train THEN 'train' ELSE 'validation' END AS split
        FROM ordered, budget, base
        WHERE cum_tokens - token_count < train OR cum_tokens - token_count - base < validation""".lstrip()),
    "assign_shards": _with(PLACED, "SELECT doc_id, token_count, split, shard FROM placed"),
    "budget_shortfall": _with(ORDERED, """,
        base AS (SELECT min(cum_tokens) AS base, (SELECT max(cum_tokens) FROM ordered) AS total
                 FROM ordered, budget WHERE cum_tokens >= train)
        SELECT 'validation' AS split, total - base AS got_tokens, 4 * validation AS wanted_tokens
        FROM base, budget WHERE total - base < 4 * validation"""),
    "corpus_manifest": _with(PLACED, """
        SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split,
               CASE WHEN split = 'validation' THEN any_value(validation) ELSE any_value(train) END AS target_tokens,
               CAST(sum(token_count) AS BIGINT) AS actual_tokens, count(*) AS documents,
               count(DISTINCT split || shard) AS parquet_shards
        FROM placed, budget GROUP BY ROLLUP (split)"""),
    "audit_shards": """
        WITH manifests AS (
          SELECT user_id AS folder, user_id % 13 <> 0 AS readable,
                 CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 11 = 0 THEN 3 ELSE 5 END AS recorded
          FROM (SELECT DISTINCT CASE WHEN user_id % 7 = 0 THEN user_id + 1000000 ELSE user_id END AS user_id FROM events)),
        files AS (SELECT CASE WHEN user_id % 17 = 0 THEN user_id + 1000000 ELSE user_id END AS folder,
                         count(DISTINCT event_type) AS stored FROM events GROUP BY folder)
        SELECT folder, CAST(recorded AS BIGINT) AS recorded_shards, coalesce(stored, 0) AS stored_shards,
               CASE WHEN m.readable IS NULL OR stored IS NULL THEN 'incomplete'
                    WHEN NOT readable THEN 'unreadable manifest'
                    WHEN recorded <> stored THEN 'shard count differs' ELSE 'complete' END AS status
        FROM manifests m FULL JOIN files f USING (folder)""",
    "split_overlap": _with(PLACED, """
        SELECT kind, key, count(*) FILTER (split = 'train') AS train_documents,
               count(*) FILTER (split = 'validation') AS validation_documents
        FROM (SELECT 'doc_id' AS kind, CAST(doc_id AS VARCHAR) AS key, split FROM placed
              UNION ALL SELECT 'text', md5(text), split FROM placed)
        GROUP BY kind, key HAVING train_documents > 0 AND validation_documents > 0"""),
    "corpus_progress": _with(PLACED, """
        SELECT progress_tokens, arg_min(doc_id, cum_tokens) AS doc_id, arg_min(split, cum_tokens) AS split
        FROM (SELECT doc_id, split, cum_tokens,
                     CASE WHEN progress = train + validation THEN progress ELSE progress // 10000 * 10000 END AS progress_tokens
              FROM (SELECT p.*, train, validation,
                           CASE split WHEN 'train' THEN least(cum_tokens, train)
                                ELSE train + least(cum_tokens - base, validation) END AS progress
                    FROM placed p, budget))
        WHERE progress_tokens > 0 GROUP BY progress_tokens"""),
    "build_vocab": _with(VOCAB, "SELECT term, n, id FROM vocab"),
    "encode_documents": _ENCODED,
    "encode_documents_joined": _ENCODED,
    "encode_bytes": """
        SELECT doc_id, CAST(1 + octet_length(encode(text)) AS BIGINT) AS n_tokens,
               CAST(coalesce(list_sum(b), 0) AS BIGINT) AS id_sum, coalesce(list_last(b), 0) AS last_id
        FROM (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..', 0),
                       lambda h: 2 + CAST('0x' || h AS INTEGER)) AS b FROM documents)""",
    "token_width": _with(VOCAB, """
        SELECT CAST(max(id) AS BIGINT) AS largest_id, CASE WHEN max(id) <= 65535 THEN 2 ELSE 4 END AS item_size FROM vocab"""),
    "bos_offsets": _with(STREAM, "SELECT doc_id, split, shard, spot AS start_token FROM stream WHERE place = 0"),
    "shard_headers": _with(STREAM, """
        SELECT split, shard, 278895051 AS magic, 1 AS version, count(*) AS token_count, 2 AS item_size
        FROM stream GROUP BY split, shard"""),
    "tokenization_manifest": _with(STREAM, """
        SELECT 'vocab' AS encoder, 0 AS bos_token_id, 16 AS bits, count(*) AS tokens, count(DISTINCT doc_id) AS documents,
               count(DISTINCT split || shard) AS shards, 278895051 AS magic, 1 AS version
        FROM stream"""),
    "document_samples": _with(A.TURNS_SQL + "," + _vocab_sql("turns") + "," + _ids_sql("turns", "word_ids") + """,
        whole AS (
          SELECT doc_id, list(id ORDER BY place)[1:65] AS x
          FROM (SELECT * FROM word_ids UNION ALL SELECT doc_id, 0, 0 FROM turns
                UNION ALL SELECT doc_id, 9000000000, 1 FROM turns) GROUP BY doc_id)""", """
        SELECT doc_id, md5(array_to_string(list_concat(x[1:len(x) - 1], list_transform(range(65 - len(x)), lambda i: 1)), ' ')) AS input_ids,
               md5(array_to_string(list_concat(x[2:], list_transform(range(65 - len(x)), lambda i: -100)), ' ')) AS labels,
               md5(array_to_string(list_concat(list_transform(range(len(x) - 1), lambda i: 1),
                                               list_transform(range(65 - len(x)), lambda i: 0)), ' ')) AS attention_mask
        FROM whole"""),
    "cut_packs": _with(CELLS, f"""
        SELECT split, shard, pack, CAST(arg_max(id, i) AS INTEGER) AS look_ahead, {_joined("id", "i")} AS window_md5
        FROM cells {_PER_PACK}"""),
    "shift_labels": _with(CELLS, f"""
        SELECT split, shard, pack,
               md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) FILTER (i < {SEQ_LEN})) AS input_ids,
               md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) FILTER (i > 0)) AS labels
        FROM cells {_PER_PACK}"""),
    "segment_ids": _with(CELLS, f"""
        SELECT split, shard, pack, CAST(max(segment) AS INTEGER) AS segments, {_joined("segment", "i")} AS segment_ids
        FROM inputs {_PER_PACK}"""),
    "position_ids": _with(CELLS, f"""
        SELECT split, shard, pack, {_joined("position", "i")} AS position_ids FROM inputs {_PER_PACK}"""),
    "mask_boundary_labels": _with(CELLS, f"""
        SELECT split, shard, pack, {_joined("CASE WHEN id = 0 THEN -100 ELSE id END", "i")} AS labels
        FROM cells WHERE i > 0 {_PER_PACK}"""),
    "pack_with_ends": _with(
        CELLS.replace("SELECT doc_id, 0, 0 FROM placed)", "SELECT doc_id, 0, 0 FROM placed UNION ALL SELECT doc_id, 9000000000, 1 FROM placed)", 1) + """,
        before AS (SELECT *, lag(id) OVER (PARTITION BY split, shard, pack ORDER BY i) AS prev FROM cells),
        marked AS (
          SELECT *, 1 + sum(CASE WHEN i > 0 AND (id = 0 OR prev = 1) THEN 1 ELSE 0 END) OVER w AS piece,
                 i - max(CASE WHEN i = 0 OR id = 0 OR prev = 1 THEN i ELSE 0 END) OVER w AS spot_in_piece
          FROM before WINDOW w AS (PARTITION BY split, shard, pack ORDER BY i))""", f"""
        SELECT split, shard, pack,
               md5(string_agg(CAST(piece AS VARCHAR), ' ' ORDER BY i) FILTER (i < {SEQ_LEN})) AS segment_ids,
               md5(string_agg(CAST(spot_in_piece AS VARCHAR), ' ' ORDER BY i) FILTER (i < {SEQ_LEN})) AS position_ids,
               md5(string_agg(CAST(CASE WHEN prev = 1 OR id = 0 THEN -100 ELSE id END AS VARCHAR), ' ' ORDER BY i) FILTER (i > 0)) AS labels
        FROM marked {_PER_PACK}"""),
    "cap_packs": _with(CELLS, f"""
        SELECT split, shard, pack, pack_number, {_joined("id", "i")} AS input_ids
        FROM inputs JOIN (
          SELECT split, shard, pack, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || split || '-' || shard), shard, pack) - 1 AS pack_number
          FROM (SELECT DISTINCT split, shard, pack FROM cells)) USING (split, shard, pack)
        WHERE pack_number < 500 GROUP BY split, shard, pack, pack_number"""),
    "order_shards": _with(PLACED, """
        SELECT split, shard, CAST(row_number() OVER (PARTITION BY split ORDER BY md5('42:' || split || '-' || shard), shard) - 1 AS INTEGER) AS shard_order
        FROM (SELECT DISTINCT split, shard FROM placed)"""),
    "batch_packs": _with(CELLS, f"""
        SELECT split, pack_number // {BATCH} AS batch, CAST(count(DISTINCT pack_number) AS INTEGER) AS packs,
               {_joined("id", "pack_number, i")} AS input_ids, {_joined("segment", "pack_number, i")} AS packed_seq_ids
        FROM inputs JOIN numbered USING (split, shard, pack) GROUP BY split, batch"""),
    "pack_stats": _with(CELLS, f"""
        SELECT split, shard, tokens, coalesce(packs, 0) AS packs, coalesce(segments, 0) AS segments,
               coalesce(masked, 0) AS masked_labels,
               tokens - CASE WHEN packs > 0 THEN packs * {SEQ_LEN} + 1 ELSE 0 END AS tail_tokens
        FROM (SELECT split, shard, count(*) AS tokens FROM stream GROUP BY split, shard)
        LEFT JOIN (SELECT split, shard, count(*) AS packs, CAST(sum(s) AS BIGINT) AS segments FROM (
                     SELECT split, shard, pack, max(segment) AS s FROM inputs {_PER_PACK}) GROUP BY split, shard)
               USING (split, shard)
        LEFT JOIN (SELECT split, shard, count(*) FILTER (id = 0) AS masked FROM cells WHERE i > 0 GROUP BY split, shard)
               USING (split, shard)"""),
}
