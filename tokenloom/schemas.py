"""Explicit schemas; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType([T.StructField("token_count", T.LongType())])

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", METADATA),
])

SHARDED_DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("order_key", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("shard", T.IntegerType()),
])

TRIAL = T.StructType([
    T.StructField("study", T.StringType()),
    T.StructField("trial", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

LOG_RECORD = T.StructType([
    T.StructField("step", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
])

EVALUATION_MANIFEST = T.StructType([
    T.StructField("checkpoint", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("suite", T.StringType()),
    T.StructField("training_step", T.LongType()),
])

TOKEN_BLOCK = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("shard_tokens", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.LongType(), containsNull=False)),
])
