"""Queries over tables that are folders of files, and over keys beyond those of the given tables."""

from pathlib import Path

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tokenloom.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


def _compare(spark, folder, name, **tables):
    """The query next to its SQL over ``tables``, each written as a folder of several files."""
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.repartition(3).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(spark, db, QUERIES[name], ORACLES[name], str(folder))[0]


def _table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    assert _compare(spark, tmp_path / "docs", "stream_ingest", documents=_table(spark, "documents")) == ""
    assert _compare(spark, tmp_path / "events", "stream_latest_losses", events=_table(spark, "events")) == ""


def test_attempts_of_five_digit_trials(spark, tmp_path):
    events = _table(spark, "events").withColumn("user_id", F.col("user_id") * 321 + 9_000)
    assert _compare(spark, tmp_path, "select_attempt", events=events) == ""


def test_deliveries_are_written_by_all_tasks(spark, tmp_path):
    """A delivery of a table of three files is three files: no task takes in the whole table."""
    root = Path(spark.conf.get("spark.checkpoint.dir")) / "tokenloom"
    before = set(root.glob("ingest-source-*"))
    assert _compare(spark, tmp_path, "stream_ingest_until_met", documents=_table(spark, "documents")) == ""
    (source,) = set(root.glob("ingest-source-*")) - before
    assert len(list((source / "0").glob("part-*.parquet"))) == 3
