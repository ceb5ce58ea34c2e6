"""Run registered queries next to their SQL twins and compare the rows.

    python tests/oracle.py <table folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def all_pairs_join(df) -> str:
    """The name of a join in the plan that pairs rows without a key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next((j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan), "")


def compare(spark, db, query, sql: str, sf_dir: str) -> tuple[str, int]:
    """Empty text when both agree, and the number of rows."""
    result = query(spark, sf_dir)
    if all_pairs_join(result):
        return all_pairs_join(result), -1
    ours = _rows(result.columns, [tuple(r) for r in result.collect()])
    answer = db.execute(sql)
    names = [c[0] for c in answer.description]
    theirs = _rows(names, answer.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} and {sorted(names)}", len(ours)
    kinds = dict(result.dtypes)
    for name, kind in zip(names, answer.description):
        is_float = kinds[name] in ("double", "float")
        if is_float != (str(kind[1]) in ("DOUBLE", "FLOAT")):
            return f"column {name}: {kinds[name]} and {kind[1]}", len(ours)
        if str(kind[1]) in ("HUGEINT",) or str(kind[1]).startswith("DECIMAL"):
            return f"column {name}: {kind[1]}", len(ours)
    if ours != theirs:
        different = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return f"{len(ours)} and {len(theirs)} rows, e.g. {different}", len(ours)
    return "", len(ours)


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from tokenloom.plans.catalog import ORACLES, QUERIES
    from tokenloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in names:
        began = time.time()
        try:
            if name in ORACLES:
                problem, count = compare(spark, db, QUERIES[name], ORACLES[name], sf_dir)
            else:
                problem, count = "", QUERIES[name](spark, sf_dir).count()
        except Exception as error:  # noqa: BLE001 - reported per query
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {count:7d} rows {time.time() - began:6.2f}s "
              f"{'' if name in ORACLES else '(rows only) '}{problem}", flush=True)
    print(f"{failed} of {len(names)} failed")


if __name__ == "__main__":
    main()
