"""All registered queries and their SQL twins."""

from __future__ import annotations

from tokenloom.plans import corpus_queries, curve_queries, eval_queries, io_queries, schedule_queries, study_queries

_MODULES = [corpus_queries, study_queries, curve_queries, eval_queries, schedule_queries, io_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
