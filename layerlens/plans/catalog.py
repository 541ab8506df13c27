"""All registered queries (name → Spark DataFrame builder) and their oracle
SQL. Importing the query modules fills the registry."""

from __future__ import annotations

import importlib

from layerlens.plans.registry import ORACLES, QUERIES, QueryFn

_MODULES = ["q_ranking", "q_dataset", "q_probe", "q_train", "q_text", "q_pooling", "q_runlog", "q_stream", "q_io"]

for _m in _MODULES:
    importlib.import_module(f"layerlens.plans.{_m}")


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
