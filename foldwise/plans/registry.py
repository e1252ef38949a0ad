"""The library's registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("split_queries", "model_queries", "experiment_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"foldwise.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in importlib.import_module(f"foldwise.plans.{m}").ORACLE.items()}
