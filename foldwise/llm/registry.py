"""The subpackage's registered queries and their oracle SQL, one module of queries per operator."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Modules that define QUERIES and, where SQL can express the query, ORACLE.
MODULES = ("sharding", "bpe", "quality_rules", "mixing", "secrets", "toxicity", "simhash", "embeddings", "quality_classifier", "substrings", "infilling", "spelling", "pitman_yor")


def queries() -> dict:
    return {k: f for m in _loaded() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _loaded() for k, sql in getattr(m, "ORACLE", {}).items()}


def _loaded() -> list:
    return [importlib.import_module(f"foldwise.llm.{m}") for m in MODULES]
