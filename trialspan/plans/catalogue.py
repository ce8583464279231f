"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialspan.plans import contrasts, corpora, likelihoods

_MODULES = (contrasts, likelihoods, corpora)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
