"""Resumable runs: what is left to do, consolidation of partial results, upserts and cached results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from trialspan.operators.scores import last_wins


def to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose key is not among the done ones; null keys are never done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def half_done(work: DataFrame, done: DataFrame, key: str, expected: str) -> DataFrame:
    """Keys with fewer results than expected: those that a check by key alone would take for done."""
    n = done.groupBy(key).agg(F.count("*").alias("n_done"))
    return work.select(key, expected).join(n, key).where(F.col("n_done") < F.col(expected))


def consolidated(parts: DataFrame, keys: list[str], order: list[Column], listed: DataFrame | None = None) -> DataFrame:
    """One row for each key, the last written, in the order of the list's ``pos`` where a list is given."""
    rows = last_wins(parts, keys, order)
    return rows if listed is None else listed.select(*keys, "pos").join(rows, keys).orderBy("pos")


def fused(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """The union of two blocks by key; where both have it, the second wins."""
    both = first.withColumn("_block", F.lit(0)).unionByName(second.withColumn("_block", F.lit(1)))
    return last_wins(both, key, [F.col("_block").desc()]).drop("_block")


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The index with rows of new keys replaced or added."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def rest_by_position(work: DataFrame, n_done: int, position: str = "pos") -> DataFrame:
    """Work behind the first ``n_done`` positions, for runs whose results carry no key."""
    return work.where(F.col(position) >= n_done)


def compute_or_reuse(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is computed and written first where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
