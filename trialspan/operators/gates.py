"""Validation gates: each gives a row of findings; ``require`` turns a finding into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class GateError(ValueError):
    """A gate that does not hold."""


def require(findings: DataFrame, rule: Column, message: str) -> DataFrame:
    """Raise ``GateError`` unless the rule holds in all rows of the (small) findings; null does not hold."""
    bad = findings.where(~F.coalesce(rule, F.lit(False))).limit(1).collect()
    if bad:
        raise GateError(f"{message}: {bad[0].asDict()}")
    return findings


def prompt_summary(prompts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows, missing keys, repeated keys, missing texts and texts without a closed marker; one row, also for no input."""
    marked = F.col(text).rlike(r"(?s)<<.*?>>")
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    by = prompts.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(blank, 1)).alias("no_text"), F.count(F.when(~blank & ~marked, 1)).alias("no_marker"))
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "no_text", "no_marker")]
    return by.agg(
        sums[0].alias("n_rows"), F.count(F.when(F.col(key).isNotNull(), 1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_without_key"),
        F.count(F.when(F.col(key).isNotNull() & (F.col("n") > 1), 1)).alias("n_repeated_keys"), sums[1].alias("n_without_text"), sums[2].alias("n_without_marker"),
    )


def full_coverage(keep: DataFrame, have: DataFrame, key: str, model: str) -> DataFrame:
    """For each model: how many wanted keys it lacks, and whether it covers all; no models give no rows."""
    wanted = keep.select(key).distinct()
    held = have.select(key, model).distinct().join(wanted, key, "left_semi")
    n = wanted.groupBy().agg(F.count("*").alias("n_wanted"))
    by = have.select(model).distinct().join(held.groupBy(model).agg(F.count("*").alias("n_held")), model, "left")
    rows = by.join(F.broadcast(n))  # one row
    return rows.select(model, "n_wanted", (F.col("n_wanted") - F.coalesce("n_held", F.lit(0))).alias("n_missing")).withColumn("covers_all", F.col("n_missing") == 0)


def cardinality(df: DataFrame, expected: int, what: str) -> DataFrame:
    """``df`` itself if it has as many rows as expected, else an error."""
    n = df.count()
    if n != expected:
        raise GateError(f"{what}: {n} rows, {expected} expected")
    return df


def missing_logs(trials: DataFrame, key: str, logs: str, shown: int = 10) -> DataFrame:
    """Number of trials without log-probabilities and the first keys that have such."""
    bad = trials.where(F.coalesce(F.size(logs) <= 0, F.lit(True)))
    first = bad.select(key).distinct().orderBy(key).limit(shown).agg(F.sort_array(F.collect_list(key)).alias("first_keys"))
    return bad.agg(F.count("*").alias("n_missing")).join(F.broadcast(first))


def drift(saved: dict, expected: dict) -> dict[str, tuple]:
    """Keys of a cache's manifest whose value differs from the expected one, with both values."""
    return {k: (saved.get(k), expected.get(k)) for k in sorted({*saved, *expected}) if saved.get(k) != expected.get(k)}
