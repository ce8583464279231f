"""Session likelihoods of several models: clean-up, partitions, paired differences and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialspan.functions.numbers import finite, sd_or_zero
from trialspan.functions.text import one_spelling, study_of

COMBINED = "COMBINED"


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; null keys are one key."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def latest_scores(session_nll: DataFrame) -> DataFrame:
    """The latest score of each model and session, finite ones only.

    Ties of the time are decided by more answer tokens, then the greater value. Experiments are
    in one spelling; missing ones are ``unknown``.
    """
    rows = last_wins(session_nll, ["model", "prompt_id"], [F.col("scored_at").desc_nulls_last(), F.col("n_answer_tokens").desc_nulls_last(), F.col("nll").desc_nulls_last()])
    key = F.coalesce(one_spelling(F.col("experiment")), F.lit("unknown"))
    return rows.where(finite(F.col("nll"))).select("model", "prompt_id", key.alias("experiment"), "cohort", "nll", "n_answer_tokens", "n_answer_spans", "scored_at")


def partition_of(experiment: Column, prefixes: dict[str, list[str]], other: str) -> Column:
    """The partition whose list has a prefix of the experiment, lists tried in order; ``other`` if none has."""
    out = F.lit(other)
    for name, starts in reversed(prefixes.items()):
        out = F.when(F.greatest(*[experiment.startswith(p) for p in starts], F.lit(False)), name).otherwise(out)
    return out


def with_combined(df: DataFrame, column: str = "partition") -> DataFrame:
    """The bag union of all partitions as one more partition, in one pass over the rows."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(COMBINED))))


def wide_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per session with a column for each model: a single shuffle in place of a join for each contrast."""
    by = [F.max(F.when(F.col("model") == m, F.col("nll"))).alias(m) for m in models]
    return scores.groupBy("prompt_id").agg(F.max("experiment").alias("experiment"), *by)


def paired_deltas(wide: DataFrame, contrasts: list[tuple[str, str, str]]) -> DataFrame:
    """(contrast, prompt_id, experiment, delta) of the sessions that both models have."""
    each = [F.struct(F.lit(name).alias("contrast"), (F.col(a) - F.col(b)).alias("delta")) for name, a, b in contrasts]
    return wide.select("prompt_id", "experiment", F.explode(F.array(*each)).alias("x")).where("x.delta IS NOT NULL").select("x.contrast", "prompt_id", "experiment", "x.delta")


def paired_summary(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the differences: n, mean, sd, effect size d, t, df and the share below zero.

    A single difference has sd 0; where sd is 0 or missing, d and t are null.
    """
    m, sd, n = F.avg("delta"), sd_or_zero(F.col("delta")), F.count("delta")
    by = deltas.groupBy(*keys).agg(n.alias("n"), m.alias("delta_mean"), sd.alias("delta_sd"), F.avg((F.col("delta") < 0).cast("double")).alias("share_below"))
    d = F.when(F.col("delta_sd") > 0, F.col("delta_mean") / F.col("delta_sd"))
    return by.withColumn("d", d).withColumn("t", F.col("d") * F.sqrt("n")).withColumn("df", F.col("n") - 1)


def study_column(df: DataFrame) -> DataFrame:
    return df.withColumn("study", study_of(F.col("experiment")))


def coverage(wide: DataFrame, contrasts: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """Per contrast: sessions of both models, and those missing in a, else in b (a is looked at first)."""
    each = [F.struct(F.lit(name).alias("contrast"), F.col(a).isNull().alias("no_a"), F.col(b).isNull().alias("no_b")) for name, a, b in contrasts]
    rows = wide.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*")
    return rows.groupBy("contrast", *keys).agg(
        F.count("*").alias("n_sessions"), F.count(F.when(F.col("no_a"), 1)).alias("n_missing_a"),
        F.count(F.when(~F.col("no_a") & F.col("no_b"), 1)).alias("n_missing_b"), F.count(F.when(~F.col("no_a") & ~F.col("no_b"), 1)).alias("n_paired"),
    )


def remapped(df: DataFrame, mapping: DataFrame, key: str, mapped_key: str, prefix: str) -> DataFrame:
    """``df`` with ``origin`` and ``mapped``: the mapped cohort of its key behind ``prefix``, else its own experiment.

    A key that is mapped to several cohorts belongs to the one named most often, of ties to the last by name;
    null and unknown cohorts, and null keys, map nothing. The mapping is reduced to one row a key before the join.
    """
    usable = mapping.where(F.col(mapped_key).isNotNull() & F.col("cohort").isNotNull() & ~F.lower(F.trim("cohort")).isin("", "unknown"))
    best = usable.groupBy(F.col(mapped_key).alias("_key"), "cohort").agg(F.count("*").alias("n")).groupBy("_key").agg(F.max_by("cohort", F.struct("n", "cohort")).alias("_cohort"))
    out = df.join(best, F.col(key) == F.col("_key"), "left")
    mapped = F.col("_key").isNotNull()
    return out.withColumn("origin", F.when(mapped, F.concat(F.lit(prefix), "_cohort")).otherwise(F.col("experiment"))).withColumn("mapped", mapped).drop("_key", "_cohort")


def collapsed(experiment: Column, one_study: dict[str, str], prefix: str = "igt_") -> Column:
    """The study of an experiment: the name of the first listed prefix that it begins with, else itself without ``prefix``."""
    out = F.regexp_replace(experiment, f"^{prefix}", "")
    for start, name in reversed(one_study.items()):
        out = F.when(experiment.startswith(start), name).otherwise(out)
    return out


def alias_maps(df: DataFrame, group: str, key: str, value: str, order: list[str], separator: str = "_") -> DataFrame:
    """(group, id, value, by) for lookups by a whole key or by its last part.

    Of rows with one whole key the last in ``order`` counts, of those with one last part the first;
    a whole key goes before a last part that reads the same.
    """
    rows = df.where(F.col(key).isNotNull())
    whole = rows.groupBy(group, F.col(key).alias("id")).agg(F.max_by(F.struct(value), F.struct(*order)).alias("v")).withColumn("by", F.lit("id"))
    parted = rows.where(F.contains(key, F.lit(separator))).groupBy(group, F.substring_index(key, separator, -1).alias("id")).agg(F.min_by(F.struct(value), F.struct(*order)).alias("v")).withColumn("by", F.lit("alias"))
    both = whole.union(parted).groupBy(group, "id").agg(F.max_by(F.struct("v", "by"), F.col("by") == "id").alias("x"))
    return both.select(group, "id", F.col(f"x.v.{value}").alias(value), "x.by")
