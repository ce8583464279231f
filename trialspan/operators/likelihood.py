"""From log-probabilities of tokens to trial and session likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspan.functions.numbers import logsumexp, mass, total


def top_alternatives(logs: Column, k: int) -> Column:
    """The k most probable tokens as (logprob, token), the best first; equal ones by token; k is cut to the vocabulary."""
    ranked = F.transform(logs, lambda x, i: F.struct((-x).alias("minus"), i.alias("token")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: F.struct((-s["minus"]).alias("logprob"), s["token"].alias("token")))


def log_probabilities(values: Column) -> Column:
    """Log-softmax of an array of scores."""
    z = F.array_repeat(logsumexp(values), F.size(values))  # as an array, so that it is computed once a row
    return F.zip_with(values, z, lambda x, z: x - z)


def token_map(tokens: Column, logs: Column) -> Column:
    """token -> logprob; arrays of unequal length are cut to the shorter, of equal tokens the last counts."""
    n = F.least(F.size(tokens), F.size(logs))
    pairs = F.arrays_zip(F.slice(tokens, 1, n).alias("t"), F.slice(logs, 1, n).alias("l"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["t"] == p["t"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["t"], p["l"])))


def deck_trial(top: Column, deck: list[int], chosen: Column) -> Column:
    """Renormalised and raw likelihood of one trial, and the mass on the deck tokens.

    Null where a deck token is not among the alternatives or the chosen token is no deck token.
    """
    tokens = F.transform(top, lambda t: t["token"])
    wanted = F.array(*[F.lit(d) for d in deck])
    logs = F.transform(wanted, lambda d: F.element_at(F.filter(top, lambda t: t["token"] == d), 1)["logprob"])
    complete = (F.size(F.array_except(wanted, tokens)) == 0) & F.array_contains(wanted, chosen)
    own = F.element_at(F.filter(top, lambda t: t["token"] == chosen), 1)["logprob"]
    return F.when(complete, F.struct((logsumexp(logs) - own).alias("nll_renorm"), (-own).alias("nll_raw"), mass(logs).alias("mass")))


def session_metrics(trials: DataFrame, session: str) -> DataFrame:
    """Per session the means over complete trials, with kept and excluded trials; sessions without a complete one have no row.

    ``trials`` has the session and ``m``, the result of ``deck_trial``.
    """
    by = trials.groupBy(session).agg(
        F.avg("m.nll_renorm").alias("nll_renorm"), F.avg("m.nll_raw").alias("nll_raw"), F.avg("m.mass").alias("mass"),
        F.count("m").alias("n_kept"), (F.count("*") - F.count("m")).alias("n_excluded"), F.count("*").alias("n_trials"),
    )
    return by.where("n_kept > 0")


def two_definitions(trials: DataFrame, session: str, logs: str) -> DataFrame:
    """Both session likelihoods of answers of several tokens: the mean of trial sums, and the mean over all answer tokens."""
    rows = trials.where(F.size(logs) > 0).select(session, (-total(F.col(logs))).alias("trial"), F.size(logs).alias("n"))
    return rows.groupBy(session).agg(F.avg("trial").alias("nll_by_trial"), (F.sum("trial") / F.sum("n")).alias("nll_by_token"), F.count("*").alias("n_trials"), F.sum("n").alias("n_tokens"))
