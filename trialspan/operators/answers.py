"""Answers of an inference service: the choice they name, trial rows with scores, and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialspan.functions.text import choice_in, stripped

# The fields that may hold an answer, in the order in which they are tried, and those with its log-probability.
ANSWER_FIELDS = ("choice", "generated_text", "text", "response", "output")
LOGPROB_FIELDS = ("logprob", "log_probability")


def _first_text(response: Column, path: str) -> Column:
    """The first of the answer fields that holds more than blanks; null if none does."""
    fields = [F.get_json_object(response, f"{path}.{name}") for name in ANSWER_FIELDS]
    return F.coalesce(*[F.when(stripped(x) != "", x) for x in fields])


def choice_of(response: Column) -> Column:
    """The choice that a response, JSON text, names: of its answer fields, else of its first ``choices`` element.

    That element is a record with the same fields or a plain text; anything else, and null, is an empty string.
    """
    own, nested = _first_text(response, "$"), _first_text(response, "$.choices[0]")
    plain = F.get_json_object(response, "$.choices[0]")
    listed = F.when(nested.isNotNull(), choice_in(nested)).when(plain.isNotNull() & ~plain.startswith("{") & ~plain.startswith("["), stripped(plain))
    return F.coalesce(F.when(own.isNotNull(), choice_in(own)).otherwise(listed), F.lit(""))


def logprob_of(response: Column) -> Column:
    return F.coalesce(*[F.get_json_object(response, f"$.{name}").try_cast("double") for name in LOGPROB_FIELDS])


def trial_rows(df: DataFrame, key: str, expected: str, response: str) -> DataFrame:
    """``df`` without the response, with ``action``, ``reward``, ``correct``, ``tolerant`` and ``logprob``.

    ``correct`` is null where nothing is expected; ``tolerant`` leaves out case and blanks at the ends. A null
    response is an answer without a choice. ``per_trial_ready`` tells whether it lists likelihoods of trials.
    """
    rows = df.withColumn("action", choice_of(F.col(response)))
    wanted = F.coalesce(F.col(expected), F.lit(""))
    same = F.col("action") == wanted
    return rows.withColumns(
        {
            "reward": F.when(same, 1.0).otherwise(0.0), "correct": F.when(wanted != "", same), "tolerant": F.when(wanted != "", F.lower(F.trim("action")) == F.lower(F.trim(wanted))),
            "logprob": logprob_of(F.col(response)), "per_trial_ready": F.coalesce(F.get_json_object(response, "$.per_trial_logprobs[0]").isNotNull(), F.lit(False)),
        }
    ).drop(response)


def trial_metrics(trials: DataFrame, group: str) -> DataFrame:
    """Rows over all (``group`` is null and ``level`` is ``global``) and by group: trials, scored, correct, tolerant, their shares and the mean reward."""
    by = trials.groupingSets([[], [group]], group).agg(
        F.when(F.grouping(group) == 1, "global").otherwise("group").alias("level"), F.count("*").alias("n_trials"), F.count("correct").alias("n_scored"), F.count(F.when(F.col("correct"), 1)).alias("n_correct"),
        F.count(F.when(F.col("tolerant"), 1)).alias("n_tolerant"), F.avg("reward").alias("mean_reward"),
    )
    return by.withColumn("accuracy", F.try_divide("n_correct", "n_scored")).withColumn("tolerant_accuracy", F.try_divide("n_tolerant", "n_scored"))


def trial_logprobs(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, trial_index, target_text, n_tokens, logprob) of the trials whose token log-probabilities a response lists.

    A trial's log-probability is the sum over its target tokens; a trial without any has none.
    """
    kind = "array<struct<trial_index:int,target_text:string,target_token_logprobs:array<double>>>"
    rows = df.select(key, F.explode(F.from_json(F.get_json_object(response, "$.per_trial_logprobs"), kind)).alias("t"))
    tokens = F.filter("t.target_token_logprobs", lambda x: x.isNotNull())
    return rows.select(key, "t.trial_index", "t.target_text", F.coalesce(F.size(tokens), F.lit(0)).alias("n_tokens"), F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)).alias("logprob"))


def session_nll(trials: DataFrame, key: str) -> DataFrame:
    """(key, nll, n_answer_tokens, n_answer_spans): the mean over a session's answer tokens of their negative log-probability."""
    by = trials.groupBy(key).agg(F.sum("n_tokens").alias("n_answer_tokens"), F.count("*").alias("n_answer_spans"), F.sum("logprob").alias("s"))
    return by.select(key, F.try_divide(-F.col("s"), F.col("n_answer_tokens")).alias("nll"), "n_answer_tokens", "n_answer_spans")
