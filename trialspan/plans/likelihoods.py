"""Queries on token log-probabilities and sequential choice models, each with the SQL that states it where there is one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspan.functions.numbers import finite, total
from trialspan.functions.text import one_spelling
from trialspan.operators import cognitive as C, likelihood as L, statistics as X
from trialspan.operators.pooled import pooled_folds
from trialspan.operators.scores import latest_scores, paired_summary, wide_scores
from trialspan.runtime import table

#: the fixture's deck tokens and number of saved alternatives
DECK, TOP = [0, 1, 2, 3], 10
PVL = [0.0, 0.0, -1.0, -2.0]
VSE = [0.2, 0.5, -0.5, 0.1, -3.0]
ORL = [-1.0, -1.5, 0.3, 0.4, 0.6]


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is a trial: its scores as log-probabilities of 64 tokens, the label its session, label modulo 4 its choice."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    return rows.select("vec_id", "label", L.log_probabilities(F.col("scores")).alias("logs"), (F.col("label") % 4).alias("chosen"))


def topk_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trials(spark, sf).select("vec_id", L.top_alternatives(F.col("logs"), TOP).alias("top"))
    return rows.select("vec_id", F.element_at("top", 1)["token"].alias("best_token"), F.round(F.element_at("top", 1)["logprob"], 9).alias("best_logprob"), F.array_join(F.transform("top", lambda t: t["token"].cast("string")), ",").alias("tokens"))


def renorm_session_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trials(spark, sf).select("label", L.deck_trial(L.top_alternatives(F.col("logs"), 64), DECK, F.col("chosen")).alias("m"))
    out = L.session_metrics(rows, "label")
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("nll_renorm", "nll_raw", "mass")], "n_kept", "n_excluded", "n_trials")


def top_saved_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trials(spark, sf).select("label", L.deck_trial(L.top_alternatives(F.col("logs"), TOP), DECK, F.col("chosen")).alias("m"))
    return rows.groupBy("label").agg(F.count("m").alias("n_kept"), F.count("*").alias("n_trials"))


def mass_on_deck_tokens(spark: SparkSession, sf: str) -> DataFrame:
    mass = total(F.transform(F.slice("logs", 1, 4), lambda x: F.exp(x)))
    rows = _trials(spark, sf).groupBy("label").agg(F.avg(mass).alias("m"), F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_trials"), F.round(F.avg("m"), 9).alias("mean_of_session_means"))


def two_nll_definitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trials(spark, sf).select("label", F.slice("logs", F.lit(1), (F.col("vec_id") % 3 + 1).cast("int")).alias("answer"))
    out = L.two_definitions(rows, "label", "answer")
    return out.select("label", F.round("nll_by_trial", 9).alias("nll_by_trial"), F.round("nll_by_token", 9).alias("nll_by_token"), "n_trials", "n_tokens")


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The latest delivery of each session that has trials."""
    rows = table(spark, sf, "session_manifest").where("prompt_id IS NOT NULL AND size(trials) > 0")
    return rows.groupBy("prompt_id").agg(F.max_by(F.struct("experiment", "trials"), F.struct("loaded_at", "row_id")).alias("r")).select("prompt_id", "r.experiment", F.transform("r.trials", lambda t: F.struct(t["deck"], (t["gain"] / 100).alias("gain"), (F.abs(t["loss"]) / 100).alias("loss"))).alias("trials"))


def _told(rows: DataFrame) -> DataFrame:
    """Totals, and the likelihoods of the first and the last trial, of which the last has seen all states; NaN is null."""
    known = lambda c: F.round(F.when(~F.isnan(c), c), 6)
    return rows.select("prompt_id", F.round("total_nll", 6).alias("total_nll"), F.size("per_trial").alias("n_trials"), known(F.element_at("per_trial", 1)).alias("first_nll"), known(F.element_at("per_trial", -1)).alias("last_nll"))


def pvl_per_trial_nll(spark: SparkSession, sf: str) -> DataFrame:
    return _told(C.trial_likelihoods(_sessions(spark, sf), "prompt_id", "trials", "pvl", PVL))


def pvl_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    s = [float(C._squash(x)) for x in PVL]
    rows = _sessions(spark, sf).select("prompt_id", C.pvl_fold(F.col("trials"), s[0], 2 * s[1], 10 * s[2], 5 * s[3]).alias("nll"))
    return rows.select("prompt_id", F.round(total(F.filter("nll", lambda x: ~F.isnan(x))), 6).alias("total_nll"))


def vse_per_trial_nll(spark: SparkSession, sf: str) -> DataFrame:
    return _told(C.trial_likelihoods(_sessions(spark, sf), "prompt_id", "trials", "vse", VSE))


def orl_per_trial_nll(spark: SparkSession, sf: str) -> DataFrame:
    return _told(C.trial_likelihoods(_sessions(spark, sf), "prompt_id", "trials", "orl", ORL))


#: starts and steps of the registered fits of single sessions, and of the pooled ones, which are the study's
STARTS, STEPS = 1, 15
POOLED_STARTS, POOLED_STEPS = 32, 1000


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """The latest delivery of each session that has trials, with its provenance, its participant and amounts in whole units."""
    rows = table(spark, sf, "session_manifest").where("prompt_id IS NOT NULL AND size(trials) > 0")
    kept = ("subject_id", "manifest", "cohort", "igt_version", "deck_map", "trials")
    last = rows.groupBy("prompt_id").agg(F.max_by(F.struct(*kept, one_spelling(F.col("experiment")).alias("experiment")), F.struct("loaded_at", "row_id")).alias("r")).select("prompt_id", "r.*")
    amounts = F.transform("trials", lambda t: F.struct(t["deck"].alias("deck"), (t["gain"] / 100).alias("gain"), (F.abs(t["loss"]) / 100).alias("loss")))
    return last.withColumns({"trials": amounts, "participant": F.coalesce(F.nullif(F.lower(F.trim("subject_id")), F.lit("")), "prompt_id"), "experiment": F.coalesce("experiment", F.lit("unknown"))})


def temporal_holdout_nll(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the first half of each session, evaluated on the rest with the state carried over."""
    return C.holdout(_people(spark, sf), "prompt_id", "trials", "pvl", fit_share=0.5, starts=STARTS, steps=STEPS).drop("deck_map")


def in_sample_fits(spark: SparkSession, sf: str) -> DataFrame:
    return C.fit_sessions(_people(spark, sf), "prompt_id", "trials", "pvl", starts=STARTS, steps=STEPS).drop("per_trial", "deck_map")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.coalesce(F.nullif(F.lower(F.trim("subject_id")), F.lit("")), "prompt_id")
    return table(spark, sf, "session_manifest").select(unit.alias("participant"), one_spelling(F.col("experiment")).alias("experiment"))


def kfold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of participants: all sessions of one lie in one fold of an experiment."""
    return C.hash_folds(_units(spark, sf), "participant", "experiment")


def kfold_status(spark: SparkSession, sf: str) -> DataFrame:
    folds = kfold_assignment(spark, sf)
    parts = [F.sum(F.conv(F.substring(F.md5("participant"), i, 8), 16, 10).cast("long")).alias(f"m{i}") for i in (1, 9)]
    held = folds.groupBy("experiment", "fold").agg(F.count("*").alias("n_held"), F.first("group_size").alias("group_size"), *parts)
    whole = held.groupBy("experiment").agg(F.sum("m1").alias("a1"), F.sum("m9").alias("a9"))
    both = held.join(whole, "experiment")
    return both.select(
        "experiment", "fold", "n_held", F.concat_ws("-", "m1", "m9").alias("eval_members"), F.concat_ws("-", F.col("a1") - F.col("m1"), F.col("a9") - F.col("m9")).alias("train_members"),
        C.fold_status(F.col("group_size") - F.col("n_held"), F.col("group_size"), 5).alias("status"),
    )


def pooled_kfold_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds of participants, each fitted on all sessions of the other four, from all starts of the study until they settle."""
    return pooled_folds(_people(spark, sf), "prompt_id", "participant", "trials", "experiment", "pvl", folds=5, starts=POOLED_STARTS, steps=POOLED_STEPS).drop("deck_map")


def same_sessions_with_cognitive(spark: SparkSession, sf: str) -> DataFrame:
    """Language models and a sequential model on exactly the sessions that all have; folds with few training participants are left out."""
    scores = wide_scores(latest_scores(table(spark, sf, "session_nll")), ["centra70", "base70"])
    fitted = C.hash_folds(_people(spark, sf), "participant", "experiment")
    flagged = fitted.groupBy("experiment", "fold").agg((F.first("group_size") - F.count("*") < 8).alias("low_train_warning"))
    rows = _people(spark, sf).join(fitted, ["experiment", "participant"]).join(F.broadcast(flagged), ["experiment", "fold"]).where(~F.coalesce("low_train_warning", F.lit(False)))
    own = C.trial_likelihoods(rows, "prompt_id", "trials", "pvl", PVL).select("prompt_id", F.try_divide("total_nll", F.size(F.filter("per_trial", lambda x: ~F.isnan(x)))).alias("pvl"))
    both = own.where(finite(F.col("pvl"))).join(scores.drop("experiment"), "prompt_id").dropna(subset=["centra70", "base70"])
    return both.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in ("pvl", "centra70", "base70")])


def dual_metric_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """The same contrast in the metric on the deck tokens alone and in the raw one: a model against the same model with halved scores."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    both = rows.select("label", (F.col("label") % 4).alias("chosen"), F.explode(F.array(F.struct(F.lit("sharp").alias("model"), F.col("scores")), F.struct(F.lit("flat").alias("model"), F.transform("scores", lambda x: x / 2).alias("scores")))).alias("x"))
    trial = both.select("label", "x.model", L.deck_trial(L.top_alternatives(L.log_probabilities(F.col("x.scores")), 64), DECK, F.col("chosen")).alias("m"))
    each = trial.where("m IS NOT NULL").groupBy("label").pivot("model", ["sharp", "flat"]).agg(F.avg("m.nll_renorm").alias("renorm"), F.avg("m.nll_raw").alias("raw"))
    deltas = each.select("label", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), (F.col(f"sharp_{x}") - F.col(f"flat_{x}")).alias("delta")) for x in ("renorm", "raw")])).alias("d")).select("d.*")
    out = paired_summary(deltas, ["metric"])
    return out.select("metric", "n", *[F.round(c, 9).alias(c) for c in ("delta_mean", "delta_sd", "d", "t")])


def cross_model_d(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential models against each other on the same sessions, by mean trial likelihood."""
    sessions = _sessions(spark, sf)
    each = C.mean_likelihoods(sessions, "prompt_id", "trials", {"pvl": PVL, "orl": ORL})
    deltas = each.select(F.lit("pvl_orl").alias("contrast"), "prompt_id", (F.col("pvl") - F.col("orl")).alias("delta")).where("delta IS NOT NULL")

    return X.with_p_values(paired_summary(deltas, ["contrast"]))


QUERIES = {
    f.__name__: f
    for f in (
        topk_argmax, renorm_session_metrics, top_saved_coverage, mass_on_deck_tokens, two_nll_definitions, pvl_per_trial_nll, pvl_by_fold, vse_per_trial_nll,
        orl_per_trial_nll, temporal_holdout_nll, in_sample_fits, kfold_assignment, kfold_status, pooled_kfold_fit, same_sessions_with_cognitive, dual_metric_contrast, cross_model_d,
    )
}

_LOGS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
    z AS (SELECT *, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS z FROM v),
    t AS (SELECT vec_id, label, label % 4 AS chosen, list_transform(s, lambda x: x - z) AS logs FROM z)"""
_TOKENS = _LOGS + ", k AS (SELECT vec_id, label, chosen, unnest(logs) AS lp, generate_subscripts(logs, 1) - 1 AS token FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, token) AS nth FROM k)"

_FOLDS = """u AS (SELECT DISTINCT coalesce(nullif(lower(trim(subject_id)), ''), prompt_id) AS participant, regexp_replace(lower(trim(experiment)), '[-\\s]+', '_', 'g') AS experiment FROM session_manifest),
    r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY sha256(participant), participant) - 1 AS nth, count(*) OVER (PARTITION BY experiment) AS group_size FROM u WHERE participant IS NOT NULL AND experiment IS NOT NULL),
    f AS (SELECT experiment, participant, CAST(nth % least(5, group_size) AS INTEGER) AS fold, group_size FROM r)"""


def _sig(x: float) -> float:
    return float(C._squash(x))


def _recursion(name: str) -> str:
    """A recursive query of trial likelihoods (prompt_id, i, nll) of a model: state columns of four decks, one step a trial."""
    if name == "pvl":
        rate, curve, aversion, c = _sig(PVL[0]), 2 * _sig(PVL[1]), 10 * _sig(PVL[2]), 5 * _sig(PVL[3])
        start, value = {"ev": "0.0"}, lambda k: f"ev{k} * {c!r}"
        step = lambda k: {"ev": f"CASE WHEN d = {k} THEN ev{k} + {rate!r} * (CASE WHEN g > l THEN pow(g - l, {curve!r}) WHEN g < l THEN -{aversion!r} * pow(l - g, {curve!r}) ELSE 0 END - ev{k}) ELSE ev{k} END"}
    elif name == "vse":
        theta, delta, alpha, phi, c = _sig(VSE[0]), _sig(VSE[1]), _sig(VSE[2]), 10 * math.tanh(VSE[3]), float(C._grow(VSE[4]))
        start, value = {"it": "0.0", "re": repr(phi)}, lambda k: f"(it{k} + re{k}) * {c!r}"
        step = lambda k: {"it": f"it{k} * {delta!r} + CASE WHEN d = {k} THEN pow(abs(g), {theta!r}) - pow(abs(l), {theta!r}) ELSE 0 END", "re": f"CASE WHEN d = {k} THEN 0.0 ELSE re{k} + {alpha!r} * ({phi!r} - re{k}) END"}
    else:
        win, lose, k_, by_f, by_p = _sig(ORL[0]), _sig(ORL[1]), float(C._grow(ORL[2])), ORL[3], ORL[4]
        start, value = {"ev": "0.0", "ef": "0.0", "ps": "0.0"}, lambda k: f"ev{k} + ef{k} * {by_f!r} + ps{k} * {by_p!r}"
        own, other = f"(CASE WHEN g >= l THEN {win!r} ELSE {lose!r} END)", f"(CASE WHEN g >= l THEN {lose!r} ELSE {win!r} END)"
        step = lambda k: {"ev": f"CASE WHEN d = {k} THEN ev{k} + {own} * (g - l - ev{k}) ELSE ev{k} END", "ef": f"CASE WHEN d = {k} THEN ef{k} + {own} * (sign(g - l) - ef{k}) ELSE ef{k} + {other} * (-sign(g - l) / 3.0 - ef{k}) END", "ps": f"CASE WHEN d = {k} THEN 1.0 ELSE ps{k} / {1 + k_!r} END"}
    names = [f"{c}{k}" for c in start for k in range(1, 5)]
    top = f"greatest({', '.join(value(k) for k in range(1, 5))})"
    z = f"({top} + ln({' + '.join(f'exp({value(k)} - {top})' for k in range(1, 5))}))"
    steps = {f"{c}{k}": step(k)[c] for c in start for k in range(1, 5)}
    return f"""latest_ AS (SELECT prompt_id, trials FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS nth FROM session_manifest WHERE prompt_id IS NOT NULL AND len(trials) > 0) WHERE nth = 1),
        flat_ AS (SELECT prompt_id, unnest(range(1, len(trials) + 1)) AS i, unnest(trials) AS t FROM latest_),
        step_ AS (SELECT prompt_id, i, CASE t.deck WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 ELSE 0 END AS d, coalesce(t.gain / 100, 0.0) AS g, coalesce(abs(t.loss) / 100, 0.0) AS l FROM flat_),
        {name} AS (SELECT prompt_id, CAST(0 AS BIGINT) AS i, {', '.join(f'CAST({start[n[:-1]]} AS DOUBLE) AS {n}' for n in names)}, CAST(NULL AS DOUBLE) AS nll FROM latest_
            UNION ALL SELECT s.prompt_id, s.i, {', '.join(f'CASE WHEN d > 0 THEN {steps[n]} ELSE {n} END' for n in names)}, CASE d {' '.join(f'WHEN {k} THEN {z} - ({value(k)})' for k in range(1, 5))} END FROM {name} r JOIN step_ s ON s.prompt_id = r.prompt_id AND s.i = r.i + 1)"""


def _totals(name: str) -> str:
    return f"""WITH RECURSIVE {_recursion(name)} SELECT prompt_id, coalesce(round(sum(nll) FILTER (isfinite(nll)), 6), CAST('inf' AS DOUBLE)) AS total_nll, CAST(count(*) AS INTEGER) AS n_trials,
        round(max(nll) FILTER (i = 1), 6) AS first_nll, round(arg_max(nll, i) FILTER (i = (SELECT len(trials) FROM latest_ a WHERE a.prompt_id = {name}.prompt_id)), 6) AS last_nll FROM {name} WHERE i > 0 GROUP BY prompt_id"""


SQL = {
    **{f"{m}_per_trial_nll": _totals(m) for m in ("pvl", "orl", "vse")},
    "pvl_by_fold": f"WITH RECURSIVE {_recursion('pvl')} SELECT prompt_id, coalesce(round(sum(nll) FILTER (isfinite(nll)), 6), 0.0) AS total_nll FROM pvl WHERE i > 0 GROUP BY prompt_id",
    "topk_argmax": f"""WITH {_TOKENS} SELECT vec_id, CAST(max(token) FILTER (nth = 1) AS INTEGER) AS best_token, round(max(lp) FILTER (nth = 1), 9) AS best_logprob,
        string_agg(CAST(token AS VARCHAR), ',' ORDER BY nth) AS tokens FROM r WHERE nth <= {TOP} GROUP BY vec_id""",
    "renorm_session_metrics": f"""WITH {_LOGS}, m AS (SELECT label, logs[1:4] AS d, logs[chosen + 1] AS own FROM t),
        e AS (SELECT label, ln(list_sum(list_transform(d, lambda x: exp(x)))) - own AS renorm, -own AS raw, list_sum(list_transform(d, lambda x: exp(x))) AS mass FROM m)
        SELECT label, round(avg(renorm), 9) AS nll_renorm, round(avg(raw), 9) AS nll_raw, round(avg(mass), 9) AS mass, count(*) AS n_kept, CAST(0 AS BIGINT) AS n_excluded, count(*) AS n_trials FROM e GROUP BY label""",
    "top_saved_coverage": f"""WITH {_TOKENS}, c AS (SELECT vec_id, label, count(*) FILTER (nth <= {TOP} AND token < 4) AS held FROM r GROUP BY vec_id, label)
        SELECT label, count(*) FILTER (held = 4) AS n_kept, count(*) AS n_trials FROM c GROUP BY label""",
    "mass_on_deck_tokens": f"""WITH {_LOGS}, s AS (SELECT label, avg(list_sum(list_transform(logs[1:4], lambda x: exp(x)))) AS m, count(*) AS n FROM t GROUP BY label)
        SELECT count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_trials, round(avg(m), 9) AS mean_of_session_means FROM s""",
    "two_nll_definitions": f"""WITH {_LOGS}, a AS (SELECT label, logs[1:vec_id % 3 + 1] AS x FROM t), s AS (SELECT label, -list_sum(x) AS s, len(x) AS n FROM a)
        SELECT label, round(avg(s), 9) AS nll_by_trial, round(sum(s) / sum(n), 9) AS nll_by_token, count(*) AS n_trials, CAST(sum(n) AS BIGINT) AS n_tokens FROM s GROUP BY label""",
    "kfold_assignment": f"""WITH {_FOLDS} SELECT experiment, participant, fold, group_size FROM f""",
    "kfold_status": f"""WITH {_FOLDS},
        h AS (SELECT experiment, fold, count(*) AS n_held, any_value(group_size) AS n, sum(CAST('0x' || substr(md5(participant), 1, 8) AS BIGINT)) AS m1, sum(CAST('0x' || substr(md5(participant), 9, 8) AS BIGINT)) AS m9 FROM f GROUP BY 1, 2),
        w AS (SELECT *, sum(m1) OVER (PARTITION BY experiment) AS a1, sum(m9) OVER (PARTITION BY experiment) AS a9 FROM h)
        SELECT experiment, fold, n_held, m1 || '-' || m9 AS eval_members, (a1 - m1) || '-' || (a9 - m9) AS train_members,
               CASE WHEN n - n_held < 2 THEN 'excluded_tiny_train' WHEN n < 25 THEN 'tiny_cohort' WHEN n - n_held < 10 THEN 'low_train' ELSE 'ok' END AS status FROM w""",
    "dual_metric_contrast": """WITH v AS (SELECT label, label % 4 AS chosen, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
        b AS (SELECT label, chosen, 'sharp' AS model, s FROM v UNION ALL SELECT label, chosen, 'flat', list_transform(s, lambda x: x / 2) FROM v),
        z AS (SELECT *, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS z FROM b),
        e AS (SELECT label, model, ln(list_sum(list_transform(s[1:4], lambda x: exp(x - z)))) - (s[chosen + 1] - z) AS renorm, z - s[chosen + 1] AS raw FROM z),
        m AS (SELECT label, avg(renorm) FILTER (model = 'sharp') - avg(renorm) FILTER (model = 'flat') AS renorm, avg(raw) FILTER (model = 'sharp') - avg(raw) FILTER (model = 'flat') AS raw FROM e GROUP BY label),
        d AS (SELECT 'renorm' AS metric, renorm AS delta FROM m UNION ALL SELECT 'raw', raw FROM m)
        SELECT metric, count(*) AS n, round(avg(delta), 9) AS delta_mean, round(stddev_samp(delta), 9) AS delta_sd, round(avg(delta) / stddev_samp(delta), 9) AS d, round(avg(delta) / stddev_samp(delta) * sqrt(count(*)), 9) AS t FROM d GROUP BY metric""",
}
