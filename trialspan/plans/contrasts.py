"""Queries on session likelihoods and paired contrasts, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from trialspan.functions.numbers import finite, sd_or_zero
from trialspan.functions.text import last_part, one_spelling, study_of
from trialspan.operators import gates, resume, scores as S, statistics as X
from trialspan.runtime import table
from trialspan.sources import readers

MODELS = ["centra70", "base70", "lora_igt", "lora_noise", "lora_irrelevant", "randominit"]
CONTRASTS = [("centra_base", "centra70", "base70"), ("igt_noise", "lora_igt", "lora_noise"), ("igt_irrelevant", "lora_igt", "lora_irrelevant"), ("base_random", "base70", "randominit")]
PARTITIONS = {"A": ["igt_brastolen2018"], "B": ["igt_sorvane2022_retest"]}
OTHER = "C"
REPLICATES = 10_000
FLOOR = [(f"{m}_randominit", m, "randominit") for m in ("centra70", "lora_igt", "lora_noise")]
#: studies whose parts count as one
ONE_STUDY = {"igt_brastolen2018": "Brastolen 2018", "igt_quenmar2016": "Quenmar 2016"}

# --- SQL that several queries share -----------------------------------------------------------------------------------

KEY = "regexp_replace(lower(trim(experiment)), '[-\\s]+', '_', 'g')"
STUDY = "coalesce(nullif(regexp_extract(experiment, '^((?:igt_)?[a-z]+[0-9]{4})', 1), ''), experiment)"
PART = "CASE WHEN starts_with(experiment, 'igt_brastolen2018') THEN 'A' WHEN starts_with(experiment, 'igt_sorvane2022_retest') THEN 'B' ELSE 'C' END"
SCORES = f"""scores AS (
    SELECT model, prompt_id, coalesce({KEY}, 'unknown') AS experiment, nll, n_answer_tokens, n_answer_spans FROM (
        SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at DESC NULLS LAST, n_answer_tokens DESC NULLS LAST, nll DESC NULLS LAST) AS nth FROM session_nll)
    WHERE nth = 1 AND nll IS NOT NULL AND isfinite(nll))"""
WIDE = SCORES + ", wide AS (SELECT prompt_id, max(experiment) AS experiment, " + ", ".join(f"max(nll) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM scores GROUP BY prompt_id)"
DELTAS = WIDE + ", deltas AS (" + " UNION ALL ".join(f"SELECT '{n}' AS contrast, prompt_id, experiment, {a} - {b} AS delta FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for n, a, b in CONTRASTS) + ")"
PARTED = DELTAS + f", parted AS (SELECT contrast, prompt_id, experiment, delta, {PART} AS partition FROM deltas), both_ AS (SELECT * FROM parted UNION ALL SELECT contrast, prompt_id, experiment, delta, 'COMBINED' FROM parted)"
SUMS = DELTAS + f""", clustered AS (SELECT contrast, {STUDY} AS study, delta FROM deltas),
    moments AS (SELECT contrast, study, count(*) AS n, avg(delta) AS m, var_pop(delta) AS v FROM clustered GROUP BY contrast, study),
    centred AS (SELECT *, sum(n * m) OVER (PARTITION BY contrast) / sum(n) OVER (PARTITION BY contrast) AS centre FROM moments),
    sums AS (SELECT contrast, study, n, n * (m - centre) AS s1, n * (v + (m - centre) * (m - centre)) AS s2, m, centre FROM centred)"""


def _d(n: str, s1: str, s2: str) -> str:
    variance = f"(({s2}) - ({s1}) * ({s1}) / ({n})) / nullif(({n}) - 1, 0)"
    return f"CASE WHEN ({n}) > 1 AND {variance} > 1e-18 THEN (centre + ({s1}) / ({n})) / sqrt({variance}) END"


# --- queries ----------------------------------------------------------------------------------------------------------


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_scores(table(spark, sf, "session_nll"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return S.wide_scores(_scores(spark, sf), MODELS)


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    return S.paired_deltas(_wide(spark, sf), CONTRASTS)


def _parted(df: DataFrame) -> DataFrame:
    return S.with_combined(df.withColumn("partition", S.partition_of(F.col("experiment"), PARTITIONS, OTHER)))


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    return X.cluster_moments(S.study_column(_deltas(spark, sf)), ["contrast"], "study")


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def paired_contrast_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    out = S.paired_summary(_parted(_deltas(spark, sf)), ["contrast", "partition"])
    return _rounded(out, "delta_mean", "delta_sd", "share_below", "d", "t")


def paired_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.with_p_values(paired_contrast_by_partition(spark, sf)), "p_less", "p_greater", "p_magnitude", digits=9)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.bonferroni(paired_p_values(spark, sf).where("partition = 'COMBINED'"))
    return rows.select("contrast", "n", "d", "p_less", "alpha_family", (F.col("p_less") < F.col("alpha_family")).alias("holds_in_family"), X.verdict(F.col("d"), F.col("p_less")).alias("verdict"))


def bonferroni_family(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.bonferroni(paired_contrast_by_partition(spark, sf)).select("contrast", "partition", "n", "d", "alpha_family"), "alpha_family", digits=9)


def absolute_nll(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parted(_scores(spark, sf)).groupBy("model", "partition").agg(F.count("nll").alias("n"), F.avg("nll").alias("mean"), sd_or_zero(F.col("nll")).alias("sd"))
    return _rounded(rows, "mean", "sd")


def absolute_nll_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parted(_scores(spark, sf)).groupBy("model").pivot("partition", ["A", "B", "C", "COMBINED"]).agg(F.count("nll").alias("n"), F.round(F.avg("nll"), 9).alias("mean"), F.round(sd_or_zero(F.col("nll")), 9).alias("sd"))
    return rows.select("model", *[F.coalesce(f"{p}_n", F.lit(0)).alias(f"n_{p}") for p in ("A", "B", "C", "COMBINED")], *[F.col(f"{p}_{x}").alias(f"{x}_{p}") for p in ("A", "B", "C", "COMBINED") for x in ("mean", "sd")])


def contrast_missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _wide(spark, sf).withColumn("partition", S.partition_of(F.col("experiment"), PARTITIONS, OTHER))
    return S.coverage(S.with_combined(rows), CONTRASTS, ["partition"])


def same_sessions_intersection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _wide(spark, sf).dropna(subset=MODELS)
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 9).alias(f"mean_{m}") for m in MODELS])


def study_remap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by study of origin: the mapped cohort of a participant overrides the session's own experiment, and two studies count as one each."""
    m = table(spark, sf, "session_manifest").select("subject_id", F.coalesce(one_spelling(F.col("experiment")), F.lit("unknown")).alias("experiment"))
    return S.remapped(m, table(spark, sf, "cohort_mapping"), "subject_id", "sid", "igt_mapped_").withColumn("study", S.collapsed(F.col("origin"), ONE_STUDY)).groupBy("study").agg(
        F.count("*").alias("n_sessions"), F.count(F.when(F.col("mapped"), 1)).alias("n_mapped"), F.countDistinct("experiment").alias("n_experiments"))


def alias_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Label maps looked up by experiment and id: by the whole id, else by its last part."""
    m = table(spark, sf, "session_manifest").where("subject_id IS NOT NULL").withColumn("experiment", one_spelling(F.col("experiment"))).where("experiment IS NOT NULL")
    maps = S.alias_maps(m, "experiment", "subject_id", "deck_map", ["loaded_at", "row_id"])
    probes = m.select("row_id", "experiment", F.explode(F.array("subject_id", last_part(F.col("subject_id")))).alias("id"))
    return probes.join(maps, ["experiment", "id"], "left").select("row_id", "id", "by", "deck_map")


def positional_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of one order joined by their places: the ids of a model's latest scores, and their likelihoods."""
    rows = _scores(spark, sf).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("prompt_id", "nll"))).alias("l"))
    ids, values = rows.select("model", F.posexplode("l.prompt_id").alias("pos", "prompt_id")), rows.select("model", F.posexplode("l.nll").alias("pos", "nll"))
    out = readers.positional(ids.where("model = 'centra70'").drop("model"), values.where("model = 'centra70'").drop("model"))
    return out.select("pos", "prompt_id", F.round("nll", 9).alias("nll"))


def floor_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Trained models against the random one, each at the whole alpha, beside the family."""
    out = X.floor_checks(S.paired_summary(S.paired_deltas(_wide(spark, sf), FLOOR), ["contrast"]))
    return _rounded(out, "delta_mean", "delta_sd", "share_below", "d", "t", "p_greater", "p_less", "p_magnitude")


def study_effect_interval(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.cluster_effect_interval(_moments(spark, sf), ["contrast"], "study", REPLICATES), "mean_of_means", "sd_of_means", "d_clusters", "low", "high")


def loeo_effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.leave_one_out(_moments(spark, sf), ["contrast"], "study"), "d_all", "d_without")


def loeo_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = X.leave_one_out_summary(X.leave_one_out(_moments(spark, sf), ["contrast"], "study"), ["contrast"], "study")
    return _rounded(out, "d_median", "d_min", "d_max")


def study_aggregated_d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.cluster_effect(_moments(spark, sf), ["contrast"]), "mean_of_means", "sd_of_means", "d_clusters")


def cluster_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.cluster_bootstrap(_moments(spark, sf), ["contrast"], "study", REPLICATES), "low", "high")


def cluster_bootstrap_exact(spark: SparkSession, sf: str) -> DataFrame:
    return X.cluster_bootstrap(_moments(spark, sf), ["contrast"], "study", REPLICATES, draws="exact")


def session_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.session_bootstrap(_deltas(spark, sf), ["contrast"], REPLICATES), "low", "high")


def sign_flip_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.sign_flip(_deltas(spark, sf), ["contrast"], REPLICATES), "p")


def exact_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return X.exact_resampling(_deltas(spark, sf), ["contrast"], REPLICATES)


def cache_difference_diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "session_nll").where(finite(F.col("nll")))
    by = rows.groupBy("model", "prompt_id").agg(F.count("*").alias("n"), F.max_by("nll", F.struct("scored_at", "nll")).alias("last"), F.min_by("nll", F.struct("scored_at", "nll")).alias("first"))
    again = by.where("n > 1").withColumn("x", F.col("last") - F.col("first"))
    out = again.groupBy("model").agg(F.count("*").alias("n_again"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("sd"), F.count(F.when(F.abs("x") > 1e-4, 1)).alias("n_differing"))
    return _rounded(out, "least", "most", "mean", "median", "sd")


def canonical_cell_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the latest scores against a table of the first ones: the same, different, or in one table only."""
    first = S.last_wins(table(spark, sf, "session_nll"), ["model", "prompt_id"], [F.col("scored_at").asc_nulls_last(), F.col("n_answer_tokens").asc_nulls_last(), F.col("nll").asc_nulls_last()])
    first = first.where(finite(F.col("nll"))).withColumn("experiment", F.coalesce(one_spelling(F.col("experiment")), F.lit("unknown"))).where("model <> 'randominit'")
    cells = [df.groupBy("model", "experiment").agg(F.avg("nll").alias("v")) for df in (_scores(spark, sf).where("model <> 'lora_noise'"), first)]
    return X.compare_cells(*cells, ["model", "experiment"], "v", 1e-9).select("model", "experiment", "state")


def last_wins_fusion(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "session_nll").select("model", "prompt_id", "nll", "scored_at")
    early, late = raw.where("scored_at < timestamp'2024-07-01'"), raw.where("scored_at >= timestamp'2024-07-01'")
    one = lambda df: df.groupBy("model", "prompt_id").agg(F.max_by("nll", F.struct("scored_at", "nll")).alias("nll"))
    return _rounded(resume.fused(one(early), one(late), ["model", "prompt_id"]), "nll")


def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    work = table(spark, sf, "session_manifest").select("prompt_id").where("prompt_id IS NOT NULL").distinct()
    work = work.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return resume.to_do(work, _scores(spark, sf), ["model", "prompt_id"]).groupBy("model").agg(F.count("*").alias("n_left"))


def model_coverage(spark: SparkSession, sf: str) -> DataFrame:
    keep = table(spark, sf, "session_manifest").select("prompt_id").where("prompt_id IS NOT NULL")
    return gates.full_coverage(keep, _scores(spark, sf), "prompt_id", "model")


def likelihood_by_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scores(spark, sf).where("n_answer_tokens > 0").groupBy("model", "experiment")
    out = rows.agg(F.count("*").alias("n"), F.avg("nll").alias("mean_of_sessions"), (F.sum(F.col("nll") * F.col("n_answer_tokens")) / F.sum("n_answer_tokens")).alias("mean_of_tokens"), F.sum("n_answer_tokens").alias("n_tokens"))
    return _rounded(out, "mean_of_sessions", "mean_of_tokens")


def run_index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "session_nll").groupBy("model", F.date_format("scored_at", "yyyy-MM").alias("run_id")).agg(F.count("*").alias("n"))
    old = runs.where("run_id < '2024-10'").select(F.concat_ws("/", "model", "run_id").alias("run_id"), "n")
    new = runs.where("run_id >= '2024-07'").select(F.concat_ws("/", "model", "run_id").alias("run_id"), (F.col("n") * 2).alias("n"))
    return resume.upsert(old, new, "run_id")


QUERIES = {
    f.__name__: f
    for f in (
        paired_contrast_by_partition, paired_p_values, verdicts, bonferroni_family, absolute_nll, absolute_nll_pivot, contrast_missing_counts,
        same_sessions_intersection, study_remap_counts, alias_key_lookup, positional_scores, floor_checks, study_effect_interval, loeo_effect_sizes, loeo_summary, study_aggregated_d, cluster_bootstrap_ci, cluster_bootstrap_exact,
        session_bootstrap_ci, sign_flip_pvalue, exact_resampling, cache_difference_diagnostic, canonical_cell_validation, last_wins_fusion, resume_todo,
        model_coverage, likelihood_by_tokens, run_index_upsert,
    )
}

_SUMMARY = f"""{PARTED}, s AS (
    SELECT contrast, partition, count(delta) AS n, avg(delta) AS m, CASE WHEN count(delta) = 1 THEN 0.0 ELSE stddev_samp(delta) END AS sd, avg(CAST(delta < 0 AS DOUBLE)) AS below FROM both_ GROUP BY contrast, partition)"""
_SD = "CASE WHEN count(nll) = 1 THEN 0.0 ELSE stddev_samp(nll) END"
_CELLS = f"{SCORES}, cells AS (SELECT model, nll, {PART} AS partition FROM scores), both_ AS (SELECT * FROM cells UNION ALL SELECT model, nll, 'COMBINED' FROM cells)"
_LOO = f"""{SUMS}, rest AS (
    SELECT contrast, study, n, centre, sum(n) OVER w AS an, sum(s1) OVER w AS a1, sum(s2) OVER w AS a2, s1, s2 FROM sums WINDOW w AS (PARTITION BY contrast)),
    loo AS (SELECT contrast, study, n AS n_left_out, {_d("an", "a1", "a2")} AS d_all, {_d("an - n", "a1 - s1", "a2 - s2")} AS d_without FROM rest)"""
_DRAW = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"
_PARTS = ("A", "B", "C", "COMBINED")
_STEP = "xor({0}, {0} >> 16)"
_HASHED = f"""h0 AS (SELECT contrast, delta, r, (CAST('0x' || substr(md5(prompt_id), 1, 8) AS BIGINT) + ((r + {X.SEED}) % 4294967296) * {X._GOLDEN} % 4294967296) % 4294967296 AS x FROM deltas, range({REPLICATES}) a(r)),
    h1 AS (SELECT contrast, delta, r, {_STEP.format('x')} * {X._MIX} % 4294967296 AS x FROM h0), h2 AS (SELECT contrast, delta, r, {_STEP.format('x')} * {X._MIX} % 4294967296 AS x FROM h1),
    drawn AS (SELECT contrast, delta, r, {_STEP.format('x')} AS x FROM h2)"""
# P(T > t): half of all less the integral of the density from 0 to t, by Simpson's rule
_T_UPPER = """0.5 - sign(t) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * (least(abs(t), 60.0) / 6000) * list_sum(list_transform(range(0, 6001),
    lambda i: (CASE WHEN i = 0 OR i = 6000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 3.0 * pow(1 + pow(least(abs(t), 60.0) * i / 6000, 2) / df, -(df + 1) / 2.0)))"""

SQL = {
    "paired_contrast_by_partition": f"""WITH {_SUMMARY}
        SELECT contrast, partition, n, round(m, 9) AS delta_mean, round(sd, 9) AS delta_sd, round(below, 9) AS share_below, round(CASE WHEN sd > 0 THEN m / sd END, 9) AS d,
               round(CASE WHEN sd > 0 THEN m / sd END * sqrt(n), 9) AS t, n - 1 AS df FROM s""",
    "bonferroni_family": f"WITH {_SUMMARY} SELECT contrast, partition, n, round(CASE WHEN sd > 0 THEN m / sd END, 9) AS d, round(0.05 / nullif(count(CASE WHEN sd > 0 THEN 1 END) OVER (), 0), 9) AS alpha_family FROM s",
    "absolute_nll": f"WITH {_CELLS} SELECT model, partition, count(nll) AS n, round(avg(nll), 9) AS mean, round({_SD}, 9) AS sd FROM both_ GROUP BY model, partition",
    "absolute_nll_pivot": f"WITH {_CELLS} SELECT model, " + ", ".join(f"count(nll) FILTER (partition = '{p}') AS n_{p}, round(avg(nll) FILTER (partition = '{p}'), 9) AS mean_{p}, round(CASE WHEN count(nll) FILTER (partition = '{p}') = 1 THEN 0.0 ELSE stddev_samp(nll) FILTER (partition = '{p}') END, 9) AS sd_{p}" for p in _PARTS) + " FROM both_ GROUP BY model",
    "contrast_missing_counts": f"WITH {WIDE}, p AS (SELECT *, {PART} AS partition FROM wide), b AS (SELECT * FROM p UNION ALL SELECT * REPLACE ('COMBINED' AS partition) FROM p) "
    + " UNION ALL ".join(f"SELECT '{n}' AS contrast, partition, count(*) AS n_sessions, count(*) FILTER ({a} IS NULL) AS n_missing_a, count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS n_missing_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_paired FROM b GROUP BY partition" for n, a, b in CONTRASTS),
    "same_sessions_intersection": f"WITH {WIDE} SELECT count(*) AS n, " + ", ".join(f"round(avg({m}), 9) AS mean_{m}" for m in MODELS) + " FROM wide WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MODELS),
    "study_remap_counts": f"""WITH e AS (SELECT subject_id, coalesce({KEY}, 'unknown') AS experiment FROM session_manifest),
        c AS (SELECT sid, cohort, count(*) AS n FROM cohort_mapping WHERE sid IS NOT NULL AND cohort IS NOT NULL AND lower(trim(cohort)) NOT IN ('', 'unknown') GROUP BY 1, 2),
        b AS (SELECT sid, cohort FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, cohort DESC) AS nth FROM c) WHERE nth = 1),
        o AS (SELECT e.experiment, b.sid IS NOT NULL AS mapped, CASE WHEN b.sid IS NOT NULL THEN 'igt_mapped_' || b.cohort ELSE e.experiment END AS origin FROM e LEFT JOIN b ON e.subject_id = b.sid)
        SELECT CASE WHEN starts_with(origin, 'igt_brastolen2018') THEN 'Brastolen 2018' WHEN starts_with(origin, 'igt_quenmar2016') THEN 'Quenmar 2016' ELSE regexp_replace(origin, '^igt_', '') END AS study,
               count(*) AS n_sessions, count(*) FILTER (mapped) AS n_mapped, count(DISTINCT experiment) AS n_experiments FROM o GROUP BY 1""",
    "alias_key_lookup": f"""WITH m AS (SELECT row_id, {KEY} AS experiment, subject_id, list_last(string_split(subject_id, '_')) AS tail, deck_map, loaded_at FROM session_manifest WHERE subject_id IS NOT NULL AND experiment IS NOT NULL),
        w AS (SELECT experiment, subject_id AS id, deck_map FROM (SELECT *, row_number() OVER (PARTITION BY experiment, subject_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS nth FROM m) WHERE nth = 1),
        a AS (SELECT experiment, tail AS id, deck_map FROM (SELECT *, row_number() OVER (PARTITION BY experiment, tail ORDER BY loaded_at NULLS FIRST, row_id) AS nth FROM m WHERE contains(subject_id, '_')) WHERE nth = 1),
        k AS (SELECT *, 'id' AS by FROM w UNION ALL SELECT *, 'alias' FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.experiment = a.experiment AND w.id = a.id)),
        p AS (SELECT row_id, experiment, subject_id AS id FROM m UNION ALL SELECT row_id, experiment, tail FROM m)
        SELECT p.row_id, p.id, k.by, k.deck_map FROM p LEFT JOIN k USING (experiment, id)""",
    "positional_scores": f"WITH {SCORES} SELECT CAST(row_number() OVER (ORDER BY prompt_id) - 1 AS INTEGER) AS pos, prompt_id, round(nll, 9) AS nll FROM scores WHERE model = 'centra70'",
    "floor_checks": f"""WITH {WIDE}, d AS ({" UNION ALL ".join(f"SELECT '{n}' AS contrast, {a} - {b} AS delta FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for n, a, b in FLOOR)}),
        s AS (SELECT contrast, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS sd, avg(CAST(delta < 0 AS DOUBLE)) AS below FROM d GROUP BY contrast),
        t AS (SELECT *, m / sd AS d, m / sd * sqrt(n) AS t, n - 1 AS df FROM s), p AS (SELECT *, {_T_UPPER} AS p FROM t)
        SELECT contrast, n, round(m, 9) AS delta_mean, round(sd, 9) AS delta_sd, round(below, 9) AS share_below, round(d, 9) AS d, round(t, 9) AS t, df, round(p, 9) AS p_greater, round(1 - p, 9) AS p_less, round(least(p, 1 - p), 9) AS p_magnitude,
               CAST(0.05 AS DOUBLE) AS alpha, 1 - p < 0.05 AS holds FROM p""",
    "paired_p_values": f"""WITH {_SUMMARY}, t AS (SELECT *, CASE WHEN sd > 0 THEN round(m / sd * sqrt(n), 9) END AS t, n - 1 AS df FROM s), p AS (SELECT *, CASE WHEN t IS NULL OR df < 1 THEN NULL ELSE {_T_UPPER} END AS p FROM t)
        SELECT contrast, partition, n, round(m, 9) AS delta_mean, round(sd, 9) AS delta_sd, round(below, 9) AS share_below, round(CASE WHEN sd > 0 THEN m / sd END, 9) AS d, t, df, round(p, 9) AS p_greater, round(1 - p, 9) AS p_less, round(least(p, 1 - p), 9) AS p_magnitude FROM p""",
    "verdicts": f"""WITH {_SUMMARY}, t AS (SELECT *, CASE WHEN sd > 0 THEN round(m / sd, 9) END AS d, CASE WHEN sd > 0 THEN round(m / sd * sqrt(n), 9) END AS t, n - 1 AS df FROM s WHERE partition = 'COMBINED'),
        p AS (SELECT *, CASE WHEN t IS NULL OR df < 1 THEN NULL ELSE round(1 - ({_T_UPPER}), 9) END AS p_less, 0.05 / nullif(count(d) OVER (), 0) AS alpha_family FROM t)
        SELECT contrast, n, d, p_less, alpha_family, p_less < alpha_family AS holds_in_family, CASE WHEN d < -0.1 AND p_less < 0.05 THEN 'win' WHEN abs(d) < 0.1 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM p""",
    "study_effect_interval": f"""WITH {SUMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY study) - 1 AS pos, count(*) OVER (PARTITION BY contrast) AS c FROM sums),
        draws AS (SELECT contrast, r, k, {_DRAW.format(f"'{X.SEED}:' || r || ':' || k")} % c AS pick FROM (SELECT DISTINCT contrast, c FROM ranked) g, range({REPLICATES}) a(r), range(200) b(k) WHERE k < c),
        pooled AS (SELECT d.contrast, d.r, avg(s.m) AS mean, stddev_samp(s.m) AS sd FROM draws d JOIN ranked s ON s.contrast = d.contrast AND s.pos = d.pick GROUP BY d.contrast, d.r),
        q AS (SELECT contrast, CAST(count(*) AS INTEGER) AS n_replicates, round(quantile_cont(mean / sd, 0.025), 9) AS low, round(quantile_cont(mean / sd, 0.975), 9) AS high FROM pooled WHERE sd > 1e-12 GROUP BY contrast)
        SELECT contrast, count(*) AS n_clusters, round(avg(m), 9) AS mean_of_means, round(stddev_samp(m), 9) AS sd_of_means, count(*) FILTER (m < 0) AS n_below,
        round(CASE WHEN stddev_samp(m) > 0 THEN avg(m) / stddev_samp(m) END, 9) AS d_clusters, any_value(n_replicates) AS n_replicates, any_value(low) AS low, any_value(high) AS high FROM sums LEFT JOIN q USING (contrast) GROUP BY contrast""",
    "loeo_effect_sizes": f"WITH {_LOO} SELECT contrast, study, n_left_out, round(d_all, 9) AS d_all, round(d_without, 9) AS d_without FROM loo",
    "loeo_summary": f"""WITH {_LOO}, r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY abs(d_without - d_all) DESC NULLS LAST, study) AS nth FROM loo)
        SELECT contrast, count(d_without) AS n_clusters, round(median(d_without), 9) AS d_median, round(min(d_without), 9) AS d_min, round(max(d_without), 9) AS d_max,
               count(*) FILTER (sign(d_without) = sign(d_all)) AS n_same_sign, max(study) FILTER (nth = 1) AS most_influential FROM r GROUP BY contrast""",
    "study_aggregated_d": f"""WITH {SUMS} SELECT contrast, count(*) AS n_clusters, round(avg(m), 9) AS mean_of_means, round(stddev_samp(m), 9) AS sd_of_means, count(*) FILTER (m < 0) AS n_below,
        round(CASE WHEN stddev_samp(m) > 0 THEN avg(m) / stddev_samp(m) END, 9) AS d_clusters FROM sums GROUP BY contrast""",
    "cluster_bootstrap_ci": f"""WITH {SUMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY study) - 1 AS pos, count(*) OVER (PARTITION BY contrast) AS c FROM sums),
        draws AS (SELECT contrast, r, k, {_DRAW.format(f"'{X.SEED}:' || r || ':' || k")} % c AS pick FROM (SELECT DISTINCT contrast, c FROM ranked) g, range({REPLICATES}) a(r), range(200) b(k) WHERE k < c),
        pooled AS (SELECT d.contrast, d.r, sum(s.n) AS n, sum(s.s1) AS s1, sum(s.s2) AS s2, any_value(s.centre) AS centre FROM draws d JOIN ranked s ON s.contrast = d.contrast AND s.pos = d.pick GROUP BY d.contrast, d.r),
        e AS (SELECT contrast, {_d("n", "s1", "s2")} AS d FROM pooled),
        o AS (SELECT contrast, d, row_number() OVER (PARTITION BY contrast ORDER BY d) - 1 AS idx, count(*) OVER (PARTITION BY contrast) AS n FROM e WHERE d IS NOT NULL)
        SELECT contrast, CAST(any_value(n) AS INTEGER) AS n_replicates, round(max(d) FILTER (idx = least(floor(n * 0.025), n - 1)), 9) AS low, round(max(d) FILTER (idx = least(floor(n * 0.975), n - 1)), 9) AS high FROM o GROUP BY contrast""",
    "sign_flip_pvalue": f"""WITH {DELTAS}, {_HASHED}, f AS (SELECT contrast, r, sum(delta * (1 - 2 * (x % 2))) AS flipped FROM drawn GROUP BY contrast, r), o AS (SELECT contrast, sum(delta) AS observed FROM deltas GROUP BY contrast)
        SELECT contrast, CAST(count(*) AS INTEGER) AS n_replicates, round(avg(CAST(CASE WHEN observed < 0 THEN flipped <= observed + 1e-9 ELSE flipped >= observed - 1e-9 END AS DOUBLE)), 9) AS p FROM f JOIN o USING (contrast) GROUP BY contrast""",
    "session_bootstrap_ci": f"""WITH {DELTAS}, {_HASHED}, w AS (SELECT contrast, r, delta, {" + ".join(f"CAST(x >= {p} AS INTEGER)" for p in X.POISSON)} AS w FROM drawn),
        m AS (SELECT contrast, r, sum(w * delta) / nullif(sum(w), 0) AS d FROM w GROUP BY contrast, r)
        SELECT contrast, CAST(count(d) AS INTEGER) AS n_replicates, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high FROM m GROUP BY contrast""",
    "cache_difference_diagnostic": """WITH f AS (SELECT * FROM session_nll WHERE nll IS NOT NULL AND isfinite(nll)),
        r AS (SELECT model, prompt_id, nll, row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at, nll) AS up, row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at DESC, nll DESC) AS down, count(*) OVER (PARTITION BY model, prompt_id) AS n FROM f),
        x AS (SELECT model, prompt_id, max(nll) FILTER (down = 1) - max(nll) FILTER (up = 1) AS x FROM r WHERE n > 1 GROUP BY model, prompt_id)
        SELECT model, count(*) AS n_again, round(min(x), 9) AS least, round(max(x), 9) AS most, round(avg(x), 9) AS mean, round(median(x), 9) AS median, round(stddev_samp(x), 9) AS sd, count(*) FILTER (abs(x) > 1e-4) AS n_differing FROM x GROUP BY model""",
    "canonical_cell_validation": f"""WITH {SCORES}, first AS (SELECT model, coalesce({KEY}, 'unknown') AS experiment, nll FROM (
            SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at NULLS LAST, n_answer_tokens NULLS LAST, nll NULLS LAST) AS nth FROM session_nll) WHERE nth = 1 AND nll IS NOT NULL AND isfinite(nll)),
        a AS (SELECT model, experiment, avg(nll) AS a FROM scores WHERE model <> 'lora_noise' GROUP BY 1, 2), b AS (SELECT model, experiment, avg(nll) AS b FROM first WHERE model <> 'randominit' GROUP BY 1, 2)
        SELECT coalesce(a.model, b.model) AS model, coalesce(a.experiment, b.experiment) AS experiment,
               CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' WHEN abs(a - b) <= 1e-9 THEN 'identical' ELSE 'different' END AS state FROM a FULL JOIN b ON a.model = b.model AND a.experiment = b.experiment""",
    "last_wins_fusion": """WITH r AS (SELECT model, prompt_id, nll, row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at >= TIMESTAMP '2024-07-01' DESC, scored_at DESC, nll DESC NULLS LAST) AS nth FROM session_nll WHERE scored_at IS NOT NULL)
        SELECT model, prompt_id, round(nll, 9) AS nll FROM r WHERE nth = 1""",
    "resume_todo": f"WITH {SCORES}, w AS (SELECT DISTINCT prompt_id FROM session_manifest WHERE prompt_id IS NOT NULL), m AS (SELECT unnest([{', '.join(repr(m) for m in MODELS)}]) AS model) "
    "SELECT model, count(*) AS n_left FROM m, w WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.model = m.model AND s.prompt_id = w.prompt_id) GROUP BY model",
    "model_coverage": f"""WITH {SCORES}, w AS (SELECT DISTINCT prompt_id FROM session_manifest WHERE prompt_id IS NOT NULL), n AS (SELECT count(*) AS n FROM w),
        h AS (SELECT model, count(DISTINCT CASE WHEN prompt_id IN (SELECT prompt_id FROM w) THEN prompt_id END) AS held FROM scores GROUP BY model)
        SELECT model, n AS n_wanted, n - held AS n_missing, n = held AS covers_all FROM h, n""",
    "likelihood_by_tokens": f"""WITH {SCORES} SELECT model, experiment, count(*) AS n, round(avg(nll), 9) AS mean_of_sessions, round(sum(nll * n_answer_tokens) / sum(n_answer_tokens), 9) AS mean_of_tokens,
        CAST(sum(n_answer_tokens) AS BIGINT) AS n_tokens FROM scores WHERE n_answer_tokens > 0 GROUP BY model, experiment""",
    "run_index_upsert": """WITH r AS (SELECT model, strftime(scored_at, '%Y-%m') AS m, count(*) AS n FROM session_nll GROUP BY 1, 2)
        SELECT concat_ws('/', model, m) AS run_id, CASE WHEN m >= '2024-07' THEN n * 2 ELSE n END AS n FROM r WHERE m IS NOT NULL""",
}
