"""Queries on sessions' texts and corpora, each with the SQL that states it where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspan.functions import text as T
from trialspan.operators import answers as A, corpus as K, gates, masks, prompts as P
from trialspan.operators.scores import last_wins
from trialspan.runtime import table
from trialspan.sources import readers, writers

SCIENCE = ["learning", "likelihood", "model", "token", "schedule", "aprendizaje", "modelo"]
BLOCKED = ["server", "servidor", "access denied", "javascript", "filler"]
BUDGET, CHUNK_TOKENS, TAIL = 200_000, 512, 10


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "session_manifest")


def _fingerprint(trim_last: bool):
    kept = F.slice("trials", 1, F.greatest(F.size("trials") - int(trim_last), F.lit(0)))
    pair = lambda t: F.concat_ws(":", F.round(t["gain"] * 100).cast("long").cast("string"), F.round(t["loss"] * 100).cast("long").cast("string"))
    return F.sha2(F.array_join(F.transform(kept, pair), ";"), 256)


def fingerprint_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _manifest(spark, sf).where("size(trials) > 1")
    held = rows.where("lower(trim(split)) <> 'train'").select(_fingerprint(True).alias("fp")).union(rows.where("lower(trim(split)) <> 'train'").select(_fingerprint(False).alias("fp"))).distinct()
    train = rows.where("lower(trim(split)) = 'train'").select("row_id", "prompt_id", _fingerprint(False).alias("fp"))
    return train.join(held, "fp", "left_semi").select("row_id", "prompt_id", "fp")


def retest_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _manifest(spark, sf).select("row_id", "prompt_id", T.one_spelling(F.col("experiment")).alias("experiment"))
    again = rows.where(F.contains("experiment", F.lit("_retest"))).select("row_id")
    return rows.join(again, "row_id", "left_anti").groupBy("experiment").agg(F.count("*").alias("n"))


def blocklist_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corpus(spark, sf)
    reason = K.reject_reason([("task", K.of_task(F.col("experiment"), F.col("text"))), ("blank", K.blank(F.col("text")))])
    return rows.withColumn("reason", F.coalesce(reason, F.lit("kept"))).groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(T.approx_tokens(F.col("text"))), F.lit(0)).alias("n_tokens"))


def allowlist_reason_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    title, body = F.split("text", "\n", 2)[0], F.substring("text", 1, 600)
    hit = F.coalesce(T.first_word(title, SCIENCE), T.first_word(body, SCIENCE))
    where = F.when(T.first_word(title, SCIENCE).isNotNull(), "title").when(T.first_word(body, SCIENCE).isNotNull(), "body")
    blocked = T.first_phrase(F.substring("text", 1, 12000), BLOCKED)
    reason = K.reject_reason([("too_short", F.length("text") < 800), ("allowlist_miss", hit.isNull()), ("blocklist_hit", blocked.isNotNull())])
    return rows.select("doc_id", reason.alias("reason"), hit.alias("term"), where.alias("found_in"), blocked.alias("blocked_by"))


def rejected_counts(spark: SparkSession, sf: str) -> DataFrame:
    return allowlist_reason_chain(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def budgeted_prefix_hash_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", T.approx_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    kept = K.budget_prefix(rows, K.hash_order(F.col("doc_id").cast("string"), "v1"), "doc_id", F.col("n_tokens"), BUDGET)
    return kept.select("doc_id", "n_tokens", "position", "total_before")


def sentence_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", F.filter(T.sentences(F.coalesce("text", F.lit(""))), lambda s: s != "").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.sentence_chunks(_documents(spark, sf).select("doc_id", "text"), "text")
    return rows.select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"), K.wrapped("Text: ", F.col("chunk")).alias("record"))


def marker_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corpus(spark, sf).select("row_id", F.posexplode(T.span_texts(F.coalesce("text", F.lit("")))).alias("trial_index", "target_text"))
    return rows.groupBy("row_id").agg(F.count("*").alias("n_spans"), F.max("trial_index").alias("last_index"), F.max_by("target_text", "trial_index").alias("last_target"))


def span_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _corpus(spark, sf).select("row_id", T.marker_count(text).alias("n_markers"), T.span_count(text).alias("n_spans"), T.approx_tokens(text).alias("n_tokens_approx"))


def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select("row_id", F.explode(P.spans(F.col("text"))).alias("s")).select("row_id", "s.*")


def scanned_span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select("row_id", F.size(P.scanned_spans(F.col("text"))).alias("n_scanned"))


def marker_aware_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.marker_chunks(_corpus(spark, sf).select("row_id", "text"), "text", CHUNK_TOKENS)
    return rows.select("row_id", "chunk_idx", "n_chunks", "chunk_tokens", F.length("chunk").alias("n_chars"), T.span_count(F.col("chunk")).alias("n_answer_spans"))


def chunk_audit(spark: SparkSession, sf: str) -> DataFrame:
    return K.chunk_audit(K.marker_chunks(_corpus(spark, sf).select("row_id", "text"), "text", CHUNK_TOKENS), "row_id", "text", CHUNK_TOKENS)


def trainable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return marker_aware_chunks(spark, sf).where("n_answer_spans > 0").groupBy("row_id").agg(F.count("*").alias("n_trainable"))


def tail_choices_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).where("text IS NOT NULL").select("row_id", F.sha2(P.tail_of_choices(F.col("text"), TAIL), 256).alias("hash"), F.length(P.tail_of_choices(F.col("text"), TAIL)).alias("n_chars"))


def prediction_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = _corpus(spark, sf).select("row_id", P.prediction_prompt(F.col("text")).alias("p"), P.last_choice(F.col("text")).alias("target"))
    return rows.where("p IS NOT NULL").select("row_id", F.length("p").alias("n_chars"), F.sha2("p", 256).alias("hash"), "target")


def request_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return P.requests(_corpus(spark, sf).where("prompt_id IS NOT NULL")).select("prompt_id", "target", F.to_json("request").alias("request"))


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    rows = _manifest(spark, sf).select("row_id", P.rendered(F.col("trials"), P.label_list(F.col("deck_map"))).alias("text"))
    return rows.select("row_id", F.length("text").alias("n_chars"), T.marker_count(F.col("text")).alias("n_markers"))


def deck_relabel(spark: SparkSession, sf: str) -> DataFrame:
    ids = _manifest(spark, sf).select("subject_id").where("subject_id IS NOT NULL").distinct()
    return ids.select("subject_id", F.array_join(P.hashed_labels(F.col("subject_id")), "").alias("labels"))


def deck_relabel_seeded(spark: SparkSession, sf: str) -> DataFrame:
    ids = _manifest(spark, sf).select("subject_id").where("subject_id IS NOT NULL").distinct()
    return ids.select("subject_id", F.array_join(P.seeded_labels(F.col("subject_id")), "").alias("labels"))


def deck_labels_stored(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("row_id", F.array_join(P.label_list(F.col("deck_map")), "").alias("labels"))


def answer_mask_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = masks.answer_labels(_corpus(spark, sf), "row_id", "text")
    return rows.select("row_id", "n_tokens", "n_spans", F.size(F.filter("labels", lambda x: x != masks.IGNORED)).alias("n_answer_tokens"))


def collated_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.length(w)).alias("ids"))
    rows = rows.withColumn("labels", F.transform("ids", lambda x: F.when(x > 5, x).otherwise(masks.IGNORED)))
    out = masks.collate(rows.withColumn("pos", F.col("doc_id") - 1), "pos", "ids", "labels", 8)
    return out.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.max(F.size("input_ids")).alias("width"), F.min(F.size("input_ids")).alias("least_width"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_attended"))


def choice_extraction(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.substring_index(F.coalesce("text", F.lit("")), "\n", -1)
    return _corpus(spark, sf).select("row_id", T.choice_in(tail).alias("choice"))


def accuracy_by_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """The last choice of a text predicted by the one before it."""
    found = T.span_texts(F.coalesce("text", F.lit("")))
    rows = _corpus(spark, sf).select(T.one_spelling(F.col("experiment")).alias("experiment"), found.alias("s")).where("size(s) > 1")
    hit = (F.element_at("s", -1) == F.element_at("s", -2)).cast("int")
    return rows.groupBy("experiment").agg(F.count("*").alias("n"), F.sum(hit).alias("n_correct"), F.round(F.avg(hit), 9).alias("accuracy"))


def confusion_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = T.span_texts(F.coalesce("text", F.lit("")))
    rows = _corpus(spark, sf).select(found.alias("s")).where("size(s) > 1")
    return rows.groupBy(F.element_at("s", -1).alias("target"), F.element_at("s", -2).alias("predicted")).agg(F.count("*").alias("n"))


def corpus_length_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return _corpus(spark, sf).groupBy(T.one_spelling(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 9).alias("mean_chars"))


def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gates.prompt_summary(_corpus(spark, sf), "prompt_id", "text")


def missing_log_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.missing_logs(_manifest(spark, sf), "prompt_id", "trials")


def whitelist_ordered_join(spark: SparkSession, sf: str) -> DataFrame:
    listed = readers.ordered_ids(_manifest(spark, sf).where("prompt_id IS NOT NULL").groupBy(T.one_spelling(F.col("experiment")).alias("experiment")).agg(F.sort_array(F.collect_set("prompt_id")).alias("ids")), "ids")
    latest = last_wins(_corpus(spark, sf), ["prompt_id"], [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc()])
    return listed.join(latest.select("prompt_id", "row_id"), "prompt_id").select("pos", "prompt_id", "row_id")


def trial_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    rows = _manifest(spark, sf).where("size(trials) > 0").select("row_id", "prompt_id", F.posexplode("trials").alias("pos", "t"))
    return rows.groupBy("row_id").agg(F.count("*").alias("n_trials"), F.sum(F.when(F.col("pos") % 2 == 0, 1).otherwise(0)).alias("n_even"), F.max("pos").alias("last_pos"))


def corpus_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return writers.provenance(_corpus(spark, sf).select("row_id", "text"), "text", {"policy": "whole"}).select("n_texts", "n_chars", "shortest", "longest", F.round("mean_chars", 9).alias("mean_chars"))


def noise_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return K.noise_prompts(spark, 200, 20).select("prompt_id", T.span_count(F.col("text")).alias("n_spans"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers of a service in several shapes, made from the corpus: each text's last choice but one, as an answer to its last."""
    found = T.span_texts(F.coalesce("text", F.lit("")))
    rows = _corpus(spark, sf).select("row_id", T.one_spelling(F.col("experiment")).alias("experiment"), found.alias("s")).where("size(s) > 1")
    said = F.element_at("s", -2)
    shape = F.pmod("row_id", F.lit(4))
    answer = (
        F.when(shape == 0, F.to_json(F.struct(F.concat(F.lit(" "), said, F.lit(">> and so on")).alias("generated_text"), F.lit(-0.5).alias("logprob"))))
        .when(shape == 1, F.to_json(F.struct(F.lit(" ").alias("choice"), F.concat(F.lit("<<"), said).alias("text"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(F.lower(said).alias("text"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(said).alias("choices"), F.lit(-1).alias("log_probability"))))
    )
    return rows.select("row_id", "experiment", F.element_at("s", -1).alias("expected"), answer.alias("response"))


def trial_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.trial_rows(_responses(spark, sf), "row_id", "expected", "response")
    return rows.select("row_id", "experiment", "expected", "action", "reward", "correct", "tolerant", "logprob")


def trial_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and tolerant accuracy and mean reward, over all and by experiment."""
    return A.trial_metrics(trial_rows(spark, sf), "experiment").withColumns({c: F.round(c, 9) for c in ("accuracy", "tolerant_accuracy", "mean_reward")})


def full_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _manifest(spark, sf).select("row_id", P.full_prompt(F.col("trials"), P.label_list(F.col("deck_map")), 2000, F.coalesce("n_trials", F.size("trials")), "$").alias("text"))
    return rows.select("row_id", F.length("text").alias("n_chars"), F.contains("text", F.lit("loan of 2000$")).alias("states_loan"))


QUERIES = {
    f.__name__: f
    for f in (
        trial_rows, trial_metrics, full_prompts, fingerprint_semi_join, retest_anti_join, blocklist_filter, allowlist_reason_chain, rejected_counts, budgeted_prefix_hash_order, sentence_split_counts,
        sentence_chunks, marker_spans, span_counts, span_offsets, scanned_span_offsets, marker_aware_chunks, chunk_audit, trainable_chunks, tail_choices_compaction,
        prediction_prompt, request_payloads, prompt_render, deck_relabel, deck_relabel_seeded, deck_labels_stored, answer_mask_labels, collated_batches,
        choice_extraction, accuracy_by_experiment, confusion_rows, corpus_length_summary, validation_summary, missing_log_gate, whitelist_ordered_join,
        trial_ordinals, corpus_provenance, noise_corpus,
    )
}

KEY = "regexp_replace(lower(trim({0})), '[-\\s]+', '_', 'g')"
_EXP = KEY.format("experiment")
_FP = "sha256(array_to_string(list_transform({0}, lambda t: CAST(CAST(round(t.gain * 100) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(t.loss * 100) AS BIGINT) AS VARCHAR)), ';'))"
_TOK = "greatest(1, CAST(floor(length(coalesce(text, '')) / 4.0) AS INTEGER))"


def _words(terms: list[str]) -> str:
    return "(?i)\\b(" + "|".join(terms) + ")\\b"


_CHAIN = f"""d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    h AS (SELECT doc_id, text, nullif(lower(regexp_extract(split_part(text, chr(10), 1), '{_words(SCIENCE)}', 1)), '') AS in_title, nullif(lower(regexp_extract(substr(text, 1, 600), '{_words(SCIENCE)}', 1)), '') AS in_body,
          CASE {" ".join(f"WHEN contains(lower(substr(text, 1, 12000)), '{b}') THEN '{b}'" for b in BLOCKED)} END AS blocked_by FROM d),
    c AS (SELECT doc_id, CASE WHEN length(text) < 800 THEN 'too_short' WHEN coalesce(in_title, in_body) IS NULL THEN 'allowlist_miss' WHEN blocked_by IS NOT NULL THEN 'blocklist_hit' END AS reason,
          coalesce(in_title, in_body) AS term, CASE WHEN in_title IS NOT NULL THEN 'title' WHEN in_body IS NOT NULL THEN 'body' END AS found_in, blocked_by FROM h)"""
_SPANS = "regexp_extract_all(coalesce(text, ''), '(?s)<<\\s*(.*?)\\s*>>', 1)"
_TASK = "(" + " OR ".join([f"contains(lower(coalesce(experiment, '')), '{t}')" for t in K.TASK_KEYS] + [f"contains(lower(coalesce(text, '')), '{t}')" for t in K.TASK_PHRASES]) + ")"

# blanks of all scripts; the four labels of a stored map in the order of the decks, as one string
_BLANKS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LABELS = """CASE WHEN NOT json_valid(deck_map) THEN NULL WHEN json_array_length(deck_map, '$.deck_labels_in_order') = 4 THEN array_to_string(CAST(json_extract(deck_map, '$.deck_labels_in_order') AS VARCHAR[]), '')
    WHEN (deck_map ->> '$.A') IS NOT NULL AND (deck_map ->> '$.B') IS NOT NULL AND (deck_map ->> '$.C') IS NOT NULL AND (deck_map ->> '$.D') IS NOT NULL THEN (deck_map ->> '$.A') || (deck_map ->> '$.B') || (deck_map ->> '$.C') || (deck_map ->> '$.D') END"""
_MASK_TOKEN = "<<|>>|[A-Za-z0-9]+|[^A-Za-z0-9" + _BLANKS[1:]

SQL = {
    "fingerprint_semi_join": f"""WITH r AS (SELECT row_id, prompt_id, lower(trim(split)) AS split, trials FROM session_manifest WHERE len(trials) > 1),
        h AS (SELECT {_FP.format("trials[:-2]")} AS fp FROM r WHERE split <> 'train' UNION SELECT {_FP.format("trials")} FROM r WHERE split <> 'train')
        SELECT row_id, prompt_id, {_FP.format("trials")} AS fp FROM r WHERE split = 'train' AND {_FP.format("trials")} IN (SELECT fp FROM h)""",
    "retest_anti_join": f"WITH r AS (SELECT {_EXP} AS experiment FROM session_manifest) SELECT experiment, count(*) AS n FROM r WHERE NOT coalesce(contains(experiment, '_retest'), false) GROUP BY experiment",
    "blocklist_filter": f"""WITH r AS (SELECT CASE WHEN {_TASK} THEN 'task' WHEN trim(coalesce(text, ''), E' \\t\\r\\n') = '' THEN 'blank' ELSE 'kept' END AS reason, {_TOK} AS n FROM corpus)
        SELECT reason, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY reason""",
    "allowlist_reason_chain": f"WITH {_CHAIN} SELECT * FROM c",
    "rejected_counts": f"WITH {_CHAIN} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM c GROUP BY 1",
    "budgeted_prefix_hash_order": f"""WITH r AS (SELECT doc_id, {_TOK} AS n_tokens, sha256(CAST(doc_id AS VARCHAR) || '::v1') AS h FROM documents),
        p AS (SELECT doc_id, n_tokens, row_number() OVER w AS position, coalesce(sum(n_tokens) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total_before FROM r WINDOW w AS (ORDER BY h, doc_id))
        SELECT doc_id, n_tokens, position, CAST(total_before AS BIGINT) AS total_before FROM p WHERE total_before < {BUDGET}""",
    "span_counts": f"""SELECT row_id, CAST((length(t) - length(replace(t, '<<', ''))) / 2 AS INTEGER) AS n_markers, CAST(len(regexp_extract_all(t, '(?s)<<.*?>>')) AS INTEGER) AS n_spans, {_TOK} AS n_tokens_approx
        FROM (SELECT row_id, text, coalesce(text, '') AS t FROM corpus)""",
    "marker_spans": f"SELECT row_id, CAST(len(s) AS BIGINT) AS n_spans, CAST(len(s) - 1 AS INTEGER) AS last_index, s[-1] AS last_target FROM (SELECT row_id, {_SPANS} AS s FROM corpus) WHERE len(s) > 0",
    "deck_relabel": f"""WITH i AS (SELECT DISTINCT subject_id FROM session_manifest WHERE subject_id IS NOT NULL), l AS (SELECT subject_id, c, row_number() OVER (PARTITION BY subject_id ORDER BY sha256(subject_id || '|' || c), c) AS nth
        FROM i, (SELECT unnest([{", ".join(repr(c) for c in P.LABELS)}]) AS c)) SELECT subject_id, string_agg(c, '' ORDER BY nth) AS labels FROM l WHERE nth <= 4 GROUP BY subject_id""",
    "accuracy_by_experiment": f"""WITH r AS (SELECT {_EXP} AS experiment, {_SPANS} AS s FROM corpus)
        SELECT experiment, count(*) AS n, CAST(sum(CAST(s[-1] = s[-2] AS INTEGER)) AS BIGINT) AS n_correct, round(avg(CAST(s[-1] = s[-2] AS INTEGER)), 9) AS accuracy FROM r WHERE len(s) > 1 GROUP BY experiment""",
    "confusion_rows": f"WITH r AS (SELECT {_SPANS} AS s FROM corpus) SELECT s[-1] AS target, s[-2] AS predicted, count(*) AS n FROM r WHERE len(s) > 1 GROUP BY 1, 2",
    "corpus_length_summary": f"SELECT {KEY.format('source')} AS source, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 9) AS mean_chars FROM corpus GROUP BY 1",
    "validation_summary": """WITH k AS (SELECT prompt_id, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS no_text, count(*) FILTER (trim(coalesce(text, '')) <> '' AND NOT regexp_matches(text, '(?s)<<.*?>>')) AS no_marker FROM corpus GROUP BY prompt_id)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(prompt_id) AS n_keys, CAST(coalesce(sum(n) FILTER (prompt_id IS NULL), 0) AS BIGINT) AS n_without_key, count(*) FILTER (prompt_id IS NOT NULL AND n > 1) AS n_repeated_keys,
               CAST(sum(no_text) AS BIGINT) AS n_without_text, CAST(sum(no_marker) AS BIGINT) AS n_without_marker FROM k""",
    "whitelist_ordered_join": f"""WITH l AS (SELECT DISTINCT {_EXP} AS experiment, prompt_id FROM session_manifest WHERE prompt_id IS NOT NULL), p AS (SELECT prompt_id, CAST(row_number() OVER (PARTITION BY experiment ORDER BY prompt_id) - 1 AS INTEGER) AS pos FROM l),
        c AS (SELECT prompt_id, row_id, row_number() OVER (PARTITION BY prompt_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS nth FROM corpus)
        SELECT pos, prompt_id, row_id FROM p JOIN c USING (prompt_id) WHERE nth = 1""",
    "trial_ordinals": "SELECT row_id, CAST(len(trials) AS BIGINT) AS n_trials, CAST((len(trials) + 1) // 2 AS BIGINT) AS n_even, CAST(len(trials) - 1 AS INTEGER) AS last_pos FROM session_manifest WHERE len(trials) > 0",
    "corpus_provenance": "SELECT count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 9) AS mean_chars FROM corpus",
    "collated_batches": """WITH d AS (SELECT doc_id - 1 AS pos, regexp_split_to_array(coalesce(text, ''), '\\s+') AS w FROM documents), l AS (SELECT pos // 8 AS batch_id, len(w) AS n FROM d)
        SELECT batch_id, count(*) AS n_rows, CAST(ceil(max(n) / 8.0) * 8 AS INTEGER) AS width, CAST(ceil(max(n) / 8.0) * 8 AS INTEGER) AS least_width, CAST(sum(n) AS BIGINT) AS n_attended FROM l GROUP BY batch_id""",
    "missing_log_gate": """WITH b AS (SELECT prompt_id FROM session_manifest WHERE coalesce(len(trials), 0) = 0), f AS (SELECT DISTINCT prompt_id FROM b WHERE prompt_id IS NOT NULL ORDER BY 1 LIMIT 10)
        SELECT (SELECT count(*) FROM b) AS n_missing, coalesce((SELECT list(prompt_id ORDER BY prompt_id) FROM f), []) AS first_keys""",
    "sentence_split_counts": f"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^{_BLANKS}+|{_BLANKS}+$', '', 'g'), '([.!?])[ \\t\\n\\f\\r\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents)
        SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM d""",
    "span_offsets": f"""WITH t AS (SELECT row_id, regexp_extract_all(text, '(?s)<<.*?>>') AS m, regexp_split_to_array(text, '(?s)<<.*?>>') AS b FROM corpus WHERE text IS NOT NULL),
        u AS (SELECT row_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM t),
        x AS (SELECT row_id, i, substr(m[i], 3, length(m[i]) - 4) AS inner_, CAST(list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS INTEGER) + 2 AS begin_ FROM u),
        y AS (SELECT row_id, i, inner_, begin_, regexp_replace(inner_, '^{_BLANKS}+', '') AS l FROM x), z AS (SELECT row_id, i, begin_ + length(inner_) - length(l) AS s, regexp_replace(l, '{_BLANKS}+$', '') AS target_text FROM y)
        SELECT row_id, CAST(i - 1 AS INTEGER) AS trial_index, target_text, CAST(s AS INTEGER) AS start_char, CAST(s + length(target_text) AS INTEGER) AS end_char FROM z""",
    "scanned_span_offsets": "SELECT row_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?s)<<.*?>>')) AS INTEGER) AS n_scanned FROM corpus",
    "prediction_prompt": r"""WITH p AS (SELECT row_id, regexp_extract(text, '(?s)^(.*)<<[^\n]*?>>', 1) || '<<' AS p, regexp_extract_all(text, '<<[ \t]*([^\n]*?)[ \t]*>>', 1)[-1] AS target FROM corpus WHERE regexp_matches(text, '<<[^\n]*?>>'))
        SELECT row_id, CAST(length(p) AS INTEGER) AS n_chars, sha256(p) AS hash, target FROM p""".replace("\\\\", "\\"),
    "tail_choices_compaction": f"""WITH l AS (SELECT row_id, text, string_split(text, chr(10)) AS lines FROM corpus WHERE text IS NOT NULL), c AS (SELECT *, list_filter(lines, lambda x: contains(x, '<<')) AS chosen FROM l),
        f AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, '<<')), true) AS first_, len(chosen) - {TAIL} AS left_out FROM c),
        o AS (SELECT row_id, CASE WHEN left_out <= 0 THEN text ELSE array_to_string(list_concat(lines[1:first_ - 1], ['[' || left_out || ' earlier choices omitted]'], chosen[left_out + 1:]), chr(10)) END AS t FROM f)
        SELECT row_id, sha256(t) AS hash, CAST(length(t) AS INTEGER) AS n_chars FROM o""",
    "deck_labels_stored": f"SELECT row_id, {_LABELS} AS labels FROM session_manifest",
    "prompt_render": f"""WITH m AS (SELECT row_id, coalesce(trials, []) AS trials, {_LABELS} AS labels FROM session_manifest),
        t AS (SELECT row_id, array_to_string(list_transform(trials, lambda t: 'You press <<' || CASE WHEN labels IS NULL OR position(coalesce(t.deck, '?') IN 'ABCD') = 0 OR length(t.deck) <> 1 THEN '?' ELSE labels[position(t.deck IN 'ABCD')] END
            || '>>. You win ' || printf('%.1f', coalesce(t.gain, 0.0)) || ' points and lose ' || printf('%.1f', abs(coalesce(t.loss, 0.0))) || ' points.'), chr(10)) AS text FROM m)
        SELECT row_id, CAST(length(text) AS INTEGER) AS n_chars, CAST((length(text) - length(replace(text, '<<', ''))) // 2 AS INTEGER) AS n_markers FROM t""",
    "answer_mask_labels": f"""WITH t AS (SELECT row_id, text, list_transform(regexp_extract_all(text, '(?s)<<.*?>>'), lambda x: substr(x, 3, length(x) - 4)) AS s FROM corpus WHERE text IS NOT NULL)
        SELECT row_id, CAST(len(regexp_extract_all(text, '{_MASK_TOKEN}')) AS INTEGER) AS n_tokens, CAST(len(s) AS INTEGER) AS n_spans, CAST(coalesce(list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '{_MASK_TOKEN}')))), 0) AS INTEGER) AS n_answer_tokens FROM t""",
    "choice_extraction": f"""WITH t AS (SELECT row_id, list_last(string_split(coalesce(text, ''), chr(10))) AS v FROM corpus),
        c AS (SELECT row_id, v, regexp_extract(v, '^[ \\t\\n\\f\\r\\v]*([^<>»]+?)[ \\t\\n\\f\\r\\v]*(?:>>|Â»|»)', 1) AS closing, trim(regexp_extract(v, '(?s)^.*<<(.*)$', 1)) AS behind, regexp_extract(v, '<<[ \\t\\n\\f\\r\\v]*(.*?)[ \\t\\n\\f\\r\\v]*>>', 1) AS inner_ FROM t),
        d AS (SELECT *, trim(regexp_replace(trim(regexp_split_to_array(behind, '>>|Â»|»|\\n| Trial|\\.[ \\t\\n\\f\\r\\v]|,|;|:')[1]), '^[<>"''\\s]+|[<>"''\\s]+$', '', 'g')) AS tail FROM c)
        SELECT row_id, CASE WHEN closing <> '' THEN trim(closing) WHEN contains(v, '<<') AND tail <> '' THEN tail WHEN inner_ <> '' THEN inner_ ELSE regexp_replace(v, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') END AS choice FROM d""",
}
