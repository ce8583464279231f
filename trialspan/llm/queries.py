"""The queries pN_... of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspan.llm import leaks, overlap, packing, pieces, residue, subjects, tokens, truncation
from trialspan.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_budget(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "session_nll"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "documents"))


def p1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.answer_tokens(table(spark, sf_dir, "session_nll"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.same_participant_pairs(table(spark, sf_dir, "session_manifest"), table(spark, sf_dir, "subject_links"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign_splits(table(spark, sf_dir, "session_manifest"), table(spark, sf_dir, "subject_links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.crossing_pairs(table(spark, sf_dir, "session_manifest")).select("row_id_a", "row_id_b")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "session_manifest"))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_by_row(table(spark, sf_dir, "session_manifest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(table(spark, sf_dir, "corpus")).where("cut").select("row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "corpus"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(table(spark, sf_dir, "corpus"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.cut_texts(table(spark, sf_dir, "corpus"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.packed_documents(table(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.leak_report(leaks.leaked_items(documents, items), documents, items)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.evidence(table(spark, sf_dir, "documents"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.clean_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_budget, p1_records, p1_answers, p2_found, p2_splits, p3_found, p3_rows, p3_report, p4_found, p4_report,
        p5_found, p5_pieces, p6_packed, p6_fill, p7_found, p7_report, p8_found, p8_evidence, p8_clean,
    )
}

#: queries that plain SQL can state
SQL: dict[str, str] = {
    "p5_found": "SELECT row_id FROM corpus WHERE length(text) > 6000",
    "p1_answers": """
        WITH last AS (
            SELECT model, prompt_id, n_answer_tokens, nullif(regexp_replace(lower(trim(experiment)), '[-\\s]+', '_', 'g'), '') AS experiment,
                   row_number() OVER (PARTITION BY model, prompt_id ORDER BY scored_at DESC NULLS LAST, n_answer_tokens DESC NULLS LAST, experiment DESC NULLS LAST) AS nth
            FROM session_nll)
        SELECT experiment, model, count(*) AS n_sessions, CAST(coalesce(sum(n_answer_tokens), 0) AS BIGINT) AS n_answer_tokens
        FROM last WHERE nth = 1 GROUP BY experiment, model""",
}
