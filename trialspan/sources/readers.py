"""Sources: JSON lines, JSON arrays, partial results, texts, prompts and ordered lists."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TRIAL = "struct<deck:string,gain:double,loss:double>"
SESSION = f"subject_id string, experiment string, manifest string, cohort string, session string, igt_version string, n_trials int, deck_map string, trials array<{TRIAL}>"
PROMPT = "prompt_id string, experiment string, participant string, subject_id string, cohort string, partition string, text string, prompt string, source_text string, text_len_chars int"
SCORE = "prompt_id string, experiment string, cohort string, nll double, n_answer_tokens int, n_answer_spans int"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped, other fields ignored."""
    return spark.read.schema(schema).json(path)


def sound_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file that may end in the middle of one: lines that cannot be read are left out."""
    corrupt = "_corrupt"
    full = T._parse_datatype_string(schema).add(corrupt, "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    return rows.where(F.col(f"r.{corrupt}").isNull()).select("r.*").drop(corrupt)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records, or an object whose values are the records; elements of other kinds are left out."""
    text = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    named = F.map_values(F.from_json("value", f"map<string,struct<{_fields(schema)}>>"))
    rows = text.select(F.explode(F.when(F.col("value").startswith("{"), named).otherwise(listed)).alias("r"))
    return rows.where("r IS NOT NULL").select("r.*")


def _fields(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema))


def partial_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of an earlier run; a missing or empty path gives no rows."""
    try:
        return sound_lines(spark, path, schema)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def records(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """One source by its kind: ``jsonl``, ``json`` (an array or object), ``parquet`` or ``text``."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "text":
        return whole_texts(spark, path)
    if schema is None:
        raise ValueError("JSON sources need a schema")
    if kind == "jsonl":
        return json_lines(spark, path, schema)
    if kind == "json":
        return json_array(spark, path, schema)
    raise ValueError(f"unknown kind {kind!r}")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one text; empty files are an error when the row is read."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(F.assert_true(F.length("text") > 0, "empty text file").isNull())


def prompts(df: DataFrame, limit: int = 0) -> DataFrame:
    """Prompts with a closed marker; the text is the first of text, prompt and source_text that is not empty."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "prompt", "source_text")], F.lit(""))
    rows = df.withColumn("text", text).where(F.contains("text", F.lit("<<")) & F.contains("text", F.lit(">>"))).drop("prompt", "source_text")
    return rows.limit(limit) if limit else rows


def ordered_ids(df: DataFrame, listed: str, name: str = "prompt_id") -> DataFrame:
    """The elements of a list column with their position: (pos, name)."""
    return df.select(F.posexplode(listed).alias("pos", name))


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists joined by ``pos``; an error where they are not equally long."""
    from trialspan.operators.gates import GateError

    joined = left.join(right.withColumnRenamed("pos", "_pos"), F.col("pos") == F.col("_pos"), "full")
    odd = joined.where("pos IS NULL OR _pos IS NULL").limit(1).count()
    if odd:
        raise GateError("the lists are not equally long")
    return joined.drop("_pos")


def environment(path: str) -> dict[str, str]:
    """Names and values of an environment file; comments and blank lines are skipped, quotes removed."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("\"'"))
    return out
