"""Sinks: JSON lines, texts, reports, provenance, checksums and the run index."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists", files: int = 0) -> None:
    """One JSON object a line, text unescaped; ``files`` 1 gives a single file."""
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def append_unit(df: DataFrame, path: str, unit: str) -> None:
    """Append the results of finished units, in a folder for each unit."""
    df.write.mode("append").partitionBy(unit).parquet(path)


def blank_separated(df: DataFrame, text: str, path: str, mode: str = "errorifexists") -> None:
    """Texts without blanks at their ends, an empty line between two."""
    df.select(F.trim(text).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def content_hash(df: DataFrame) -> DataFrame:
    """A hash of the table's rows that does not depend on their order: count, and two sums of row hashes.

    The sums combine before the shuffle, so no list of rows is built.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    part = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")), F.lit(0))
    sums = df.agg(F.count("*").alias("n_rows"), part(1).alias("a"), part(2).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", "n_rows", F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("sha256"))


def provenance(df: DataFrame, text: str, parameters: dict[str, str]) -> DataFrame:
    """One row about a corpus: rows, characters, the shortest, longest and mean text, its hash and the parameters."""
    n = F.length(text)
    facts = df.agg(F.count("*").alias("n_texts"), F.coalesce(F.sum(n), F.lit(0)).alias("n_chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_chars"))
    given = F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    return facts.join(F.broadcast(content_hash(df))).withColumn("parameters", given)


def mean_and_sd(mean: Column, sd: Column, n: Column) -> Column:
    """``mean +- sd (n=..)`` with four decimals; a dash where there is nothing."""
    return F.when(n > 0, F.format_string("%.4f +- %.4f (n=%d)", mean, sd, n)).otherwise("-")


def markdown(df: DataFrame, most_rows: int = 500) -> str:
    """A small result as a Markdown table; larger ones are an error, as reports are read by people."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def pretty_json(df: DataFrame, path: str, key: str, parameters: dict[str, str] | None = None, most_rows: int = 10_000) -> str:
    """A small result as one indented JSON report, written to a single file; larger results are an error.

    The report has the rows by the text of ``key``, the parameters and the time of the run in UTC. Returns the text.
    """
    rows = df.limit(most_rows + 1).toJSON().collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    each = [json.loads(r) for r in rows]
    report = {"created_at": utc_now(), "parameters": dict(sorted((parameters or {}).items())), "rows": {str(r.get(key)): r for r in sorted(each, key=lambda r: str(r.get(key)))}}
    text = json.dumps(report, indent=2, ensure_ascii=False)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def utc_now() -> str:
    """The time of a run as it is stated in reports and provenance: UTC, in whole seconds."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def metrics_report(metrics: DataFrame, group: str, outcomes: DataFrame | None = None, title: str = "Metrics") -> str:
    """Markdown of three tables: metrics over all, by group, and the outcomes of trials where given."""
    parts = [f"# {title}", "## Global", markdown(metrics.where("level = 'global'").drop("level", group)), f"## By {group}", markdown(metrics.where("level = 'group'").drop("level").orderBy(group))]
    if outcomes is not None:
        parts += ["## Trial outcomes", markdown(outcomes)]
    return "\n\n".join(parts) + "\n"


def with_trials(sessions: DataFrame, trials: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Session results and, in a folder beside them, those of their trials."""
    sessions.write.mode(mode).json(f"{path}/sessions")
    trials.write.mode(mode).json(f"{path}/trials")


def archive(path: str, run_id: str) -> str:
    """A copy of a run's outputs beside them under the run's name, on any file system that Spark knows; an earlier copy is replaced."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{run_id}")
    fs = source.getFileSystem(conf)
    fs.delete(target, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, conf)
    return target.toString()
