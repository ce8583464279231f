"""A streaming front end: scores that arrive as files are cleaned, kept once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_means(scores: DataFrame, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Number and mean of finite scores by window of their time and model; scores later than ``late`` are left out."""
    timed = scores.withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    fine = timed.where("nll IS NOT NULL AND NOT isnan(nll) AND abs(nll) < double('Infinity')")
    by = fine.withWatermark("scored_at", late).groupBy(F.window("scored_at", window), "model")
    return by.agg(F.count("*").alias("n"), F.avg("nll").alias("mean_nll")).select("window.start", "window.end", "model", "n", "mean_nll")


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose key the target does not have yet; each batch is an anti join with the target, so a batch may be run again."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
