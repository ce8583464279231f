"""Session-level helpers: reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_trialspan_shipped", False):
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="trialspan-")) / "trialspan.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(str(archive))
    context._trialspan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, with pushdown left to Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    ``spark.checkpoint.dir`` is taken from the session. Where it is unset, a temporary folder is
    used on a local master only; a cluster without the setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(known)
        return known
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"trialspan-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder; its lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
