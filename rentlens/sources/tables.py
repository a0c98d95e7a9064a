"""Table and model storage."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from rentlens.sources.csv_files import path_exists


CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``. The new files are complete before the old ones make way, and the old
    ones are removed only once the new ones are in place: a failed job or rename leaves the old table, and
    ``df`` may itself read from ``path``."""
    spark = df.sparkSession
    fresh, aside = (f"{path.rstrip('/')}-{uuid.uuid4().hex}" for _ in range(2))
    df.write.format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {})).save(fresh)
    new, old, kept = map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, (fresh, path, aside))
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaces = path_exists(spark, path)
    if replaces and not files.rename(old, kept):
        raise OSError(f"could not move the old table at {path}")
    if not files.rename(new, old):
        if replaces:
            files.rename(kept, old)
        raise OSError(f"could not publish {fresh} as {path}")
    if replaces:
        files.delete(kept, True)


def save_model(model: PipelineModel, path: str, version: str) -> None:
    model.write().overwrite().save(f"{path}/{version}")


def load_model(spark: SparkSession, path: str, version: str) -> PipelineModel:
    target = f"{path}/{version}"
    if not path_exists(spark, target):
        raise FileNotFoundError(f"missing model: {target}")
    return PipelineModel.load(target)
