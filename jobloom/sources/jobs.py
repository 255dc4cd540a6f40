"""The job table on parquet."""

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from jobloom.schema import STORED_JOB


def read_jobs(spark: SparkSession, path: str | PurePath) -> DataFrame:
    return spark.read.schema(STORED_JOB).parquet(str(path))


def empty_jobs(spark: SparkSession) -> DataFrame:
    """A job table before its first ingest."""
    return spark.createDataFrame([], STORED_JOB)
