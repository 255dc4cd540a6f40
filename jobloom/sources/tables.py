"""Parquet sources."""

from pyspark.sql import DataFrame, SparkSession, types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over `spark.sql.shuffle.partitions` tasks, for tables in few
    files whose rows are costly to work on. Only planned here; nothing runs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_pages(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Fetched pages (page_id, url, html). A url without a row, or with a NULL
    html, is a fetch that failed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
