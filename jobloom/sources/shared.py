"""Storage that outlives an executor."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The temporary folders of local sessions, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`. Only a plain
    local session without one, as in tests, gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _OWN:
            _OWN[own] = tempfile.mkdtemp(prefix="jobloom-")
        folder = _OWN[own]
    return folder.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile removes its shuffle files when it ends; else they stay until the driver collects garbage.
    For results that are only read again from storage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again. Cuts the lineage of a result that has
    several readers; a lost executor costs a reread. Files stay until the folder is cleared, those of the
    shuffles before it go."""
    path = f"{shared_folder(df.sparkSession)}/jobloom-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_copy(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an expensive result that several consumers read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
