"""Incremental ingest of arriving pages."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobloom.functions.skills import SKILLS
from jobloom.functions.text import is_http_url
from jobloom.operators.ingest import build_jobs
from jobloom.operators.pages import parse_pages
from jobloom.schema import PAGES
from jobloom.sources.store import JobStore


def arriving_jobs(pages: DataFrame, known: DataFrame, as_of: Column, vocabulary=tuple(SKILLS)) -> DataFrame:
    """Streams of pages and of known urls -> rows of the job table, the first good page of each url.

    The urls taken are state of the stream, kept in its state store by key, so a
    micro-batch looks up the urls that arrive and reads no list of all. Pages that cannot be
    parsed leave no state; a later page of their url is taken. Of a url's pages in one
    micro-batch any is taken. Known urls (url) come out as rows without an id.
    """
    good = pages.where(is_http_url(F.col("url")) & F.col("html").isNotNull())
    jobs = build_jobs(parse_pages(good, as_of).where("parse_error is null"), as_of, vocabulary)
    return jobs.unionByName(known.select("url"), allowMissingColumns=True).dropDuplicates(["url"])


def ingest_arriving_pages(
    spark: SparkSession, pages_folder: str, store: JobStore, checkpoint: str, as_of: Column,
    vocabulary=tuple(SKILLS), name: str = "pages", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Every page file not yet seen goes through parsing into the store, a
    micro-batch as one batch of the store, named after the stream and its number: a replayed
    micro-batch finds its name there and changes nothing.

    Urls that the store has when the stream first starts enter its state with the first micro-batch,
    the only one that reads them all. Urls that other writers add later are not
    known to it; the store shows the row that was committed first. The checkpoint must be on
    shared storage, and a new checkpoint needs a new name. For states beyond memory set
    `spark.sql.streaming.stateStore.providerClass` to the provider on disk.
    """
    known = f"{store.path}/streams/{name}"
    store.urls().write.mode("ignore").parquet(known)
    schema = spark.read.parquet(known).schema
    jobs = arriving_jobs(
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(pages_folder), spark.readStream.schema(schema).parquet(known),
        as_of, vocabulary)

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        if batch_id == 0:  # a url may come both as known and as a page, and either may be taken
            own = session.read.schema(schema).parquet(known)
            rows = rows.join(own.select("url"), "url", "left_anti")
        new = rows.where("id is not null")
        if not JobStore(session, store.path, store.buckets).append(new, f"stream {name} {batch_id}"):
            new.write.format("noop").mode("overwrite").save()  # for the state, which has not seen the batch yet

    return jobs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()

