"""Idempotent ingest of requested urls.

Work is done once per distinct url. The request table is aggregated map-side
first, so a url that fills a third of all requests still reaches the join as
one row; no window ever gathers the occurrences of one url.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions.skills import SKILLS, find_skills
from jobloom.functions.text import clean, is_http_url, strip
from jobloom.operators.pages import parse_pages
from jobloom.schema import PUBLIC_JOB_COLUMNS, STORED_JOB
from jobloom.sources.shared import shared_copy, staged
from jobloom.sources.store import JobStore
from jobloom.sources.tables import spread

INGESTED, EXISTING, FAILED = "ingested", "existing", "failed"

# Reason texts.
INVALID_URL = "Invalid URL. Only http/https URLs are allowed."
NOT_FETCHED = "Page could not be fetched."


def build_jobs(parsed: DataFrame, created_at: Column, vocabulary=tuple(SKILLS)) -> DataFrame:
    """Parsed pages -> rows of the job table, search keys included. A missing
    description is stored as '', and skills are read from the cleaned text."""
    c = F.col
    cleaned = (
        parsed.withColumn("description_raw", F.coalesce(c("description_raw"), F.lit("")))
        .withColumn("description_clean", clean(c("description_raw")))
    )
    own = {
        "id": c("page_id"),
        "skills": find_skills(c("description_clean"), vocabulary),
        "created_at": created_at,
        "company_key": search_key(c("company")),
        "location_key": search_key(c("location")),
    }
    return cleaned.select(*[
        own.get(f.name, c(f.name) if f.name in cleaned.columns else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in STORED_JOB.fields
    ])


def search_key(value: Column) -> Column:
    """What a company or location filter is compared with."""
    return strip(F.lower(F.coalesce(value, F.lit(""))))


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page per url, the newest. Picks ids first, on two narrow columns,
    and joins html back on the unique id, so copies of one url never meet."""
    newest = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return pages.join(newest.select("page_id"), "page_id", "left_semi")


def wanted_urls(requests: DataFrame) -> DataFrame:
    """(url, first_pos, occurrences, valid): one row per distinct url."""
    return (
        requests.groupBy("url")
        .agg(F.min("pos").alias("first_pos"), F.count("*").alias("occurrences"))
        .withColumn("valid", is_http_url(F.col("url")))
    )


def new_pages(urls: DataFrame, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages to parse: requested, valid, not stored, fetched; of each url the
    newest. Urls are settled on narrow columns, and html is joined by id. The pages are
    spread then: a join's output lies in tasks by its bytes, few of which are much work to parse."""
    wanted = urls.where("valid").join(stored.select("url"), "url", "left_anti")
    newest = (
        pages.where(F.col("html").isNotNull()).select("url", "page_id")
        .join(wanted.select("url"), "url", "left_semi")
        .groupBy("url").agg(F.max("page_id").alias("page_id"))
    )
    return spread(pages.join(newest.select("page_id"), "page_id", "left_semi"))


def url_outcomes(
    urls: DataFrame, stored: DataFrame, parsed: DataFrame
) -> DataFrame:
    """(url, first_pos, occurrences, outcome, error, job_id) per distinct url;
    `outcome` is that of the first occurrence."""
    known = stored.select("url", F.col("id").alias("stored_id"))
    fresh = parsed.select("url", F.col("page_id").alias("new_id"), "parse_error")
    c = F.col
    ok = c("new_id").isNotNull() & c("parse_error").isNull()
    return (
        urls.join(known, "url", "left").join(fresh, "url", "left")
        .select(
            "url", "first_pos", "occurrences",
            F.when(~c("valid"), FAILED)
            .when(c("stored_id").isNotNull(), EXISTING)
            .when(ok, INGESTED).otherwise(FAILED).alias("outcome"),
            F.when(~c("valid"), INVALID_URL)
            .when(c("stored_id").isNull() & c("new_id").isNull(), NOT_FETCHED)
            .when(c("stored_id").isNull(), c("parse_error")).alias("error"),
            F.when(c("valid"), F.coalesce(c("stored_id"), F.when(ok, c("new_id"))))
            .alias("job_id"),
        )
    )


def ingest_status(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(pos, url, status, error, job_id) per request. Later repeats of a url
    that was just ingested count as existing; a failure fails every time.

    The outcome side has one row per url, so a hot url makes only the request
    side large, and the skew-join rule can split it.
    """
    repeat = (F.col("outcome") == INGESTED) & (F.col("pos") != F.col("first_pos"))
    return requests.join(outcomes, "url").select(
        "pos", "url",
        F.when(repeat, F.lit(EXISTING)).otherwise(F.col("outcome")).alias("status"),
        "error", "job_id",
    )


def ingest_counts(outcomes: DataFrame) -> DataFrame:
    """Counters for the whole request table, from one row per distinct url."""
    c = F.col

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return outcomes.agg(
        total(F.when(c("outcome") == INGESTED, 1)).alias("ingested_count"),
        total(F.when(c("outcome") == EXISTING, c("occurrences"))
              .when(c("outcome") == INGESTED, c("occurrences") - 1)).alias("existing_count"),
        total(F.when(c("outcome") == FAILED, c("occurrences"))).alias("failed_count"),
    )


def append_jobs(jobs: DataFrame, path: str) -> None:
    """Append to the job table. Failed urls were split off before, so one bad
    page never holds back the others; a retried batch finds its urls stored."""
    jobs.select(*[f.name for f in STORED_JOB.fields]).write.mode("append").parquet(path)


def ingest(
    requests: DataFrame, stored: DataFrame, pages: DataFrame, as_of: Column,
    vocabulary=tuple(SKILLS),
) -> tuple[DataFrame, DataFrame]:
    """(new job rows, outcome per distinct url). Both read the parsed pages;
    `run_ingest` keeps them from being parsed twice."""
    urls = wanted_urls(requests)
    parsed = parse_pages(new_pages(urls, stored, pages), as_of)
    return _jobs_and_outcomes(urls, stored, parsed, as_of, vocabulary)


def run_ingest(
    requests: DataFrame, stored: DataFrame, pages: DataFrame, as_of: Column, path: str,
    vocabulary=tuple(SKILLS),
) -> DataFrame:
    """Ingest and append to the job table at `path`; returns the outcomes."""
    urls = wanted_urls(requests)
    parsed = shared_copy(parse_pages(new_pages(urls, stored, pages), as_of))
    jobs, outcomes = _jobs_and_outcomes(urls, stored, parsed, as_of, vocabulary)
    # Fixed before the append, which would turn "ingested" into "existing".
    outcomes = shared_copy(outcomes)
    append_jobs(jobs, path)
    return outcomes


def ingest_into(
    store: JobStore, requests: DataFrame, pages: DataFrame, as_of: Column, batch: str,
    vocabulary=tuple(SKILLS),
) -> DataFrame:
    """Ingest into a store as one batch, which is seen whole or not at all; returns the outcomes.
    Stored urls are looked up where they lie. Under the name of a batch that is there
    already nothing is added, and the outcomes say what is stored now."""
    urls = wanted_urls(requests)
    stored = store.lookup(urls.select("url")).where("job_id is not null").select(F.col("job_id").alias("id"), "url")
    stored = staged(stored)  # as it was before the batch
    parsed = staged(parse_pages(new_pages(urls, stored, pages), as_of))
    jobs, outcomes = _jobs_and_outcomes(urls, stored, parsed, as_of, vocabulary)
    outcomes = staged(outcomes)
    store.append(jobs, batch)
    return outcomes


def ingest_answer(outcomes: DataFrame, requests: DataFrame, store: JobStore) -> tuple[DataFrame, DataFrame]:
    """(saved, failures) of the requests, in the order of `pos`: saved (pos, status and the public
    job columns), failures (pos, url, error)."""
    status = ingest_status(requests, outcomes)
    jobs = store.read(values=["summary"]).select(*PUBLIC_JOB_COLUMNS)
    saved = status.where(F.col("status") != FAILED).select("pos", "url", "status").join(jobs, "url")
    return (saved.select("pos", "status", *PUBLIC_JOB_COLUMNS),
            status.where(F.col("status") == FAILED).select("pos", "url", "error"))


def _jobs_and_outcomes(urls, stored, parsed, as_of, vocabulary):
    jobs = build_jobs(parsed.where(F.col("parse_error").isNull()), as_of, vocabulary)
    return jobs, url_outcomes(urls, stored, parsed)
