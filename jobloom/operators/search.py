"""Listing, filtering and looking up jobs."""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions.text import empty_to_null
from jobloom.operators.ingest import search_key
from jobloom.schema import PUBLIC_JOB_COLUMNS

NOT_FOUND = "Job not found"


def public(jobs: DataFrame) -> DataFrame:
    """The columns a reader may see."""
    return jobs.select(*PUBLIC_JOB_COLUMNS)


def _python_strip_lower(value: str | None) -> str:
    return (value or "").lower().strip()


def normal_keyword(keyword: str | None) -> str:
    """What is searched for; '' is no filter."""
    return _python_strip_lower(keyword)


def searched_text() -> Column:
    """What a keyword is searched in."""
    parts = ["title", "description_clean", "description_raw"]
    return F.lower(F.concat_ws(" ", *[empty_to_null(F.col(p)) for p in parts]))


def list_jobs(
    jobs: DataFrame, keyword: str | None = None, company: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Exact company and location (case and outer blanks ignored) and a literal
    keyword found in title, clean and raw description joined by one space.
    A blank filter is no filter.

    Tables written by `append_jobs` carry the comparison keys, so those two
    filters are pushed into the scan; elsewhere the key is computed.
    """
    for name, wanted in (("company", company), ("location", location)):
        wanted = _python_strip_lower(wanted)
        if wanted:
            stored = f"{name}_key"
            key = F.col(stored) if stored in jobs.columns else search_key(F.col(name))
            jobs = jobs.where(key == wanted)
    wanted = normal_keyword(keyword)
    if wanted:
        jobs = jobs.where(F.contains(searched_text(), F.lit(wanted)))
    return jobs


def result_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def filter_jobs(
    jobs: DataFrame, location: str | None = None, company: str | None = None,
    job_type: str | None = None,
) -> DataFrame:
    """Case-insensitive substring filters of the match request. The input is
    not stripped, and its % and _ stay wildcards; NULL never passes."""
    return jobs.where(passes(location, company, job_type))


def passes(
    location: str | None = None, company: str | None = None, job_type: str | None = None,
) -> Column:
    """The condition of `filter_jobs`. A backslash in the input is an ordinary character."""
    found = F.lit(True)
    for name, wanted in (("location", location), ("company", company), ("job_type", job_type)):
        if wanted:
            quoted = wanted.replace("\\", "\\\\")
            found = found & F.coalesce(F.col(name).ilike(f"%{quoted}%"), F.lit(False))
    return found


def lookup(ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every requested id with its job, or `status` saying there is none. `ids`
    has one column, `job_id`."""
    found = public(jobs)
    return ids.join(found, ids["job_id"] == found["id"], "left").withColumn(
        "status", F.when(F.col("id").isNull(), NOT_FOUND).otherwise("ok"))


def without_embedding(jobs: DataFrame) -> DataFrame:
    """Rows to backfill: a NULL vector only; an empty one was tried before."""
    return jobs.where(F.col("embedding").isNull())


def update_column(jobs: DataFrame, updates: DataFrame, name: str) -> DataFrame:
    """A new snapshot of `jobs` in which `updates(id, <name>)` replaces the
    column where it has a row. Write it to a new path, never over its input."""
    new: Column = F.col("_new")
    renamed = updates.select("id", F.col(name).alias("_new"), F.lit(True).alias("_hit"))
    return (
        jobs.join(renamed, "id", "left")
        .withColumn(name, F.when(F.col("_hit"), new).otherwise(F.col(name)))
        .select(*jobs.columns)
    )


def write_snapshot(jobs: DataFrame, path: str) -> None:
    """Fails when the path exists, so the table being read is never replaced."""
    jobs.write.mode("errorifexists").parquet(path)
