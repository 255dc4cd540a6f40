"""Job-shaped and request-shaped views of the driver tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobloom.functions.skills import find_skills
from jobloom.functions.text import clean
from jobloom.plans.postings import AS_OF
from jobloom.schema import JOB
from jobloom.sources.tables import read_table, spread

# Words the invented prose does contain; its texts name no real skill.
VOCABULARY = [
    "License", "Token", "Thing", "That", "With", "For", "Une", "Pour", "Nicht",
    "Una", "Onto", "Aus",
]
VERBS = ["that", "une", "nicht", "licen[sc]e"]
KEYWORDS = [" The T", "fr ", "E", "nicht", "que la", "zq", "in e", "onde", "of the", "xyzzy"]
HINTS = ["token", "license", "that the", "nicht"]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def joined(items: Column) -> Column:
    """Lists are compared as text."""
    return F.array_join(items, "|")


def as_jobs(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the shape of the job table; columns not named are NULL."""
    return rows.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB.fields
    ])


def document_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a job of the company `source` at the location `lang`."""
    c = F.col
    docs = spread(read_table(spark, folder, "documents"))
    # Generated, so that a filter on it runs after the spread and cleans once.
    docs = docs.select("*", F.explode(F.array(clean(c("text")))).alias("clean"))
    return as_jobs(
        docs, id=c("doc_id"), url=F.concat(F.lit("https://d.example.com/"), c("doc_id")),
        source=c("source"), title=F.concat(F.lit("Text in "), c("lang")),
        company=c("source"), location=c("lang"), description_raw=c("text"),
        description_clean=c("clean"), skills=find_skills(c("clean"), VOCABULARY),
    )


def vector_jobs(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    kind = F.concat(F.lit("type-"), c("label"))
    return as_jobs(read_table(spark, folder, "embeddings"), id=c("vec_id"),
                   job_type=kind, embedding=c("embedding"))


def conversation_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a candidate who asks about the job numbered like the
    conversation, stating the role and one word of the vocabulary."""
    c = F.col
    turns = spread(read_table(spark, folder, "conversations"))
    return turns.select(
        (c("conv_id") * 1000 + c("turn")).alias("candidate_id"),
        c("conv_id").alias("job_id"), c("text").alias("resume_text"),
        F.array(c("role"), F.lit(" that "), F.lit(" ")).alias("skills"),
    )
