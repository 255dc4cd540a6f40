"""Skill-overlap fit of candidates to the jobs they asked about."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.functions.prompts import has_match_input
from jobloom.functions.skills import (
    SKILLS, fit_parts, merge_candidate_skills, normal_skills,
)
from jobloom.operators.search import NOT_FOUND
from jobloom.sources.shared import staged

NO_INPUT = "Provide either resume_text or skills."
FIT_COLUMNS = [
    "fit_score", "candidate_skills", "matched_skills", "missing_skills",
    "extra_candidate_skills", "notes",
]


def candidate_skills(candidates: DataFrame, vocabulary=tuple(SKILLS)) -> DataFrame:
    """Adds `candidate_skills` (stated skills, then resume skills) and
    `reject_reason` for requests that state nothing."""
    c = F.col
    return candidates.withColumns({
        "candidate_skills": merge_candidate_skills(c("skills"), c("resume_text"), vocabulary),
        "reject_reason": F.when(~has_match_input(c("resume_text"), c("skills")), NO_INPUT),
    })


def fit_columns(pairs: DataFrame) -> DataFrame:
    """`pairs` has `job_skills` and `candidate_skills`; adds the fit columns.
    Row by row, no shuffle."""
    plain = pairs.withColumns({
        "job_skills": normal_skills(F.col("job_skills")),
        "candidate_skills": normal_skills(F.col("candidate_skills")),
    })
    return plain.withColumns(fit_parts(F.col("job_skills"), F.col("candidate_skills")))


def skill_fit(requests: DataFrame, jobs: DataFrame, vocabulary=tuple(SKILLS)) -> DataFrame:
    """One row per request (candidate_id, job_id, resume_text, skills), with
    `status` instead of a score when the job is unknown or nothing was stated.

    The requests name their job, so this is an equi-join on the job id; only
    id and skills of a job take part.
    """
    skills_of = jobs.select(F.col("id").alias("job_id"), F.col("skills").alias("job_skills"),
                            F.lit(True).alias("_found"))
    asked = candidate_skills(requests, vocabulary)
    scored = fit_columns(asked.join(skills_of, "job_id", "left"))
    status = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("_found").isNull(), NOT_FOUND).otherwise("ok")
    )
    return scored.withColumn("status", status).select(
        "candidate_id", "job_id", "status",
        *[F.when(status == "ok", F.col(n)).alias(n) for n in FIT_COLUMNS],
    )


def skill_overlap(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per request and skill: which side names it ('matched', 'missing' or
    'extra'). A full outer equi-join on (request, lower-cased skill); the key
    includes the request, so a skill everyone has does not make a hot group.

    `requests` has request_id, job_id and candidate_skills.
    """
    c = F.col
    named = jobs.select(c("id").alias("job_id"), c("skills").alias("job_skills"))
    wanted = (
        requests.select("request_id", "job_id").join(named, "job_id")
        .select("request_id", F.explode(normal_skills(c("job_skills"))).alias("job_skill"))
        .withColumn("skill_key", F.lower("job_skill"))
    )
    offered = (
        requests.select("request_id", F.explode(
            normal_skills(c("candidate_skills"))).alias("candidate_skill"))
        .withColumn("skill_key", F.lower("candidate_skill"))
    )
    return wanted.join(offered, ["request_id", "skill_key"], "full").select(
        "request_id",
        F.coalesce("job_skill", "candidate_skill").alias("skill"),
        F.when(c("candidate_skill").isNull(), "missing")
        .when(c("job_skill").isNull(), "extra").otherwise("matched").alias("side"),
    )


# --- the best jobs of every candidate ----------------------------------------

def best_fits(candidates: DataFrame, jobs: DataFrame, top_k: int = 10) -> DataFrame:
    """(candidate_id, rank, job_id, fit_score) of the jobs with the highest fit scores, ties to the
    smaller id; jobs that share no skill are left out. `candidates` has candidate_id and
    candidate_skills, `jobs` id and skills.

    A score depends on the two sets of skills alone. So equal sets are one class on either side, and
    a job class is its smallest `top_k` ids: no more of them can be among the best. Classes meet through
    an index from skill to class; pairs of classes are counted before anything is ranked, and of each
    candidate class the best `top_k` job classes are kept, in two steps. A skill that a third
    of all jobs name costs one row for each class that has it, not for each job.
    """
    c = F.col
    asked = candidates.where("candidate_id is not null").select("candidate_id", _skill_set(c("candidate_skills")).alias("own"))
    offered = jobs.where("id is not null").select("id", _skill_set(c("skills")).alias("own"))
    asked, offered = (staged(x.where(F.size("own") > 0)) for x in (asked, offered))
    groups = asked.groupBy("own").agg(F.min("candidate_id").alias("group"))
    classes = offered.groupBy("own").agg(F.min("id").alias("class"))
    pairs = groups.select("group", F.explode("own").alias("skill")).join(
        classes.select("class", F.size("own").alias("n"), F.explode("own").alias("skill")), "skill")
    scored = pairs.groupBy("group", "class", "n").agg(F.count("*").alias("shared")).select(
        "group", "class", F.bround(c("shared").cast("double") / c("n") * 100.0).cast("int").alias("fit_score"))
    scored = _ranked(scored, ["group"], [F.desc("fit_score"), c("class")], "class", top_k)
    members = _ranked(offered.join(classes, "own").select("id", "class"), ["class"], [c("id")], "id", top_k)
    found = scored.join(members, "class").select("group", "fit_score", c("id").alias("job_id"))
    best = _ranked(found, ["group"], [F.desc("fit_score"), c("job_id")], "job_id", top_k)
    return asked.join(groups, "own").select("candidate_id", "group").join(best, "group").select(
        "candidate_id", "rank", "job_id", "fit_score")


def _skill_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(normal_skills(items), F.lower)))


def _ranked(rows: DataFrame, by: list[str], order: list[Column], key: str, most: int) -> DataFrame:
    """The first `most` rows of each group with their rank, first within parts of a group."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    few = part.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(
        F.col("_rank") <= most).drop("_rank", "_part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col("rank") <= most)
