"""Skill vocabulary matching and the overlap score."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from jobloom.functions.lists import (
    distinct_ci, drop_ci, empty_strings, keep_ci, lowered, sorted_ci, stripped,
)

# The default vocabulary, in output order.
SKILLS = [
    "Python", "JavaScript", "TypeScript", "React", "Next.js", "Node.js",
    "FastAPI", "Django", "Flask", "AWS", "Docker", "Kubernetes", "SQL",
    "PostgreSQL", "MySQL", "Redis", "OpenSearch", "Elasticsearch", "Git", "CI/CD",
]

# Notes by score band.
NOTE_NO_JOB_SKILLS = (
    "No extracted job skills were available, so this score has low confidence."
)
NOTE_STRONG = "Strong match — most extracted job skills are covered."
NOTE_MODERATE = (
    "Moderate match — several relevant skills are present, but there are still gaps."
)
NOTE_PARTIAL = "Partial match — some overlap exists, but important skills are missing."
NOTE_LOW = "Low match — no meaningful skill overlap was found."


def _words(entry: str) -> list[str]:
    return re.findall(r"\w+", entry.lower())


def _can_share_text(vocabulary: Sequence[str]) -> bool:
    """Could two entries claim the same characters of a text? Then one scan
    over an alternation would report only one of them."""
    for entry in vocabulary:
        if not re.fullmatch(r"\w(?:.*\w)?", entry, flags=re.S):
            return True
    split = [_words(v) for v in vocabulary]
    for i, left in enumerate(split):
        for j, right in enumerate(split):
            if i == j:
                continue
            for start in range(len(left)):
                overlap = min(len(left) - start, len(right))
                if left[start:start + overlap] == right[:overlap]:
                    return True
    return False


def find_skills(text: Column, vocabulary: Sequence[str] = tuple(SKILLS)) -> Column:
    """Whole-word vocabulary hits, in vocabulary order and spelling.

    The usual vocabulary is matched by a single scan of the text; one whose
    entries may overlap falls back to one scan per entry.
    """
    text = F.coalesce(text, F.lit(""))
    if _can_share_text(vocabulary):
        tests = [
            F.when(text.rlike(rf"(?iU)\b\Q{v}\E\b"), F.lit(v)) for v in vocabulary
        ]
        return F.array_compact(F.array(*tests))
    alternation = "|".join(rf"\Q{v}\E" for v in vocabulary)
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)\b(?:{alternation})\b"), F.lit(0))
    keys = F.transform(found, lambda x: F.lower(F.upper(x)))
    spelling = F.create_map(*[F.lit(s) for v in vocabulary for s in (v.lower(), v)])
    ordered = F.array_intersect(F.array(*[F.lit(v.lower()) for v in vocabulary]), keys)
    return F.transform(ordered, lambda k: F.element_at(spelling, k))


def merge_candidate_skills(
    explicit: Column, resume: Column, vocabulary: Sequence[str] = tuple(SKILLS)
) -> Column:
    """Stated skills first, then those found in the uncleaned resume."""
    return distinct_ci(F.concat(stripped(explicit), find_skills(resume, vocabulary)))


def normal_skills(items: Column) -> Column:
    return distinct_ci(stripped(items))


def fit_parts(job: Column, candidate: Column) -> dict[str, Column]:
    """Score, sets and note for two *normalised* skill lists.

    Callers stage `normal_skills` in a column first; it is read many times.
    """
    job_keys, candidate_keys = lowered(job), lowered(candidate)
    matched = keep_ci(job, candidate_keys)
    ratio = F.size(matched).cast("double") / F.size(job)
    percent = F.bround(ratio * 100.0).cast("int")  # half to even
    no_job = F.size(job) == 0
    score = F.when(no_job, F.lit(0)).otherwise(percent)
    return {
        "fit_score": score,
        "matched_skills": sorted_ci(matched),
        "missing_skills": sorted_ci(drop_ci(job, candidate_keys)),
        # Without job skills the candidate's list is handed back unsorted.
        "extra_candidate_skills": F.when(no_job, candidate).otherwise(
            sorted_ci(drop_ci(candidate, job_keys))),
        "notes": F.when(no_job, F.lit(NOTE_NO_JOB_SKILLS))
        .when(score >= 80, F.lit(NOTE_STRONG))
        .when(score >= 50, F.lit(NOTE_MODERATE))
        .when(score > 0, F.lit(NOTE_PARTIAL))
        .otherwise(F.lit(NOTE_LOW)),
    }


__all__ = [
    "SKILLS", "empty_strings", "find_skills", "fit_parts",
    "merge_candidate_skills", "normal_skills",
]
