"""Scalar functions on hand-derived rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from jobloom.functions import jsontext, prompts, role, skills, text, vectors
from jobloom.functions.when import out_of_range, relative_time
from jobloom.operators.fit import fit_columns


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("fn, value, wanted", [
    (text.clean, "a – b\t c\xa0d", "a  b c d"),
    (text.slug, "C++ & Go!", "c-go"),
    (text.strip, "\x1c　a\x85", "a"),
    (text.collapse, " \n ", None),
    (lambda x: text.truncate(x, 4), "ab  cd", "ab…"),
    (lambda x: text.truncate(x, 4), "abcd", "abcd"),
    (text.sentences, "Build APIs. Own it! - \nLead", ["Build APIs.", "Own it!", "", "Lead"]),
    (text.url_source, "https://www.a.com:8080/x", "a.com:8080"),
    (text.url_source, "no url", "no url"),
    (text.is_http_url, "HTTP://a", True),
    (text.is_http_url, "http:///a", False),
    (text.is_http_url, None, False),
    (role.seniority, "Lead Staff Engineer", "Staff"),
    (role.seniority, "Engineer II", "Mid-level"),
    (role.seniority, "Engineer III", "Senior"),
    (role.seniority, "Sr. Dev", "Senior"),
    (role.seniority, "Internal Tools Engineer", "Not specified"),
    (role.seniority, "", "Unknown"),
    (role.duties, "We design. We build many good APIs. We build many good APIs. Own!",
     ["We build many good APIs."]),
    (skills.find_skills, "PostgreSQL, next.js; ci/cd GitHub", ["Next.js", "PostgreSQL", "CI/CD"]),
    (lambda x: skills.find_skills(x, ["data", "big data", "C++"]), "Big Data, C++x",
     ["data", "big data", "C++"]),
    (jsontext.decode_skills, None, []),
    (jsontext.decode_skills, "oops", []),
    (jsontext.decode_skills, '{"a":1}', []),
    (jsontext.decode_skills, '["a"," ", 1, false]', ["a", "1", "False"]),
    (jsontext.decode_vector, "[1, 2.5]", [1.0, 2.5]),
    (jsontext.decode_vector, "[]", []),
    (jsontext.decode_vector, "{", []),
])
def test_text(spark, fn, value, wanted):
    assert one(spark, value, fn) == wanted


def test_encode_list(spark):
    assert one(spark, ['a"b', "é", 'x",'], jsontext.encode_list, "array<string>") == (
        '["a\\"b", "\\u00e9", "x\\","]')


@pytest.mark.parametrize("value, delta", [
    ("1 month", 30), ("5 Days Ago", 5), ("2 weeks", 14), ("30+ days ago", None),
    ("2026-04-01", None),
])
def test_relative_time(spark, value, delta):
    as_of = dt.datetime(2026, 4, 30, 12)
    clock = F.lit(as_of.isoformat()).cast("timestamp")
    found = one(spark, value, lambda x: F.struct(
        relative_time(x, clock).alias("t"), out_of_range(x, clock).alias("bad")))
    assert found.t == (None if delta is None else as_of - dt.timedelta(days=delta))
    assert not found.bad


@pytest.mark.parametrize("body, items, optional", [
    ("docker is a plus, digital skills", ["Docker", "Git"], ["Git"]),
    ("nice to have: " + "x" * 77 + " git", ["Git"], ["Git"]),
    ("nice to have: " + "x" * 78 + " git", ["Git"], []),
    ("preferred\ngit", ["Git"], []),
    ("plus " + "y" * 130, ["y" * 130], ["y" * 130]),
])
def test_optional_skills(spark, body, items, optional):
    df = spark.createDataFrame([(body, items)], "b string, s array<string>")
    assert df.select(role.optional_skills(F.col("b"), F.col("s"))).first()[0] == optional


def test_summary_sentence(spark):
    none = F.lit(None).cast("string")
    found = spark.range(1).select(role.summary_sentence(
        none, F.lit("Acme"), none, F.lit("Unknown"), F.array().cast("array<string>")))
    assert found.first()[0] == (
        "This role at Acme focuses on building and supporting software systems.")


@pytest.mark.parametrize("a, b, wanted", [
    ([1, 0], [1, 0], 1.0), ([1, 0], [0, 1], 0.0), ([1, 2], [2, 1], 0.8),
    ([0, 0], [1, 0], 0.0), ([1], [1, 0], 0.0), ([], [1], 0.0), (None, [1], 0.0),
])
def test_cosine(spark, a, b, wanted):
    rows = [(a and [float(x) for x in a], [float(x) for x in b])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert math.isclose(df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0], wanted)


EIGHT = ["A", "B", "C", "D", "E", "F", "G", "H"]


@pytest.mark.parametrize("job, candidate, score, note", [
    (EIGHT[:5], EIGHT[:5], 100, "Strong"),
    (["Rust", "Scala"], ["Perl"], 0, "Low"),
    (EIGHT[:6], ["F", "D", "B"], 50, "Moderate"),
    ([], ["z", "Y"], 0, "low confidence"),
    (["Rust"], [], 0, "Low"),
    (["Scala", "Rust"], ["scala", "RUST", "Rust "], 100, "Strong"),
    (EIGHT[:7], ["A"], 14, "Partial"),
    (EIGHT, ["A"], 12, "Partial"),
    (["Scala", "Rust", "Perl"], ["Perl", "Scala"], 67, "Moderate"),
])
def test_fit(spark, job, candidate, score, note):
    df = spark.createDataFrame(
        [(job, candidate)], "job_skills array<string>, candidate_skills array<string>")
    row = fit_columns(df).first()
    assert row.fit_score == score and note in row.notes
    keys = {s.lower().strip() for s in candidate}
    assert row.matched_skills == sorted(s for s in job if s.lower() in keys)
    assert row.missing_skills == sorted(s for s in job if s.lower() not in keys)
    if not job:
        assert row.extra_candidate_skills == candidate


def test_query_and_job_text(spark):
    df = spark.createDataFrame([(" x ", ["A", " "])], "r string, s array<string>")
    found = df.select(prompts.query_text(F.col("r"), F.col("s"))).first()[0]
    assert found == "x\n\nSkills: A"
    names = ["title", "company", "location", "employment_type", "job_type", "summary",
             "description_clean", "description_raw"]
    job = {n: F.lit(None).cast("string") for n in names}
    job["skills"] = F.lit(None).cast("array<string>")
    shown = spark.range(1).select(prompts.job_text(job)).first()[0].split("\n")
    assert len(shown) == 8 and shown[0] == "Title: " and shown[-1] == "Description:"


def test_optional_skills_of_any_length(spark):
    from jobloom.functions.role import optional_skills

    long = "y" * 300
    rows = [("plus: foo\nbar", ["foo\nbar", "bar"]), ("plus " + "x" * 75 + "git", ["git"]),
            ("plus " + "x" * 80 + "git", ["git"]), (f"bonus {long}", [long, long + "z"]), ("plus a\\Eb", ["a\\Eb"])]
    df = spark.createDataFrame(rows, "t string, s array<string>")
    found = [r[0] for r in df.select(optional_skills(F.col("t"), F.col("s"))).collect()]
    assert found == [["foo\nbar"], ["git"], [], [long], ["a\\Eb"]]


def test_json_control_characters_in_lower_hex(spark):
    from jobloom.functions.jsontext import encode_list

    rows = [(["a\x1fb\x0b", "\\u001F", "\\\x1f"],)]
    import json

    found = spark.createDataFrame(rows, "s array<string>").select(encode_list(F.col("s"))).first()[0]
    assert found == json.dumps(rows[0][0])
