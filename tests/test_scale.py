"""Keyword postings, best fits and large vocabularies against the plain definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.operators import fit, search
from jobloom.operators.keyword import KeywordIndex, _pieces, pieces
from jobloom.operators.vocabulary import find_entries, find_listed
from jobloom.plans.inputs import as_jobs
from tests.test_operators import plan


# --- keywords --------------------------------------------------------------------

@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    draw = random.Random(3)
    words = ["The", "tHE", "été", "日本", "😀", "a%b", "c_d", "x", "\\", "\n", "aaa", "Engineer"]

    def text():
        return draw.choice([None, "", " ".join(draw.choice(words) for _ in range(draw.randint(0, 12)))])

    rows = [(i, text(), text(), text()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, description_clean string, description_raw string")
    jobs = as_jobs(df, **{c: F.col(c) for c in df.columns})
    path = str(tmp_path_factory.mktemp("postings"))
    return jobs, KeywordIndex.build(jobs, path)


@pytest.mark.parametrize("keyword", [
    None, " ", "t", "TH", "the", "the ", "the t", "日", "日本 😀", "😀", "a%b", "%", "c_d", "\\", "aaaa", "é t", "engineer the", "zz", "aa a"])
def test_same_as_a_full_search(searched, keyword):
    jobs, index = searched
    found = sorted(r.id for r in index.search(jobs, keyword).collect())
    assert found == sorted(r.id for r in search.list_jobs(jobs, keyword=keyword).collect())


def test_postings_are_read_by_piece(searched):
    jobs, index = searched
    shown = plan(index.candidates("engineer"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(piece", shown)
    assert index.candidates("qqqqq").count() == 0


def test_postings_stay_where_their_jobs_are(spark, searched, tmp_path):
    """The pieces, many times as large as the texts, are made once and not moved: every file is sorted by
    itself, as many as the session has partitions."""
    jobs, _ = searched
    index = KeywordIndex.build(jobs, str(tmp_path))
    by_file = index.postings().where("piece = 'e'").select(F.input_file_name().alias("f")).distinct().count()
    assert by_file > 1
    assert index.candidates("e").count() == index.postings().where("piece = 'e'").count()


def test_a_row_of_postings_holds_many_jobs(spark, searched, tmp_path):
    """One for a piece of some texts, not one for each piece of each text; it is the pieces that the column function gives."""
    jobs, _ = searched
    index = KeywordIndex.build(jobs, str(tmp_path))
    wanted = jobs.select("id", F.explode(pieces(search.searched_text())).alias("piece"))
    found = index.postings()
    assert sorted(map(tuple, found.select("piece", "id").collect())) == sorted(map(tuple, wanted.select("piece", "id").collect()))
    assert spark.read.parquet(f"{tmp_path}/postings").count() < found.count() / 2


def test_pieces_of_many_characters():
    """More different characters than go with a text's number into one whole number."""
    texts = ["".join(map(chr, range(0x4E00 + 7 * i, 0x4E00 + 7 * i + 9000))) + "\U0001F600a\U0001F600a" for i in range(5)]
    texts += ["".join(map(chr, range(0x20000, 0x30000))), "", "a"]
    found = {}
    for first, (strings, lengths, numbers) in _pieces(texts):
        at = 0
        for piece, n in zip(strings, lengths):
            for k in numbers[at:at + n]:
                found.setdefault(first + int(k), set()).add(piece)
            at += n
    for i, text in enumerate(texts):
        assert found.get(i, set()) == {text[j:j + k] for k in (1, 2, 3) for j in range(len(text) - k + 1)}


def test_pieces(spark):
    row = spark.createDataFrame([("aab😀",), ("",), ("x",)], "t string").select(pieces(F.col("t")).alias("p")).collect()
    assert sorted(row[0].p) == sorted(["a", "b", "😀", "aa", "ab", "b😀", "aab", "ab😀"])
    assert row[1].p == [] and row[2].p == ["x"]
    long = spark.range(1).select(F.size(pieces(F.repeat(F.lit("abcdefghij"), 20_000))).alias("n")).first()
    assert long.n == 30


# --- fits ------------------------------------------------------------------------

@pytest.mark.parametrize("top_k", [1, 4, 50])
def test_best_fits_same_as_brute_force(spark, top_k):
    draw = random.Random(top_k)
    names = ["Python", "SQL", "Go", "Rust", "C++", "Perl", "Ada"]

    def skills(hot):
        own = [draw.choice([s, s.lower(), f" {s} "]) for s in draw.sample(names, draw.randint(0, 4))]
        return draw.choice([own, own + [" "], own + ["python"] if hot else own])

    jobs = [(i, skills(True)) for i in range(150)] + [(i, ["Go"]) for i in range(1000, 1100)] + [(2000, None), (None, ["Go"])]
    asked = [(i, skills(False)) for i in range(40)] + [(90, None)]
    found = fit.best_fits(spark.createDataFrame(asked, "candidate_id long, candidate_skills array<string>"),
                          spark.createDataFrame(jobs, "id long, skills array<string>"), top_k)

    def keys(items):
        return {s.strip().lower() for s in items or () if s.strip()}

    wanted = []
    for key, own in asked:
        scores = [(-round(len(keys(own) & keys(s)) / len(keys(s)) * 100), i) for i, s in jobs
                  if i is not None and keys(s) and keys(own) & keys(s)]
        wanted += [(key, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:top_k])]
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_a_common_skill_makes_no_pairs_of_jobs(spark):
    """5,000 jobs and 500 candidates with one skill: one class on either side."""
    jobs = spark.range(5000).select("id", F.array(F.lit("Python")).alias("skills"))
    asked = spark.range(500).select(F.col("id").alias("candidate_id"), F.array(F.lit("python")).alias("candidate_skills"))
    found = fit.best_fits(asked, jobs, 3)
    assert found.count() == 1500 and found.agg(F.max("job_id")).first()[0] == 2
    shown = plan(found)
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


# --- vocabularies ----------------------------------------------------------------

def by_scan(text, vocabulary):
    return [v for v in vocabulary if re.search(rf"\b{re.escape(v)}\b", text, re.IGNORECASE)]


def test_same_as_one_scan_per_entry(spark):
    draw = random.Random(8)
    bits = ["data", "Data science", "science", "C++", "C", "+", "node.js", ".js", "js", "CI/CD", "a b", "b a", "été", "_x", "x1", "...", "++ x"]
    vocabulary = bits + [f"{a} {b}" for a in bits[:8] for b in bits[:8]] + ["c+", "C++ C", "data  science"]
    vocabulary = list(dict.fromkeys(vocabulary))
    texts = [(i, "".join(draw.choice(bits) + draw.choice([" ", "", ", ", "\n", ". ", "-"]) for _ in range(draw.randint(0, 14))))
             for i in range(250)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    known = spark.createDataFrame(list(enumerate(vocabulary)), "place long, entry string")
    found = {r.id: r.found for r in find_listed(df, known).collect()}
    assert found == {i: by_scan(t or "", vocabulary) for i, t in texts}


def test_a_hundred_thousand_entries(spark):
    """Overlapping ones included; the plan does not hold them."""
    entries = [(i, f"w{i % 400} w{i // 400}") for i in range(100_000)]
    known = spark.createDataFrame(entries, "place long, entry string")
    draw = random.Random(2)
    texts = [(i, " ".join(f"w{draw.randint(0, 399)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(texts, "id long, text string")
    found = find_entries(df, known)
    assert len(plan(found)) < 40_000
    held = {e for _, e in entries}
    wanted = set()
    for i, text in texts:
        words = text.split()
        wanted |= {(i, p) for p in (f"{a} {b}" for a, b in zip(words, words[1:])) if p in held}
    assert {(r.id, r.entry) for r in found.collect()} == wanted


def test_empty_vocabulary_and_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "place long, entry string")
    assert [tuple(r) for r in find_listed(df, none).collect()] == [(1, [])]
    assert find_listed(df.limit(0), none).count() == 0


def test_long_texts_in_stretches(spark):
    """Entries across the ends of stretches, short and long ones, texts that end in one."""
    draw = random.Random(4)
    vocabulary = ["b", "b c", "c++", "a b c", "++", "b c a b", "c a", "é b"]
    texts = [(i, "".join(draw.choice(["a", "b", "c", "c++", "é"]) + draw.choice([" ", " ", "", "-"]) for _ in range(n)))
             for i, n in enumerate([126, 127, 128, 129, 255, 256, 257, 511, 513, 900])]
    texts += [(100 + i, "x " * i + "b c a b") for i in range(120, 132)] + [(200 + i, "- " * i + "c++") for i in range(124, 132)]
    df = spark.createDataFrame(texts, "id long, text string")
    known = spark.createDataFrame(list(enumerate(vocabulary)), "place long, entry string")
    found = {r.id: r.found for r in find_listed(df, known).collect()}
    assert found == {i: by_scan(t, vocabulary) for i, t in texts}


def test_small_vocabulary_moves_no_runs(spark):
    """Only hits are shuffled, not each run of tokens that begins like an entry."""
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    known = spark.createDataFrame([(1, "a b"), (2, "b c")], "place long, entry string")
    shown = plan(find_entries(df, known))
    assert not re.search(r"Exchange hashpartitioning\([^)]*key#", shown)
    assert shown.count("BroadcastHashJoin") == 2
