"""Registered queries. Each reads whole tables and returns a DataFrame."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobloom.functions import jsontext, role, skills, text, vectors
from jobloom.functions.when import out_of_range, relative_time
from jobloom.operators import embedding, fit, ingest, letters, matching, pages, search
from jobloom.operators.keyword import KeywordIndex
from jobloom.operators.summaries import summarize, summarize_ids, with_summaries
from jobloom.operators.vocabulary import find_listed
from jobloom.plans.inputs import (
    HINTS, KEYWORDS, VERBS, VOCABULARY, as_jobs, as_of, conversation_requests, document_jobs,
    joined, vector_jobs,
)
from jobloom.plans.postings import facts, posting_pages
from jobloom.schema import STORED_JOB
from jobloom.sources.shared import shared_copy, shared_folder, staged
from jobloom.sources.store import JobStore
from jobloom.sources.tables import read_pages, read_table, spread
from jobloom.streaming.ingest import ingest_arriving_pages

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"


# --- raw pages -----------------------------------------------------------------

def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Source, title, clean description and skills of every page; one chain of
    projections without a shuffle."""
    lined = pages.page_lines(raw_pages(spark, folder))
    ld = pages.with_posting(lined)
    staged = ld.withColumn("_metas", pages.markup.meta_tags(c("_page"))).select(
        "page_id", "url", "_ld", "_page",
        pages.page_title(c("_ld"), c("_page"), c("_metas")).alias("title"))
    cleaned = staged.withColumn(
        "description_clean", text.clean(pages.description(c("_ld"), c("_page"))))
    return cleaned.select(
        "page_id", text.is_http_url(c("url")).alias("valid_url"),
        text.url_source(c("url")).alias("source"), "title", "description_clean",
        joined(skills.find_skills(c("description_clean"), VOCABULARY)).alias("skills"))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    lined = pages.page_lines(raw_pages(spark, folder))
    return lined.select(
        "page_id", F.size("_lines").alias("n_lines"), joined(c("_lines")).alias("lines"))


def page_description(spark: SparkSession, folder: str) -> DataFrame:
    lined = pages.page_lines(raw_pages(spark, folder))
    return lined.select(
        "page_id", pages.markup.body_text(c("_page")).alias("description_raw"))


def page_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The full parse of the raw pages."""
    return _shown(pages.parse_pages(raw_pages(spark, folder), as_of()))


def _shown(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "page_id", "source", "title", "company", "location",
        F.date_format("date_posted", STAMP).alias("date_posted"), "job_type",
        "description_raw", "parse_error")


# --- job ads -------------------------------------------------------------------

def fetched_ads(spark: SparkSession, folder: str) -> DataFrame:
    return posting_pages(spark, folder).where(c("html").isNotNull())


def parsed_ads(spark: SparkSession, folder: str) -> DataFrame:
    return pages.parse_pages(fetched_ads(spark, folder), as_of())


def ad_jobs(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parsed_ads(spark, folder).where(c("parse_error").isNull())
    return ingest.build_jobs(parsed, as_of())


def parse_page(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(parsed_ads(spark, folder))


def jsonld_fields(spark: SparkSession, folder: str) -> DataFrame:
    ads = pages.json_ld_fields(fetched_ads(spark, folder))
    title = F.try_variant_get("_ld", "$.title", "variant")
    return ads.select(
        "page_id", text.collapse(jsontext.variant_text(title)).alias("title"),
        pages.markup_company(c("_ld"), pages.markup.meta_tags(F.lit(""))).alias("company"),
        c("_ld_location").alias("location"), c("_ld_date").alias("date_text"),
        c("_ld_bad_date").alias("bad_date"), c("_ld_job_type").alias("job_type"))


def header_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What the lines below the heading say, when markup names no company."""
    lined = pages.page_lines(fetched_ads(spark, folder))
    staged = (
        lined.withColumn("_title", pages.markup.first_text(c("_page"), "h1")[1])
        .withColumn("_nearby", pages.lines_after(
            c("_lines"), c("_title"), pages.HEADER_WINDOW))
        .withColumn("_rest", pages.header_rest(c("_nearby"), F.lit(None).cast("string")))
    )
    head = pages.header_fields(c("_nearby"), c("_rest"))
    return staged.select(
        "page_id", pages.header_company(c("_lines"), c("_title")).alias("company"),
        *[head[n].alias(n) for n in ("location", "date_posted", "job_type")])


def labelled_values(spark: SparkSession, folder: str) -> DataFrame:
    lined = pages.page_lines(fetched_ads(spark, folder))
    staged = lined.withColumn("_full", F.array_join("_nodes", "\n")).withColumn(
        "_folded", pages.folded(c("_full")))
    by_name = {"location": pages.LOCATION_LABELS, "date_text": pages.DATE_LABELS,
               "job_type": pages.JOB_TYPE_LABELS}
    return staged.select("page_id", *[
        pages.labelled_value(c("_full"), c("_folded"), labels).alias(name)
        for name, labels in by_name.items()])


def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    jobs = search.public(ad_jobs(spark, folder))
    return jobs.select(
        "id", "url", "source", "title", "company", "location", "employment_type",
        "description_raw", "description_clean",
        jsontext.encode_list(c("skills")).alias("skills_json"), "summary",
        F.date_format("date_posted", STAMP).alias("date_posted"), "job_type",
        F.date_format("created_at", STAMP).alias("created_at"))


def seniority(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select(
        "page_id", role.seniority(c("title")).alias("seniority"),
        role.seniority(F.nullif("priority", F.lit("1-URGENT"))).alias("of_priority"))


def job_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = summarize(ad_jobs(spark, folder))
    return found.select(
        "job_id", "summary", "seniority", joined(c("responsibilities")).alias("duties"),
        joined(c("required_skills")).alias("required"),
        joined(c("nice_to_have")).alias("optional"))


def summary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of the jobs that events ask for by id."""
    ids = read_table(spark, folder, "events").select("event_id", (c("user_id") * 10).alias("job_id"))
    return summarize_ids(ids, document_jobs(spark, folder)).select(
        "event_id", "job_id", "status", "summary", "seniority", joined(c("required_skills")).alias("required"))


def listed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A filtered list as readers get it."""
    found = search.public(search.list_jobs(document_jobs(spark, folder), company="src2"))
    return found.select(*[x for x in found.columns if x not in ("skills", "date_posted", "created_at", "description_raw")],
                        joined(c("skills")).alias("skills"))


def stored_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Job table of documents with the summary column filled."""
    return with_summaries(document_jobs(spark, folder)).select("id", "summary")


def job_text(spark: SparkSession, folder: str) -> DataFrame:
    return letters.job_texts(ad_jobs(spark, folder))


# --- ingest --------------------------------------------------------------------

def ingest_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every ad is asked for once; every event asks again for the ad numbered
    like its user, so a few urls repeat very often; errors ask for no web url, and so
    do events of a user without an ad."""
    ads = facts(spark, folder).select(c("page_id").alias("pos"), "page_id", "url")
    events = read_table(spark, folder, "events").select(
        (c("event_id") + 1_000_000_000_000).alias("pos"), "event_type",
        c("user_id").alias("page_id"))
    none = F.concat(F.lit("no-ad:"), c("page_id"))
    again = events.join(ads.select("page_id", "url"), "page_id", "left").select(
        "pos", F.when(c("event_type") == "error", F.regexp_replace(F.coalesce("url", none), "^https", "ftp"))
        .otherwise(F.coalesce("url", none)).alias("url"))
    return ads.select("pos", "url").unionByName(again)


def stored_ads(spark: SparkSession, folder: str) -> DataFrame:
    """Ads of orders before 1996 are in the job table already."""
    known = facts(spark, folder).where("ordered_at < TIMESTAMP '1996-01-01 00:00:00'")
    return known.select(c("page_id").alias("id"), "url")


def _outcomes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    requests = ingest_requests(spark, folder)
    _, outcomes = ingest.ingest(
        requests, stored_ads(spark, folder), posting_pages(spark, folder), as_of())
    return requests, outcomes


def _document_store(spark: SparkSession, folder: str) -> JobStore:
    """Documents as stored jobs, in three batches by id. One is written twice, the second time with other titles;
    another try has written rows of all documents and not ended."""
    store = JobStore(spark, f"{shared_folder(spark)}/jobloom-store-{uuid.uuid4().hex}", 8)
    jobs = staged(document_jobs(spark, folder).withColumns({
        "created_at": as_of(), "company_key": ingest.search_key(c("company")),
        "location_key": ingest.search_key(c("location"))}))
    for k in range(3):
        store.append(jobs.where(c("id") % 3 == k), f"part {k}")
    store.append(jobs.where("id % 3 = 1").withColumn("title", F.lit("again")), "part 1")
    store.write_attempt(jobs.withColumns({"id": c("id") + 10_000_000, "url": F.concat("url", F.lit("/half"))}),
                        "rows", "failed", STORED_JOB)
    return store


def store_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader sees of the table."""
    return _document_store(spark, folder).read().select(
        "id", "url", "title", "company", "location", "description_clean", "company_key")


def store_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every event asks for a url, errors for one that only the failed try has."""
    url = F.concat(F.lit("https://d.example.com/"), c("user_id"), F.when(
        c("event_type") == "error", "/half").otherwise(""))
    asked = read_table(spark, folder, "events").select("event_id", url.alias("url"))
    return _document_store(spark, folder).lookup(asked).select("event_id", "url", "job_id")


def store_values(spark: SparkSession, folder: str) -> DataFrame:
    """Columns given new values in two batches, on top of the table: those numbered like a vector get it,
    then those of a label another one; each has its summary."""
    store = _document_store(spark, folder)
    url = F.concat(F.lit("https://d.example.com/"), c("vec_id")).alias("url")
    vectors_of = read_table(spark, folder, "embeddings")
    store.put(vectors_of.select(url, c("embedding").cast("array<double>").alias("embedding")), "embedding", "first")
    store.put(vectors_of.where("label = 3").select(
        url, F.array(c("vec_id").cast("double"), F.lit(0.5)).alias("embedding")), "embedding", "second")
    store.put(with_summaries(store.read()).select("url", "summary"), "summary", "all")
    return store.read().select(
        "id", "title", "summary", F.size("embedding").alias("width"), _weighted(c("embedding")).alias("weighted"))


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The raw pages as files that arrive one by one, into a table that has every third url already."""
    base = f"{shared_folder(spark)}/jobloom-stream-{uuid.uuid4().hex}"
    store = JobStore(spark, f"{base}/jobs", 8)
    stored = as_jobs(raw_pages(spark, folder).where("page_id % 3 = 0"), id=c("page_id"), url=c("url"),
                     title=F.lit("stored"), created_at=as_of())
    store.append(stored.withColumns({"company_key": F.lit(""), "location_key": F.lit("")}), "before")
    raw_pages(spark, folder).repartition(3, "url").write.parquet(f"{base}/in")
    ingest_arriving_pages(
        spark, f"{base}/in", store, f"{base}/checkpoint", as_of(), VOCABULARY, files_per_batch=1).awaitTermination()
    return store.read().select(
        "id", "url", "source", "title", "description_clean", joined(c("skills")).alias("skills"))


def ingest_status(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.ingest_status(*_outcomes(spark, folder))


def _answered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every event asks for a raw page, errors for none of the web; every third page is stored already."""
    store = JobStore(spark, f"{shared_folder(spark)}/jobloom-answers-{uuid.uuid4().hex}", 8)
    raw = raw_pages(spark, folder)
    stored = as_jobs(raw.where("page_id % 3 = 0"), id=c("page_id"), url=c("url"), title=F.lit("stored"), created_at=as_of())
    store.append(stored.withColumns({"company_key": F.lit(""), "location_key": F.lit("")}), "before")
    events = read_table(spark, folder, "events").select(c("event_id").alias("pos"), "event_type", c("user_id").alias("page_id"))
    requests = events.join(raw.select("page_id", "url"), "page_id", "left").select("pos", F.when(
        c("event_type") == "error", F.concat(F.lit("ftp:"), "pos")).otherwise(
        F.coalesce("url", F.concat(F.lit("https://none.example.com/"), "page_id"))).alias("url"))
    outcomes = ingest.ingest_into(store, requests, raw, as_of(), "events", VOCABULARY)
    return ingest.ingest_answer(outcomes, requests, store)


def ingest_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs that the requests are answered with."""
    return _answered(spark, folder)[0].select(
        "pos", "status", "id", "url", "title", "description_clean", joined(c("skills")).alias("skills"))


def ingest_failures(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(spark, folder)[1]


def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.ingest_counts(_outcomes(spark, folder)[1])


# --- search --------------------------------------------------------------------

def list_jobs(spark: SparkSession, folder: str) -> DataFrame:
    found = search.list_jobs(
        document_jobs(spark, folder), keyword=" The T", company=" SRC1 ", location="EN")
    return found.select("id", "company", "location", F.length("description_raw").alias("n"))


def list_total(spark: SparkSession, folder: str) -> DataFrame:
    return search.result_total(
        search.list_jobs(document_jobs(spark, folder), keyword="fr ", company=" "))


def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs by keyword, each through the postings."""
    jobs = staged(document_jobs(spark, folder))
    index = KeywordIndex.build(jobs, f"{shared_folder(spark)}/jobloom-postings-{uuid.uuid4().hex}")
    found = [index.search(jobs, k).select(F.lit(k).alias("keyword"), "id") for k in KEYWORDS]
    return reduce(DataFrame.unionByName, found)


def filter_jobs(spark: SparkSession, folder: str) -> DataFrame:
    parts = as_jobs(
        read_table(spark, folder, "part"), id=c("p_partkey"), title=c("p_name"),
        company=c("p_brand"), location=c("p_type"), job_type=c("p_name"))
    return search.filter_jobs(
        parts, location="con_m", company="brand#1", job_type="RED").select(
        "id", "title", "company", "location")


def job_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ids = read_table(spark, folder, "events").select((c("user_id") * 10).alias("job_id"))
    return search.lookup(ids, document_jobs(spark, folder)).select(
        "job_id", "url", "title", "status")


# --- text ----------------------------------------------------------------------

def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", text.clean(c("text")).alias("clean"),
        text.collapse(c("text")).alias("collapsed"))


def truncate_slug(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", text.truncate(c("text"), 500).alias("short"), text.slug(c("text")).alias("slug"))


def text_keys(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", text.text_key(F.concat(F.lit(" \n"), c("text"))).alias("text_key"))


def url_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "pages")
    odd = F.replace("url", F.lit("https://"), F.lit("//www.www.a.org:80/"))
    return rows.select(
        "page_id", text.url_source(c("url")).alias("source"),
        text.is_http_url(F.upper("url")).alias("valid"),
        text.url_source(F.concat(F.lit("s3:"), odd)).alias("odd_source"),
        text.is_http_url(odd).alias("odd_valid"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).withColumn("s", text.sentences(c("text"))).select(
        "doc_id", F.size("s").alias("n"), joined(c("s")).alias("sentences"))


def responsibilities(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", joined(role.duties(c("text"), VERBS)).alias("duties"))


def skill_split(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder).withColumn("s", skills.find_skills(c("text"), VOCABULARY))
    split = found.withColumn("o", role.optional_skills(c("text"), c("s"), HINTS))
    return split.select(
        "doc_id", joined(c("o")).alias("optional"),
        joined(F.array_except("s", "o")).alias("required"))


def relative_times(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a dated line, in several spellings."""
    amount = F.floor("value").cast("string")
    line = (
        F.when(c("event_type") == "click", F.concat(F.lit(" Posted "), amount, F.lit(" Minutes")))
        .when(c("event_type") == "view", F.concat(amount, F.lit(" hours AGO")))
        .when(c("event_type") == "signup", F.concat(amount, F.lit("\tweeks")))
        .when(c("event_type") == "purchase", F.concat(amount, F.lit(" months ago")))
        .otherwise(F.concat(amount, F.lit("000000000000 days ago")))
    )
    dated = read_table(spark, folder, "events").select("event_id", line.alias("line"))
    return dated.select(
        "event_id", F.date_format(relative_time(c("line"), as_of()), STAMP).alias("moment"),
        out_of_range(c("line"), as_of()).alias("failed"))


# --- skills --------------------------------------------------------------------

def skills_extract(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", joined(skills.find_skills(c("text"), VOCABULARY)).alias("skills"))


def skills_json(spark: SparkSession, folder: str) -> DataFrame:
    """Lists written as JSON text and read back, odd items included."""
    rows = read_table(spark, folder, "events")
    odd = F.concat(F.lit('["'), c("event_type"), F.lit('", " ", null, true, '),
                   c("user_id").cast("string"), F.lit(', " x "]'))
    items = F.array(c("event_type"), F.lit('q"é'))
    return rows.select(
        "event_id", jsontext.encode_list(items).alias("encoded"),
        joined(jsontext.decode_skills(odd)).alias("decoded"),
        F.size(jsontext.decode_skills(c("props"))).alias("from_object"))


def candidate_skills(spark: SparkSession, folder: str) -> DataFrame:
    asked = fit.candidate_skills(conversation_requests(spark, folder), VOCABULARY)
    return asked.select(
        "candidate_id", joined(c("candidate_skills")).alias("skills"), "reject_reason")


def skill_fit(spark: SparkSession, folder: str) -> DataFrame:
    found = fit.skill_fit(
        conversation_requests(spark, folder), document_jobs(spark, folder), VOCABULARY)
    lists = ["candidate_skills", "matched_skills", "missing_skills", "extra_candidate_skills"]
    return found.select(
        "candidate_id", "job_id", "status", "fit_score",
        *[joined(c(n)).alias(n) for n in lists], "notes")


def skill_overlap(spark: SparkSession, folder: str) -> DataFrame:
    asked = fit.candidate_skills(conversation_requests(spark, folder), VOCABULARY)
    return fit.skill_overlap(
        asked.withColumnRenamed("candidate_id", "request_id"), document_jobs(spark, folder))


def best_fits(spark: SparkSession, folder: str) -> DataFrame:
    """The five best jobs of every turn by its skills."""
    asked = fit.candidate_skills(conversation_requests(spark, folder), VOCABULARY)
    return fit.best_fits(asked, document_jobs(spark, folder), 5)


def vocabulary_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Which runs of two and three words of the benchmark, without marks between, stand in a document: a vocabulary of
    many thousand entries that overlap."""
    words = F.split(F.trim(F.regexp_replace("text", r"[ \n]+", " ")), " ")
    read = read_table(spark, folder, "benchmark").select(words.alias("w"))
    runs = read.select(F.explode(F.flatten(F.array(*[
        F.transform(F.filter("w", lambda _, i: i <= F.size("w") - n),
                    lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(n)), " ")) for n in (2, 3)]))).alias("entry"))
    entries = runs.where(c("entry").rlike(r"(?U)^\w+( \w+)+$")).distinct().withColumn("place", F.xxhash64("entry"))
    texts = documents(spark, folder).select(c("doc_id").alias("id"), "text")
    return find_listed(texts, entries).select(
        c("id").alias("doc_id"), F.size("found").alias("n"), joined(F.array_sort("found")).alias("found"))


# --- vectors -------------------------------------------------------------------

def cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with its successor."""
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", vectors.as_doubles(c("embedding")).alias("a"))
    following = rows.select((c("vec_id") - 1).alias("vec_id"), c("a").alias("b"))
    return rows.join(following, "vec_id", "left").select(
        "vec_id", vectors.score(c("a"), c("b")).alias("score"))


def embedding_json(spark: SparkSession, folder: str) -> DataFrame:
    stored = (
        F.when(c("label") == 3, "oops").when(c("label") == 4, '{"a":1}')
        .when(c("label") != 5, F.to_json("embedding"))
    )
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", jsontext.decode_vector(stored).alias("v"))
    return rows.select(
        "vec_id", F.size("v").alias("width"), vectors.is_missing(c("v")).alias("missing"),
        joined(F.transform("v", lambda x: F.floor(x * 1_000_000).cast("string"))).alias("millionths"))


def _partly_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of two labels never had a vector; those of a third have an empty one."""
    jobs = vector_jobs(spark, folder)
    kind = c("job_type")
    return jobs.withColumn("embedding", F.when(
        kind == "type-9", F.array().cast("array<double>")
    ).when(~kind.isin("type-1", "type-2"), c("embedding")))


def backfill_pick(spark: SparkSession, folder: str) -> DataFrame:
    return search.without_embedding(_partly_embedded(spark, folder)).select("id", "job_type")


def backfill(spark: SparkSession, folder: str) -> DataFrame:
    """State of every job's vector after one backfill."""
    done = embedding.backfilled(
        _partly_embedded(spark, folder), embedding.hashing_embedder(8), 8)
    return done.select("id", F.size("embedding").alias("width"), F.when(
        F.size("embedding") > 8, _weighted(c("embedding"))).alias("kept"),
        F.when(F.size("embedding") == 8, F.round(vectors.norm(c("embedding")), 4)).alias("norm"),
        F.when(F.size("embedding") == 8, _weighted(c("embedding"))).alias("weighted"))


def _weighted(vector: Column) -> Column:
    """Tells vectors apart: the sum of values times their positions from 1."""
    return F.round(vectors.dot(
        vectors.as_doubles(vector), F.transform(vector, lambda x, i: (i + 1).cast("double"))), 3)


def semantic_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a candidate; half of them look only at their own type."""
    kind = c("job_type")
    candidates = vector_jobs(spark, folder).select(
        c("id").alias("candidate_id"), "embedding",
        F.lit(None).cast("string").alias("location"), F.lit("").alias("company"),
        F.when(kind >= "type-5", F.upper(kind)).alias("job_type"),
        F.when(kind == "type-9", 51)
        .when(kind != "type-7", F.lit(3) + F.substr(kind, F.lit(6)).cast("int")).alias("top_k"))
    return matching.match_many(vector_jobs(spark, folder), candidates)


def _document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as jobs; those numbered like a vector have it, those of a label an empty one."""
    vectors = read_table(spark, folder, "embeddings").select(c("vec_id").alias("id"), F.when(
        c("label") == 5, F.array().cast("array<double>")).otherwise(c("embedding").cast("array<double>")).alias("embedding"))
    return staged(document_jobs(spark, folder).drop("embedding").join(vectors, "id", "left"))


def _match_requests(spark: SparkSession, folder: str) -> matching.Answers:
    """Every turn asks for jobs; some filter by place or company, some have no text or a bad top_k."""
    conv, turn = c("conv_id"), c("turn")
    asked = turn % 7 != 5
    requests = read_table(spark, folder, "conversations").select(
        (conv * 1000 + turn).alias("candidate_id"), F.when(asked, c("text")).alias("resume_text"),
        F.array(F.when(asked, c("role")).otherwise(F.lit(" "))).alias("skills"),
        F.when(turn % 3 == 1, "E").when(turn % 3 == 2, "fr").alias("location"),
        F.when(conv % 4 == 1, "SRC1").when(conv % 4 == 2, "src_2").alias("company"),
        F.lit("").alias("job_type"),
        F.when(conv % 10 == 9, 0).when(conv % 10 != 7, (3 + conv % 5).cast("int")).alias("top_k"))
    return matching.match_requests(
        _document_vectors(spark, folder), requests, embedding.hashing_embedder(64), 64)


def match_requests(spark: SparkSession, folder: str) -> DataFrame:
    found = _match_requests(spark, folder).matches
    return found.select(
        "candidate_id", "rank", "similarity_score", "match_reason", "total_candidates", "reject_reason",
        c("job.id").alias("job_id"), "job.url", "job.title", "job.company", "job.location")


def match_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that the same requests have made, by value."""
    return _match_requests(spark, folder).vectors.select(
        "id", F.size("embedding").alias("width"), _weighted(c("embedding")).alias("weighted"))


def match_one(spark: SparkSession, folder: str) -> DataFrame:
    vector = [float(i % 7 - 3) for i in range(64)]
    return matching.match_one(vector_jobs(spark, folder), vector, job_type="TYPE_", top_k=50)


def embed_hook(spark: SparkSession, folder: str) -> DataFrame:
    """Non-zero vector positions of the stand-in embedder."""
    texts = read_table(spark, folder, "benchmark").select(c("item_id").alias("id"), "text")
    found = embedding.embed_texts(texts, embedding.hashing_embedder(64), 64)
    return found.select("id", F.posexplode("embedding").alias("pos", "value")).where(
        "value <> 0").select("id", "pos", F.round("value", 4).alias("value"))


def embed_once(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, with vectors on file for the good ones; those of toxic ones
    are past their lifetime."""
    texts = documents(spark, folder).select(c("doc_id").alias("id"), "text")
    good = read_table(spark, folder, "labels").where("quality = 1")
    age = F.when(c("toxic") == 1, F.expr("INTERVAL 3601 SECONDS")).otherwise(
        F.expr("INTERVAL 3600 SECONDS"))
    cached = texts.join(good, c("id") == c("doc_id")).select(
        text.text_key(c("text")).alias("text_key"),
        F.array(F.lit(-1.0)).alias("embedding"), (as_of() - age).alias("embedded_at"))
    found = embedding.embed_once(texts, cached, embedding.hashing_embedder(16), as_of(), 16)
    return found.select("id", "text_key", F.size("embedding").alias("width"),
                        _weighted(c("embedding")).alias("weighted"))


# --- prompts -------------------------------------------------------------------

def query_text(spark: SparkSession, folder: str) -> DataFrame:
    return matching.query_texts(conversation_requests(spark, folder)).select(
        "candidate_id", "text", "reject_reason")


def letter_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a request: by known or unknown job id, by text, or by
    neither."""
    kind = c("event_type")
    user = c("user_id")
    requests = read_table(spark, folder, "events").select(
        c("event_id").alias("request_id"),
        F.when(kind.isin("click", "view"), user)
        .when(kind == "error", user + 1_000_000_000_000).alias("job_id"),
        F.when(kind == "purchase", c("props")).otherwise(F.lit(" ")).alias("job_text"),
        F.concat(F.lit("R "), kind).alias("resume_text"),
        F.when(user > 9, F.concat(F.lit("N"), user)).alias("candidate_name"),
        F.when(kind != "view", kind).otherwise(F.lit("")).alias("company_override"),
        F.when(user == 7, "odd").when(kind == "click", "warm").alias("tone"),
        F.when(kind == "view", "short").alias("length"))
    return letters.letter_prompts(requests, document_jobs(spark, folder))


def _letter_requests(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select(
        c("page_id").alias("request_id"), c("url").alias("job_url"),
        c("priority").alias("resume_text"), c("segment").alias("candidate_name"),
        F.lit("confident").alias("tone"), F.lit(None).cast("string").alias("length"))


def letter_from_url(spark: SparkSession, folder: str) -> DataFrame:
    """A letter for every ad; the older ads are stored already."""
    jobs = shared_copy(ad_jobs(spark, folder))  # both sides read the parse
    known = stored_ads(spark, folder).select("id")
    return letters.letter_prompts_from_urls(
        _letter_requests(spark, folder), jobs.join(known, "id", "left_semi"), jobs.join(known, "id", "left_anti"))


def letter_get_or_create(spark: SparkSession, folder: str) -> DataFrame:
    """The same letters; the older ads are in the job table, the others are fetched, parsed and stored for them."""
    store = JobStore(spark, f"{shared_folder(spark)}/jobloom-letters-{uuid.uuid4().hex}", 8)
    ads = posting_pages(spark, folder)
    old = spread(fetched_ads(spark, folder).join(stored_ads(spark, folder).select(c("id").alias("page_id")), "page_id", "left_semi"))
    store.append(ingest.build_jobs(pages.parse_pages(old, as_of()).where("parse_error is null"), as_of()), "before")
    requests = _letter_requests(spark, folder)
    return letters.letters_for_urls(store, requests, ads, as_of(), "letters")


def explain_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn explained against the turn that follows it, the last one against nothing."""
    turns = read_table(spark, folder, "conversations")
    answers = turns.select("conv_id", (c("turn") - 1).alias("turn"), c("text").alias("job_text"))
    pairs = turns.withColumnRenamed("text", "resume_text").join(answers, ["conv_id", "turn"], "left")
    return letters.explain_prompts(pairs).select("conv_id", "turn", "prompt")


QUERIES = {q.__name__: q for q in (
    page_fields, page_lines, page_description, page_parse,
    parse_page, jsonld_fields, header_fields, labelled_values, job_rows,
    seniority, job_summary, stored_summaries, job_text,
    ingest_status, ingest_counts, ingest_saved, ingest_failures, summary_lookup, listed_jobs, store_batches, store_lookup, store_values, stream_ingest,
    list_jobs, list_total, keyword_search, filter_jobs, job_lookup,
    clean_text, truncate_slug, text_keys, url_fields, sentences, responsibilities,
    skill_split, relative_times,
    skills_extract, vocabulary_extract, skills_json, candidate_skills, skill_fit, skill_overlap, best_fits,
    cosine, embedding_json, backfill_pick, backfill, semantic_match, match_requests, match_vectors, match_one,
    embed_hook, embed_once,
    query_text, letter_prompt, letter_from_url, letter_get_or_create, explain_prompt,
)}
