"""Job postings derived from the order tables.

The driver's raw pages are not job ads, so the operators that read ads get one
page per order. `FACTS` says what an ad announces; it runs unchanged on both
engines. Only Spark turns those facts into HTML and parses them back, so the
SQL side of a query knows the expected fields without reading any HTML.

Ads come in three layouts: a JSON-LD block, bare header lines, labelled text.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.functions.skills import SKILLS
from jobloom.sources.tables import read_table, spread

AS_OF = "2026-04-30 12:00:00"
_SKILL_LIST = ",".join(SKILLS)

FACTS = f"""
SELECT o_orderkey AS page_id,
       'https://www.board' || CAST(c_nationkey AS VARCHAR(9)) || '.example.com/jobs/'
         || CAST(o_orderkey AS VARCHAR(19)) AS url,
       o_orderdate AS ordered_at,
       o_orderstatus AS layout,
       o_orderpriority AS priority,
       c_mktsegment AS segment,
       c_name AS company,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Lead Staff ' WHEN '2-HIGH' THEN 'Senior '
            WHEN '4-NOT SPECIFIED' THEN 'jr. ' ELSE '' END
         || c_mktsegment || ' Engineer'
         || CASE o_orderpriority WHEN '5-LOW' THEN ' II' ELSE '' END AS title,
       replace(upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)), ' e', ' E')
         || ', ' || substr(c_mktsegment, 1, 2) AS place,
       CAST(extract(DAY FROM o_orderdate) AS INT) AS age_days,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Full-time' WHEN 'AUTOMOBILE' THEN 'Contract'
            WHEN 'MACHINERY' THEN 'part time' WHEN 'HOUSEHOLD' THEN 'Internship'
            ELSE 'Temporary' END AS kind,
       split_part('{_SKILL_LIST}', ',', CAST(c_nationkey % 20 AS INT) + 1) AS skill_a,
       split_part('{_SKILL_LIST}', ',', CAST(o_custkey % 20 AS INT) + 1) AS skill_b,
       split_part('{_SKILL_LIST}', ',', CAST(extract(DAY FROM o_orderdate) AS INT) % 20 + 1)
         AS skill_c,
       'We use ' || split_part('{_SKILL_LIST}', ',', CAST(c_nationkey % 20 AS INT) + 1)
         || ' and ' || split_part('{_SKILL_LIST}', ',', CAST(o_custkey % 20 AS INT) + 1)
         || '. Build and maintain services for R&D at ' || c_name
         || '. Own it! Improve tooling for all ' || lower(c_mktsegment)
         || ' teams. Nice to have: '
         || split_part('{_SKILL_LIST}', ',', CAST(extract(DAY FROM o_orderdate) AS INT) % 20 + 1)
         || '.' AS body
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
     JOIN {{nation}} ON c_nationkey = n_nationkey
     JOIN {{region}} ON n_regionkey = r_regionkey
"""

# Texts around the facts, shared with the SQL side.
CROWD = "Over 25 applicants"
FOOT = "Thanks"


def facts(spark: SparkSession, folder: str) -> DataFrame:
    names = ["orders", "customer", "nation", "region"]
    return spark.sql(FACTS, **{n: read_table(spark, folder, n) for n in names})


def _escaped(text):
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def _json_ld_page():
    c = F.col
    age = F.concat(c("age_days").cast("string"), F.lit(" days ago"))
    city = F.substring_index("place", ", ", 1)
    code = F.substring_index("place", ", ", -1)
    block = F.struct(
        F.lit("JobPosting").alias("@type"), c("title").alias("title"),
        F.struct(c("company").alias("name")).alias("hiringOrganization"),
        F.struct(F.struct(city.alias("addressLocality"), code.alias("addressRegion"))
                 .alias("address")).alias("jobLocation"),
        F.array("kind", F.lit("Onsite")).alias("employmentType"),
        F.concat(c("body"), F.lit("  <b>Apply</b>")).alias("description"),
        F.when(c("segment") != "MACHINERY", age).alias("datePosted"),
    )
    # A number where text belongs makes that ad fail. to_json leaves out NULLs,
    # so the key is free.
    text = F.regexp_replace(
        F.to_json(block), "[}]$",
        F.when(c("segment") == "MACHINERY", F.lit(',"datePosted":20260401}'))
        .otherwise(F.lit("}")))
    # Of a repeated key the last value counts.
    text = F.regexp_replace(text, "^[{]", '{"title":"Draft","datePosted":"yesterday","title":7,')
    return F.concat(
        F.lit('<html><head><script type="application/ld+json">{oops</script>'
              '<script type="application/ld+json">[{"@type":"Thing"},'),
        text, F.lit("]</script></head><body><h1>Other</h1></body></html>"))


def _header_page():
    c = F.col
    age = F.concat(c("age_days").cast("string"), F.lit(" days ago"))
    line = [F.concat(F.lit("<div class='x>y'>"), x, F.lit("</div>"))
            for x in (c("company"), c("place"), age, F.lit(CROWD), c("kind"))]
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Jobs</title><style>p>a{}</style></head>"
              "<body><nav>Menu<nav>Jobs</nav>Home</nav><!-- <h1>No</h1> --><template>a<template>"
              "<h1>b</h1></template>c</template><h1> "),
        c("title"), F.lit("\n</h1>"), *line, F.lit("<p>"), _escaped(c("body")),
        F.lit(f"</p><div><header>Top<header></div><footer>{FOOT}<footer>x</footer>y</footer></body></html>"))


def _labelled_page():
    c = F.col
    age = F.concat(c("age_days").cast("string"), F.lit(" days ago"))
    return F.concat(
        F.lit('<html><head><meta name="og:title" content="'), c("title"),
        F.lit('"/><meta content="LinkedIn" property="og:site_name">'
              "<meta property='twitter:site' content='"), c("company"),
        F.lit("'></head><body><p>Location: "), c("place"), F.lit("</p><p>Posted On: "), age,
        F.lit("</p><p>Employment type:&nbsp;"), c("kind"), F.lit("</p>"),
        F.lit("<script>var a = '<p>no</p>';</script><p>"), _escaped(c("body")),
        F.lit("</p></body></html>"))


def posting_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of every order; labelled ads of low priority could
    not be fetched."""
    html = (
        F.when(F.col("layout") == "F", _json_ld_page())
        .when(F.col("layout") == "O", _header_page())
        .when(F.col("priority") != "5-LOW", _labelled_page())
    )
    # Generated, so that a filter on the page does not make it a second time.
    return spread(facts(spark, folder)).select("page_id", "url", F.explode(F.array(html)).alias("html"))


# The same ads as fields, for the SQL side: what parsing must give.
EXPECTED = f"""
SELECT page_id, url, ordered_at, layout, priority, segment,
       title AS raw_title, company AS raw_company, place AS raw_place, kind AS raw_kind,
       skill_a, skill_b, skill_c, age_days, body,
       replace(regexp_extract(url, '^https?://([^/]*)', 1), 'www.', '') AS source,
       title, company,
       CASE WHEN layout = 'P' AND place LIKE 'Middle East%' THEN NULL ELSE place END AS location,
       CASE WHEN layout = 'F' AND segment = 'MACHINERY' THEN NULL
            ELSE strftime(TIMESTAMP '{AS_OF}' - to_days(age_days), '%Y-%m-%d %H:%M:%S') END
         AS date_posted,
       CASE layout WHEN 'F' THEN kind || ', Onsite' ELSE kind END AS job_type,
       CASE layout
         WHEN 'F' THEN body || ' <b>Apply</b>'
         WHEN 'O' THEN title || ' ' || company || ' ' || place || ' ' || age_days
                       || ' days ago {CROWD} ' || kind || ' ' || body
         ELSE 'Location: ' || place || ' Posted On: ' || age_days
              || ' days ago Employment type:' || chr(160) || kind || ' ' || body
       END AS description_raw,
       CASE WHEN layout = 'F' AND segment = 'MACHINERY' THEN 'datePosted is not text' END
         AS parse_error
FROM facts WHERE layout <> 'P' OR priority <> '5-LOW'
"""


def expected_cte() -> str:
    tables = {n: n for n in ("orders", "customer", "nation", "region")}
    return f"facts AS ({FACTS.format(**tables)}), ads AS ({EXPECTED})"
