"""Raw page -> parsed posting. One chain of projections, no shuffle.

Columns are staged (`_page`, `_nodes`, `_ld`, ...) because each is read
several times; the optimizer keeps a projection apart when folding it into the
next would repeat expensive work.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions import markup
from jobloom.functions.jsontext import truthy, variant_kind, variant_text
from jobloom.functions.text import (
    BLANK_CLASS, bind, collapse, empty_to_null, made_or_null, strip, url_source,
)
from jobloom.functions.when import out_of_range, relative_time

#: Bytecodes of the longest method that HotSpot compiles.
COMPILED = 8000

# Meta keys tried in order.
TITLE_METAS = ["og:title", "twitter:title", "title"]
COMPANY_METAS = ["og:site_name", "twitter:site"]

# Company names that stand for the job board itself.
BOARD_NAMES = ["linkedin", "@linkedin"]

# Header lines that are page furniture, and phrases that mark one.
FURNITURE_LINES = ["apply", "save", "report this job", "see who has hired for this role"]
FURNITURE_PHRASES = ["applicant", "hiring for this role"]

# Labels by field, tried in order.
LOCATION_LABELS = ["Location"]
DATE_LABELS = ["Date Posted", "Posted", "Posted On"]
JOB_TYPE_LABELS = ["Employment type", "Job type", "Full/Part-Time", "Schedule"]

# Window sizes and length limits.
COMPANY_WINDOW = 7
HEADER_WINDOW = 11
MAX_COMPANY_LINE = 60
MAX_HEADER_COMPANY = 120
MAX_LOCATION = 60
MAX_LABELLED = 80

# Line patterns. "words, XX" is tested on the last word before
# the comma only, which finds the same lines in linear time.
_WS = f"[{BLANK_CLASS}]"
_CITY_STATE = rf"(?:[A-Za-z]+|{_WS}+),{_WS}*[A-Z]{{2}}"
PLACE_LINE = rf"(?iU)\b(?:remote|united states|{_CITY_STATE})\b"
PLACE_OR_MODE_LINE = rf"(?iU)\b(?:remote|united states|hybrid|on[- ]site|{_CITY_STATE})\b"
HEADER_PLACE = (
    rf"(?iU)\bremote\b|\bhybrid\b|\bon[-{BLANK_CLASS}]?site\b"
    rf"|[A-Z][.{BLANK_CLASS}'-]*[A-Za-z.{BLANK_CLASS}'-],{_WS}?[A-Z][A-Za-z.{BLANK_CLASS}'-]"
)
AGO = (
    rf"(?iU)\b\d+{_WS}+(?:minute|minutes|hour|hours|day|days|week|weeks|month|months)"
    rf"{_WS}+ago\b"
)
JOB_TYPE = (
    rf"(?iU)\b(?:full[-{BLANK_CLASS}]?time|part[-{BLANK_CLASS}]?time|contract|temporary"
    r"|internship|intern|apprenticeship)\b"
)
VALUE_END = (
    rf"{_WS}{{2,}}|\n|\b[A-Z][a-zA-Z ]{{2,}}:|\b[A-Z][a-z]+{_WS}[A-Z][a-z]+|\z"
)


def looks_like_location(line: Column) -> Column:
    return line.rlike(PLACE_OR_MODE_LINE)


def looks_like_relative_date(line: Column) -> Column:
    return line.rlike(AGO)


def is_bad_company(company: Column) -> Column:
    return empty_to_null(company).isNull() | F.lower(company).isin(BOARD_NAMES)


def valid_location(location: Column) -> Column:
    """NULL instead of a long or dotted location; nothing is tried in its place."""
    fits = (F.length(location) <= MAX_LOCATION) & ~F.contains(location, F.lit("."))
    return F.when((location != "") & fits, location)


# --- single fields ---------------------------------------------------------

def page_title(ld: Column, page: Column, metas: Column) -> Column:
    ld_title = F.try_variant_get(ld, "$.title", "variant")
    has_h1, h1 = markup.first_text(page, "h1")
    _, head_title = markup.first_text(page, "title")
    chain = F.when(truthy(ld_title), collapse(variant_text(ld_title))).when(has_h1, h1)
    for key in TITLE_METAS:
        content = markup.meta_content(metas, key)
        chain = chain.when(content.isNotNull(), collapse(content))
    return chain.otherwise(head_title)


def markup_company(ld: Column, metas: Column) -> Column:
    name = F.try_variant_get(ld, "$.hiringOrganization.name", "variant")
    from_meta = []
    for key in COMPANY_METAS:
        value = collapse(markup.meta_content(metas, key))
        from_meta.append(F.when(~F.lower(value).isin(BOARD_NAMES), value))
    return F.when(truthy(name), collapse(variant_text(name))).otherwise(
        F.coalesce(*from_meta))


def ld_address(ld: Column) -> Column:
    """The first place's address when places are a list."""
    return F.coalesce(
        F.try_variant_get(ld, "$.jobLocation[0].address", "variant"),
        F.try_variant_get(ld, "$.jobLocation.address", "variant"),
    )


def ld_location(address: Column) -> Column:
    def part(name: str) -> Column:
        value = F.try_variant_get(address, f"$.{name}", "variant")
        return F.when(truthy(value), strip(variant_text(value)))

    return collapse(F.concat_ws(
        ", ", part("addressLocality"), part("addressRegion"), part("addressCountry")))


def ld_date(ld: Column) -> tuple[Column, Column]:
    """(text or NULL, True when the value is set but not text)."""
    value = F.try_variant_get(ld, "$.datePosted", "variant")
    is_text = variant_kind(value) == "STRING"
    text = F.when(is_text, collapse(F.try_variant_get(value, "$", "string")))
    return text, F.coalesce(truthy(value) & ~is_text, F.lit(False))


def ld_job_type(ld: Column) -> Column:
    value = F.try_variant_get(ld, "$.employmentType", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = F.array_join(F.transform(F.filter(items, truthy), variant_text), ", ")
    single = F.when(truthy(value), variant_text(value))
    return collapse(F.when(items.isNotNull(), listed).otherwise(single))


def lines_after(lines: Column, title: Column, count: int) -> Column:
    """Up to `count` lines after the first line equal to the title."""
    at = F.array_position(lines, title)
    return F.when(at > 0, F.slice(lines, (at + 1).cast("int"), F.lit(count)))


def header_company(lines: Column, title: Column) -> Column:
    def plausible(line: Column) -> Column:
        low = F.lower(line)
        noise = low.isin(FURNITURE_LINES)
        for phrase in FURNITURE_PHRASES:
            noise = noise | F.contains(low, F.lit(phrase))
        return (
            ~noise
            & (F.length(line) <= MAX_COMPANY_LINE)
            & ~F.contains(line, F.lit("."))
            & ~looks_like_location(line)
            & ~looks_like_relative_date(line)
        )

    nearby = lines_after(lines, title, COMPANY_WINDOW)
    return F.try_element_at(F.filter(nearby, plausible), F.lit(1))


def first_place_line(lines: Column) -> Column:
    return F.try_element_at(F.filter(lines, lambda x: x.rlike(PLACE_LINE)), F.lit(1))


def header_rest(nearby: Column, company: Column) -> Column:
    """Header lines without the one that would serve as the company when the
    markup names none: the first that is short and is neither place, date nor
    applicant count. That line gives no other field."""
    def takes_company(line: Column) -> Column:
        low = F.lower(line)
        return (
            (F.length(line) < MAX_HEADER_COMPANY)
            & ~F.contains(low, F.lit("applicant"))
            & ~F.contains(low, F.lit("ago"))  # plain substring: "Chicago" too
            & ~line.rlike(HEADER_PLACE)
        )

    first = F.array_position(F.transform(nearby, takes_company), True).cast("int")
    at = F.when(empty_to_null(company).isNull(), first).otherwise(F.lit(0))
    # A lambda re-evaluates what it captures for every item, hence `bind`.
    return bind(at, lambda n: F.filter(nearby, lambda _, i: i + 1 != n))


def header_fields(nearby: Column, rest: Column) -> dict[str, Column]:
    dates = F.filter(rest, looks_like_relative_date)
    types = F.filter(rest, lambda x: x.rlike(JOB_TYPE))
    return {
        "location": F.when(F.size(rest) > 0, first_place_line(nearby)),
        "date_posted": collapse(  # the last dated line wins
            F.regexp_extract(F.try_element_at(dates, F.lit(-1)), AGO, 0)),
        "job_type": collapse(  # the first typed line wins
            F.regexp_extract(F.try_element_at(types, F.lit(1)), JOB_TYPE, 0)),
    }


def folded(text: Column) -> Column:
    """Case-folded copy for cheap containment tests ahead of a regex."""
    return F.lower(F.upper(text))


def _after(full_text: Column, folded_text: Column, word: str, pattern: str) -> Column:
    """First group of a case-insensitive pattern, '' without a match. Most
    pages lack the word, and a containment test is far cheaper than the scan."""
    return F.when(
        F.contains(folded_text, F.lit(word.lower())),
        F.regexp_extract(full_text, f"(?idU){pattern}", 1),
    ).otherwise(F.lit(""))


def labelled_value(full_text: Column, folded_text: Column, labels: list[str]) -> Column:
    """Value after the first label that occurs, which decides even when nothing
    is left of it. Labels match inside words ("Relocation")."""
    raw = None
    for label in reversed(labels):
        found = _after(
            full_text, folded_text, label, rf"\Q{label}\E{_WS}*:?{_WS}*(.+)")
        raw = made_or_null(found) if raw is None else F.coalesce(made_or_null(found), raw)
    kept = F.regexp_extract(strip(raw), rf"(?sU)^(.*?)(?={VALUE_END})", 1)
    return collapse(F.btrim(F.left(kept, F.lit(MAX_LABELLED)), F.lit(" •-")))


def company_from_text(full_text: Column, folded_text: Column) -> Column:
    labelled = _after(
        full_text, folded_text, "company", rf"Company{_WS}*:?{_WS}*(.+)")
    hiring = _after(
        full_text, folded_text, "about the job",
        rf"About the job{_WS}+(.+?){_WS}+is hiring")
    return F.coalesce(collapse(labelled), collapse(hiring))


def description(ld: Column, page: Column) -> Column:
    value = F.try_variant_get(ld, "$.description", "variant")
    from_ld = F.when(truthy(value), collapse(variant_text(value)))
    return F.coalesce(from_ld, markup.body_text(page))


# --- operators ---------------------------------------------------------------

def page_lines(pages: DataFrame) -> DataFrame:
    """Adds `_page` (see `markup.readable`), `_nodes` and `_lines`."""
    return (
        pages.withColumn("_page", markup.readable(F.col("html")))
        .withColumn("_nodes", markup.text_nodes(F.col("_page")))
        .withColumn("_lines", markup.text_lines(F.col("_nodes")))
    )


def with_posting(pages: DataFrame) -> DataFrame:
    """Adds `_ld`, the JobPosting block. Of a repeated key the last value counts, which is a
    setting of the session; it is made here, and holds for all JSON that the session reads as VARIANT.
    So does that methods are generated no longer than HotSpot compiles; a smaller limit stays."""
    conf = pages.sparkSession.conf
    conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > COMPILED:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED))
    return pages.withColumn("_ld", markup.job_posting(F.col("html")))


def json_ld_fields(pages: DataFrame) -> DataFrame:
    """Adds `_ld` and what the JobPosting block alone says about each field."""
    ld = F.col("_ld")
    date, bad_date = ld_date(ld)
    staged = with_posting(pages)
    return staged.withColumn("_ld_address", ld_address(ld)).withColumns({
        "_ld_location": ld_location(F.col("_ld_address")),
        "_ld_date": date,
        "_ld_bad_date": bad_date,
        "_ld_job_type": ld_job_type(ld),
    })


def parse_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """All input columns except `html`, plus the seven parsed fields and
    `parse_error` (NULL when the page parsed)."""
    c = F.col
    staged = (
        json_ld_fields(page_lines(pages))
        .withColumn("_metas", markup.meta_tags(c("_page")))
        .withColumn("_title", page_title(c("_ld"), c("_page"), c("_metas")))
        .withColumn("_full_text", F.array_join(c("_nodes"), "\n"))
        .withColumns({
            "_folded": folded(c("_full_text")),
            "_markup_company": markup_company(c("_ld"), c("_metas")),
            "_nearby": lines_after(c("_lines"), c("_title"), HEADER_WINDOW),
        })
        .withColumn("_rest", header_rest(c("_nearby"), c("_markup_company")))
    )
    head = header_fields(c("_nearby"), c("_rest"))
    date_text = F.coalesce(
        c("_ld_date"), head["date_posted"], labelled_value(c("_full_text"), c("_folded"), DATE_LABELS))
    located = F.coalesce(
        c("_ld_location"), head["location"],
        labelled_value(c("_full_text"), c("_folded"), LOCATION_LABELS))
    company = F.when(~is_bad_company(c("_markup_company")), c("_markup_company")).otherwise(
        F.coalesce(header_company(c("_lines"), c("_title")),
                   company_from_text(c("_full_text"), c("_folded"))))
    typed = F.coalesce(
        c("_ld_job_type"), head["job_type"],
        labelled_value(c("_full_text"), c("_folded"), JOB_TYPE_LABELS))
    error = F.when(c("_ld_bad_date"), F.lit("datePosted is not text")).when(
        out_of_range(c("_date_text"), as_of), F.lit("date value out of range"))
    kept = [c(name) for name in pages.columns if name != "html"]
    return (
        staged.withColumns({"_date_text": date_text, "_location": located})
        .select(
            *kept,
            url_source(c("url")).alias("source"),
            c("_title").alias("title"),
            company.alias("company"),
            valid_location(c("_location")).alias("location"),
            relative_time(c("_date_text"), as_of).alias("date_posted"),
            typed.alias("job_type"),
            description(c("_ld"), c("_page")).alias("description_raw"),
            # Every consumer filters on this column. As a generated one it stops
            # that filter from being pushed down, which would parse twice.
            F.explode(F.array(error)).alias("parse_error"),
        )
    )
