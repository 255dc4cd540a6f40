"""The registered queries again, as SQL for DuckDB.

Written from the meaning of each query, not from its Spark plan. DuckDB's regex
has ASCII word boundaries and no look-around, so boundaries are spelled out and
sentence ends are marked before splitting.
"""

import re

from jobloom.functions import prompts, role, skills
from jobloom.plans.inputs import HINTS, KEYWORDS, VERBS, VOCABULARY
from jobloom.plans.postings import AS_OF, expected_cte

# Blanks by code point: this regex dialect has no Unicode blank class.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_WORD = r"[^\pL\pM\p{Nd}\p{Pc}]"


# --- expressions ---------------------------------------------------------------

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"nullif({strip(f'''regexp_replace({x}, '{WS}+', ' ', 'g')''')}, '')"


def clean(x: str) -> str:
    spaced = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return strip(rf"regexp_replace({spaced}, '[^\x20-\x7E]', '', 'g')")


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def find_skills(x: str, vocabulary) -> str:
    """Constant patterns, which DuckDB compiles once."""
    tests = ", ".join(
        f"CASE WHEN regexp_matches({x}, '(?i)(^|{NOT_WORD}){re.escape(v)}({NOT_WORD}|$)') "
        f"THEN {quoted(v)} END" for v in vocabulary)
    return f"list_filter([{tests}], lambda s: s IS NOT NULL)"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g')"
    pieces = rf"string_split_regex({marked}, '\x01|\n+')"
    return (
        f"list_transform(list_filter({pieces}, lambda p: {strip('p')} <> ''), "
        "lambda p: trim(p, ' -•' || chr(9)))"
    )


def duties(x: str, verbs) -> str:
    verb = f"(^|{NOT_WORD})({'|'.join(verbs)})({NOT_WORD}|$)"
    kept = (
        f"list_filter(list_transform({sentences(x)}, lambda p: {strip('p')}), "
        f"lambda p: length(p) > 20 AND regexp_matches(lower(p), '{verb}'))"
    )
    first_seen = "lambda p, i: list_position(k, p) = i"
    return (
        f"list_slice((SELECT list_filter(k, {first_seen}) FROM (SELECT {kept} AS k)), 1, 4)"
    )


def seniority(x: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({x}), '(^|{NOT_WORD}){w}({NOT_WORD}|$)') THEN '{label}'"
        for w, label in role.SENIORITY.items())
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'Unknown' {cases} ELSE 'Not specified' END"


def distinct_ci(x: str) -> str:
    return (
        f"list_filter({x}, lambda e, i: list_position("
        f"list_transform({x}, lambda y: lower(y)), lower(e)) = i)"
    )


def sorted_ci(x: str) -> str:
    keyed = f"list_transform({x}, lambda e: lower(e) || chr(1) || e)"
    return f"list_transform(list_sort({keyed}), lambda z: split_part(z, chr(1), 2))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

ADS = "WITH " + expected_cte()


# --- raw pages -----------------------------------------------------------------

def _removed(x: str, names) -> str:
    for name in names:
        x = rf"regexp_replace({x}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', chr(1), 'g')"
    return x


def _nodes(x: str) -> str:
    split = rf"string_split(regexp_replace({x}, '<[a-zA-Z/!?][^>]*>', chr(1), 'g'), chr(1))"
    decoded = "p"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"),
                       ("gt", ">"), ("nbsp", "\xa0"), ("amp", "&")):
        decoded = f"replace({decoded}, '&{name};', {quoted(char)})"
    return (
        f"list_filter(list_transform({split}, lambda p: {strip(decoded)}), "
        "lambda p: p <> '')"
    )


_SEEN = _removed("regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g')", ["script", "style"])
_BODY = (
    r"coalesce(nullif(regexp_extract(kept, '(?is)<body\b[^>]*>(.*?)(</body\s*>|$)', 1), ''),"
    " kept)"
)
_LINES = f"list_transform({_nodes('seen')}, lambda n: regexp_replace(n, '{WS}+', ' ', 'g'))"
_H1 = r"regexp_extract(seen, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)"
PAGES = f"""
WITH seen AS (SELECT *, {_SEEN} AS seen FROM pages),
kept AS (SELECT *, {_removed('seen', ['noscript', 'header', 'footer', 'nav'])} AS kept
         FROM seen),
read AS (
  SELECT page_id, url, {_LINES} AS lines,
         {collapse(f"array_to_string({_nodes(_H1)}, ' ')")} AS title,
         array_to_string({_nodes(_BODY)}, ' ') AS description_raw,
         replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), 'www.', '') AS source
  FROM kept)
"""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["page_fields"] = f"""{PAGES}
SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid_url, source, title,
       {clean('description_raw')} AS description_clean,
       {joined(find_skills(clean('description_raw'), VOCABULARY))} AS skills
FROM read"""

ORACLE_SQL["page_lines"] = f"""{PAGES}
SELECT page_id, CAST(len(lines) AS INT) AS n_lines, {joined('lines')} AS lines FROM read"""

ORACLE_SQL["page_description"] = f"{PAGES} SELECT page_id, description_raw FROM read"


# --- job ads -------------------------------------------------------------------

ORACLE_SQL["parse_page"] = f"""{ADS}
SELECT page_id, source, title, company, location, date_posted, job_type, description_raw,
       parse_error FROM ads"""

ORACLE_SQL["jsonld_fields"] = f"""{ADS}
SELECT page_id, CASE WHEN layout = 'F' THEN raw_title END AS title,
       CASE WHEN layout = 'F' THEN raw_company END AS company,
       CASE WHEN layout = 'F' THEN raw_place END AS location,
       CASE WHEN layout = 'F' AND segment <> 'MACHINERY' THEN age_days || ' days ago' END
         AS date_text,
       layout = 'F' AND segment = 'MACHINERY' AS bad_date,
       CASE WHEN layout = 'F' THEN raw_kind || ', Onsite' END AS job_type
FROM ads"""

ORACLE_SQL["header_fields"] = f"""{ADS}
SELECT page_id, CASE WHEN layout = 'O' THEN raw_company END AS company,
       CASE WHEN layout = 'O' THEN raw_place END AS location,
       CASE WHEN layout = 'O' THEN age_days || ' days ago' END AS date_posted,
       CASE WHEN layout = 'O' THEN raw_kind END AS job_type
FROM ads"""

ORACLE_SQL["labelled_values"] = f"""{ADS}
SELECT page_id,
       CASE WHEN layout = 'P' AND raw_place NOT LIKE 'Middle East%' THEN raw_place END
         AS location,
       CASE WHEN layout = 'P' THEN 'On: ' || age_days || ' days ago' END AS date_text,
       CASE WHEN layout = 'P' THEN raw_kind END AS job_type
FROM ads"""

_JOBS = f"""{ADS}, cleaned AS MATERIALIZED (
  SELECT *, {clean('description_raw')} AS description_clean FROM ads
  WHERE parse_error IS NULL),
jobs AS MATERIALIZED (
  SELECT *, {find_skills('description_clean', skills.SKILLS)} AS skills FROM cleaned)
"""
_SKILLS_JSON = (
    "'[' || array_to_string(list_transform(skills, lambda s: '\"' || s || '\"'), ', ') || ']'"
)

ORACLE_SQL["job_rows"] = f"""{_JOBS}
SELECT page_id AS id, url, source, title, company, location,
       CAST(NULL AS VARCHAR) AS employment_type, description_raw, description_clean,
       {_SKILLS_JSON} AS skills_json, CAST(NULL AS VARCHAR) AS summary, date_posted,
       job_type, '{AS_OF}' AS created_at
FROM jobs"""

ORACLE_SQL["seniority"] = f"""{ADS}
SELECT page_id, {seniority('title')} AS seniority,
       {seniority("nullif(priority, '1-URGENT')")} AS of_priority
FROM facts"""

def after_hint(x: str, items: str, hints, vocabulary) -> str:
    """Items that stand within 80 characters after a hint."""
    tests = ", ".join(
        f"CASE WHEN list_contains({items}, {quoted(v)}) AND regexp_matches({x}, "
        f"'({'|'.join(hints)}).{{0,80}}{re.escape(v.lower())}') THEN {quoted(v)} END"
        for v in vocabulary)
    return f"list_filter([{tests}], lambda s: s IS NOT NULL)"


def _sentence(required: str) -> str:
    top = f"array_to_string(list_slice({required}, 1, 4), ', ')"
    return f"""coalesce(nullif(title, ''), 'This role')
       || coalesce(' at ' || nullif(company, ''), '')
       || coalesce(' based in ' || nullif(location, ''), '')
       || ' focuses on building and supporting software systems.'
       || CASE WHEN seniority IN ('Unknown', 'Not specified') THEN ''
               ELSE ' It appears to be a ' || lower(seniority) || ' role.' END
       || CASE WHEN len({required}) > 0
               THEN ' The role emphasizes skills such as ' || {top} || '.' ELSE '' END"""


def _summary_ctes(text: str, vocabulary) -> str:
    return f"""graded AS (
  SELECT *, {seniority('title')} AS seniority, {duties(text, role.DUTY_VERBS)} AS duties,
         {after_hint(f'lower({text})', 'skills', role.OPTIONAL_HINTS, vocabulary)} AS optional
  FROM jobs), split AS (
  SELECT *, list_filter(skills, lambda s: NOT list_contains(optional, s)) AS required
  FROM graded)"""


ORACLE_SQL["job_summary"] = f"""{_JOBS}, {_summary_ctes('description_clean', skills.SKILLS)}
SELECT page_id AS job_id, {_sentence('required')} AS summary, seniority,
       CASE WHEN len(duties) > 0 THEN {joined('duties')}
            ELSE {quoted('|'.join(role.DEFAULT_DUTIES))} END AS duties,
       {joined('list_slice(required, 1, 6)')} AS required,
       {joined('list_slice(optional, 1, 4)')} AS optional
FROM split"""

_DOCUMENT_JOBS = f"""cleaned AS MATERIALIZED (SELECT *, {clean('text')} AS clean FROM documents),
jobs AS MATERIALIZED (
  SELECT doc_id AS id, 'https://d.example.com/' || doc_id AS url, source,
         'Text in ' || lang AS title, source AS company, lang AS location,
         text AS description_raw, clean AS description_clean,
         {find_skills('clean', VOCABULARY)} AS skills
  FROM cleaned)"""

ORACLE_SQL["stored_summaries"] = f"""
WITH {_DOCUMENT_JOBS}, {_summary_ctes('description_clean', VOCABULARY)}
SELECT id, {_sentence('required')} AS summary FROM split"""


def _job_text(job_type: str) -> str:
    return f"""'Title: ' || title || chr(10) || 'Company: ' || company || chr(10)
       || 'Location: ' || coalesce(location, '') || chr(10) || 'Employment type: ' || chr(10)
       || 'Job type: ' || {job_type} || chr(10) || 'Skills: ' || {_SKILLS_JSON} || chr(10)
       || 'Summary: ' || chr(10) || 'Description: ' || description_clean"""


ORACLE_SQL["job_text"] = f"""{_JOBS}
SELECT page_id AS id, {_job_text('job_type')} AS job_text FROM jobs"""


# --- ingest --------------------------------------------------------------------

_REQUESTS = f"""{ADS}, requests AS (
  SELECT page_id AS pos, page_id, url, true AS valid FROM facts
  UNION ALL
  SELECT 1000000000000 + event_id, page_id,
         CASE WHEN page_id IS NULL THEN 'no-ad:' || user_id
              WHEN event_type = 'error' THEN 'ftp' || substr(url, 6) ELSE url END,
         event_type <> 'error' AND page_id IS NOT NULL
  FROM events LEFT JOIN facts ON page_id = user_id),
known AS (SELECT page_id, ordered_at < TIMESTAMP '1996-01-01 00:00:00' AS stored FROM facts),
judged AS (
  SELECT pos, url, valid, r.page_id, stored, ads.page_id IS NOT NULL AS fetched,
         ads.parse_error,
         row_number() OVER (PARTITION BY url ORDER BY pos) AS occurrence
  FROM requests r LEFT JOIN known USING (page_id) LEFT JOIN ads USING (url)),
statuses AS (
  SELECT pos, url,
         CASE WHEN NOT valid THEN 'failed' WHEN stored THEN 'existing'
              WHEN NOT fetched OR parse_error IS NOT NULL THEN 'failed'
              WHEN occurrence = 1 THEN 'ingested' ELSE 'existing' END AS status,
         CASE WHEN NOT valid THEN 'Invalid URL. Only http/https URLs are allowed.'
              WHEN stored THEN NULL WHEN NOT fetched THEN 'Page could not be fetched.'
              ELSE parse_error END AS error,
         CASE WHEN valid AND (stored OR (fetched AND parse_error IS NULL))
              THEN page_id END AS job_id
  FROM judged)
"""
ORACLE_SQL["ingest_status"] = f"{_REQUESTS} SELECT * FROM statuses"
ORACLE_SQL["ingest_counts"] = f"""{_REQUESTS}
SELECT count(*) FILTER (status = 'ingested') AS ingested_count,
       count(*) FILTER (status = 'existing') AS existing_count,
       count(*) FILTER (status = 'failed') AS failed_count
FROM statuses"""

_ANSWERED = f"""{PAGES}, asked AS (
  SELECT event_id AS pos, event_type <> 'error' AS valid, read.*,
         CASE WHEN event_type = 'error' THEN 'ftp:' || event_id
              ELSE coalesce(url, 'https://none.example.com/' || user_id) END AS asked_url
  FROM events LEFT JOIN read ON page_id = user_id)"""
ORACLE_SQL["ingest_saved"] = f"""{_ANSWERED}
SELECT pos, CASE WHEN page_id % 3 > 0 AND row_number() OVER (PARTITION BY asked_url ORDER BY pos) = 1
                 THEN 'ingested' ELSE 'existing' END AS status,
       page_id AS id, url, CASE WHEN page_id % 3 > 0 THEN title ELSE 'stored' END AS title,
       CASE WHEN page_id % 3 > 0 THEN {clean('description_raw')} END AS description_clean,
       CASE WHEN page_id % 3 > 0 THEN {joined(find_skills(clean('description_raw'), VOCABULARY))} END AS skills
FROM asked WHERE valid AND page_id IS NOT NULL"""
ORACLE_SQL["ingest_failures"] = f"""{_ANSWERED}
SELECT pos, asked_url AS url, CASE WHEN valid THEN 'Page could not be fetched.'
         ELSE 'Invalid URL. Only http/https URLs are allowed.' END AS error
FROM asked WHERE NOT valid OR page_id IS NULL"""

ORACLE_SQL["summary_lookup"] = f"""
WITH {_DOCUMENT_JOBS}, {_summary_ctes('description_clean', VOCABULARY)}
SELECT event_id, user_id * 10 AS job_id, CASE WHEN id IS NULL THEN 'Job not found' ELSE 'ok' END AS status,
       CASE WHEN id IS NOT NULL THEN {_sentence('required')} END AS summary,
       CASE WHEN id IS NOT NULL THEN seniority END AS seniority,
       {joined('list_slice(required, 1, 6)')} AS required
FROM events LEFT JOIN split ON id = user_id * 10"""

ORACLE_SQL["listed_jobs"] = f"""
WITH {_DOCUMENT_JOBS}
SELECT id, url, source, title, company, location, CAST(NULL AS VARCHAR) AS employment_type, description_clean,
       CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS job_type, {joined('skills')} AS skills
FROM jobs WHERE company = 'src2'"""

ORACLE_SQL["store_batches"] = f"""
WITH {_DOCUMENT_JOBS}
SELECT id, url, title, company, location, description_clean, company AS company_key FROM jobs"""

ORACLE_SQL["store_lookup"] = """
SELECT event_id, 'https://d.example.com/' || user_id || CASE WHEN event_type = 'error' THEN '/half' ELSE '' END AS url,
       doc_id AS job_id
FROM events LEFT JOIN documents ON doc_id = user_id AND event_type <> 'error'"""

ORACLE_SQL["store_values"] = f"""
WITH {_DOCUMENT_JOBS}, {_summary_ctes('description_clean', VOCABULARY)}
SELECT id, title, {_sentence('required')} AS summary,
       CAST(CASE WHEN label = 3 THEN 2 ELSE len(embedding) END AS INT) AS width,
       round(CASE WHEN label = 3 THEN vec_id + 1.0 ELSE list_dot_product(
         embedding::DOUBLE[], range(1, len(embedding) + 1)::DOUBLE[]) END, 3) AS weighted
FROM split LEFT JOIN embeddings ON vec_id = id"""

ORACLE_SQL["stream_ingest"] = f"""{PAGES}
SELECT page_id AS id, url, CASE WHEN page_id % 3 > 0 THEN source END AS source,
       CASE WHEN page_id % 3 > 0 THEN title ELSE 'stored' END AS title,
       CASE WHEN page_id % 3 > 0 THEN {clean('description_raw')} END AS description_clean,
       CASE WHEN page_id % 3 > 0 THEN {joined(find_skills(clean('description_raw'), VOCABULARY))} END AS skills
FROM read WHERE page_id % 3 = 0 OR title IS NOT NULL"""


# --- search --------------------------------------------------------------------

_HAYSTACK = "lower(concat_ws(' ', 'Text in ' || lang, nullif(clean, ''), nullif(text, '')))"
_CLEANED = f"(SELECT *, {clean('text')} AS clean FROM documents)"

ORACLE_SQL["list_jobs"] = f"""
SELECT doc_id AS id, source AS company, lang AS location, CAST(length(text) AS INT) AS n
FROM {_CLEANED}
WHERE source = 'src1' AND lang = 'en' AND contains({_HAYSTACK}, 'the t')"""

ORACLE_SQL["list_total"] = f"""
SELECT count(*) AS total FROM {_CLEANED} WHERE contains({_HAYSTACK}, 'fr')"""

def _keyword(keyword: str) -> str:
    return f"""SELECT {quoted(keyword)} AS keyword, doc_id AS id FROM cleaned
WHERE contains({_HAYSTACK}, {quoted(keyword.strip().lower())})"""


ORACLE_SQL["keyword_search"] = f"WITH cleaned AS MATERIALIZED {_CLEANED} " + " UNION ALL ".join(map(_keyword, KEYWORDS))

ORACLE_SQL["filter_jobs"] = """
SELECT p_partkey AS id, p_name AS title, p_brand AS company, p_type AS location FROM part
WHERE p_type ILIKE '%con_m%' AND p_brand ILIKE '%brand#1%' AND p_name ILIKE '%RED%'"""

ORACLE_SQL["job_lookup"] = """
SELECT user_id * 10 AS job_id, 'https://d.example.com/' || doc_id AS url,
       'Text in ' || lang AS title,
       CASE WHEN doc_id IS NULL THEN 'Job not found' ELSE 'ok' END AS status
FROM events LEFT JOIN documents ON doc_id = user_id * 10"""


# --- text ----------------------------------------------------------------------

ORACLE_SQL["clean_text"] = f"""
SELECT doc_id, {clean('text')} AS clean, {collapse('text')} AS collapsed FROM documents"""

ORACLE_SQL["truncate_slug"] = f"""
SELECT doc_id,
       CASE WHEN length(text) <= 500 THEN text
            ELSE regexp_replace(left(text, 500), '{WS}+$', '') || '…' END AS short,
       trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM documents"""

ORACLE_SQL["text_keys"] = f"""
SELECT doc_id, sha256(lower({strip('text')})) AS text_key FROM documents"""

ORACLE_SQL["url_fields"] = r"""
SELECT page_id, replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '') AS source,
       url LIKE 'http%' AS valid,
       CASE WHEN url LIKE 'https://%' THEN 'a.org:80'
            ELSE 's3:' || url END AS odd_source,
       url NOT LIKE 'https://%' AS odd_valid
FROM pages"""

ORACLE_SQL["sentences"] = f"""
SELECT doc_id, CAST(len(s) AS INT) AS n, {joined('s')} AS sentences
FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)"""

ORACLE_SQL["responsibilities"] = f"""
SELECT doc_id, {joined(duties('text', VERBS))} AS duties FROM documents"""

ORACLE_SQL["skill_split"] = f"""
WITH found AS MATERIALIZED (
  SELECT doc_id, text, {find_skills('text', VOCABULARY)} AS s FROM documents),
split AS (SELECT doc_id, s, {after_hint('lower(text)', 's', HINTS, VOCABULARY)} AS o FROM found)
SELECT doc_id, {joined('o')} AS optional,
       {joined('list_filter(s, lambda x: NOT list_contains(o, x))')} AS required
FROM split"""

ORACLE_SQL["relative_times"] = f"""
WITH dated AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS n FROM events),
moved AS (SELECT event_id, event_type = 'error' AND n > 0 AS failed,
  CASE event_type
    WHEN 'click' THEN {AS_OF_SQL} - to_minutes(n) WHEN 'view' THEN {AS_OF_SQL} - to_hours(n)
    WHEN 'signup' THEN {AS_OF_SQL} - to_days(CAST(n * 7 AS INT))
    WHEN 'purchase' THEN {AS_OF_SQL} - to_days(CAST(n * 30 AS INT))
    WHEN 'error' THEN CASE WHEN n = 0 THEN {AS_OF_SQL} END END AS moment FROM dated)
SELECT event_id, {stamp('moment')} AS moment, failed FROM moved"""


# --- skills --------------------------------------------------------------------

ORACLE_SQL["skills_extract"] = f"""
SELECT doc_id, {joined(find_skills('text', VOCABULARY))} AS skills FROM documents"""

ORACLE_SQL["skills_json"] = r"""
SELECT event_id, '["' || event_type || '", "q\"\u00e9"]' AS encoded,
       event_type || '|None|True|' || user_id || '|x' AS decoded,
       CAST(0 AS INT) AS from_object
FROM events"""

_ASKED = f"""
stated AS MATERIALIZED (SELECT conv_id * 1000 + turn AS candidate_id, conv_id AS job_id,
  list_concat([role, 'that'], {find_skills('text', VOCABULARY)}) AS named FROM conversations),
asked AS MATERIALIZED (
  SELECT candidate_id, job_id, {distinct_ci('named')} AS cand FROM stated)"""

ORACLE_SQL["candidate_skills"] = f"""
WITH {_ASKED}
SELECT candidate_id, {joined('cand')} AS skills, CAST(NULL AS VARCHAR) AS reject_reason
FROM asked"""

_LOWERED = "list_transform({}, lambda y: lower(y))"


def _without(items: str, others: str) -> str:
    return (f"list_filter({items}, lambda e: NOT list_contains("
            f"{_LOWERED.format(others)}, lower(e)))")


_MATCHED = f"list_filter(job, lambda e: list_contains({_LOWERED.format('cand')}, lower(e)))"

ORACLE_SQL["skill_fit"] = f"""
WITH {_ASKED}, {_DOCUMENT_JOBS}, pairs AS (
  SELECT candidate_id, job_id, cand, skills AS job, id IS NOT NULL AS found
  FROM asked LEFT JOIN jobs ON id = job_id), scored AS (
  SELECT *, CASE WHEN len(job) = 0 THEN 0
         ELSE CAST(round_even(len({_MATCHED}) / len(job) * 100.0, 0) AS INT) END AS score
  FROM pairs)
SELECT candidate_id, job_id, CASE WHEN found THEN 'ok' ELSE 'Job not found' END AS status,
       CAST(CASE WHEN found THEN score END AS INT) AS fit_score,
       CASE WHEN found THEN {joined('cand')} END AS candidate_skills,
       CASE WHEN found THEN {joined(sorted_ci(_MATCHED))} END AS matched_skills,
       CASE WHEN found THEN {joined(sorted_ci(_without('job', 'cand')))} END AS missing_skills,
       CASE WHEN found AND len(job) = 0 THEN {joined('cand')}
            WHEN found THEN {joined(sorted_ci(_without('cand', 'job')))} END
         AS extra_candidate_skills,
       CASE WHEN NOT found THEN NULL WHEN len(job) = 0 THEN {quoted(skills.NOTE_NO_JOB_SKILLS)}
            WHEN score >= 80 THEN {quoted(skills.NOTE_STRONG)}
            WHEN score >= 50 THEN {quoted(skills.NOTE_MODERATE)}
            WHEN score > 0 THEN {quoted(skills.NOTE_PARTIAL)}
            ELSE {quoted(skills.NOTE_LOW)} END AS notes
FROM scored"""

ORACLE_SQL["skill_overlap"] = f"""
WITH {_ASKED}, {_DOCUMENT_JOBS},
wanted AS (SELECT candidate_id AS request_id, unnest(skills) AS skill
           FROM asked JOIN jobs ON id = job_id),
offered AS (SELECT candidate_id AS request_id, unnest(cand) AS skill FROM asked)
SELECT coalesce(w.request_id, o.request_id) AS request_id,
       coalesce(w.skill, o.skill) AS skill,
       CASE WHEN o.skill IS NULL THEN 'missing' WHEN w.skill IS NULL THEN 'extra'
            ELSE 'matched' END AS side
FROM wanted w FULL JOIN offered o
  ON w.request_id = o.request_id AND lower(w.skill) = lower(o.skill)"""

ORACLE_SQL["best_fits"] = f"""
WITH {_ASKED}, {_DOCUMENT_JOBS},
pairs AS (
  SELECT candidate_id, id AS job_id, len(skills) AS n, len(list_filter(skills, lambda s: list_contains(
           {_LOWERED.format('cand')}, lower(s)))) AS shared
  FROM asked, jobs WHERE len(skills) > 0),
ranked AS (
  SELECT candidate_id, job_id, CAST(round_even(shared / n * 100.0, 0) AS INT) AS fit_score, shared FROM pairs WHERE shared > 0),
best AS (
  SELECT candidate_id, job_id, fit_score,
         CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY fit_score DESC, job_id) AS INT) AS rank FROM ranked)
SELECT candidate_id, rank, job_id, fit_score FROM best WHERE rank <= 5"""

_A_WORD = r"[\pL\pM\p{Nd}\p{Pc}]+"

ORACLE_SQL["vocabulary_extract"] = rf"""
WITH w AS (SELECT string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
entry AS MATERIALIZED (
  SELECT DISTINCT entry, lower(entry) AS key
  FROM (SELECT array_to_string(w[i:i + n - 1], ' ') AS entry
        FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (2), (3)) AS v(n)))
  WHERE regexp_full_match(entry, '{_A_WORD}( {_A_WORD})+')),
token AS MATERIALIZED (
  SELECT doc_id, t[i] AS t, i FROM (
    SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(lower(text), '(?s){_A_WORD}|.') AS t FROM documents))),
run AS (
  SELECT doc_id, t || lead(t, 1) OVER d || lead(t, 2) OVER d AS two,
         t || lead(t, 1) OVER d || lead(t, 2) OVER d || lead(t, 3) OVER d || lead(t, 4) OVER d AS three
  FROM token WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hit AS (
  SELECT DISTINCT doc_id, entry FROM (SELECT doc_id, two AS key FROM run UNION ALL SELECT doc_id, three FROM run) JOIN entry USING (key)),
listed AS (SELECT doc_id, list(entry ORDER BY entry) AS found FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(found), 0) AS INT) AS n, coalesce({joined('found')}, '') AS found
FROM documents LEFT JOIN listed USING (doc_id)"""


# --- vectors -------------------------------------------------------------------

def _hashed(source: str, width: int = 64) -> str:
    """(id, v): word counts of (id, text) over the places."""
    return f"""(
  SELECT id, list(coalesce(n, 0)::DOUBLE ORDER BY pos) AS v
  FROM (SELECT id, unnest(range({width})) AS pos FROM {source})
  LEFT JOIN (SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {width} AS pos, count(*) AS n
             FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM {source})
             GROUP BY ALL) USING (id, pos)
  GROUP BY id)"""


ORACLE_SQL["cosine"] = """
SELECT a.vec_id, CASE WHEN b.vec_id IS NULL THEN 0.0::DOUBLE ELSE round(list_cosine_similarity(
         a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) END AS score
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

ORACLE_SQL["embedding_json"] = """
SELECT vec_id, CAST(CASE WHEN label IN (3, 4, 5) THEN 0 ELSE len(embedding) END AS INT)
         AS width, label IN (3, 4, 5) AS missing,
       CASE WHEN label IN (3, 4, 5) THEN '' ELSE array_to_string(list_transform(embedding,
         lambda x: CAST(CAST(floor(CAST(CAST(x AS VARCHAR) AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), '|') END AS millionths
FROM embeddings"""

ORACLE_SQL["backfill_pick"] = """
SELECT vec_id AS id, 'type-' || label AS job_type FROM embeddings WHERE label IN (1, 2)"""

ORACLE_SQL["backfill"] = f"""
WITH texts AS MATERIALIZED (
  SELECT vec_id AS id, 'Title: ' || chr(10) || 'Company: ' || chr(10) || 'Location: ' || chr(10) || 'Employment type: '
         || chr(10) || 'Job type: type-' || label || chr(10) || 'Skills: []' || chr(10) || 'Summary: ' || chr(10)
         || 'Description: ' AS text
  FROM embeddings WHERE label IN (1, 2)),
made AS (SELECT * FROM {_hashed('texts', 8)})
SELECT vec_id AS id, CAST(CASE WHEN label IN (1, 2) THEN 8 WHEN label = 9 THEN 0
         ELSE len(embedding) END AS INT) AS width,
       CASE WHEN label NOT IN (1, 2, 9) THEN round(list_dot_product(embedding::DOUBLE[],
         range(1, len(embedding) + 1)::DOUBLE[]), 3) END AS kept,
       CASE WHEN label IN (1, 2) THEN 1.0::DOUBLE END AS norm,
       round(list_dot_product(v, range(1, 9)::DOUBLE[]) / sqrt(list_dot_product(v, v)), 3) AS weighted
FROM embeddings LEFT JOIN made ON id = vec_id"""

ORACLE_SQL["semantic_match"] = """
WITH pairs AS (
  SELECT a.vec_id AS candidate_id, b.vec_id AS job_id,
         CASE WHEN a.label = 7 THEN 10 ELSE 3 + a.label END AS top_k,
         round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0
           AS similarity_score
  FROM embeddings a JOIN embeddings b ON a.label < 5 OR a.label = b.label WHERE a.label <> 9),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id
                               ORDER BY similarity_score DESC, job_id) AS rank,
         count(*) OVER (PARTITION BY candidate_id) AS total_candidates
  FROM pairs)
SELECT candidate_id, CAST(rank AS INT) AS rank, similarity_score,
       CAST(NULL AS VARCHAR) AS match_reason, job_id, total_candidates,
       CAST(NULL AS VARCHAR) AS reject_reason
FROM ranked WHERE rank <= top_k
UNION ALL
SELECT vec_id, NULL, NULL, NULL, NULL, 0, 'top_k must be between 1 and 50' FROM embeddings WHERE label = 9"""

_MATCHED_REQUESTS = f"""
WITH {_DOCUMENT_JOBS},
stored AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 5),
asked AS MATERIALIZED (
  SELECT conv_id * 1000 + turn AS id,
         concat_ws(chr(10) || chr(10), nullif({strip('text')}, ''), 'Skills: ' || role) AS text,
         CASE turn % 3 WHEN 1 THEN 'e' WHEN 2 THEN 'fr' ELSE '' END AS place,
         CASE conv_id % 4 WHEN 1 THEN 'src1' WHEN 2 THEN 'src_2' ELSE '' END AS firm,
         CASE conv_id % 10 WHEN 9 THEN 0 WHEN 7 THEN 10 ELSE 3 + conv_id % 5 END AS top_k,
         CASE WHEN turn % 7 = 5 THEN 'Provide either resume_text or skills.'
              WHEN conv_id % 10 = 9 THEN 'top_k must be between 1 and 50' END AS reason
  FROM conversations),
filters AS (SELECT DISTINCT place, firm FROM asked WHERE reason IS NULL),
first_new AS MATERIALIZED (
  SELECT place, firm, id FROM (
    SELECT place, firm, id, row_number() OVER (PARTITION BY place, firm ORDER BY id) AS r
    FROM filters JOIN jobs ON location ILIKE '%' || place || '%' AND company ILIKE '%' || firm || '%'
    WHERE id NOT IN (SELECT id FROM stored))
  WHERE r <= 25),
texts AS MATERIALIZED (
  SELECT id, {_job_text("''")} AS text FROM jobs WHERE id IN (SELECT id FROM first_new)),
made AS MATERIALIZED (SELECT * FROM {_hashed('texts')}),
wanted AS MATERIALIZED (SELECT * FROM {_hashed('(SELECT * FROM asked WHERE reason IS NULL)')}),
usable AS (
  SELECT a.id AS candidate_id, j.id AS job_id, s.v FROM asked a JOIN jobs j
    ON location ILIKE '%' || place || '%' AND company ILIKE '%' || firm || '%' JOIN stored s ON s.id = j.id
  WHERE reason IS NULL
  UNION ALL
  SELECT a.id, f.id, m.v FROM asked a JOIN first_new f USING (place, firm) JOIN made m ON m.id = f.id
  WHERE reason IS NULL),
pairs AS (
  SELECT candidate_id, job_id, round(CASE WHEN list_sum(u.v) = 0 OR list_sum(w.v) = 0 THEN 0.0
           ELSE list_cosine_similarity(w.v, u.v) END, 4) + 0.0 AS similarity_score
  FROM usable u JOIN wanted w ON w.id = candidate_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY similarity_score DESC, job_id) AS rank,
         count(*) OVER (PARTITION BY candidate_id) AS total
  FROM pairs)
"""

ORACLE_SQL["match_requests"] = f"""{_MATCHED_REQUESTS}
SELECT a.id AS candidate_id, CAST(rank AS INT) AS rank, similarity_score,
       CAST(NULL AS VARCHAR) AS match_reason, coalesce(total, 0) AS total_candidates, reason AS reject_reason,
       j.id AS job_id, j.url, j.title, j.company, j.location
FROM asked a LEFT JOIN (SELECT r.* FROM ranked r JOIN asked q ON q.id = candidate_id AND rank <= top_k) r
  ON r.candidate_id = a.id
LEFT JOIN jobs j ON j.id = r.job_id"""

ORACLE_SQL["match_vectors"] = f"""{_MATCHED_REQUESTS}
SELECT id, CAST(64 AS INT) AS width, round(list_dot_product(v, range(1, 65)::DOUBLE[])
         / sqrt(list_dot_product(v, v)), 3) AS weighted FROM made"""

ORACLE_SQL["match_one"] = f"""
SELECT vec_id AS job_id, round(list_cosine_similarity(embedding::DOUBLE[],
         {[float(i % 7 - 3) for i in range(64)]}::DOUBLE[]), 4) + 0.0 AS similarity_score
FROM embeddings ORDER BY similarity_score DESC, job_id LIMIT 50"""

ORACLE_SQL["embed_hook"] = """
WITH words AS (
  SELECT item_id AS id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS digest
  FROM benchmark),
placed AS (
  SELECT id, CAST(CAST('0x' || substr(digest, 1, 8) AS BIGINT) % 64 AS INT) AS pos,
         count(*) AS n FROM words GROUP BY ALL)
SELECT id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 4) AS value FROM placed"""

ORACLE_SQL["embed_once"] = f"""
WITH keyed AS (SELECT doc_id AS id, sha256(lower({strip('text')})) AS text_key FROM documents),
cached AS (SELECT DISTINCT text_key FROM keyed JOIN labels ON id = doc_id
           WHERE quality = 1 AND toxic = 0),
words AS (
  SELECT doc_id AS id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS digest
  FROM documents),
placed AS (
  SELECT id, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % 16 AS pos, count(*) AS n
  FROM words GROUP BY ALL),
made AS (SELECT id, sum((pos + 1) * n) / sqrt(sum(n * n)) AS weighted FROM placed GROUP BY id)
SELECT id, text_key, CAST(CASE WHEN c.text_key IS NULL THEN 16 ELSE 1 END AS INT) AS width,
       CASE WHEN c.text_key IS NULL THEN round(coalesce(weighted, 0.0), 3) ELSE -1.0 END::DOUBLE AS weighted
FROM keyed LEFT JOIN cached c USING (text_key) LEFT JOIN made USING (id)"""


# --- prompts -------------------------------------------------------------------

ORACLE_SQL["query_text"] = f"""
SELECT conv_id * 1000 + turn AS candidate_id,
       concat_ws(chr(10) || chr(10), nullif({strip('text')}, ''),
                 'Skills: ' || role || ', that') AS text,
       CAST(NULL AS VARCHAR) AS reject_reason
FROM conversations"""


def _letter(tone: str, length: str, name: str, company: str, title: str, resume: str,
            text: str) -> str:
    parts = prompts.LETTER_PROMPT.split("%s")
    out = quoted(parts[0])
    for value, part in zip((tone, length, name, company, title, resume, text), parts[1:]):
        out += f" || coalesce({value}, '') || {quoted(part)}"
    return strip(out)


ORACLE_SQL["letter_prompt"] = f"""
WITH {_DOCUMENT_JOBS}, asked AS (
  SELECT event_id AS request_id, event_type AS kind, props, user_id,
         CASE WHEN event_type IN ('click', 'view') THEN user_id
              WHEN event_type = 'error' THEN user_id + 1000000000000 END AS wanted,
         CASE WHEN user_id = 7 THEN 'odd' WHEN event_type = 'click' THEN 'warm'
              ELSE 'professional' END AS tone,
         CASE WHEN event_type = 'view' THEN 'short' ELSE 'medium' END AS length,
         'R ' || event_type AS resume, CASE WHEN user_id > 9 THEN 'N' || user_id END AS name
  FROM events), met AS (
  SELECT *, CASE WHEN kind = 'view' THEN j.company ELSE kind END AS shown_company,
         CASE WHEN kind = 'purchase' THEN props ELSE {_job_text("''")} END AS body,
         CASE WHEN kind = 'signup' THEN 'Provide either job_id or job_text.'
              WHEN tone = 'odd' THEN 'Unknown tone or length.'
              WHEN kind = 'error' OR (wanted IS NOT NULL AND j.id IS NULL)
              THEN 'Job not found' END AS error
  FROM asked LEFT JOIN jobs j ON j.id = wanted)
SELECT request_id, id AS job_id, url AS job_url, shown_company AS company,
       title AS role_title, error,
       CASE WHEN error IS NULL THEN {_letter('tone', 'length', 'name', 'shown_company',
                                             'title', 'resume', 'body')} END AS prompt,
       false AS was_job_created
FROM met"""

ORACLE_SQL["letter_from_url"] = f"""{_JOBS}, met AS (
  SELECT f.page_id AS request_id, j.page_id AS job_id, j.url AS job_url, j.company,
         j.title AS role_title, f.priority AS resume, f.segment AS name,
         j.ordered_at >= TIMESTAMP '1996-01-01 00:00:00' AS created,
         {_job_text('j.job_type').replace('title', 'j.title').replace('company', 'j.company')
          .replace('coalesce(location', 'coalesce(j.location')} AS body
  FROM facts f LEFT JOIN jobs j ON j.page_id = f.page_id)
SELECT request_id, job_id, job_url, company, role_title,
       CASE WHEN job_id IS NULL THEN 'Failed to ingest job from URL' END AS error,
       CASE WHEN job_id IS NOT NULL THEN {_letter("'confident'", "'medium'", 'name', 'company',
                                                  'role_title', 'resume', 'body')} END AS prompt,
       coalesce(created, false) AS was_job_created
FROM met"""

ORACLE_SQL["letter_get_or_create"] = ORACLE_SQL["letter_from_url"]

ORACLE_SQL["explain_prompt"] = """
SELECT a.conv_id, a.turn,
       'Resume:' || chr(10) || a.text || chr(10) || chr(10) || 'Job:' || chr(10) ||
         coalesce(b.text, '') AS prompt
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""
