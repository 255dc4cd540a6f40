"""Fixed schemas. Nothing in this package infers a schema."""

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "DOUBLES": T.ArrayType(T.DoubleType()),
}


def _fields(spec: str) -> T.StructType:
    """'name TYPE, ...' without needing a running session."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PAGES = _fields("page_id BIGINT, url STRING, html STRING")

JOB = _fields(
    """id BIGINT, url STRING, source STRING, title STRING, company STRING,
    location STRING, employment_type STRING, description_raw STRING,
    description_clean STRING, skills STRINGS, summary STRING,
    date_posted TIMESTAMP, job_type STRING, embedding DOUBLES,
    created_at TIMESTAMP"""
)

# The stored form adds two lower-cased keys so that list filters become plain
# equality, which parquet can push into the scan.
STORED_JOB = T.StructType(
    JOB.fields + _fields("company_key STRING, location_key STRING").fields)

# Everything a reader may see; the vector stays inside.
PUBLIC_JOB_COLUMNS = [f.name for f in JOB.fields if f.name != "embedding"]

INGEST_REQUESTS = _fields("pos BIGINT, url STRING")

CANDIDATES = _fields(
    """candidate_id BIGINT, resume_text STRING, skills STRINGS,
    location STRING, company STRING, job_type STRING, top_k INT"""
)

LETTER_REQUESTS = _fields(
    """request_id BIGINT, job_id BIGINT, job_text STRING, job_url STRING,
    resume_text STRING, candidate_name STRING, company_override STRING,
    tone STRING, length STRING"""
)
