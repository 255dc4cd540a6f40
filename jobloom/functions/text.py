"""Text primitives on columns.

Blanks follow Unicode rather than ASCII: `trim` alone removes only U+0020, so
every strip here passes the full blank set to `btrim`, which stays in codegen.
"""

from pyspark.sql import Column, functions as F

# The 29 characters treated as blank, by code point.
BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
# The same set as the inside of a Java character class. Single characters share
# one table and the property is one test, where ranges would be tried in turn.
BLANK_CLASS = (
    r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\p{IsWhite_Space}"
)
BLANK_RUN = f"[{BLANK_CLASS}]+"


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    """NULL for NULL, '' and all-blank input; otherwise the text unchanged."""
    return F.when(strip(text) != "", text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def made_or_null(text: Column) -> Column:
    """As `empty_to_null`, for a text that is costly to make: `nullif` inside a condition makes it twice."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def collapse(text: Column) -> Column:
    """Blank runs become one space, ends stripped, nothing left becomes NULL."""
    return made_or_null(strip(F.regexp_replace(text, BLANK_RUN, " ")))


def clean(text: Column) -> Column:
    """Printable ASCII only. Blanks collapse first, so dropping a character
    between two spaces leaves both."""
    spaced = F.regexp_replace(text, BLANK_RUN, " ")
    return strip(F.regexp_replace(spaced, r"[^\x20-\x7E]", ""))


def truncate(text: Column, max_chars: int = 500) -> Column:
    head = F.concat(rstrip(F.left(text, F.lit(max_chars))), F.lit("…"))
    return F.when(F.length(text) > max_chars, head).otherwise(text)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def sentences(text: Column) -> Column:
    """Rough sentences. Pieces are tested for blankness before bullets are
    stripped, so a lone dash survives as ''."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])[{BLANK_CLASS}]+|\n+")
    return F.transform(
        F.filter(pieces, lambda p: strip(p) != ""),
        lambda p: F.btrim(p, F.lit(" -•\t")),
    )


def text_key(text: Column) -> Column:
    """Reuse key: two texts that differ only in case or outer blanks share it."""
    return F.sha2(F.lower(strip(F.coalesce(text, F.lit("")))), 256)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def url_source(url: Column) -> Column:
    """Network location without any `www.`; the whole url when there is none."""
    host = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.coalesce(empty_to_null(F.replace(host, F.lit("www."), F.lit(""))), url)
