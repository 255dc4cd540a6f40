"""Lists stored as JSON text, and loosely typed JSON read through VARIANT."""

from pyspark.sql import Column, functions as F

from jobloom.functions.lists import stripped


def _ascii_escape(json_text: Column) -> Column:
    """Non-ASCII characters as \\uXXXX (surrogate pairs above U+FFFF)."""
    escaped = F.transform(
        F.split(json_text, ""),
        lambda c: F.when(
            c.rlike(r"[^\x00-\x7F]"),
            F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1")),
        ).otherwise(c),
    )
    return F.when(json_text.rlike(r"[^\x00-\x7F]"), F.array_join(escaped, "")).otherwise(json_text)


def _json_string(item: Column) -> Column:
    quoted = F.to_json(F.array(item))
    for digit in "ABCDEF":  # control characters, in lower-case hex
        quoted = F.regexp_replace(
            quoted, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", "$1" + digit.lower())
    return _ascii_escape(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def encode_list(items: Column) -> Column:
    """JSON list with ', ' between items. Skill lists reach the embedding text
    in this spelling, so the blank matters."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, _json_string), ", "), F.lit("]"))


def variant_kind(value: Column) -> Column:
    """OBJECT, ARRAY, BOOLEAN, VOID, STRING, ... without type arguments."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _python_like(json_text: Column) -> Column:
    """Nested JSON in literal spelling. Keys come out sorted, since VARIANT
    does not keep their order."""
    spaced = F.regexp_replace(json_text, r'"((?:[^"\\]|\\.)*+)"([:,]?)', "'$1'$2 ")
    return F.regexp_replace(spaced, r"' ([}\]])", "'$1")


def variant_text(value: Column) -> Column:
    """Any JSON value as text, with True/False/None capitalised."""
    text = F.to_json(value)
    return (
        F.when(text.rlike("^[{\\[]"), _python_like(text))
        .when(text == "null", F.lit("None"))
        .when(text.isin("true", "false"), F.initcap(text))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def truthy(value: Column) -> Column:
    """False for absent, null, false, '', 0, [] and {}."""
    falsy = r"""^(?:null|false|""|\[\]|\{\}|-?0(?:\.0*)?(?:[eE].*)?)$"""
    return F.coalesce(~F.to_json(value).rlike(falsy), F.lit(False))


def decode_skills(json_text: Column) -> Column:
    """JSON list of skills; NULL, '', malformed and non-list input give []."""
    items = F.try_variant_get(F.try_parse_json(json_text), "$", "array<variant>")
    return stripped(F.transform(items, variant_text))


def decode_vector(json_text: Column) -> Column:
    """JSON list of numbers; anything else counts as a missing vector."""
    vector = F.from_json(json_text, "array<double>")
    return F.coalesce(vector, F.array().cast("array<double>"))


__all__ = [
    "decode_skills", "decode_vector", "encode_list",
    "truthy", "variant_kind", "variant_text",
]
