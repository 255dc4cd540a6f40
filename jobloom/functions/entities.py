"""HTML character references, decoded in one left-to-right pass."""

import html.entities
import json

from pyspark.sql import Column, functions as F

from jobloom.functions.text import bind


def _table() -> dict[str, str]:
    """Named references from the standard library, plus the windows-1252
    reading of &#128; to &#159;."""
    frequent = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot"]
    named = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    table = {k: named.pop(k) for k in frequent}
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            table[f"#{code}"] = char
    return table | named


_TABLE_JSON = json.dumps(_table())


# '&' has been split away: a reference is what stands at the start of a piece.
_REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)"


# Characters that would read as markup once decoded, and their stand-ins.
_MARKUP = "<>\"'"
_STAND_INS = "\x02\x03\x04\x05"


def decode_entities(page: Column) -> Column:
    """Decode every reference of a page that still has its tags, once.

    A decoded '<' must not become a tag, so markup characters are decoded to
    stand-ins, which `shown` turns back when text leaves the page. An unknown
    name keeps its '&' and loses its ';', as a lenient HTML reader does.
    """
    return bind(page, lambda t: F.when(
        F.contains(t, F.lit("&")), bind(F.split(t, "&"), _decode_pieces)
    ).otherwise(t))


def without_marks(page: Column) -> Column:
    """A raw page may hold the characters that are used as marks here; they go."""
    return bind(page, lambda p: F.when(p.rlike("[\x01-\x05]"), F.translate(p, "\x01" + _STAND_INS, "")).otherwise(p))


def shown(text: Column) -> Column:
    """With the markup characters; nearly all texts have none."""
    return bind(text, lambda t: F.when(
        t.rlike(f"[{_STAND_INS}]"), F.translate(t, _STAND_INS, _MARKUP)).otherwise(t))


def _decode_pieces(pieces: Column) -> Column:
    table = F.from_json(F.lit(_TABLE_JSON), "map<string,string>")
    # Each step is its own transform, so that no part is evaluated twice.
    named = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, _REFERENCE, 1).alias("name")),
    )
    looked_up = F.transform(named, lambda s: F.struct(
        s["name"].alias("name"),
        F.substr(s["piece"], F.length(s["name"]) + 1).alias("rest"),
        F.try_element_at(table, s["name"]).alias("known"),
    ))
    decoded = F.transform(looked_up, lambda s: F.concat(
        F.coalesce(
            F.translate(s["known"], _MARKUP, _STAND_INS),
            F.when(F.startswith(s["name"], F.lit("#")),
                   F.translate(_numeric(s["name"]), _MARKUP, _STAND_INS)),
            F.concat(F.lit("&"), s["name"]),
        ),
        F.when(s["name"] == "", s["rest"]).otherwise(
            F.regexp_replace(s["rest"], "^;", "")),
    ))
    return F.concat(F.element_at(pieces, 1), F.array_join(decoded, ""))


def _numeric(name: Column) -> Column:
    """'#8211' or '#x2013' as a character; U+FFFD when there is none."""
    is_hex = F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x"
    code = F.when(
        is_hex, F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("long")
    ).otherwise(F.substr(name, F.lit(2)).try_cast("long"))
    is_character = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(is_character, char).otherwise(F.lit(chr(0xFFFD)))
