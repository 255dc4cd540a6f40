"""Exact removal of repeated paragraphs, lines and sentences, by hashing.

Texts are cut into units of three sizes: paragraphs (lines between blank ones), lines,
and sentences within a line (up to a full stop, question or exclamation mark with a blank
after it). Units of `least` words or more are normalised and hashed, and digests of all sizes are
grouped globally: the earliest in the order of documents and places stays, the
rest go. A passage that begins inside one line and ends inside another is caught by its sentences, one that
is laid out in short sentences by its line or paragraph. Smaller units stay as they are, for short
phrases repeat without being copies. Only digests move in the shuffle, pre-aggregated on the map side, and
each document is told which of its units are the earliest, so that a unit that
a third of the documents share is no hot key.

Normalised: A-Z lower-cased, white space runs made one blank, ends trimmed.

What goes: a sentence, if it, its line or its paragraph repeats. A line all of whose sentences go is
removed whole, with its line end; in other lines the blanks around stay.

Defined cases: a null text has no units; rows that repeat an id are told apart
by unit number only, so a unit that repeats at the same place of the same id stays in
each; a null id ranks first; an empty table gives no rows. Results are in one
struct column, which replaces a column of its name.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.llm.common import appended, chunks, set_aside, with_field

UNITS = ("paragraph", "line", "sentence")
#: Words of the smallest unit that is looked at.
LEAST_WORDS = 12

RESULT = T.StructType([
    T.StructField("n_units", T.IntegerType()), T.StructField("kept_text", T.StringType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("removed_starts", T.ArrayType(T.IntegerType())),
    T.StructField("removed_ends", T.ArrayType(T.IntegerType()))])
_ARROW = pa.struct([
    ("n_units", pa.int32()), ("kept_text", pa.string()), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("removed_starts", pa.list_(pa.int32())), ("removed_ends", pa.list_(pa.int32()))])
_SENTENCE_END = re.compile(r"(?<=[.!?])(?=[\x20\x09])")
_WHITE = "\t\n\x0b\f\r "

#: Of a line: where it begins and ends, and of its sentences that are not blank where they begin and end, and their words.
Line = tuple[int, int, list[tuple[int, int, list[bytes]]]]


def lines_of(text: str) -> list[Line]:
    found, start = [], 0
    for raw in text.split("\n"):
        sentences, at = [], start
        for piece in _SENTENCE_END.split(raw):
            words = piece.encode().lower().split()
            if words:
                first = at + len(piece) - len(piece.lstrip(_WHITE))
                sentences.append((first, at + len(piece.rstrip(_WHITE)), words))
            at += len(piece)
        found.append((start, start + len(raw), sentences))
        start += len(raw) + 1
    return found


def units_of(lines: list[Line], kinds: Collection[str], least: int) -> dict[tuple[int, int], tuple[bytes, list[int]]]:
    """(begin, end) -> digest and the numbers of the lines that the unit is made of, in the order of places."""
    found = {}

    def add(sentences, numbers):
        n = sum(len(words) for _, _, words in sentences)
        if n and n >= least:
            text = b" ".join([w for _, _, words in sentences for w in words])
            found[sentences[0][0], sentences[-1][1]] = blake2b(text, digest_size=16).digest(), numbers

    paragraph, numbers = [], []
    for i, (_, _, sentences) in enumerate([*lines, (0, 0, [])]):
        if "sentence" in kinds:
            for s in sentences:
                add([s], [i])
        if sentences:
            if "line" in kinds:
                add(sentences, [i])
            paragraph += sentences
            numbers = [*numbers, i]
        else:
            if "paragraph" in kinds and paragraph:
                add(paragraph, numbers)
            paragraph, numbers = [], []
    return dict(sorted(found.items()))


def first_units(docs: DataFrame, kinds: Collection[str] = UNITS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, units): the numbers of the units that are the earliest of their kind."""
    def digests(batches):
        for batch in chunks(batches, "text"):
            of, at, digest = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = units_of(lines_of(text), kinds, least)
                of += [row] * len(own)
                at += range(len(own))
                digest += [d for d, _ in own.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array(digest, pa.binary())],
                names=["doc_id", "at", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    units = docs.where("text is not null").select("doc_id", "text").mapInArrow(
        digests, f"doc_id {kind}, at int, digest binary")
    first = units.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    return first.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.at").alias("units"))


def _without(text: str | None, firsts: set[int], kinds: Collection[str], least: int) -> dict:
    if text is None:
        return {"n_units": 0, "kept_text": None, "starts": [], "ends": [], "removed_starts": [], "removed_ends": []}
    lines = lines_of(text)
    units = units_of(lines, kinds, least)
    repeats = [(span, numbers) for i, (span, (_, numbers)) in enumerate(units.items()) if i not in firsts]
    by_line: dict[int, list[tuple[int, int]]] = {}
    for span, numbers in repeats:
        for i in numbers:
            by_line.setdefault(i, []).append(span)
    kept, gone, parts = [], [], []
    for i, (start, end, sentences) in enumerate(lines):
        cut = [(a, b) for a, b, _ in sentences if any(x <= a and b <= y for x, y in by_line.get(i, ()))]
        if cut and len(cut) == len(sentences):
            gone.append((start, end))
            continue
        edges = [start, *(x for span in cut for x in span), end]
        own = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b or not cut]
        kept += own
        gone += cut
        parts.append("".join([text[a:b] for a, b in own]))
    return {"n_units": len(units), "kept_text": "\n".join(parts), "starts": [a for a, _ in kept],
            "ends": [b for _, b in kept], "removed_starts": [a for a, _ in gone], "removed_ends": [b for _, b in gone]}


def drop_repeats(docs: DataFrame, kinds: Collection[str] = UNITS, least: int = LEAST_WORDS,
                 out: str = "dedup") -> DataFrame:
    """docs (doc_id, text, ...) with a struct: n_units, kept_text, and the places of kept and
    removed stretches in the original text, line by line, in characters."""
    own, back = set_aside(docs.drop(out), ["_of", "_first"])
    first = first_units(own, kinds, least).select(F.col("doc_id").alias("_of"), F.col("units").alias("_first"))
    joined = own.join(first, own["doc_id"].eqNullSafe(first["_of"]), "left").drop("_of")
    schema = with_field(own.schema, out, RESULT)

    def assemble(batches):
        for batch in chunks(batches, "text"):
            made = [_without(text, set(firsts or ()), kinds, least) for text, firsts in zip(
                batch.column("text").to_pylist(), batch.column("_first").to_pylist())]
            yield appended(batch.drop_columns(["_first"]), out, pa.array(made, _ARROW))

    return back(joined.mapInArrow(assemble, schema))
