"""Benchmark decontamination by Wu-Manber multi-pattern search.

The alphabet is words: a text becomes an array of word numbers, patterns are
windows of item words. A table says for each block of two words how far the
search may move on, by its last place in any pattern; where it may not move, the
block is the end of some pattern, and the bucket of that suffix holds the ones to
compare directly. A task runs the search over many stretches of text at once.

Items come to the tasks in blocks of bounded size, one pass over the texts for
each block (the passes are chained in one job, without a shuffle).

Defined cases: a null or empty text has no words; an item without id or words is
none; items that repeat an id count once; an empty table gives no rows. Results
are in one struct column, which replaces a column of its name.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.llm.common import LOWER, UPPER, appended, chunks, lists, text_bytes, with_field

WINDOW = 10
#: Bytes of item texts sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Consecutive end positions that one cursor of the search walks over.
STRETCH = 256
PAIRS = 4096
_TABLE_BITS = 18

#: Lower-cases A-Z, keeps digits, letters and bytes beyond ASCII; the rest is blank.
_WORDS = bytes(
    b if b >= 0x80 or chr(b) in "0123456789" + LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32
    for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Patterns:
    """Patterns of one length over word numbers (from 1; 0 is any other word)."""

    def __init__(self, rows: np.ndarray, known: int):
        self.rows, self.length, self.base = rows, rows.shape[1], known + 1
        self.block = min(2, self.length)
        blocks = np.stack([self._hash(rows[:, j], rows[:, j - 1]) for j in range(self.block - 1, self.length)])
        self.shift = np.full(1 << _TABLE_BITS, self.length - self.block + 1, np.int64)
        for j, h in enumerate(blocks):
            np.minimum.at(self.shift, h, self.length - self.block - j)
        order = np.argsort(blocks[-1], kind="stable")
        self.rows, ends = rows[order], blocks[-1][order]
        self.order = order
        self.first = np.searchsorted(ends, np.arange((1 << _TABLE_BITS) + 1))

    def _hash(self, last: np.ndarray, previous: np.ndarray) -> np.ndarray:
        key = last.astype(np.uint64)
        if self.block == 2:
            key = key * np.uint64(self.base) + previous.astype(np.uint64)
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray):
        """Yields (start positions, pattern numbers) of the occurrences."""
        at = np.arange(self.length - 1, len(text), STRETCH)
        end = np.minimum(at + STRETCH, len(text))
        while len(at):
            block = self._hash(text[at], text[at - 1])
            move = self.shift[block]
            stop = move == 0
            if stop.any():
                yield from self._compare(text, at[stop], block[stop])
            at = at + np.maximum(move, 1)
            keep = at < end
            at, end = at[keep], end[keep]

    def _compare(self, text: np.ndarray, at: np.ndarray, block: np.ndarray):
        low, count = self.first[block], self.first[block + 1] - self.first[block]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) // (PAIRS * 64))) + 1):
            n = count[part]
            where = np.repeat(at[part] - self.length + 1, n)
            which = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            for j in range(self.length):  # few are left after the first words
                same = text[where + j] == self.rows[which, j]
                where, which = where[same], which[same]
            if len(where):
                yield where, self.order[which]


class Index:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(words_of((text or "").encode()), size):
                owners.setdefault(window, set()).add(str(item))
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for window in owners for w in window}))}
        self.groups = []
        for length in sorted({len(w) for w in owners}):
            own = sorted(w for w in owners if len(w) == length)
            rows = np.array([[self.number[w] for w in window] for window in own], np.int32)
            self.groups.append((Patterns(rows, len(self.number)), [sorted(owners[w]) for w in own]))

    def scan(self, texts: list[bytes], old: list[dict | None]) -> pa.Array:
        """Hits of each text, on top of what earlier blocks have found."""
        split = [words_of(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        first = np.concatenate([[0], np.cumsum(counts + 1)])  # a gap after each text
        text = np.zeros(int(first[-1]), np.int32)
        get = self.number.get
        for start, words in zip(first, split):
            text[start:start + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        change = np.zeros(len(text) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for i, state in enumerate(old):
            if state and state["items"]:
                items[i] = set(state["items"])
                np.add.at(change, first[i] + np.array(state["starts"]), 1)
                np.add.at(change, first[i] + np.array(state["ends"]), -1)
        for patterns, owners in self.groups:
            for where, which in patterns.search(text):
                np.add.at(change, where, 1)
                np.add.at(change, where + patterns.length, -1)
                of = np.searchsorted(first, where, "right") - 1
                for doc, k in set(zip(of.tolist(), which.tolist())):
                    items.setdefault(doc, set()).update(owners[k])
        hit = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(first, starts, "right") - 1
        n = len(texts)
        spans = np.bincount(of, minlength=n)
        n_hit = np.bincount(of, weights=ends - starts, minlength=n).astype(np.int64)
        named = [sorted(items.get(i, ())) for i in range(n)]
        return pa.StructArray.from_arrays([
            pa.array(counts), pa.array(n_hit), pa.array(named, pa.list_(pa.string())),
            lists(pa.array((starts - first[of]).astype(np.int32)), spans),
            lists(pa.array((ends - first[of]).astype(np.int32)), spans)],
            names=[f.name for f in RESULT.fields])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """docs (text, ...) with a struct: n_words, n_hit, items, and the hit spans as
    numbers of words (starts, and ends after the last word)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = with_field(docs.schema, out, RESULT)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in part], window))

        def search(batches, index=shared, more=b > 0):
            for batch in chunks(batches, "text"):
                old = batch.column(out).to_pylist() if more else [None] * batch.num_rows
                yield appended(batch, out, index.value.scan(text_bytes(batch.column("text")), old))

        docs = docs.mapInArrow(search, schema)
    return docs
