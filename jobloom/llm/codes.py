"""Vector codes: each part of a vector becomes the number of the nearest entry of a codebook.

The codebooks are trained by Lloyd's rounds over all vectors, exactly, in integers.
A round walks two trees at once: one over the vector parts of a block, one over the
entries of their codebook. A pair of nodes has bounds of the distance between what
is below; an entry node that is farther from a part node than some other entry node
can be is left out. Where one entry remains, the whole part node is assigned to it by
its cached sum and count; leaves that stay uncertain compare integers. A bound drops a
node only if it is strictly farther, so ties go to the lower index.

The trees over the parts do not change between rounds: they are built once, a block of
vectors at a time, and staged with boxes and sums. A task sends one sum for each
entry and component; they are added up in Spark, and what the driver holds is the codebooks.

Defined cases: a vector that is null or empty, holds null or non-finite components, or differs in width
from that of the smallest other id takes no part; a null id comes last; rows
that repeat an id are vectors of their own; with fewer vectors than entries there is
an entry for each; an empty table gives no rows. The width must be a multiple of the
number of parts, and integers must stay below 2^29 for widths of eight (`_limit`), else an
error says so. Results are in one struct column, which replaces a column of its name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom.llm.common import appended, lists, staged, with_field

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors under one tree, and the fewest in a leaf.
BLOCK_ROWS, LEAF = 4096, 16

RESULT = T.StructType([
    T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
_FAR = 1 << 40

Books = list[np.ndarray]


class Tree:
    """Boxes over rows, halved by the longest side of each box. Nodes are numbered from 1 as in a heap;
    `order` says which row is where, and a node holds places first to last."""

    def __init__(self, rows: np.ndarray, depth: int):
        n, order = len(rows), np.arange(len(rows))
        for level in range(depth):
            start = np.arange(1 << level) * n >> level
            node = np.repeat(np.arange(1 << level), np.diff([*start, n]))
            here = rows[order]
            side = np.argmax(np.maximum.reduceat(here, start) - np.minimum.reduceat(here, start), axis=1)
            order = order[np.lexsort((here[np.arange(n), side[node]], node))]
        self._set(rows[order], order, depth)
        start = np.minimum(self.first[1 << depth:], n - 1)
        empty = (self.size[1 << depth:] == 0)[:, None]
        boxes = np.where(empty, _FAR, np.minimum.reduceat(self.rows, start)), np.where(
            empty, -_FAR, np.maximum.reduceat(self.rows, start)), np.where(empty, 0, np.add.reduceat(self.rows, start))
        self.low, self.high, self.sums = (np.zeros((2 << depth, rows.shape[1]), np.int64) for _ in range(3))
        for held, leaves, join in zip((self.low, self.high, self.sums), boxes, (np.minimum, np.maximum, np.add)):
            held[1 << depth:] = leaves
            for level in range(depth - 1, -1, -1):
                under = held[2 << level:4 << level]
                held[1 << level:2 << level] = join(under[0::2], under[1::2])

    def _set(self, rows: np.ndarray, order: np.ndarray, depth: int) -> None:
        n = len(rows)
        self.rows, self.order, self.leaves = rows, order, 1 << depth
        level = np.concatenate([np.full(1 << k, k) for k in range(depth + 1)])
        at = np.arange(1, 2 << depth) - (1 << level)
        self.first = np.concatenate([[0], at * n >> level])
        self.last = np.concatenate([[0], (at + 1) * n >> level])
        self.size = self.last - self.first

    def packed(self) -> dict[str, bytes]:
        return {"rows": self.rows.astype(np.int32).tobytes(), "low": self.low.astype(np.int32).tobytes(),
                "high": self.high.astype(np.int32).tobytes(), "sums": self.sums.tobytes()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], width: int) -> Tree:
        tree = cls.__new__(cls)
        kinds = {"rows": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}
        held = {k: np.frombuffer(row[k], kind).reshape(-1, width).astype(np.int64) for k, kind in kinds.items()}
        tree._set(held["rows"], np.zeros(0, np.int64), (len(held["low"]) // 2).bit_length() - 1)
        tree.low, tree.high, tree.sums = held["low"], held["high"], held["sums"]
        return tree


def part_tree(rows: np.ndarray) -> Tree:
    return Tree(rows, max(0, (len(rows) // LEAF).bit_length() - 1))


def entry_tree(book: np.ndarray) -> Tree:
    """Each leaf has one entry, or none."""
    return Tree(book, (len(book) - 1).bit_length())


def nearest(parts: Tree, entries: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Yields (part nodes, their entries, True) for nodes that are assigned whole, and
    (places in the part tree, their entries, False) for what leaves have compared."""
    node, entry = np.array([1]), np.array([1])  # pairs, sorted by part node
    while len(node):
        gap = np.maximum(np.maximum(parts.low[node] - entries.high[entry], entries.low[entry] - parts.high[node]), 0)
        reach = np.maximum(parts.high[node] - entries.low[entry], entries.high[entry] - parts.low[node])
        near, far = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        first = np.flatnonzero(np.diff(node, prepend=0))
        of = np.cumsum(np.diff(node, prepend=0) != 0) - 1
        keep = near <= np.minimum.reduceat(far, first)[of]
        node, entry, of = node[keep], entry[keep], of[keep]
        many = np.bincount(of)
        single = entries.size[entry] == 1
        settled = np.bincount(of, weights=single).astype(np.int64) == many
        leaf = node >= parts.leaves
        whole = (settled & (many == 1))[of]
        if whole.any():
            yield node[whole], entries.order[entries.first[entry[whole]]], True
        compare = settled[of] & leaf & ~whole
        if compare.any():
            yield *_compared(parts, entries, node[compare], entry[compare]), False
        halved = settled[of] & ~leaf & ~whole
        opened = ~settled[of]
        both = opened & ~single
        node, entry = np.concatenate([
            2 * node[halved], 2 * node[halved] + 1, node[opened & single], node[both], node[both]]), np.concatenate([
                entry[halved], entry[halved], entry[opened & single], 2 * entry[both], 2 * entry[both] + 1])
        order = np.argsort(node, kind="stable")
        node, entry = node[order], entry[order]
        real = entries.size[entry] > 0
        node, entry = node[real], entry[real]


def _compared(parts: Tree, entries: Tree, node: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = np.full(len(parts.rows), np.iinfo(np.int64).max)
    found = np.full(len(parts.rows), -1)
    number = entries.order[entries.first[entry]]
    for k in np.unique(number):  # ascending, and only what is nearer replaces
        own = node[number == k]
        size = parts.size[own]
        at = np.arange(size.sum()) + np.repeat(parts.first[own] - np.cumsum(size) + size, size)
        gap = parts.rows[at] - entries.rows[entries.order == k]
        distance = (gap * gap).sum(axis=1)
        nearer = distance < least[at]
        least[at[nearer]] = distance[nearer]
        found[at[nearer]] = k
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def sums_of(parts: Tree, book: np.ndarray) -> np.ndarray:
    """For each entry the sum of its parts and, last, their number."""
    total = np.zeros((len(book), book.shape[1] + 1), np.int64)
    for where, entry, whole in nearest(parts, entry_tree(book)):
        rows, n = (parts.sums[where], parts.size[where]) if whole else (parts.rows[where], 1)
        np.add.at(total, (entry, slice(None, -1)), rows)
        np.add.at(total, (entry, -1), n)
    return total


def codes_of(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    parts = part_tree(rows)
    held = np.empty(len(rows), np.int64)
    for where, entry, whole in nearest(parts, entry_tree(book)):
        if whole:
            size = parts.size[where]
            at = np.arange(size.sum()) + np.repeat(parts.first[where] - np.cumsum(size) + size, size)
            held[at] = np.repeat(entry, size)
        else:
            held[where] = entry
    found = np.empty_like(held)
    found[parts.order] = held
    return found


def _limit(width: int) -> int:
    """Integers up to here keep squared distances of this width within 63 bits."""
    return math.isqrt((1 << 62) // width) // 2


def _integers(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """Row per vector, whole numbers; all have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.floor(scale * flat).reshape(len(column), -1)
    limit = _limit(max(1, found.shape[1] // parts))
    if found.size and np.abs(found).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}")
    return found.astype(np.int64)


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has finite components only."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))

    return vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, bad))


def _first(vectors: DataFrame, key: str, vector: str, scale: int, parts: int, entries: int) -> Books:
    """The parts of the vectors with the smallest ids."""
    order = [F.asc_nulls_last(key), F.col(vector)]
    rows = vectors.select(key, vector).orderBy(*order).limit(entries * 2).collect()
    width = len(rows[0][vector]) if rows else 0
    if width % parts:
        raise ValueError(f"vectors of width {width} cannot be cut into {parts} equal parts")
    if any(len(r[vector]) != width for r in rows):
        rows = vectors.where(F.size(vector) == width).select(key, vector).orderBy(*order).limit(entries).collect()
    if not width:
        return []
    column = pa.array([r[vector] for r in rows[:entries]], pa.list_(pa.float64()))
    return list(np.ascontiguousarray(x) for x in np.split(_integers(column, scale, parts), parts, axis=1))


def _blocks(vectors: DataFrame, vector: str, scale: int, parts: int) -> DataFrame:
    """(part, rows, low, high, sums): the trees of each block of vectors, one for each part."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                whole = _integers(batch.column(vector).slice(at, BLOCK_ROWS), scale, parts)
                made = [{"part": i} | part_tree(x).packed() for i, x in enumerate(np.split(whole, parts, axis=1))]
                yield pa.RecordBatch.from_pylist(made, pa.schema(
                    [("part", pa.int32()), *((c, pa.binary()) for c in ("rows", "low", "high", "sums"))]))

    return vectors.select(vector).mapInArrow(build, "part int, rows binary, low binary, high binary, sums binary")


def _totals(blocks: DataFrame, books: Books) -> np.ndarray:
    """Sums and numbers by part and entry."""
    shape = (len(books), len(books[0]), books[0].shape[1] + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total[row["part"]] += sums_of(Tree.unpacked(row, shape[2] - 1), books[row["part"]])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "n"])

    found = np.zeros(math.prod(shape), np.int64)
    for cell, n in blocks.mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        found[cell] = n
    return found.reshape(shape)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """A codebook for each part: rows of integers. Empty without vectors."""
    usable = kept(vectors, vector).where(F.size(vector) > 0)
    books = _first(usable, key, vector, scale, parts, entries)
    if not books:
        return []
    usable = usable.where(F.size(vector) == sum(b.shape[1] for b in books))
    blocks = staged(_blocks(usable, vector, scale, parts), compression="zstd")
    for _ in range(rounds):
        for book, total in zip(books, _totals(blocks, books)):
            used = total[:, -1] > 0
            book[used] = total[used, :-1] // total[used, -1:]
    return books


def encode(vectors: DataFrame, books: Books, vector: str = "embedding", scale: int = SCALE,
           out: str = "code") -> DataFrame:
    """The vectors that take part, with a struct: codes (an entry for each part), and error, their squared distance."""
    schema = with_field(vectors.schema, out, RESULT)
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                parts = np.split(_integers(batch.column(vector), scale, len(books)), len(books), axis=1)
                codes = np.stack([codes_of(x, book) for x, book in zip(parts, books)], axis=1)
                error = sum(((x - book[c]) ** 2).sum(axis=1) for x, book, c in zip(parts, books, codes.T))
                yield appended(batch, out, pa.StructArray.from_arrays([
                    lists(pa.array(codes.ravel().astype(np.int32)), np.full(len(codes), len(books))),
                    pa.array(error)], names=RESULT.fieldNames()))

    usable = kept(vectors, vector).where(F.size(vector) == sum(b.shape[1] for b in books))
    return usable.mapInArrow(assign, schema)


def decode(code: Column, books: Books, scale: int = SCALE) -> Column:
    """The vector that codes stand for: the middle of what each integer covers."""
    table = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book])
                      for book in books])
    return F.flatten(F.transform(code, lambda c, i: F.element_at(F.element_at(table, i + 1), c + 1)))


def digest(books: Books) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()
