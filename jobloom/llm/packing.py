"""Packing of token sequences: dominance reduction by Martello and Toth, then best fit.

Documents become ids; one longer than a sequence is cut, the first piece being the
shorter one. How many pieces there are of each length is all that packing needs, and
that is a table of at most `size` rows, so the whole corpus is one instance, planned
on the driver in steps that take many equal pieces at once:

1. Reduction: for a length, the set of at most three pieces that dominates every
   other set with a piece of that length is fixed, as often as it can be made. Some
   best packing has it: whatever else goes with that piece fits in the places of the set's others.
2. What is left is packed by best fit, in descending order.

The plan gives runs: pieces number `first` and on of a length go to sequences
`base` and on, at an offset. There are at most a few for each length and state of a
sequence, whatever the number of pieces. Pieces are numbered within a length by
task and place in it, from counts per task and length, so no length gathers in one
task, and each finds its run by a binary search.

Ids come from the installed tokenizer. Texts are cut before blanks that a visible
character follows, where the tokenizer begins anew as well, and a task encodes each different
part once.

Defined cases: a null or empty text is its end id alone; rows that repeat an id are
separate documents; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from jobloom.llm.common import chunks, staged

SIZE, END = 1024, 2
#: Different parts of texts that a Python worker remembers; then it starts afresh.
PARTS = 1 << 20
#: Longer parts are encoded whenever they come.
LONG = 64
_PARTS = re.compile(r"(?= \S)")
#: So many parts go to a call.
_CALL = 256


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of texts. As a dict: the number of each part of a text met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spelled = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(spelled.values()) + 1, np.int64)  # the vocabulary spells a byte as a character
        self.bytes[list(spelled.values())] = list(map(len, spelled))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.first, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self.n) + len(self.new)
        self.new.append(part)
        return number

    def _learn(self) -> None:
        """Encodes the new parts. Those that begin with a blank and a visible character go many to a
        call, for there the tokenizer begins anew; the bytes of the ids tell where each ends."""
        words = [i for i, part in enumerate(self.new) if part[:1] == " " and part[1:2] and not part[1].isspace()]
        own = set(words)
        other = [i for i in range(len(self.new)) if i not in own]
        calls = [words[at:at + _CALL] for at in range(0, len(words), _CALL)]
        lines = ["".join([self.new[i] for i in call]) for call in calls]
        n, ids, order = np.zeros(len(self.new), np.int64), [], []
        for call, found in zip(calls, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            own = np.array(found.ids, np.uint32)
            ends = np.cumsum([len(self.new[i].encode()) for i in call])
            edges = np.searchsorted(reached := np.cumsum(self.bytes[own]), ends)
            if edges[-1] + 1 != len(own) or not np.array_equal(reached[edges], ends):
                other += call
                continue
            n[call] = np.diff(edges, prepend=-1)
            ids.append(own)
            order += call
        for i, found in zip(other, self.tokenizer.encode_batch_fast(
                [self.new[i] for i in other], add_special_tokens=False)):
            own = np.array(found.ids, np.uint32)
            n[i] = len(own)
            ids.append(own)
        order += other
        first, order = np.empty_like(n), np.array(order, np.int64)
        first[order] = len(self.ids) + np.cumsum(n[order]) - n[order]
        self.first, self.n = np.concatenate([self.first, first]), np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, *ids])
        for part in self.new:
            if len(part) > LONG:
                del self[part]
        self.new = []

    def encode(self, texts: list[str], end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, and how many each has."""
        if len(self) > PARTS or len(self.ids) > 8 * PARTS:
            self.forget()
        split = [_PARTS.split(t) for t in texts]
        parts = [p for s in split for p in s]
        numbers = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self._learn()
        sizes = np.concatenate([[0], np.cumsum(self.n[numbers])])
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        counts = np.diff(sizes[np.concatenate([[0], last])])
        at = np.arange(sizes[-1]) + np.repeat(self.first[numbers] - sizes[:-1], self.n[numbers])
        ids = np.insert(self.ids[at], np.cumsum(counts), end) if texts else self.ids[:0]
        return ids, counts + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, piece, start, length, its ids as
    little-endian unsigned 32-bit integers, and (task, nth), its number among a task's pieces of that length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        known = encoder(path)
        for batch in chunks(batches, "text"):
            ids, counts = known.encode(["" if t is None else t for t in batch.column("text").to_pylist()], end)
            n = -(-counts // size)
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            short = (counts - (n - 1) * size)[of]
            length = np.where(piece == 0, short, size)
            start = np.where(piece == 0, 0, short + (piece - 1) * size)
            order = np.argsort(length, kind="stable")
            kinds, firsts, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(firsts - met[kinds], many)
            met[kinds] += many
            offsets = np.concatenate([[0], np.cumsum(length)]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(of), [
                None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), data, pa.array(np.full(len(of), task, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary, task int, nth long")


class Plan:
    """Where pieces go, from the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.size = size
        self.left = {k: n for k, n in sorted(counts.items()) if n > 0}
        self.given: dict[int, int] = defaultdict(int)
        self.sequences = self.fixed = 0
        #: length -> [(first, times, base, offset)]: pieces number `first` and on, `times` to a sequence.
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _close(self, many: int, content: list[tuple[int, int]]) -> None:
        """`many` sequences with these (length, times)."""
        offset = 0
        for length, times in content:
            self.runs[length].append((self.given[length], times, self.sequences, offset))
            self.given[length] += many * times
            offset += length * times
        self.sequences += many

    # --- reduction ---

    def _largest(self, room: int, used: dict[int, int]) -> int:
        """The longest piece that fits into the room beside the used ones, or 0."""
        i = bisect_right(self.lengths, room) - 1
        while i >= 0 and self.left.get(self.lengths[i], 0) <= used.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def _smallest(self, used: dict[int, int], many: int) -> list[int]:
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(many - len(found), self.left.get(length, 0) - used.get(length, 0))
            if len(found) == many:
                break
        return found

    def dominating(self, j: int) -> list[int] | None:
        """A set with a piece of length j that dominates all others with one, or None."""
        room, used = self.size - j, {j: 1}
        small = self._smallest(used, 3)
        if not small or small[0] > room:
            return [j]
        best = self._largest(room, used)
        if best == room or len(small) < 2 or small[0] + small[1] > room:
            return [j, best]
        if len(small) > 2 and sum(small) <= room:
            return None  # four or more pieces may go together
        # Pairs x >= y beside j: a single longer piece may hold both, or each has its own place.
        with_best = used | {best: used.get(best, 0) + 1}
        second = self._largest(room - best, with_best)
        wide = False  # some pair is longer than the longest single piece
        for y in self.lengths:
            if 2 * y > room:
                break
            if self.left[y] <= used.get(y, 0):
                continue
            x = self._largest(room - y, used | {y: used.get(y, 0) + 1})
            if x >= y and x + y > best:
                wide = True
                if y > second:
                    return None
        return [j, best, second] if wide and second else [j, best] if not wide else None

    def _reduce(self) -> None:
        self.lengths = list(self.left)
        again = True
        while again:
            again = False
            for j in sorted(self.left, reverse=True):
                while self.left.get(j, 0) and (found := self.dominating(j)):
                    need = {k: found.count(k) for k in found}
                    many = min(self.left[k] // n for k, n in need.items())
                    self._close(many, list(need.items()))
                    for k, n in need.items():
                        self.left[k] -= many * n
                    again = True
            self.left = {k: n for k, n in self.left.items() if n}
            self.lengths = list(self.left)

    # --- best fit ---

    def _best_fit(self) -> None:
        """Each piece, the longest first, to the open sequence with the least room that holds it.
        Open sequences with equal content are one group: room -> [(how many, content)]."""
        groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
        for length in sorted(self.left, reverse=True):
            n = self.left[length]
            for room in range(length, self.size):
                while n and groups[room]:
                    many, content = groups[room].pop()
                    n = self._fill(groups, length, n, room, many, content)
            if n:
                many = -(-n // (self.size // length))
                self._fill(groups, length, n, self.size, many, [])
        for room in sorted(groups):
            for many, content in groups[room]:
                self._close(many, content)

    def _fill(self, groups, length: int, n: int, room: int, many: int, content) -> int:
        """Pieces left over after filling the group's sequences one by one."""
        times = room // length
        full = min(many, n // times)
        if full:
            groups[room - times * length].append((full, [*content, (length, times)]))
            many, n = many - full, n - full * times
        if many and n:
            groups[room - n * length].append((1, [*content, (length, n)]))
            many, n = many - 1, 0
        if many:
            groups[room].append((many, content))
        return n

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {k: tuple(np.array(x, np.int64) for x in zip(*runs)) for k, runs in self.runs.items()}


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Staged rows of `pieces` (length, task, nth, ...) -> the same without the last two, with
    sequence_id and offset."""
    counts = staged(found.groupBy("length", "task").agg(F.count("*").alias("n")))
    total = counts.groupBy("length").agg(F.sum("n")).collect()  # at most `size` rows
    runs = found.sparkSession.sparkContext.broadcast(Plan(dict(map(tuple, total)), size).arrays())
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    own = [c for c in found.columns if c not in ("task", "nth")]
    numbered = found.join(bases, ["length", "task"]).select(
        *own, (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "sequence_id"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    first, times, base, at = runs.value[int(length[part[0]])]
                    run = np.searchsorted(first, number[part], "right") - 1
                    nth = number[part] - first[run]
                    sequence[part] = base[run] + nth // times[run]
                    offset[part] = at[run] + nth % times[run] * length[part]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(sequence), pa.array(offset)],
                names=[*own, "sequence_id", "offset"])

    return numbered.mapInArrow(put, numbered.schema)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids, sequence_id, offset)."""
    return place(staged(pieces(docs, path, size, end), compression="zstd"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows of `pack` -> (sequence_id, ids, starts): the ids of a sequence and where its pieces begin."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.col("held.offset").alias("starts"))
