"""Keyword search through postings, for many searches over one table.

The searched text is what `list_jobs` searches. Its pieces of one to three characters are
posted with the ids of the jobs that hold them. A keyword of up to three characters is a piece,
and its posting is the answer; of a longer one the rarest pieces are intersected, and the jobs left are
searched for the keyword itself. Postings stay where their jobs were read, each file sorted by piece, so
a search reads of every file the row groups and pages of its pieces only.

Pieces are made in numpy, for some texts at a time: a piece and the number of its text are one whole number, and
these are sorted. So a row holds a piece and all the jobs of those texts that have it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobloom.functions.text import bind
from jobloom.operators.search import normal_keyword, searched_text
from jobloom.sources.tables import spread

PIECE = 3
#: Postings that are intersected; the search of the text decides.
RAREST = 4
#: Bytes of a row group of postings.
ROW_GROUP = 8 << 20
#: Bytes of texts whose pieces are made at a time.
CHUNK = 1 << 20
POSTING = "piece string, jobs int, ids array<{kind}>"
COUNT = "piece string, jobs long"


def pieces(text: Column) -> Column:
    """The different runs of one to three characters, as a column; `_pieces` gives the same for many texts."""
    def runs(chars: Column) -> Column:
        pair = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))),
                          F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
        return bind(pair, lambda two: F.array_distinct(F.concat(chars, two, F.zip_with(
            F.slice(two, F.lit(1), F.greatest(F.size(two) - 1, F.lit(0))),
            F.slice(chars, F.lit(3), F.size(chars)), lambda a, b: F.concat(a, b)))))

    return bind(F.when(text != "", F.split(text, "")).otherwise(F.array().cast("array<string>")), runs)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> POSTING."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // CHUNK
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column("text")[start:end].cast(pa.binary()).to_pylist()]
            for first, found in _pieces(texts):
                strings, lengths, jobs = found
                ids = batch.column("id").take(pa.array(jobs + (start + first)))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(strings, pa.string()), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), ids)],
                    names=["piece", "jobs", "ids"])


def _pieces(texts: list[str]) -> Iterator[tuple[int, tuple[list[str], np.ndarray, np.ndarray]]]:
    """The different runs of one to three characters of each text: for some texts in a row, from the one with
    the number told, the pieces, of how many texts each is, and the numbers of these."""
    # Two characters that are none end each text, so a run at its end is a shorter one.
    codes = np.frombuffer(("\0\0".join(texts) + "\0\0").encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) for t in texts]) + 2
    ends = np.cumsum(lengths)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    chars = np.flatnonzero(there)
    table = np.zeros(len(there), np.int64)
    table[chars] = np.arange(1, len(chars) + 1)
    x = table[codes]
    x[ends - 1] = x[ends - 2] = 0
    name = np.array(["", *map(chr, chars.tolist())], object)
    bits = len(chars).bit_length()
    low, shift = (1 << bits) - 1, min(20, 63 - 3 * bits)  # the number of a text goes beside a piece
    for first in range(0, len(texts), 1 << shift):
        own = lengths[first:first + (1 << shift)]
        end = int(ends[first + len(own) - 1])
        y = x[end - int(own.sum()):end]
        run = y[:-2] << bits
        run |= y[1:-1]
        run <<= bits
        run |= y[2:]
        run <<= shift
        run |= np.repeat(np.arange(len(own)), own)[:-2]
        three = _different(run[y[:-2] > 0])
        two = _different(three & ~(low << shift))
        one = _different(two & ~(((low << bits) | low) << shift))
        whole = _different(np.concatenate([three, two, one]))
        piece = whole >> shift
        begin = _changes(piece)
        distinct = piece[begin]
        strings = name[distinct >> 2 * bits] + name[distinct >> bits & low] + name[distinct & low]
        yield first, (strings.tolist(), np.diff(np.append(begin, len(piece))), whole & (1 << shift) - 1)


def _changes(numbers: np.ndarray) -> np.ndarray:
    """The places of the first of equal numbers in a row."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(numbers)), bool), numbers[1:] != numbers[:-1]]))


def _different(numbers: np.ndarray) -> np.ndarray:
    numbers.sort()
    return numbers[_changes(numbers)]


class KeywordIndex:
    """Postings in the folder, of jobs with unique ids."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.kind = spark, path, id_type

    @classmethod
    def build(cls, jobs: DataFrame, path: str) -> "KeywordIndex":
        index = cls(jobs.sparkSession, path, jobs.schema["id"].dataType.simpleString())
        posted = spread(jobs.where("id is not null").select("id", searched_text().alias("text"))).mapInArrow(
            _posted, POSTING.format(kind=index.kind))
        # Of the jobs only the texts move; their pieces are many times as large and are made once.
        posted.sortWithinPartitions("piece").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        counts = index._lists().groupBy("piece").agg(F.sum("jobs").alias("jobs"))
        counts.repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{path}/counts")
        return index

    def _lists(self) -> DataFrame:
        return self.spark.read.schema(POSTING.format(kind=self.kind)).parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        """(piece, id)"""
        return self._lists().select("piece", F.explode("ids").alias("id"))

    def candidates(self, keyword: str) -> DataFrame:
        """(id): all jobs that hold the keyword, in lower case and without outer blanks, and for one longer than a piece
        perhaps others."""
        parts = sorted({keyword[i:i + PIECE] for i in range(max(1, len(keyword) - PIECE + 1))})
        counts = self.spark.read.schema(COUNT).parquet(f"{self.path}/counts")
        known = counts.where(F.col("piece").isin(parts)).collect()  # a row for each piece of the keyword
        if len(known) < len(parts):
            return self.postings().select("id").limit(0)
        rare = [r["piece"] for r in sorted(known, key=lambda r: (r["jobs"], r["piece"]))[:RAREST]]
        found = self.postings().where(F.col("piece").isin(rare))
        return found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")

    def search(self, jobs: DataFrame, keyword: str | None) -> DataFrame:
        """As `list_jobs` with that keyword."""
        wanted = normal_keyword(keyword)
        if not wanted:
            return jobs
        found = jobs.join(self.candidates(wanted), "id", "left_semi")
        return found if len(wanted) <= PIECE else found.where(F.contains(searched_text(), F.lit(wanted)))
