"""Target-distribution importance resampling over hashed features.

A feature is a run of words, its bucket the CRC-32 of its bytes modulo a fixed number.
CRCs are computed for the distinct features of a chunk of texts at a time: features
of equal length form a matrix of bytes, all rows are carried on column by column, and
the results are scattered back. A long feature is cut into blocks of equal
length, rows of one matrix too, whose CRCs are then combined in pairs.

The counts of all documents and of all target texts give each bucket a gain (target
against source), a document's weight is the floored mean of its features' gains, and
noise of the Gumbel distribution makes the highest scores a draw in proportion to the weights.
The draw is global and exact: scores are integers in a range that the counts' width
bounds (under 200,000 values), so a count per score says where each score's ranks begin,
and ranks are given within a score only.

Defined cases: a null or empty text has no features and a weight of 0; a null id
draws noise as an empty one and loses ties; rows that repeat an id are separate
documents with equal noise, ties between them are settled arbitrarily; without
documents there are no rows, without target texts all target counts are 0. Results are in one struct
column, which replaces a column of its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from jobloom.llm.common import appended, chunks, staged, text_bytes, with_field
from jobloom.llm.decontaminate import words_of

RUN, BUCKETS = 1, 10_000
PERCENT, LEAST_WORDS, SEED = 10, 20, "2024"
#: Longer features are cut into blocks of so many bytes.
BLOCK = 64
#: Scores whose counts are added up first.
SCORES = 256

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
    T.StructField("weight", T.LongType())])


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_BYTE = _byte_table()


def _columns(rows: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The registers after each row's bytes, one column of all rows at a time."""
    for column in np.ascontiguousarray(rows.T):
        register = _BYTE[(register ^ column) & 255] ^ (register >> 8)
    return register


def _moved(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """What registers become over the zero bytes that the four tables stand for."""
    return (tables[0][register & 255] ^ tables[1][register >> 8 & 255]
            ^ tables[2][register >> 16 & 255] ^ tables[3][register >> 24])


def _zero_block() -> np.ndarray:
    start = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32))
    return _columns(np.zeros((1024, BLOCK), np.uint8), start.ravel()).reshape(4, 256)


def _long_rows(rows: np.ndarray) -> np.ndarray:
    n, size = rows.shape
    blocks = 1 << (-(-size // BLOCK) - 1).bit_length()
    padded = np.zeros((n, blocks * BLOCK), np.uint8)  # zeros in front leave an empty register alone
    padded[:, -size:] = rows
    padded[:, blocks * BLOCK - size:][:, :4] ^= 255  # the register that all begin with
    register = _columns(padded.reshape(n * blocks, BLOCK), np.zeros(n * blocks, np.uint32)).reshape(n, blocks)
    move = _zero_block()
    while register.shape[1] > 1:
        register = _moved(move, register[:, 0::2]) ^ register[:, 1::2]
        move = _moved(move, move)
    return register[:, 0]


def crc32s(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    flat = np.frombuffer(b"".join([features[i] for i in order]), np.uint8)
    sizes, found, at = sizes[order], np.empty(len(features), np.uint32), 0
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)] if len(sizes) else []
    for a, b in zip(edges, edges[1:]):
        size = int(sizes[a])
        rows = flat[at:at + (b - a) * size].reshape(b - a, size)
        at += rows.size
        register = (_long_rows(rows) if size > BLOCK
                    else _columns(rows, np.full(b - a, 0xFFFFFFFF, np.uint32)))
        found[order[a:b]] = ~register
    return found


def features_of(words: list[bytes], most: int = RUN) -> list[bytes]:
    """All runs of 1 to `most` consecutive words, repeats included."""
    found = list(words)
    for size in range(2, most + 1):
        found += [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    return found


def _hashed(batch: pa.RecordBatch, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, and the number of words and features of each text."""
    words = [words_of(t) for t in text_bytes(batch.column("text"))]
    features = words if most == 1 else [features_of(w, most) for w in words]
    flat = [f for part in features for f in part]
    distinct = list(dict.fromkeys(flat))
    bucket = dict(zip(distinct, (crc32s(distinct) % np.uint32(buckets)).tolist()))
    return (np.fromiter(map(bucket.__getitem__, flat), np.int64, len(flat)),
            np.fromiter(map(len, words), np.int64, len(words)),
            np.fromiter(map(len, features), np.int64, len(features)))


def bucket_counts(texts: DataFrame, most: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task sends one row for each bucket it has met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text"):
            total += np.bincount(_hashed(batch, most, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    found = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed share in the target over that in the source."""
    in_source, in_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([
        math.floor(1000 * math.log((t + 1) * in_source / ((s + 1) * in_target)))
        for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = RUN, out: str = "importance") -> DataFrame:
    """docs (text, ...) with a struct: n_words, n_features, weight."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bucket, n_words, n_features = _hashed(batch, most, len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(n_features)
            weight = (sums[ends] - sums[ends - n_features]) // np.maximum(n_features, 1)
            yield appended(batch, out, pa.StructArray.from_arrays(
                [pa.array(x) for x in (n_words, n_features, weight)], names=RESULT.fieldNames()))

    return docs.mapInArrow(score, with_field(docs.schema, out, RESULT))


def importance(docs: DataFrame, target: DataFrame, most: int = RUN, buckets: int = BUCKETS,
               out: str = "importance") -> DataFrame:
    """`weigh` by the counts of all docs (text) and all target (text)."""
    return weigh(docs, gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets)), most, out)


def noise(key: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    value = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((value + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS,
         seed: str = SEED, out: str = "importance") -> DataFrame:
    """The struct of `weigh` with score and rank (null: not drawn). Of the documents
    with `least` words, so many percent are drawn. The rows are staged, so pass narrow ones."""
    own = [c for c in scored.columns if c != out]
    score = F.col(f"{out}.weight") + noise(F.col(key), seed)
    rows = staged(scored.select(
        F.struct(*own).alias("row"), F.col(key).alias("key"),
        F.col(out).alias("found"), score.alias("score"), (F.col(f"{out}.n_words") >= least).alias("may")))
    size = F.count("*").alias("n")
    counts = staged(rows.where("may").groupBy("score").agg(size))
    total = counts.agg(F.sum("n")).first()[0] or 0
    quota = total * percent // 100
    span = F.floor(F.col("score") / SCORES).alias("span")
    spans = counts.groupBy(span).agg(F.sum("n").alias("n")).orderBy(F.desc("span")).collect()
    before = dict(zip([r["span"] for r in spans], accumulate([r["n"] for r in spans], initial=0)))
    table = counts.sparkSession.createDataFrame(list(before.items()), "span long, before long")
    inner = W.partitionBy("span").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    above = counts.withColumn("span", span).join(F.broadcast(table), "span").select(
        "score", (F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("above")
    ).where(F.col("above") < quota)
    # At most a row for each score: bounded by the range of scores, whatever the input.
    placed = rows.join(F.broadcast(above.withColumn("may", F.lit(True))), ["score", "may"], "left")
    place = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("key")))
    drawn = placed.where("above is not null").withColumn("place", place.cast("long"))
    rest = placed.where("above is null").withColumn("place", F.lit(None).cast("long"))
    rank = F.when(F.col("place") <= quota, F.col("place"))
    return drawn.unionByName(rest).select("row.*", F.struct(
        "found.n_words", "found.n_features", "found.weight", "score", rank.alias("rank")).alias(out))
