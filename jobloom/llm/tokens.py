"""Token counts by a separator scan over flat token files.

Documents are tokenised and their ids written one after another, an
end-of-document id after each, in blocks of a fixed number of ids that ignore
where documents begin. Nothing in a file says where a document is. The scan finds
the end ids of a block with one vectorised comparison and reports how many
there are, the lengths between them, and what lies before the first and after the
last; a prefix scan over the blocks of a file numbers the documents, and the
pieces of one that runs over several blocks are summed.

A file is what one task has written. Which document came n-th is kept apart from
the ids, in a manifest.

Defined cases: a null or empty text has no tokens; rows that repeat an id are
separate documents; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from jobloom.llm.common import chunks, staged

BLOCK = 1 << 16
_FILE = "file int, block int, ids binary, first long, doc_ids array<long>"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str, most: int | None = None):
    """A byte-pair tokenizer from a file of ranks, or from its first `most` ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if most is not None:
        ranks = {k: v for k, v in ranks.items() if v < most}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Place and split pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def token_files(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> rows of a file: blocks (file, block, ids), and its manifest (file, first,
    doc_ids). The end id is the first free one."""
    def write(batches):
        tokenizer = encoding(path, pattern)
        end = tokenizer.n_vocab
        kind = np.uint16 if end < 1 << 16 else np.uint32
        file, number, written = TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, kind)

        def rows(ids, numbers, first, docs):
            n = len(ids) + (docs is not None)
            none = docs is not None
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.int32()), pa.array([*numbers, *[None] * none], pa.int32()),
                pa.array([*ids, *[None] * none], pa.binary()), pa.array([*[None] * len(ids), *[first] * none], pa.int64()),
                pa.array([*[None] * len(ids), *[docs] * none], pa.list_(pa.int64()))],
                names=["file", "block", "ids", "first", "doc_ids"])

        for batch in chunks(batches, "text"):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            parts = [rest]
            for ids in tokenizer.encode_ordinary_batch(texts, num_threads=1):
                ids.append(end)
                parts.append(np.array(ids, kind))
            flat = np.concatenate(parts)
            n = len(flat) // block
            yield rows([flat[i * block:(i + 1) * block].tobytes() for i in range(n)], range(number, number + n),
                       written, batch.column("doc_id").cast(pa.int64()).to_pylist())
            number, written, rest = number + n, written + len(texts), flat[n * block:]
        if len(rest):
            yield rows([rest.tobytes()], [number], 0, None)

    return docs.select("doc_id", "text").mapInArrow(write, _FILE)


def scan(files: DataFrame, end: int) -> DataFrame:
    """(file, block, ids) -> (file, number, n_tokens): the documents that end in a file, in order."""
    kind = np.uint16 if end < 1 << 16 else np.uint32

    def search(batches):
        for batch in batches:
            ends, head, tail, inner = [], [], [], []
            for ids in batch.column("ids"):
                flat = np.frombuffer(ids.as_buffer(), kind)
                at = np.flatnonzero(flat == end)
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(flat))
                tail.append(len(flat) - 1 - int(at[-1]) if len(at) else 0)
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(ends, pa.int64()), pa.array(head, pa.int64()),
                 pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "ends", "head", "tail", "inner"])

    blocks = files.where("ids is not null").select("file", "block", "ids").mapInArrow(
        search, "file int, block int, ends long, head long, tail long, inner array<long>")
    before = F.sum("ends").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    placed = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    whole = placed.select("file", F.col("before"), F.posexplode("inner").alias("i", "n_tokens")).select(
        "file", (F.col("before") + 1 + F.col("i")).alias("number"), "n_tokens")
    pieces = placed.select("file", F.explode(F.array(
        F.struct(F.col("before").alias("number"), F.col("head").alias("n")),
        F.struct((F.col("before") + F.col("ends")).alias("number"), F.col("tail").alias("n")))).alias("p"))
    stitched = pieces.groupBy("file", F.col("p.number").alias("number")).agg(F.sum("p.n").alias("n_tokens"))
    return whole.unionByName(stitched)


def token_counts(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens), without the end ids."""
    files = staged(token_files(docs, path, pattern, block), compression="zstd")
    listed = files.where("doc_ids is not null").select(
        "file", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("first") + F.col("i")).alias("number"), "doc_id")
    counts = scan(files, encoding(path, pattern).n_vocab)
    return listed.join(counts, ["file", "number"]).select("doc_id", "n_tokens")
