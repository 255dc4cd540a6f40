"""Near copies by SimHash, compared exactly in tiles.

A tile is what fingerprints share that have the same population count in each
of their eight bytes. Two fingerprints that differ in r bits have counts that
differ by r at most, so a tile is only compared with the tiles whose counts are
within the radius; the others are skipped. Each fingerprint stays in its own tile
and visits every later one within the radius; a task sorts its rows by tile and
compares tile pairs with exclusive-or and bit counts in numpy. A tile with very
many fingerprints is dealt out to parts and compared in a further round. Equal
fingerprints are one. Tasks pass on a spanning star per group found, not all pairs.

Defined cases: a null or empty text has fingerprint 0; a null id never names a
group unless all ids of the group are null; rows that repeat an id are separate
documents; an empty table gives no rows. Results are in columns that replace
columns of their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.llm.common import LOWER, UPPER, appended, chunks, staged, text_bytes, with_field
from jobloom.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a tile that one task compares; more are dealt to PARTS parts.
TILE_ROWS, PARTS = 8192, 32
PAIRS = 1 << 21
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()  # at ASCII white space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1:].tolist() or [len(joined)]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit in a byte
    ones = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(bits), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """docs (text, ...) with the fingerprint as a long."""
    def add(batches):
        for batch in chunks(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
            yield appended(batch, out, pa.array(found.view(np.int64)))

    return docs.mapInArrow(add, with_field(docs.schema, out, T.LongType()))


def _steps(radius: int) -> np.ndarray:
    """Ways in which the counts of a later tile can differ: changes by byte, the
    first of them upwards, that come to the radius at most."""
    found = []
    for n in range(1, radius + 1):
        for where in combinations(range(8), n):
            for sizes in np.ndindex(*[2 * radius] * n):
                change = [s - radius + (s >= radius) for s in sizes]
                if change[0] > 0 and sum(map(abs, change)) <= radius:
                    row = np.zeros(8, np.int8)
                    row[list(where)] = change
                    found.append(row)
    return np.array(found).reshape(-1, 8)


def _packed(counts: np.ndarray) -> np.ndarray:
    return (counts.astype(np.int64) << (4 * np.arange(8))).sum(axis=-1)


_VISIT = "tile long, part int, home boolean, fp long"
_FOUND = "tile long, part int, home boolean, a long, b long"


def _dealt(radius: int):
    def deal(batches):
        steps = _steps(radius)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int8)
                reached = counts[:, None, :] + steps
                valid = ((reached >= 0) & (reached <= 8)).all(axis=2)
                tiles = np.concatenate([_packed(counts), _packed(reached)[valid]])
                rows = np.concatenate([fp, np.broadcast_to(fp[:, None], valid.shape)[valid]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(tiles), pa.array(np.zeros(len(tiles), np.int32)),
                    pa.array(np.arange(len(tiles)) < len(fp)), pa.array(rows)], names=["tile", "part", "home", "fp"])
    return deal


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of the same components, at most one for each node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            keep = root != np.arange(len(nodes))
            return nodes[keep], nodes[root[keep]]
        root = new


def _compared(radius: int, round_: int):
    """Rows sorted by tile and part, those at home first -> links, and the rows of tiles too large, dealt
    out in another way in each round."""
    limit = TILE_ROWS

    def links(fp: np.ndarray, homes: int, since: int):
        """Of the rows from `since` on, each with the rows at home before it."""
        if homes == 0 or since >= len(fp):
            return
        step = max(1, PAIRS // homes)
        for at in range(max(since, 1), len(fp), step):
            rows = np.arange(at, min(at + step, len(fp)))
            near = np.bitwise_count(fp[rows][:, None] ^ fp[None, :homes]) <= radius
            near &= np.arange(homes)[None, :] < rows[:, None]
            i, j = np.nonzero(near)
            if len(i):
                yield stars(fp[rows[i]], fp[j])

    def small(fp, first, homes, sizes):
        """The same for many small tiles at once."""
        of = np.repeat(np.arange(len(first)), sizes)
        place = np.arange(len(fp)) - first[of]
        count = np.minimum(place, homes[of])
        for rows in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
            n = count[rows]
            left = np.repeat(rows, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of[rows]], n)
            near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
            if near.any():
                yield stars(fp[left[near]], fp[right[near]])

    def row_batch(a, b, tile=0, part=0, home=False):
        full = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x, kind), len(a)))
        return pa.RecordBatch.from_arrays(
            [full(tile, np.int64), full(part, np.int32), full(home, bool), pa.array(a.view(np.int64)),
             pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))],
            names=["tile", "part", "home", "a", "b"])

    def spread(fp, home, key):
        """A large tile's rows, each to the parts where it must be compared."""
        own = _dealt_to(fp, round_)
        for part in range(PARTS):
            to = ~home | (own >= part)
            yield row_batch(fp[to], None, key, part, home[to] & (own[to] == part))

    def whole(key, fp, home, first, sizes, met):
        """Complete tiles; `met` says that the homes of the first one have been compared."""
        homes = np.add.reduceat(home.astype(np.int64), first)
        few = (homes < 64) & (homes > 0)
        for g in np.flatnonzero(~few & (homes > 0)):
            own = slice(first[g], first[g] + sizes[g])
            if homes[g] > limit:
                yield from spread(fp[own], home[own], key[first[g]])
            else:
                for a, b in links(fp[own], int(homes[g]), int(homes[g]) if met and g == 0 else 0):
                    yield row_batch(a, b)
        if few.any():
            inner, n = np.repeat(few, sizes).nonzero()[0], sizes[few]
            for a, b in small(fp[inner], np.cumsum(n) - n, homes[few], n):
                yield row_batch(a, b)

    def compare(batches):
        carried, met, large = None, False, None  # the rows of the tile that may go on
        for batch in batches:
            tile, part, fp, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "part", "fp", "home"))
            # bit counts of signed numbers would be those of their absolute values
            rows = [tile * PARTS + part, fp.astype(np.int64).view(np.uint64), home.astype(bool)]
            if large is not None:
                stay = len(fp) if (same := rows[0] == large).all() else int(np.argmin(same))
                yield from spread(rows[1][:stay], rows[2][:stay], large)
                rows = [x[stay:] for x in rows]
                if not len(rows[0]):
                    continue
                large = None
            if carried is not None:
                rows = [np.concatenate(x) for x in zip(carried, rows)]
            key, fp, home = rows
            if not len(key):
                continue
            first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            last = int(first[-1])
            if last:
                yield from whole(key[:last], fp[:last], home[:last], first[:-1], np.diff(first), met)
                met = False
            carried = [x[last:] for x in rows]
            if len(carried[0]) > 8 * limit:
                key, fp, home = carried
                homes = int(home.sum())
                if homes > limit:
                    yield from spread(fp, home, key[0])
                    large, carried = key[0], None
                elif not homes:  # nothing to meet
                    carried = None
                elif homes < len(fp):  # all homes are here, so these visitors can go
                    for a, b in links(fp, homes, homes if met else 0):
                        yield row_batch(a, b)
                    carried, met = [x[:homes] for x in carried], True
        if carried is not None and len(carried[0]):
            key, fp, home = carried
            yield from whole(key, fp, home, np.array([0]), np.array([len(fp)]), met)

    return compare


def _dealt_to(fp: np.ndarray, round_: int) -> np.ndarray:
    """The part of each fingerprint, in every round another: all bits are mixed after the round's number is in."""
    mixed = (fp ^ np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (mixed >> np.uint64(40)).astype(np.int64) % PARTS


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that join all those within the radius."""
    visits = prints.select("fp").mapInArrow(_dealt(radius), _VISIT)
    found, round_ = None, 0
    while True:
        sorted_ = visits.repartition("tile", "part").sortWithinPartitions("tile", "part", F.col("home").desc())
        out = staged(sorted_.mapInArrow(_compared(radius, round_), _FOUND))
        edges = out.where("b is not null").select("a", "b")
        found = edges if found is None else found.union(edges)
        deferred = out.where("b is null")
        if deferred.isEmpty():
            return found
        round_ += 1
        visits = deferred.select("tile", "part", "home", F.col("a").alias("fp"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row for each row."""
    marked = staged(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"))
    prints = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    groups = components(links(prints, radius))
    named = prints.join(groups, prints.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = staged(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return marked.join(labels, marked.fingerprint == labels.fp).select("doc_id", "fingerprint", "component_id")
