"""Mixing sources to target weights along a curriculum.

Every source has a share of the words to take, and a schedule that says how
densely it appears over the course of training. The integral of the schedule
gives the source's cumulative demand; inverting it at the place of a document
in its source's stream gives the training position; documents are range-sorted
by position.

A source's stream is its documents in the order of a hash of the id, repeated;
the first `target` words of it are taken, so the last document taken may be cut.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last; rows that repeat an id are separate
documents (interchangeable ones if they are of one size); an empty table gives
no rows. Results are in one struct column, which replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobloom.llm.common import WORD, set_aside

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
#: Knots (time from 0 to 1, density) of each source's schedule, by the
#: source's rank and repeating: fading, growing, steady.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
#: A source's stream is cut into this many ranges of hashes, so that no task
#: gets a whole source. The order doesn't depend on it.
CELLS_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with rank, target. One row per source.

    Words are shared by weight, stopping at `repeats` times the source's size.
    In order of size over weight the sources that stop come first, and the level
    (words per weight) is that of the first one that doesn't.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn(
        "rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ).withColumn("most", repeats * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * share
         - F.coalesce(F.sum("most").over(order), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(everything)
         - F.coalesce(F.sum("weight").over(order), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", F.col("words_left") / F.col("weight_left"))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"),
                         F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return left.select(
        "source", "source_size", "rank",
        F.least("most", F.coalesce(first * F.col("weight"), F.col("most"))).alias("target"))


def _time(share: Column, knots) -> Column:
    """The time by which `share` (0 to 1) of a source's demand has come up."""
    pieces = list(zip(knots, knots[1:]))
    total = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in pieces)
    found, before = F.lit(float(knots[-1][0])), 0.0
    branches = []
    for (t0, m0), (t1, m1) in pieces:
        area = (t1 - t0) * (m0 + m1) / 2 / total
        a, slope = m0 / total, (m1 - m0) / total / (t1 - t0)
        rest = F.greatest(share - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
        branches.append((before + area, F.when(rest <= 0, F.lit(t0)).otherwise(
            t0 + F.least(2 * rest / (a + root), F.lit(t1 - t0)))))
        before += area
    for end, value in reversed(branches):
        found = F.when(share <= end, value).otherwise(found)
    return found


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE,
        repeats: int = MAX_REPEATS, schedules=SCHEDULES, out: str = "mix") -> DataFrame:
    """docs (doc_id, source, text, ...) with a struct: size, source_size, target, taken,
    and uses, an array of (pass, words, position) for each time the document is taken."""
    docs, back = set_aside(docs, ["_source", "_cell", "_start", "_at"])
    key = F.xxhash64("doc_id")
    plain = docs.select(
        *[c for c in docs.columns if c != out],
        F.struct((word_count(F.col("text")) if size is None else size).alias("size"), key.alias("key"),
                 F.shiftright(key, 64 - CELLS_BITS).alias("cell")).alias(out))
    cells = plain.groupBy("source", F.col(f"{out}.cell").alias("cell")).agg(F.sum(f"{out}.size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    before = F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    starts = cells.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(
        targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))
    ).select(F.col("c.source").alias("_source"), F.col("cell").alias("_cell"), F.struct(
        "before", "rank", "source_size", "target").alias("_start"))
    joined = plain.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col(f"{out}.cell") == F.col("_cell")))
    run = W.partitionBy("_source", "_cell").orderBy(f"{out}.key", "doc_id", f"{out}.size")
    words, total = F.col(f"{out}.size"), F.col("_start.source_size")
    start = F.col("_start.before") + F.sum(words).over(run.rowsBetween(W.unboundedPreceding, 0)) - words
    limit = F.floor(F.col("_start.target") + 0.5)
    took = lambda p: F.least(F.greatest(limit - p * total - F.col("_at"), F.lit(0)), words)

    def position(p: int) -> Column:
        part = (p * total + F.col("_at") + took(p) / 2) / F.col("_start.target")
        found = _time(part, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            found = F.when(F.col("_start.rank") % len(schedules) == i, _time(part, knots)).otherwise(found)
        return found

    uses = F.filter(F.array(*[
        F.when(took(p) > 0, F.struct(F.lit(p).alias("pass"), took(p).alias("words"), position(p).alias("position")))
        for p in range(repeats)]), lambda u: u.isNotNull())
    return back(joined.withColumn("_at", start).select(
        *[c for c in plain.columns if c != out],
        F.struct(words.alias("size"), total.alias("source_size"), F.col("_start.target").alias("target"),
                 sum((took(p) for p in range(1, repeats)), took(0)).alias("taken"), uses.alias("uses"),
                 (F.col("_at") / F.greatest(total, F.lit(1))).alias("place")).alias(out)))


def training_order(mixed: DataFrame, out: str = "mix", use: str = "use") -> DataFrame:
    """A row for each use of a document, range-sorted by position; the words that a
    use takes are the first `words` of the text."""
    rows = mixed.withColumn(use, F.explode(f"{out}.uses"))
    at = [F.col(f"{use}.position"), F.col("doc_id"), F.col(f"{use}.pass")]
    return rows.repartitionByRange(*at).sortWithinPartitions(*at)
