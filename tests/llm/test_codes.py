import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import codes


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """[(id, vector)] -> ([(id, codes, error)], codebooks)"""
    rows = [(k, [math.floor(scale * x) for x in v]) for k, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for c in cut:
                own[near(c[p], book)[1]].append(c[p])
            for e, held in enumerate(own):
                if held:
                    book[e] = [sum(x) // len(held) for x in zip(*held)]
    found = []
    for (key, _), c in zip(rows, cut):
        best = [near(x, book) for x, book in zip(c, books)]
        found.append((key, [i for _, i in best], sum(d for d, _ in best)))
    return sorted(found, key=repr), books


def check(spark, rows, **kind):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    books = codes.train(df, **kind)
    scale = {k: v for k, v in kind.items() if k == "scale"}
    found = codes.encode(df, books, **scale).select("vec_id", "code.codes", "code.error").collect()
    wanted, own = brute(rows, **kind)
    assert [b.tolist() for b in books] == own
    assert sorted((tuple(r) for r in found), key=repr) == wanted


def test_same_as_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(32)]) for i in range(900)]
    check(spark, rows, parts=4)


def test_ties_repeats_and_groups(spark):
    """Few different values: many equal distances, equal entries, and nodes assigned whole."""
    draw = random.Random(2)
    rows = [(draw.randint(0, 300), [draw.choice([-2.0, 0.0, 1.0]) + draw.choice([0, 0, 0.001]) for _ in range(8)])
            for _ in range(700)] + [(5, [0.5] * 8)] * 300
    check(spark, rows, parts=2, scale=16)
    check(spark, rows[:7], parts=8)  # fewer vectors than entries
    check(spark, [(1, [0.25] * 8)] * 40, parts=4, entries=3)


@pytest.mark.parametrize("n,entries", [(1, 1), (50, 16), (3000, 16), (5000, 37)])
def test_trees_assign_as_a_full_search_does(n, entries):
    draw = np.random.default_rng(n)
    centres = draw.integers(-3000, 3000, (6, 5))
    rows = centres[draw.integers(0, 6, n)] + draw.integers(-40, 40, (n, 5)) // 30
    book = rows[draw.integers(0, n, entries)]
    distance = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
    wanted = distance.argmin(axis=1)
    assert codes.codes_of(rows, book).tolist() == wanted.tolist()
    total = codes.sums_of(codes.part_tree(rows), book)
    assert total[:, -1].tolist() == np.bincount(wanted, minlength=entries).tolist()
    for k in range(entries):
        assert total[k, :-1].tolist() == rows[wanted == k].sum(axis=0).tolist()


def test_nodes_are_assigned_whole_by_their_sums():
    """Groups far apart: no part is compared with an entry of its own."""
    draw = np.random.default_rng(4)
    rows = np.repeat(np.arange(16)[:, None] * 100_000, 256, axis=0) + draw.integers(0, 9, (4096, 8))
    book = np.arange(16)[:, None] * 100_000 + np.zeros((1, 8), np.int64)
    kinds = [whole for _, _, whole in codes.nearest(codes.part_tree(rows), codes.entry_tree(book))]
    assert kinds and all(kinds)


def test_staged_trees_are_the_same():
    rows = np.random.default_rng(5).integers(-9, 9, (777, 3))
    tree = codes.part_tree(rows)
    again = codes.Tree.unpacked(tree.packed(), 3)
    for name in ("rows", "low", "high", "sums", "first", "last", "size", "leaves"):
        assert np.array_equal(getattr(tree, name), getattr(again, name))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, []), (1, [1.0, -0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0]), (7, []),
            (None, [1.0, 1.0]), (1, [1.0, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(7) for c in ("part", "rows", "low", "cell", "n", "codes", "error", "label")})
    books = codes.train(df, parts=2)
    found = codes.encode(df, books).collect()
    good = [r for r in rows if r[1] and len(r[1]) == 2 and all(x is not None and math.isfinite(x) for x in r[1])]
    assert sorted(((r.vec_id, list(r.code.codes), r.code.error) for r in found), key=repr) == brute(good, parts=2)[0]
    assert all(r.part == 7 and r.codes == 7 and r.label == 7 for r in found)
    assert codes.train(df.limit(0)) == [] and codes.encode(df.limit(0), []).count() == 0
    assert codes.train(df.where("vec_id = 2")) == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.train(df, parts=3)
    with pytest.raises(Exception, match="beyond"):
        codes.train(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"), parts=2)


def test_decode_and_digest(spark):
    books = [np.array([[0, 1], [2, 3]]), np.array([[-4, 5], [6, 7]])]
    row = spark.createDataFrame([([1, 0],)], "c array<int>").select(codes.decode(F.col("c"), books, 2).alias("v")).first()
    assert row.v == [1.25, 1.75, -1.75, 2.75]
    assert codes.digest(books) == hashlib.sha256(b"0,1,2,3,-4,5,6,7").hexdigest()
