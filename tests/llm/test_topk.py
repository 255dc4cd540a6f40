import random

import pytest

from jobloom.llm import topk


def brute(vectors, k):
    rows = []
    for q, x in vectors:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors if v != q)
            rows += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(rows)


@pytest.mark.parametrize("blocks", [1, 2, 1000])
def test_same_as_brute_force(spark, blocks):
    draw = random.Random(5)
    vectors = [(i, [draw.randint(-3, 3) for _ in range(12)]) for i in range(700)]  # many ties
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(3)
    found = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, blocks)
    assert sorted(tuple(r) for r in found.collect()) == brute(vectors, 10)


def test_large_values_stay_exact(spark):
    vectors = [(i, [2 ** 40 + i, -2 ** 20, 3]) for i in range(0, 120, 10)]
    vectors = [(i, [x // 2 ** 10 for x in v]) for i, v in vectors] + [(5, [2 ** 30, 2 ** 30, 1])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 3).collect()) == brute(vectors, 3)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, -0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [2.0]), (6, []),
            (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, [1.0, -0.5])]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert found == [(100, 1, 5, 2048 * 1024), (100, 2, 7, 1024 * 512), (100, 3, 7, 1024 * 512), (100, 4, 6, 0)]
    assert topk.top_k(df, df.limit(0)).count() == 0
