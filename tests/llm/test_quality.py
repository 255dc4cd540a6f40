import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_learns_tables_and_interactions():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)  # no feature says anything alone
    model = q.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    y = (np.sin(6 * x[:, 2]) > 0.2).astype(int)
    model = q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_without_labels_all_are_alike():
    assert q.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert q.fit(np.zeros((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.8


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = q.classify(docs, q.train(docs, labels)).join(labels, "doc_id").where(q.fold(F.col("doc_id")) == 0)
    rows = found.select("quality_model.predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.train(docs, labels), q.train(docs, turned)
    assert a.start == b.start and all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_edge_cases(spark, edge, none):
    assert [r[0] for r in spark.createDataFrame([(1,), (None,)], "i long").select(q.fold(F.col("i"))).collect()] == [
        zlib.crc32(b"1") % 5, 0]
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (7, 3), (None, 1), (8, 0)], "doc_id long, quality int")
    rows = q.classify(edge, q.train(edge, labels)).collect()
    assert len(rows) == 12 and all(0 <= r.quality_model.score <= 1 for r in rows)
    assert all(r.quality_model.predicted == (r.quality_model.score >= 0.3) for r in rows)
    assert q.classify(none, q.train(none, labels.limit(0))).count() == 0


# --- the same by plain loops ------------------------------------------------------

def plain_score(model, row):
    total = model.start
    for j, table in enumerate(model.tables):
        total += table[sum(e <= row[j] for e in model.edges[j])]
    for (i, j), table in model.pairs.items():
        total += table[sum(e <= row[i] for e in model.coarse[i])][sum(e <= row[j] for e in model.coarse[j])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def leaf(g, w):
    return sum(g) / (sum(w) + q.SHRINK)


def gain(g, w):
    return sum(g) ** 2 / (sum(w) + q.SHRINK)


def plain_tree(g, w, most):
    """Again and again the cut that gains most, tried one by one."""
    parts = [list(range(len(g)))]
    while len(parts) < most:
        tried = []
        for part in parts:
            for k in range(1, len(part)):
                a, b = part[:k], part[k:]
                if min(sum(w[i] for i in a), sum(w[i] for i in b)) >= q.LEAF_WEIGHT:
                    of = [([g[i] for i in x], [w[i] for i in x]) for x in (a, b, part)]
                    tried.append((gain(*of[0]) + gain(*of[1]) - gain(*of[2]), part, a, b))
        if not tried or max(t[0] for t in tried) <= 1e-9:
            break
        _, part, a, b = max(tried, key=lambda t: t[0])
        parts.remove(part)
        parts += [a, b]
    value = [0.0] * len(g)
    for part in parts:
        for i in part:
            value[i] = leaf([g[i] for i in part], [w[i] for i in part])
    return value


def test_trees_and_quadrants_as_by_trying_all():
    draw = np.random.default_rng(3)
    for _ in range(30):
        g, w = draw.normal(size=9), draw.random(9) * 3
        assert q._leaves(g, w, 4) == pytest.approx(plain_tree(g.tolist(), w.tolist(), 4))
        g, w = draw.normal(size=(4, 5)), draw.random((4, 5)) * 3
        best = max((sum(gain(g[a, b].ravel(), w[a, b].ravel()) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))), i, j)
                   for i in range(1, 4) for j in range(1, 5))
        found, value = q._quadrants(g, w)
        assert found == pytest.approx(best[0])
        for a in (slice(0, best[1]), slice(best[1], None)):
            for b in (slice(0, best[2]), slice(best[2], None)):
                assert value[a, b] == pytest.approx(leaf(g[a, b].ravel(), w[a, b].ravel()))


def test_boosting_and_scores_as_by_plain_loops(monkeypatch):
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 6), ("PAIR_BINS", 4)):
        monkeypatch.setattr(q, name, value)
    draw = np.random.default_rng(6)
    x = np.round(draw.random((150, 4)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) | (x[:, 2] > 0.9)).astype(int)
    model = q.fit(x, y)
    fine = [[sum(e <= v for e in model.edges[j]) for v in x[:, j]] for j in range(4)]
    wide = [[sum(e <= v for e in model.coarse[j]) for v in x[:, j]] for j in range(4)]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    total = [math.log(rate / (1 - rate))] * len(y)
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    pairs = {pair: np.zeros(table.shape) for pair, table in model.pairs.items()}
    for _ in range(3):
        for j, table in enumerate(tables):
            p = [1 / (1 + math.exp(-t)) for t in total]
            g, w = [0.0] * len(table), [0.0] * len(table)
            for k, b in enumerate(fine[j]):
                g[b] += y[k] - p[k]
                w[b] += p[k] * (1 - p[k])
            value = plain_tree(g, w, q.LEAVES)
            for b in range(len(table)):
                table[b] += q.RATE * value[b]
            total = [t + q.RATE * value[b] for t, b in zip(total, fine[j])]
    for j, table in enumerate(tables):
        assert model.tables[j] == pytest.approx(table)
    for _ in range(2):
        for (i, j), table in pairs.items():
            p = [1 / (1 + math.exp(-t)) for t in total]
            g, w = np.zeros(table.shape), np.zeros(table.shape)
            for k in range(len(y)):
                g[wide[i][k], wide[j][k]] += y[k] - p[k]
                w[wide[i][k], wide[j][k]] += p[k] * (1 - p[k])
            value = q._quadrants(g, w)[1]
            table += q.RATE * value
            total = [t + q.RATE * value[wide[i][k], wide[j][k]] for k, t in enumerate(total)]
    for pair, table in pairs.items():
        assert model.pairs[pair] == pytest.approx(table)
    assert model.score(x) == pytest.approx([plain_score(model, row) for row in x])


def test_table_scores_of_the_real_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    rows = q.classify(docs.select("doc_id", "text"), model).collect()
    for r in rows[::7]:
        assert r.quality_model.score == pytest.approx(plain_score(model, q.features((r.text or "").encode())))
