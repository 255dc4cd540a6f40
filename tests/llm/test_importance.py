import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import importance
from tests.llm.conftest import CLASHES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, percent=10, least=20, seed="2024"):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, most)[1])

    s, t = counts(x for _, x in docs), counts(x for _, x in target)
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for key, text in docs:
        n, own = features(text, most)
        gains = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
                 for b in (zlib.crc32(f.encode()) % buckets for f in own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[:len(able) * percent // 100]):
        row[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


def run(docs, target, most=1, buckets=10_000, **kind):
    found = importance.draw(importance.importance(docs, target, most, buckets).drop("text"), **kind)
    return sorted((tuple(r) for r in found.select("doc_id", "importance.*").collect()), key=repr)


def test_crc32():
    draw = random.Random(3)
    data = [draw.randbytes(n) for n in [*range(0, 140), 255, 256, 257, 1000, 64 * 64, 70_001] for _ in range(3)] + [b"same"] * 4
    draw.shuffle(data)
    assert importance.crc32s(data).tolist() == [zlib.crc32(d) for d in data]
    assert importance.crc32s([]).tolist() == []


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 97)])
def test_same_as_brute_force(spark, most, buckets):
    draw = random.Random(9)
    words = ["Apple", "bär", "c1", "dé", "EE", "f" * 90, "日本", "g"]

    def text(n):
        return "".join(draw.choice(words) + draw.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    docs = [(i, text(draw.randint(0, 60))) for i in range(400)] + [(i, "the same text " * 8) for i in range(1000, 1300)]
    target = [(i, text(30)) for i in range(5)] + [(6, None)]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    right = spark.createDataFrame(target, "item_id long, text string")
    assert run(left, right, most, buckets, percent=15) == brute(docs, target, most, buckets, 15)


def test_edge_cases(spark, edge, none):
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(1, "the cat sat"), (None, None)], "item_id long, text string")
    found = importance.draw(importance.importance(edge, target), percent=50, least=3)
    assert all(r[c] == 7 for r in found.collect() for c in CLASHES if c != "importance")
    rows = sorted((tuple(r) for r in found.select("doc_id", "importance.*").collect()), key=repr)
    wanted = brute(docs, [(1, "the cat sat")], percent=50, least=3)
    assert sorted(str(r[:5]) for r in rows) == sorted(str(r[:5]) for r in wanted)
    assert sorted(str((r[0], r[5])) for r in rows if r[5]) == sorted(str((r[0], r[5])) for r in wanted if r[5])
    assert run(none, target) == []
    assert len(run(edge.select("doc_id", "text"), target.limit(0))) == len(docs)
    again = importance.draw(importance.importance(edge.withColumn("importance", F.lit("x")), target))
    assert again.columns.count("importance") == 1 and again.count() == len(docs)


def test_gains_are_exact():
    source, target = np.array([0, 5, 10 ** 13]), np.array([3, 0, 7])
    assert importance.gains(source, target).tolist() == [
        math.floor(1000 * math.log((t + 1) * (10 ** 13 + 8.0) / ((s + 1) * 13.0))) for s, t in zip([0., 5., 1e13], [3., 0., 7.])]
