from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobloom.llm import mixing


def targets(sizes):
    """Shares by weight, one round after the other, until none is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, found = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not full:
            return found | {s: weight[s] * level for s in left}
        for s in full:
            found[s] = 2.0 * sizes[s]
            total -= found[s]
        left -= full
    return found


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.mix.size
        taken[r.source] += r.mix.taken
        assert r.mix.taken <= 2 * r.mix.size and r.mix.taken == sum(u.words for u in r.mix.uses)
    want = targets(sizes)
    for r in rows:
        assert r.mix.source_size == sizes[r.source]
        assert r.mix.target == pytest.approx(want[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=0.51)


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}" if i % 6 else None) for i in range(600)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mixed.collect()
    check(found)
    assert sorted(found, key=lambda r: r.doc_id) == sorted(mixed.collect(), key=lambda r: r.doc_id)


def test_edge_cases(edge, none):
    found = mixing.mix(edge).collect()
    check(found)
    assert len(found) == 12 and {r.doc_id: r.mix.size for r in found}[2] == 0
    assert mixing.mix(none).count() == 0


def test_training_order_follows_the_schedules(spark):
    rows = [(i, "w " * 5, f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ordered = mixing.training_order(mixing.mix(docs)).select("source", "use.position").collect()
    positions = [r.position for r in ordered]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    early = [r.source for r in ordered if r.position < 0.25]
    late = [r.source for r in ordered if r.position > 0.75]
    assert early.count("s0") > 2 * late.count("s0")  # fades
    assert late.count("s1") > 2 * early.count("s1")  # grows
    assert early.count("s2") == pytest.approx(late.count("s2"), rel=0.1)


def test_time_inverts_the_integral(spark):
    knots = ((0.0, 1.0), (0.3, 3.0), (1.0, 0.0))
    area = 0.3 * 2 + 0.7 * 1.5

    def share(t):
        if t <= 0.3:
            return (t + t * t * (2 / 0.3) / 2) / area
        x = t - 0.3
        return (0.6 + 3 * x - 3 / 0.7 * x * x / 2) / area

    times = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(share(t),) for t in times], "s double")
    found = [r[0] for r in df.select(mixing._time(F.col("s"), knots)).collect()]
    assert found == pytest.approx(times, abs=1e-7)
