import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import simhash
from jobloom.llm.components import components


def groups(prints, radius=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    found = {}
    for p in prints:
        found.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, found.values()))


def test_fingerprint_by_definition(spark):
    texts = ["One two three four, FIVE", "a b", "", " \t", "é É ü a b c " * 100]
    for text in texts:
        words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        rows = spark.createDataFrame([(s,) for s in shingles] or [("",)], "s string").select(F.xxhash64("s")).collect()
        hashes = [r[0] % 2 ** 64 for r in rows] if shingles else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("limit", [3, simhash.TILE_ROWS])
def test_links_join_all_near_prints(spark, monkeypatch, limit):
    """Also with tiles too large for a task, which are dealt out."""
    draw = random.Random(limit)
    base = [draw.getrandbits(64) for _ in range(12)] + [0]
    prints = set(base)
    for b in base:
        for _ in range(30):
            b ^= 1 << draw.randrange(64)
            prints.add(b)
            prints.add(b ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64))
    monkeypatch.setattr(simhash, "TILE_ROWS", limit)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    found = {r.node: r.root for r in components(links).collect()}
    made = {}
    for p in signed:
        made.setdefault(found.get(p, p), []).append(p % 2 ** 64)
    assert sorted(map(sorted, made.values())) == groups(sorted(prints))


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 600)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_span_components():
    a, b = np.array([5, 5, 9, 2]), np.array([4, 9, 1, 3])
    assert sorted(zip(*(x.tolist() for x in simhash.stars(a, b)))) == [(3, 2), (4, 1), (5, 1), (9, 1)]


def test_edge_cases(edge, none):
    found = simhash.near_copies(edge).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 12 and by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == 0
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[9].component_id == 1
    assert by[None].component_id is None
    assert simhash.near_copies(none).count() == 0


def test_every_round_deals_a_part_anew():
    """What one part holds is spread over all parts by the next round, and so on."""
    prints = np.random.default_rng(1).integers(0, 2 ** 63, 2_000_000).astype(np.uint64)
    for round_ in range(3):
        counts = np.bincount(simhash._dealt_to(prints, round_), minlength=simhash.PARTS)
        assert counts.min() > 0.5 * len(prints) / simhash.PARTS
        prints = prints[simhash._dealt_to(prints, round_) == 5]
