import random

import numpy as np
import pytest

from jobloom.llm import decontaminate as d


def brute(texts, items, size=10):
    found = []
    for text in texts:
        words, hit, names = d.words_of(text.encode()), set(), set()
        for item, body in items:
            for window in d.windows_of(d.words_of(body.encode()), size):
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i:i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        names.add(item)
        found.append((len(words), len(hit), sorted(names)))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_what_brute_force_finds(seed):
    draw = random.Random(seed)
    words = ["a", "b", "c", "É", "x1"][:draw.randint(2, 5)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(str(i), text(draw.choice([0, 1, 2, 4, 5, 9]))) for i in range(5)]
    texts = [text(draw.randint(0, 600)) for _ in range(20)] + ["", "A, b! C"]
    found = d.Index(items, 4).scan([t.encode() for t in texts], [None] * len(texts)).to_pylist()
    assert [(f["n_words"], f["n_hit"], f["items"]) for f in found] == brute(texts, items, 4)
    for f in found:
        assert sum(b - a for a, b in zip(f["starts"], f["ends"])) == f["n_hit"]


def test_shift_never_skips_a_match():
    draw = np.random.default_rng(3)
    rows = draw.integers(1, 5, (40, 6)).astype(np.int32)
    text = draw.integers(0, 5, 5000).astype(np.int32)
    got = {(int(w), int(p)) for where, which in d.Patterns(rows, 4).search(text) for w, p in zip(where, which)}
    want = {(i, p) for i in range(len(text) - 5) for p in range(40) if (text[i:i + 6] == rows[p]).all()}
    assert got == want


def test_blocks_of_items_agree(spark):
    docs = [(i, " ".join(f"w{(i * j) % 30}" for j in range(80))) for i in range(30)]
    items = [(str(i), " ".join(f"w{(i * j) % 30}" for j in range(20, 45))) for i in range(12)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id string, text string")
    one = d.decontaminate(docs_df, items_df).collect()
    many = d.decontaminate(docs_df, items_df, block_bytes=200).collect()
    assert sorted(one) == sorted(many)
    want = brute([t for _, t in docs], items)
    assert [(r[2].n_words, r[2].n_hit, r[2].items) for r in sorted(one)] == want


def test_edge_cases(spark, edge, none):
    items = spark.createDataFrame(
        [(1, "cat sat on the mat"), (None, "dog ran"), (3, None), (4, ""), (5, "x" * 120_000)], "item_id long, text string")
    found = {r.doc_id: r.contamination for r in d.decontaminate(edge, items).collect()}
    assert found[1].items == ["1"] and found[1].n_hit == 5 and found[9] == found[1]
    assert found[2].n_words == found[3].n_words == 0 and found[8].items == ["5"]
    assert d.decontaminate(none, items).count() == 0
    assert d.decontaminate(edge, items.limit(0)).where("contamination.n_hit > 0").count() == 0
