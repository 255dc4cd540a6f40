"""The pipeline's stages against brute force, each on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as c
from jobloom.llm import decontaminate, quality, simhash
from jobloom.llm.common import staged
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_lines import brute as near_lines
from tests.llm.test_mixing import targets
from tests.llm.test_simhash import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in c.STAGES:
        kept.append(staged(stage(spark, kept[-1], SF)))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]
    assert all(k.columns == columns for k in kept[:-1])

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {i: model.score(np.array([quality.features(r.text.encode())]))[0] for i, r in rows[0].items()}
    assert set(rows[1]) == {i for i, p in score.items() if p >= 0.3}

    removed, want = near_lines([(i, r.text) for i, r in rows[1].items()]), {}
    for i, r in rows[1].items():
        lines = r.text.split("\n")
        left = [x for k, x in enumerate(lines) if k not in removed.get(i, ())]
        if any(x.split() for x in left) or not removed.get(i):
            want[i] = "\n".join(left)
    assert {i: r.text for i, r in rows[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[2].values())

    prints = {}
    for i, r in rows[2].items():
        prints.setdefault(simhash.fingerprint(r.text.encode()), []).append(i)
    assert set(rows[3]) == {min(i for p in g for i in prints[p]) for g in groups(sorted(prints))}

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    hits = index.scan([r.text.encode() for r in rows[3].values()], [None] * len(rows[3])).to_pylist()
    assert set(rows[4]) == {i for i, h in zip(rows[3], hits) if not h["n_hit"]}
    some = list(rows[3].values())[:25]
    assert [h["n_hit"] for h in hits[:25]] == [n for _, n, _ in contaminated([r.text for r in some], items)]

    sizes = {}
    for r in rows[4].values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = {r.source: r.n for r in kept[5].groupBy("source").agg(F.sum("words").alias("n")).collect()}
    for source, target in targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.51


def test_edge_cases(spark, edge):
    docs = edge.withColumn("n_chars", F.length("text"))
    for _, stage in c.STAGES[1:]:
        docs = staged(stage(spark, docs, SF))
    ids = [r.doc_id for r in docs.collect()]
    assert 1 in ids and 9 not in ids
