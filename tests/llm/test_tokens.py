import pytest

from jobloom.llm import tokens


@pytest.mark.parametrize("block", [1, 2, 7, 64, tokens.BLOCK])
def test_counts_as_the_tokenizer_does(spark, block):
    path, pattern = tokens.public_ranks()
    encode = tokens.encoding(path, pattern).encode_ordinary
    texts = ["", "one", "Ünï code", "a b c " * 30, None, "<|endoftext|>", "line\n\nline"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path, pattern, block).collect()}
    assert found == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_files_hold_the_tokens_in_order(spark):
    path, pattern = tokens.public_ranks()
    import numpy as np

    encoding = tokens.encoding(path, pattern)
    docs = spark.createDataFrame([(1, "hello world"), (2, "again")], "doc_id long, text string").coalesce(1)
    rows = tokens.token_files(docs, path, pattern, 2).collect()
    flat = np.concatenate([np.frombuffer(r.ids, np.uint16) for r in rows if r.ids is not None]).tolist()
    end = encoding.n_vocab
    assert flat == [*encoding.encode_ordinary("hello world"), end, *encoding.encode_ordinary("again"), end]


def test_edge_cases(edge, none):
    path, pattern = tokens.public_ranks()
    rows = tokens.token_counts(edge, path, pattern).collect()
    assert len(rows) == 12 and {r.doc_id: r.n_tokens for r in rows}[2] == 0
    assert tokens.token_counts(none, path, pattern).count() == 0
