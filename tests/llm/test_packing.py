import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from jobloom.llm import packing

PATH = packing.public_vocabulary()


def fewest(lengths, size):
    """The least number of sequences, by trying all ways."""
    @lru_cache(None)
    def go(left):
        if not left:
            return 0
        rest = list(left)
        first = rest.pop()  # the longest
        best = len(left)
        seen = set()

        def extend(start, room, chosen):
            nonlocal best
            key = tuple(chosen)
            if key not in seen:
                seen.add(key)
                remain = Counter(rest) - Counter(chosen)
                best = min(best, 1 + go(tuple(sorted(remain.elements()))))
            for i in range(start, len(rest)):
                if rest[i] <= room:
                    extend(i + 1, room - rest[i], [*chosen, rest[i]])

        extend(0, size - first, [])
        return best

    return go(tuple(sorted(lengths)))


def lower_bound(counts, size):
    """Pieces over half a sequence need one each; what has no room beside them needs more."""
    best = 0
    for least in range(size // 2 + 1):
        large = sum(n for k, n in counts.items() if k > size - least)
        middle = {k: n for k, n in counts.items() if size // 2 < k <= size - least}
        small = sum(k * n for k, n in counts.items() if least <= k <= size // 2)
        room = sum((size - k) * n for k, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - room) // size)))
    return best


def laid_out(plan, counts):
    """sequence -> its (offset, length)s, by the rule that `place` follows."""
    held = {}
    for length, n in counts.items():
        for number in range(n):
            first, times, base, at = [r for r in plan.runs[length] if r[0] <= number][-1]
            i = number - first
            held.setdefault(base + i // times, []).append((at + i % times * length, length))
    return held


def check_layout(plan, counts, size):
    held = laid_out(plan, counts)
    assert sorted(held) == list(range(plan.sequences))
    for content in held.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= size


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    draw = random.Random(seed)
    size = draw.choice([10, 20, 30])
    low, high = draw.choice([(1, size), (size // 5, size), (size // 4, size * 2 // 3)])
    lengths = [draw.randint(max(1, low), high) for _ in range(draw.randint(1, 11))]
    counts = Counter(lengths)
    plan = packing.Plan(counts, size)
    check_layout(plan, counts, size)
    best = fewest(lengths, size)
    assert plan.fixed + fewest([k for k, n in plan.left.items() for _ in range(n)], size) == best
    assert plan.sequences <= best * 11 / 9 + 1


def test_best_fit_as_one_by_one():
    draw = random.Random(8)
    for _ in range(30):
        counts = {k: draw.randint(1, 40) for k in draw.sample(range(1, 100), 12)}
        plan = packing.Plan(counts, 100)
        rooms = []
        for k in sorted(plan.left, reverse=True):
            for _ in range(plan.left[k]):
                fitting = [r for r in rooms if r >= k]
                r = min(fitting, default=100)
                if fitting:
                    rooms.remove(r)
                rooms.append(r - k)
        assert plan.sequences - plan.fixed == len(rooms)
        check_layout(plan, counts, 100)


def test_plan_does_not_grow_with_the_pieces():
    draw = random.Random(4)
    counts = {k: draw.randint(1, 50) for k in range(1, 1025)}
    small, large = packing.Plan(counts), packing.Plan({k: n * 10 ** 9 for k, n in counts.items()})
    runs = [sum(map(len, p.runs.values())) for p in (small, large)]
    assert runs[1] < 2 * runs[0]
    assert lower_bound(counts, 1024) * 10 ** 9 * 0.9999 <= large.sequences < 1.003 * 10 ** 9 * lower_bound(counts, 1024)


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    draw = random.Random(6)
    parts = ["word", " ", "  ", "\n", "\t ", "été", "'s", "'", "日本", " ", "\x1c", "\x85", "12", "!?", "x" * 200, " ",
             "<|endoftext|>", "I'll", ""]
    texts = ["", " ", *("".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(800))]
    for _ in range(2):  # the second time from memory
        ids, counts = own.encode(texts)
        wanted = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert counts.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]
    assert own.encode([])[0].tolist() == []


def test_whole_result(spark, edge, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    size = 64
    found = packing.pack(edge.repartition(3), PATH, size).collect()
    texts = sorted((str(r.doc_id), tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]))
                   for r in edge.collect())
    wanted = []
    for key, ids in texts:
        first = len(ids) - (-(-len(ids) // size) - 1) * size
        cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > first else [0, len(ids)]
        wanted += [(key, i, a, ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(str(r.doc_id), r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found]
    assert sorted(got) == sorted(wanted)
    held = {}
    for r in found:
        assert r.length == len(r.ids) // 4
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in held.values():
        ends = np.cumsum([n for _, n in sorted(content)])
        assert [a for a, _ in sorted(content)] == [0, *ends[:-1]] and ends[-1] <= size
    assert len(held) <= -(-sum(r.length for r in found) // size) + 1
    assert packing.pack(none, PATH, size).count() == 0


def test_sequences_hold_their_pieces(spark):
    draw = random.Random(7)
    docs = spark.createDataFrame(
        [(i, " ".join(["some", "words"] * draw.randint(0, 40))) for i in range(200)], "doc_id long, text string").repartition(4)
    packed = packing.place(packing.staged(packing.pieces(docs, PATH, 50)), 50)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    rows = packed.collect()
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length].tobytes() == bytes(r.ids)
        assert zlib.crc32(bytes(r.ids)) >= 0
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_numbers_hold_across_tasks(spark):
    """One length in all tasks: no place is given twice."""
    docs = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string").repartition(7)
    found = packing.pack(docs, PATH, 10)
    assert found.select("sequence_id", "offset").distinct().count() == 3000
    assert found.agg({"sequence_id": "max"}).first()[0] == 3000 // 3 - 1


def test_parts_with_line_ends_and_digits_go_many_to_a_call():
    known = packing.Encoder(packing.public_vocabulary())
    plain, handed = known.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            handed.extend(texts)
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    known.tokenizer = Counting()
    texts = [" ".join(f"é{i}.\n\nLine{i * j}  <|endoftext|>{j}\t" for i in range(50)) + "  " for j in range(20)]
    texts += ["", " ", "  x\n y", "\x1c a\x1c b", "a\r\n b \n c\x85 　d"]
    ids, counts = known.encode(texts)
    want = [[*plain.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    assert ids.tolist() == [i for t in want for i in t] and counts.tolist() == list(map(len, want))
    assert len(handed) < 50
