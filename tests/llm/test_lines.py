from jobloom.llm import linejoin, lines


def test_first_line_stays(spark):
    rows = [(3, "Same  Line\nown three\n\nlast"), (1, "same line\nx"), (2, "  SAME line \nsame line\nx y\n")]
    found = {r.doc_id: r.dedup for r in lines.drop_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), ["line"], 1).collect()}
    assert found[1].kept_text == "same line\nx" and found[1].n_units == 2
    assert found[2].kept_text == "x y\n" and list(zip(found[2].removed_starts, found[2].removed_ends)) == [(0, 12), (13, 22)]
    assert found[3].kept_text == "own three\n\nlast" and found[3].starts == [11, 21, 22]


def test_paragraphs(spark):
    rows = [(1, "one\ntwo\n\nthree"), (2, "three\n \nfour\n\n\none\nTWO")]
    found = {r.doc_id: r.dedup for r in lines.drop_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), ["paragraph"], 1).collect()}
    assert found[2].kept_text == " \nfour\n\n" and found[1].kept_text == rows[0][1]


def test_a_passage_inside_lines(spark):
    passage = "It begins in one line of text. It goes on in a second sentence of\nwords! And it ends here."
    rows = [(1, passage), (2, f"Before it. {passage} After it."), (3, f"Own. {passage}")]
    found = {r.doc_id: r.dedup for r in lines.drop_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), least=3).collect()}
    assert found[1].kept_text == passage and found[1].removed_starts == []
    # Of a broken sentence each half is one.
    assert found[2].kept_text == "Before it.  \nwords!  After it."
    assert [rows[1][1][a:b] for a, b in zip(found[2].removed_starts, found[2].removed_ends)] == [
        "It begins in one line of text.", "It goes on in a second sentence of", "And it ends here."]
    assert found[3].kept_text == "Own.  "  # its second line is the first document's


def by_hand(docs, least):
    """The same from the definition: every unit against all units before."""
    import re

    white, units = " \t\n\x0b\f\r", []
    for doc, text in docs:
        start, spans = 0, []
        own = []
        for raw in text.split("\n"):
            cuts = [0, *(m.start() for m in re.finditer(r"(?<=[.!?])(?=[ \t])", raw)), len(raw)]
            own.append((start, start + len(raw), [(start + a, start + b) for a, b in zip(cuts, cuts[1:])]))
            start += len(raw) + 1
        spans += [(doc, "s", i, a, b) for i, line in enumerate(own) for a, b in line[2]]
        spans += [(doc, "l", i, line[0], line[1]) for i, line in enumerate(own)]
        for m in re.finditer(r"(?:^|\n)((?:[^\n]*[^\n \t\x0b\f\r][^\n]*(?:\n|$))+)", text):
            spans.append((doc, "p", None, m.start(1), m.end(1)))
        units += [(d, a + len(text[a:b]) - len(text[a:b].lstrip(white)), k, i, a, b,
                   " ".join("".join(c.lower() if c < "\x80" else c for c in text[a:b]).split())) for d, k, i, a, b in spans]
    units = [u for u in units if len(u[6].split()) >= max(1, least)]
    first = {}
    for u in units:
        first[u[6]] = min(first.get(u[6], u[:2]), u[:2])
    repeats = [u for u in units if first[u[6]] != u[:2]]
    return {doc: (len({(u[1], u[6]) for u in units if u[0] == doc}),
                  {c for u in repeats if u[0] == doc for c in range(u[4], u[5]) if text[c] not in white}) for doc, text in docs}


def test_same_as_by_hand(spark):
    import random

    draw = random.Random(5)
    words = ["Aa", "bb.", "cc!", "dd", "É", "ee?"]
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 7))) for _ in range(25)]
    docs = [(d, "".join(draw.choice(made) + draw.choice([" ", "\n", "\n\n", "\n \n", "  ", ".\t"]) for _ in range(draw.randint(0, 14))))
            for d in range(150)]
    for least in (1, 3, 6):
        found = lines.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least=least)
        wanted = by_hand(docs, least)
        for r in found.collect():
            gone = {c for a, b in zip(r.dedup.removed_starts, r.dedup.removed_ends) for c in range(a, b)}
            assert (r.dedup.n_units, {c for c in gone if not r.text[c].isspace()}) == wanted[r.doc_id]
            kept = "".join(r.text[a:b] for a, b in zip(r.dedup.starts, r.dedup.ends))
            assert kept == r.dedup.kept_text.replace("\n", "")


def test_edge_cases(edge, none):
    rows = lines.drop_repeats(edge, ["line"], 1).collect()
    found = {r.doc_id: r.dedup for r in rows}
    assert len(rows) == 12 and found[2].n_units == 0 and found[2].kept_text is None
    assert found[4].kept_text == " \n\t " and found[5].kept_text == "Another line here" and found[9].kept_text == ""
    assert lines.drop_repeats(none).count() == 0
    assert all(r[c] == 7 for r in rows for c in edge.columns[3:] if c != "dedup")


def brute(docs):
    seen, removed = [], {}
    for doc, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            words = set(line.lower().split())
            if words:
                if any(5 * len(words & other) >= 4 * len(words | other) for other in seen):
                    removed.setdefault(doc, []).append(i)
                seen.append(words)
    return removed


def test_near_lines_same_as_brute_force(spark, monkeypatch):
    import random

    draw = random.Random(2)
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 400}"
    base = [[word() for _ in range(draw.randint(1, 25))] for _ in range(60)]
    docs = []
    for d in range(80):
        text = []
        for _ in range(8):
            line = list(draw.choice(base)) if draw.random() < 0.6 else [word() for _ in range(draw.randint(1, 25))]
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                line[draw.randrange(len(line))] = word()
            text.append(" ".join(line))
        docs.append((d, "\n".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    for few in (1, 8):
        monkeypatch.setattr(linejoin, "FEW", few)
        found = {r.doc_id: r.near_lines for r in linejoin.drop_near_lines(df).collect()}
        assert {d: r.removed for d, r in found.items() if r.removed} == want
        for d, text in docs:
            assert found[d].kept_text == "\n".join(
                x for i, x in enumerate(text.split("\n")) if i not in want.get(d, ()))


def test_near_lines_edge_cases(edge, none):
    rows = linejoin.drop_near_lines(edge).collect()
    found = {r.doc_id: r.near_lines for r in rows}
    assert len(rows) == 12 and found[2].n_lines == 0 and found[2].removed == [] and found[2].kept_text is None
    assert found[4].kept_text == " \n\t " and found[5].removed == [0] and found[9].kept_text == ""
    assert linejoin.drop_near_lines(none).count() == 0


def test_few_texts_are_moved_for_unlike_lines(spark, monkeypatch):
    import random

    draw = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    made = [[w if draw.random() < 0.84 else f"w{draw.randrange(1000)}" for w in base] for _ in range(120)]
    docs = [(d, " ".join(words)) for d, words in enumerate(made)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    told, verified = [], linejoin._verified

    def counting(pairs, *others):
        told.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(linejoin, "_verified", counting)
    found = {r.doc_id: r.near_lines.removed for r in linejoin.drop_near_lines(df).collect()}
    want = brute(docs)
    assert {d: r for d, r in found.items() if r} == want
    assert sum(told) <= 20


def test_no_table_of_rarities_is_spelled_out_in_a_plan(spark):
    df = spark.createDataFrame([(1, "one two three\nfour five"), (2, "four five six"), (3, None)], "doc_id long, text string")
    levels = linejoin.rarities(df)
    sets = linejoin.sets_of(df, levels)
    plans = sets._jdf.queryExecution()
    assert len(plans.toString()) < 100_000 and "_levels" not in plans.optimizedPlan().toString()
    assert {(r.doc_id, r.at, r.n) for r in sets.collect()} == {(1, 0, 3), (1, 1, 2), (2, 0, 3)}
    (row,) = levels.collect()
    # two words occur twice (8 * log2(3) = 12), three once, each in a bucket of its own here
    parts = [b for x in row.levels for b in (x & (2 ** 64 - 1)).to_bytes(8, "little") if b]
    assert len(row.levels) == linejoin.BUCKETS // 8 and sorted(parts) == [8, 8, 8, 8, 12, 12]
