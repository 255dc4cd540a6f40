"""Whole-word hits of a large vocabulary, as a join.

Text and entries are cut into tokens: runs of word characters, and each other character by itself. An
entry with word boundaries at both ends stands in a text exactly where its tokens do, next to a
word if it begins or ends with another character. Of each place of a text the first tokens (three, or as many as the
shortest entry has) meet the heads of the entries, which few places pass; from those, runs as long as an entry with that
head meet the entries by their text. The entries are staged, so that Spark knows their size and broadcasts
them where they are few; then no place of a text is shuffled. A text is taken in stretches, so
that a row stays small however long the text is. Work grows with the text and
with the hits, not with the vocabulary, and entries may overlap or hold one another.
"""

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions.text import bind
from jobloom.sources.shared import staged

_TOKENS = r"(?U)\w+|(?s:.)"
#: Tokens that must be those of an entry before runs are made; places of a stretch of text.
HEAD, STRETCH = 3, 256


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKENS), F.lit(0))


def _is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(r"(?U)^\w"), F.lit(False))


def entries(vocabulary: DataFrame) -> DataFrame:
    """(place, entry) -> (place, entry, key, head, n, opens, closes): `head` has the first tokens, `opens` and `closes`
    say that a word must stand before or after."""
    c = F.col
    read = vocabulary.where(c("entry") != "").select("place", "entry", tokens(c("entry")).alias("t"))
    return read.select(
        "place", "entry", F.array_join("t", "").alias("key"), F.slice("t", 1, HEAD).alias("head"), F.size("t").alias("n"),
        (~_is_word(F.element_at("t", 1))).alias("opens"), (~_is_word(F.element_at("t", -1))).alias("closes"))


def find_entries(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """texts (id, text), vocabulary (place, entry) -> (id, place, entry), a row for each entry that a text holds, ignoring case.
    Rows that repeat an id are one text in parts; texts without a hit have no row."""
    c = F.col
    known = staged(entries(vocabulary))
    longest, shortest = known.agg(F.max("n"), F.min("n")).first()
    longest, head = longest or 1, min(shortest or 1, HEAD)
    # How long the entries are that begin with these tokens.
    starts = known.select(F.array_join(F.slice("head", 1, head), "").alias("head"), "n").groupBy("head").agg(
        F.collect_set("n").alias("lengths"))

    def stretches(t: Column) -> Column:
        """Each with the token before it and those that an entry may have behind it, and one more."""
        return F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(STRETCH)), lambda k: F.slice(
            t, k + 1, F.lit(STRETCH + longest + 1)))

    before_all = F.concat(F.array(F.lit("")), tokens(c("text")))  # so that the first token has one before it
    read = texts.where(c("id").isNotNull()).select("id", F.explode(bind(before_all, stretches)).alias("stretch"))
    # Of each place its first tokens, and the token before it, as many as an entry has, and one more.
    first = F.concat(*[F.get("stretch", c("at") + (i + 1)) for i in range(head)])
    places = read.select("id", "stretch", F.posexplode(F.slice("stretch", 2, STRETCH)).alias("at", "_")).select(
        "id", F.coalesce(first, F.lit("")).alias("head"), F.slice("stretch", c("at") + 1, F.lit(longest + 2)).alias("near"))
    begun = places.join(starts, "head")
    runs = begun.select("id", "near", F.explode("lengths").alias("n")).where(F.size("near") > c("n")).select(
        "id", F.array_join(F.slice("near", F.lit(2), c("n")), "").alias("key"),
        _is_word(F.get("near", F.lit(0))).alias("before"), _is_word(F.get("near", c("n") + 1)).alias("after"))
    found = runs.join(known.drop("head", "n"), "key").where(
        (c("before") | ~c("opens")) & (c("after") | ~c("closes")))
    return found.select("id", "place", "entry").distinct()


def find_listed(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, found): the entries of each text in the order of the vocabulary; [] where there are none."""
    hits = find_entries(texts, vocabulary).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("place", "entry"))).alias("hits"))
    return texts.select("id").join(hits, "id", "left").select("id", F.coalesce(
        F.transform("hits", lambda h: h["entry"]), F.array().cast("array<string>")).alias("found"))
