"""Near-duplicate texts by an exact inverted join with prefix and skip (problem 4).

Texts with the same set of words are folded into one class first, so a text posted
again and again in other order or punctuation is one row from then on.

A class's words are written in one global order, rare words first, and the class is posted
under the first ones only. Two sets with 10 * common >= 7 * union share a word within
short prefixes, whose lengths depend on which of the two is the larger set:

* the larger, x, shares at least ``ceil(0.7 |x|)`` words, so it looks up its first
  ``|x| - ceil(0.7 |x|) + 1`` words;
* the smaller, y, shares at least ``ceil(1.4 / 1.7 |y|)`` words, so it is posted
  under its first ``|y| - ceil(1.4 / 1.7 |y|) + 1`` words only.

What lies beyond the prefixes is skipped while merging: those are the long
posting lists of frequent words. Collisions are counted per pair, the count
plus what can still follow the last collision bounds the overlap, and pairs
above the bound are checked against the whole word sets. No pair is lost and
none is doubtful. Lists that may still be long are cut into parts that different tasks hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegraph.functions.text import words
from tidegraph.session import written

MIN_WORDS = 8
#: Similarity as a fraction of whole numbers, so that no rounding decides.
NUMERATOR, DENOMINATOR = 7, 10
#: Most words whose frequency is broadcast; rarer ones count as equally rare.
FREQUENT_WORDS = 1_000_000
#: Postings of a word in one part of its list; a word in more texts is spread over several parts.
PART_POSTINGS = 10_000


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def needed(size_a: Column, size_b: Column) -> Column:
    """Least number of common words of two sets that are similar enough."""
    return _ceil_div((size_a + size_b) * NUMERATOR, NUMERATOR + DENOMINATOR)


def distinct_texts(df: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per key: key and ``words``, the sorted 64-bit hashes of the text's distinct words.

    Texts with fewer than ``min_words`` words are left out, as they have no links, and so are NULL keys and
    texts. Of differing texts under one key the one with the least hash holds. Words are cut before rows are
    moved, so a text is read once however often its set is used.
    """
    hashes = F.sort_array(F.array_distinct(F.transform(words(F.col(text)), lambda w: F.xxhash64(w))))
    sets = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), hashes.alias("words"))
    return sets.where(F.size("words") >= min_words).groupBy("key").agg(F.min_by("words", "mark").alias("words"))


def memberships(texts: DataFrame) -> DataFrame:
    """key and ``class`` of each text: the hash of its set of words, equal for texts with equal sets."""
    return texts.select("key", F.xxhash64("words").alias("class"))


def representatives(texts: DataFrame) -> DataFrame:
    """One text of each class, the one with the smallest key: key (the class), words."""
    first = memberships(texts).groupBy("class").agg(F.min("key").alias("key"))
    return texts.join(first, "key").select(F.col("class").alias("key"), "words")


def postings(texts: DataFrame, frequent_words: int = FREQUENT_WORDS, part_postings: int = PART_POSTINGS) -> DataFrame:
    """The prefix words of each text: key, size, word, place (from 1), posted (also in the short prefix) and parts of the word's list.

    Word frequencies are counted over all texts. The table that is broadcast
    holds words of frequency f >= total / ``frequent_words``, of which there can be at most
    ``frequent_words``; all others share the lowest frequency and go by their hash.
    """
    frequency = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    bound = frequency.agg((F.sum("frequency") / frequent_words).alias("bound")).scalar()
    frequent = frequency.where((F.col("frequency") >= bound) & (F.col("frequency") >= 2))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("frequency").asc_nulls_first(), "word"))
    size = F.col("size")
    long_prefix = size - _ceil_div(size * NUMERATOR, DENOMINATOR) + 1
    short_prefix = size - needed(size, size) + 1
    return (
        texts.select("key", F.size("words").alias("size"), F.explode("words").alias("word"))
        .join(F.broadcast(frequent), "word", "left")
        .withColumn("place", place)
        .where(F.col("place") <= long_prefix)
        # a list is no longer than its word is frequent; words without a frequency are in fewer texts than a part holds,
        # as long as all occurrences are fewer than frequent_words * part_postings; beyond that parts are only longer
        .select("key", "size", "word", "place", (F.col("place") <= short_prefix).alias("posted"), F.coalesce(F.ceil(F.col("frequency") / part_postings), F.lit(1)).cast("int").alias("parts"))
    )


def candidate_pairs(posted: DataFrame) -> DataFrame:
    """Pairs (a larger or equal, b) whose prefix collisions leave the threshold within reach."""
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    look = posted.select("word", F.col("key").alias("a"), F.col("size").alias("na"), F.col("place").alias("pa"), every_part)
    hold = posted.where("posted").select("word", F.col("key").alias("b"), F.col("size").alias("nb"), F.col("place").alias("pb"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    ordered = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    in_reach = (F.col("nb") * DENOMINATOR >= F.col("na") * NUMERATOR) & ordered
    need = needed(F.col("na"), F.col("nb"))
    first = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least(F.col("pa"), F.col("pb")) >= need
    return (
        look.join(hold, ["word", "part"])
        .where(in_reach & first)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count(F.lit(1)).alias("collisions"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .where(F.col("collisions") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
        .select("a", "b")
    )


def class_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of different classes (a < b) whose sets share at least 0.7 of their words."""
    one = representatives(texts)
    pairs = candidate_pairs(postings(one))
    # only sets of some pair are read once more
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = one.join(named, "key", "left_semi")
    common = F.size(F.array_intersect("wa", "wb"))
    union = F.size("wa") + F.size("wb") - common
    return (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
        .where(common * DENOMINATOR >= union * NUMERATOR)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def similar_pairs(df: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs of different keys (a < b) whose texts share at least 0.7 of their distinct words.

    Repeated rows of a key count once. Empty tables give no pairs. Every pair is written out, also those within
    a class; ``duplicate_groups`` has one row per key instead.
    """
    texts = distinct_texts(df, key, text, min_words)
    member = memberships(texts)
    a = member.select(F.col("class").alias("a"), F.col("key").alias("ka"))
    b = member.select(F.col("class").alias("b"), F.col("key").alias("kb"))
    across = class_pairs(texts).join(a, "a").join(b, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    within = a.join(b, F.col("a") == F.col("b")).where("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return across.unionByName(within)


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is linked with, over any path) of the pairs a, b.

    Alternates large-star and small-star steps, each written to the shared
    folder; the number of steps grows with the logarithm of the longest path.
    Raises if ``rounds`` steps do not suffice, rather than returning parts.
    """
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = written(edges.distinct(), "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(new, "links")
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def duplicate_groups(df: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per key that has a link: ``key``, ``group`` (smallest key it is linked with) and ``links``, the number of keys it is linked to.

    Only classes are paired. A key's links are the other keys of its class and all
    keys of the classes its own is linked to, so copies are counted and never listed as pairs.
    """
    member = written(memberships(distinct_texts(df, key, text, min_words)), "members")
    pairs = written(class_pairs(distinct_texts(df, key, text, min_words)), "pairs")
    classes = member.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("first"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both.join(classes.select(F.col("class").alias("b"), "members"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("members").alias("across"))
    roots = components(pairs).select(F.col("node").alias("class"), "root")
    linked = classes.join(across, "class", "left").join(roots, "class", "left").withColumn("links", F.col("members") - 1 + F.coalesce("across", F.lit(0))).where("links > 0")
    rooted = linked.withColumn("root", F.coalesce("root", "class"))
    group = rooted.groupBy("root").agg(F.min("first").alias("group"))
    return member.join(rooted.join(group, "root").select("class", "group", "links"), "class").select("key", "group", "links")
