"""Normalisation of raw text rows, duplicates, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, Config
from tidegraph.functions.hashing import fields_hash
from tidegraph.functions.ids import account_id, tweet_id, tweet_id_error, user_object
from tidegraph.functions.text import is_blank, normalized_text, plain_status
from tidegraph.functions.times import created_at, snapshot
from tidegraph.operators.skew import account_key

METRICS = ("likes", "retweets", "reply_count", "quoted_count", "bookmarks", "views")


def whole_number(c: Column) -> Column:
    """A metric as a whole number, fractions cut off; NULL for anything that is no number."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")).when(s.rlike(r"^[+-]?\d+\.\d*(?:[eE][+-]?\d+)?$"), s.try_cast("double").try_cast("bigint"))


def text_quality(c: Column) -> Column:
    """null, empty, whitespace_only or ok."""
    return F.when(c.isNull(), "null").when(c == "", "empty").when(is_blank(c), "whitespace_only").otherwise("ok")


def normalise(rows: DataFrame, nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Raw text rows (ten columns plus file, sheet and row) to the 24 normalised columns.

    First failure wins: bad post id, bad user, bad time (rejected), author outside
    the universe, time outside the calendar (excluded), else retained.
    """
    user = user_object(F.col("user"))
    t = created_at(F.col("created_at"), config)
    read = rows.select("*", user.alias("_u"), t.alias("_t"), tweet_id_error(F.col("id")).alias("_bad")).withColumnRenamed("text", "text_raw")
    joined = read.join(nodes.select(F.col("account_id").alias("_a"), "node_index"), account_id(F.col("_u.account_id")) == F.col("_a"), "left").drop("_a")
    reason = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(~F.col("_u.ok"), F.col("_u.error"))
        .when(F.col("_t").isNull(), "invalid_timestamp")
        .when(F.col("node_index").isNull(), "author_not_in_frozen_universe")
        .when(snapshot(F.col("_t"), config).isNull(), "outside_canonical_snapshot_range")
    )
    excluded = ("author_not_in_frozen_universe", "outside_canonical_snapshot_range")
    status = F.when(F.col("exclusion_reason").isNull(), "retained").when(F.col("exclusion_reason").isin(*excluded), "excluded").otherwise("rejected")
    done = normalized_text(joined.withColumn("exclusion_reason", reason), "text_raw", "text_normalized").withColumn("record_status", status)
    return done.select(
        tweet_id(F.col("id")).alias("tweet_id"),
        F.col("_u.account_id").alias("author_account_id"),
        "node_index",
        F.col("created_at").cast("string").alias("created_at_original"),
        F.col("_t").cast("timestamp").alias("created_at_utc"),
        snapshot(F.col("_t"), config).alias("snapshot_id"),
        "text_raw",
        "text_normalized",
        text_quality(F.col("text_normalized")).alias("text_quality"),
        F.length("text_raw").cast("bigint").alias("text_raw_len"),
        F.length("text_normalized").cast("bigint").alias("text_normalized_len"),
        *[whole_number(F.col(m)).alias(m) for m in METRICS],
        "source_file",
        "source_sheet",
        "source_row_number",
        "record_status",
        "exclusion_reason",
        F.lit(None).cast("boolean").alias("is_duplicate"),
        F.lit(None).cast("boolean").alias("is_canonical_duplicate"),
    )


def duplicate_groups(df: DataFrame, key: Column, content: Column, where: Column | None = None) -> DataFrame:
    """Per key: occurrences, distinct contents, files and the canonical (first) location.

    Counts of distinct contents and files are counts over keys reduced before, so a key on a third of all rows stays spread.
    """
    rows = df.where(where) if where is not None else df
    one = rows.select(key.alias("key"), content.alias("content"), "source_file", "source_row_number").where(F.col("key").isNotNull())
    states = one.groupBy("key", "content", "source_file").agg(F.count(F.lit(1)).alias("n"), F.min("source_row_number").alias("row"))
    contents = states.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct("source_file", "row")).alias("first"))
    files = states.groupBy("key", "source_file").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("files"))
    whole = contents.groupBy("key").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("contents"), F.min("first").alias("first"))
    return whole.join(files, "key").select("key", "occurrences", "contents", "files", F.col("first.source_file").alias("canonical_source_file"), F.col("first.row").alias("canonical_source_row_number"))


def duplicate_effects(records: DataFrame) -> DataFrame:
    """What leaving repeated posts out would do, per file and snapshot: rows, rows of repeated posts, and rows that would go."""
    k = tweet_id(F.col("tweet_id"))
    groups = duplicate_groups(records, k, post_content()).where("occurrences > 1").select("key", "canonical_source_file", "canonical_source_row_number")
    rows = records.select(k.alias("key"), "source_file", "source_row_number", "snapshot_id").join(groups, "key", "left")
    repeated = F.col("canonical_source_file").isNotNull()
    own = (F.col("source_file") == F.col("canonical_source_file")) & (F.col("source_row_number") == F.col("canonical_source_row_number"))
    return rows.groupBy("source_file", "snapshot_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(repeated).alias("repeated_rows"), F.count_if(repeated & ~own).alias("dropped_rows"))


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, duplicate groups, concordant and discordant ones, within one file and across files, rows too many."""
    dup = F.col("occurrences") > 1
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(dup).alias("duplicate_groups"),
        F.count_if(dup & (F.col("contents") == 1)).alias("concordant"),
        F.count_if(dup & (F.col("contents") > 1)).alias("discordant"),
        F.count_if(dup & (F.col("files") == 1)).alias("within_file"),
        F.count_if(dup & (F.col("files") > 1)).alias("cross_file"),
        F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("extra_rows"),
    )


def multiplicity(groups: DataFrame) -> DataFrame:
    return groups.groupBy("occurrences").agg(F.count(F.lit(1)).alias("groups"))


def post_content() -> Column:
    """What must agree for two rows of a post to be exact duplicates."""
    return fields_hash(F.col("author_account_id"), F.col("created_at_original"), F.col("text_raw"))


def duplicate_report(records: DataFrame) -> DataFrame:
    """One row per post on several rows, as DuplicateReportRow; locations are listed in order."""
    k = tweet_id(F.col("tweet_id"))
    groups = duplicate_groups(records, k, post_content()).where("occurrences > 1")
    spots = (
        records.select(k.alias("key"), F.struct("source_file", "source_row_number").alias("at"))
        .join(groups.select("key"), "key", "left_semi")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("at")).alias("at"))
        .select("key", F.array_join(F.transform("at", lambda x: F.concat(x["source_file"], F.lit(":"), x["source_row_number"])), ";").alias("source_locations"))
    )
    return groups.join(spots, "key").select(
        F.col("key").alias("tweet_id"),
        F.when(F.col("contents") == 1, "exact_duplicate").otherwise("conflicting_id").alias("duplicate_type"),
        F.col("occurrences").alias("occurrence_count"),
        "canonical_source_file",
        "canonical_source_row_number",
        "source_locations",
    )


def with_duplicate_flags(records: DataFrame) -> DataFrame:
    """``records`` with is_duplicate and is_canonical_duplicate filled."""
    groups = duplicate_groups(records, tweet_id(F.col("tweet_id")), post_content()).where("occurrences > 1")
    joined = records.drop("is_duplicate", "is_canonical_duplicate").withColumn("key", tweet_id(F.col("tweet_id"))).join(groups, "key", "left")
    own = (F.col("source_file") == F.col("canonical_source_file")) & (F.col("source_row_number") == F.col("canonical_source_row_number"))
    return joined.select(
        *[c for c in records.columns if c not in ("is_duplicate", "is_canonical_duplicate")],
        F.col("occurrences").isNotNull().alias("is_duplicate"),
        (F.col("occurrences").isNotNull() & own).alias("is_canonical_duplicate"),
    )


def account_reconciliation(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per author: rows, retained rows, node index and whether the author is in the universe."""
    counted = (
        records.where(account_key(F.col("author_account_id")).isNotNull())
        .groupBy(account_key(F.col("author_account_id")).alias("account_id"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(plain_status(F.col("record_status")) == "retained").alias("retained"))
    )
    return counted.join(nodes.groupBy("account_id").agg(F.min("node_index").alias("node_index")), "account_id", "left").withColumn("matched", F.col("node_index").isNotNull())


def author_overlap(events: DataFrame, records: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many authors both tables have, only one has, and how many are outside the universe or never seen."""
    a = events.select(account_key(F.col("author_account_id")).alias("id")).where("id is not null").distinct().withColumn("a", F.lit(1))
    b = records.select(account_key(F.col("author_account_id")).alias("id")).where("id is not null").distinct().withColumn("b", F.lit(1))
    n = nodes.select(F.col("account_id").alias("id")).distinct().withColumn("n", F.lit(1))
    both = a.join(b, "id", "full").join(n, "id", "full")
    has = lambda c: F.col(c).isNotNull()
    return both.agg(
        F.count_if(has("a") & has("b")).alias("in_both"),
        F.count_if(has("a") & ~has("b")).alias("only_events"),
        F.count_if(has("b") & ~has("a")).alias("only_records"),
        F.count_if((has("a") | has("b")) & ~has("n")).alias("outside_universe"),
        F.count_if(has("n") & ~has("a") & ~has("b")).alias("unseen"),
    )


def row_accounting(records: DataFrame) -> DataFrame:
    """Rows in, by status; statuses in any spelling, missing ones apart."""
    s = plain_status(F.col("record_status"))
    return records.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_in"),
        *[F.count_if(s == x).alias(x) for x in ("retained", "excluded", "rejected")],
        F.count_if(s.isNull()).alias("without_status"),
    )


def text_quality_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("text_quality").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("text_normalized_len").alias("shortest"),
        F.max("text_normalized_len").alias("longest"),
        F.round(F.avg("text_normalized_len"), 6).alias("mean_length"),
    )


def repeated_texts(records: DataFrame) -> DataFrame:
    """Texts on several rows: how often, by how many authors, in how many snapshots."""
    t = F.col("text_normalized")
    one = records.where(~is_blank(t)).select(F.sha2(t, 256).alias("text_hash"), "author_account_id", "snapshot_id")
    pairs = one.groupBy("text_hash", "author_account_id", "snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        pairs.groupBy("text_hash")
        .agg(F.sum("n").alias("occurrences"), F.count_distinct("author_account_id").alias("authors"), F.count_distinct("snapshot_id").alias("snapshots"))
        .where("occurrences > 1")
    )


def repeats_by_scope(records: DataFrame) -> DataFrame:
    """How many texts stand on several rows, by who and when: same author at one time or several, several authors."""
    t = F.col("text_normalized")
    one = records.where(~is_blank(t)).select(F.sha2(t, 256).alias("h"), "author_account_id", "created_at_utc")
    by_author = one.groupBy("h", "author_account_id").agg(F.count(F.lit(1)).alias("n"), F.min("created_at_utc").alias("a"), F.max("created_at_utc").alias("b"))
    per = by_author.groupBy("h").agg(F.sum("n").alias("n"), F.count("author_account_id").alias("authors"), F.bool_or(F.col("a") < F.col("b")).alias("times")).where("n > 1")
    scope = F.when(F.col("authors") > 1, "several_authors").when(F.col("authors") == 0, "no_author").when(F.coalesce("times", F.lit(False)), "same_author_other_time").otherwise("same_author_same_time")
    return per.groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows"))
