"""Eligible text units and deterministic samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.config import DEFAULT, Config
from tidegraph.functions.frames import numbered
from tidegraph.functions.hashing import content_hash, fields_hash
from tidegraph.functions.text import is_blank, plain_status
from tidegraph.operators.graph import first_wins

DOMAIN = "tidegraph-unit-v1"
SAMPLE_DOMAIN = "tidegraph-sample-v1"


def exclusion(text: Column) -> Column:
    """null_text, empty_text, whitespace_only_text or NULL for a usable text."""
    return F.when(text.isNull(), "null_text").when(text == "", "empty_text").when(is_blank(text), "whitespace_only_text")


def canonical_locations(report: DataFrame) -> DataFrame:
    """tweet_id and its canonical location from a duplicate report, as far as the report agrees with itself.

    Kept: groups of at least two, with as many locations as counted, whose canonical location is the
    smallest of them. Of repeated groups the smallest location holds.
    """
    spots = F.transform(F.split("source_locations", ";"), lambda x: F.struct(F.regexp_extract(x, r"^(.*):\d+$", 1).alias("f"), F.regexp_extract(x, r":(\d+)$", 1).try_cast("bigint").alias("r")))
    least = F.array_min(spots)
    good = (F.col("occurrence_count") >= 2) & (F.size(spots) == F.col("occurrence_count")) & (least["f"] == F.col("canonical_source_file")) & (least["r"] == F.col("canonical_source_row_number"))
    return report.where(good).groupBy("tweet_id").agg(F.min(F.struct(F.col("canonical_source_file").alias("f"), F.col("canonical_source_row_number").alias("r"))).alias("at")).select("tweet_id", "at.f", "at.r")


def node_units(records: DataFrame, report: DataFrame, run: str = "run") -> DataFrame:
    """Retained records with ``reason`` (NULL if eligible) and the hashes of their text units."""
    text = F.col("text_normalized")
    retained = records.where(plain_status(F.col("record_status")) == "retained")
    joined = retained.join(canonical_locations(report).withColumnRenamed("tweet_id", "_id"), F.col("tweet_id") == F.col("_id"), "left")
    other = F.col("_id").isNotNull() & ~((F.col("source_file") == F.col("f")) & (F.col("source_row_number") == F.col("r")))
    return joined.withColumns(
        {
            "reason": F.coalesce(exclusion(text), F.when(other, "noncanonical_duplicate")),
            "content_hash": content_hash(text),
            "unit_hash": fields_hash(F.lit(DOMAIN), F.lit("node"), F.lit(run), F.col("tweet_id"), F.col("source_file"), F.col("source_row_number")),
        }
    ).drop("_id", "f", "r")


def event_units(events: DataFrame, run: str = "run") -> DataFrame:
    """Events, one per signature, with ``reason`` (NULL if eligible); text_hash must begin the text's hash."""
    text = F.col("cleaned_text")
    one = first_wins(events, ["signature"], ["source_file", "source_row_number"])
    wrong = ~content_hash(text).startswith(F.coalesce(F.col("text_hash"), F.lit("?")))
    return one.withColumns(
        {
            "reason": F.coalesce(exclusion(text), F.when(wrong, "text_hash_mismatch")),
            "content_hash": content_hash(text),
            "unit_hash": fields_hash(F.lit(DOMAIN), F.lit("event"), F.lit(run), F.col("signature")),
        }
    )


def eligibility_report(units: DataFrame) -> DataFrame:
    return units.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("units"))


def activity_terciles(activity: DataFrame, count: str = "n") -> DataFrame:
    """The counts at places (n - 1) // 3 and 2 (n - 1) // 3 of the ordered counts: one row, low and high."""
    by_value = activity.groupBy(count).agg(F.count(F.lit(1)).alias("f"))
    running = by_value.withColumn("upto", F.sum("f").over(W.partitionBy().orderBy(count)))
    total = by_value.agg(F.sum("f")).scalar()
    last = total - 1
    holds = lambda place: F.min(F.when(F.col("upto") > place, F.col(count)))
    return running.agg(holds(F.floor(last / 3)).alias("low"), holds(F.floor(2 * last / 3)).alias("high"))


def priority(unit_hash: Column, seed: int) -> Column:
    """A unit's place in the draw: SHA-256 of seed and unit; as hexadecimal text it sorts as the number does."""
    return F.sha2(F.concat_ws("\x1f", F.lit(SAMPLE_DOMAIN), F.lit(str(seed)), unit_hash), 256)


def with_strata(units: DataFrame, node: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """``units`` with activity, length level, bucket and priority.

    Activity counts are aggregated and joined back per node; the two thresholds are scalars.
    """
    activity = units.groupBy(node).agg(F.count(F.lit(1)).alias("activity"))
    limits = activity_terciles(activity, "activity")
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    level = F.when(F.col("activity") <= low, "low").when(F.col("activity") <= high, "medium").otherwise("high")
    n = F.length(text)
    return units.join(activity, node).withColumns(
        {
            "activity_level": level,
            "length_level": F.when(n <= config.short_chars, "short").when(n <= config.medium_chars, "medium").otherwise("long"),
            "bucket": F.pmod(F.col(node), F.lit(config.node_buckets)).cast("int"),
            "priority": priority(F.col("unit_hash"), config.seed),
        }
    )


def stratified_sample(units: DataFrame, strata: list[str], limit: int, forced: str | None = None) -> DataFrame:
    """``limit`` units: first the best of each ``forced`` value, then the best of each stratum, then the best of all.

    Best means smallest priority, then smallest unit_hash. The bests of groups are found by
    aggregation and the rest by a distributed top-k, so nothing is sorted whole.
    """
    key = F.struct("priority", "unit_hash")
    heads = units.groupBy(*strata).agg(F.min(key).alias("k")).select("k.*").distinct().withColumn("tier", F.lit(1))
    if forced:
        chosen = units.groupBy(forced).agg(F.min(key).alias("k")).select("k.*").distinct().withColumn("tier", F.lit(0))
        heads = heads.unionByName(chosen)
    rest = units.select("priority", "unit_hash").distinct().orderBy("priority", "unit_hash").limit(limit).withColumn("tier", F.lit(2))
    picked = heads.unionByName(rest).groupBy("priority", "unit_hash").agg(F.min("tier").alias("tier")).orderBy("tier", "priority", "unit_hash").limit(limit)
    columns = [c for c in units.columns if c not in ("priority", "unit_hash")]
    one = first_wins(units, ["unit_hash"], ["priority", *columns])
    return one.join(picked.select("unit_hash", "tier"), "unit_hash")


def missing_values(population: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """Values of the population that the sample lacks."""
    return population.select(column).distinct().join(sample.select(column).distinct(), column, "left_anti")


def ordered_prefix(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in a total order."""
    return df.orderBy(*order).limit(limit)


def shard_bounds(batches: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first batch, end) of contiguous shares of ``batches``."""
    if shards < 1 or batches < 0:
        raise ValueError("at least one shard and no negative number of batches")
    return [(i, batches * i // shards, batches * (i + 1) // shards) for i in range(shards)]


def batch_numbers(df: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """``df`` with the number of its batch of ``size`` rows in ``order``, a total order."""
    return numbered(df, order, "_i").withColumn(out, F.floor(F.col("_i") / size).cast("bigint")).drop("_i")


def batch_key(batch: Column, offset: Column) -> Column:
    """The name of a batch: its number and the number of rows before it."""
    return F.format_string("b%08d-o%012d", batch, offset)


def unit_batches(units: DataFrame, size: int) -> DataFrame:
    """Eligible units in batches of ``size`` by their hash: batch_key, first_row, rows and input_hash of each.

    The input hash covers the units' hashes in order, so a batch that is run again with other content is
    told from the same one. A batch has ``size`` rows at most.
    """
    placed = batch_numbers(units.select("unit_hash", "content_hash"), ["unit_hash"], size)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit_hash", "content_hash"))), lambda u: F.concat_ws(",", u["unit_hash"], u["content_hash"]))
    one = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("input_hash"))
    first = (F.col("batch") * size).cast("bigint")
    return one.select(batch_key(F.col("batch"), first).alias("batch_key"), first.alias("first_row"), "rows", "input_hash")


def replay_outcome(batches: DataFrame, committed: DataFrame) -> DataFrame:
    """What running batches again means: batch_key and outcome: new, committed (nothing to do) or conflict (other content than what was committed)."""
    old = committed.select("batch_key", F.col("rows").alias("_rows"), F.col("input_hash").alias("_hash"))
    same = (F.col("rows") == F.col("_rows")) & F.col("input_hash").eqNullSafe(F.col("_hash"))
    return batches.join(old, "batch_key", "left").select("batch_key", F.when(F.col("_rows").isNull(), "new").when(same, "committed").otherwise("conflict").alias("outcome"))


def examples(df: DataFrame, by: list[str], text: str, most: int = 32) -> DataFrame:
    """The ``most`` smallest content hashes of each group, as examples that can be found again: ``by``, content_hash.

    The best of salted parts come first, so no task ranks a whole group.
    """
    h = df.where(F.col(text).isNotNull()).select(*by, content_hash(F.col(text)).alias("content_hash")).distinct().withColumn("_salt", F.substring("content_hash", 64, 1))
    ranked = lambda d, extra: d.withColumn("_r", F.row_number().over(W.partitionBy(*by, *extra).orderBy("content_hash"))).where(F.col("_r") <= most).drop("_r")
    return ranked(ranked(h, ["_salt"]), []).drop("_salt")


def scale_estimate(units: DataFrame, edges: DataFrame, snapshots: int, nodes: int, dimension: int, units_per_second: float | None = None) -> DataFrame:
    """One row: how many units and edges there are and what vectors of four bytes a number need for units, dense nodes and edges, and the time at a measured pace."""
    u = units.agg(F.count(F.lit(1)).alias("units"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    size = dimension * 4
    pace = F.col("units") / F.lit(units_per_second) if units_per_second else F.lit(None).cast("double")
    return u.join(e, F.lit(True)).select(
        "units", "edges", (F.col("units") * size).alias("unit_bytes"), F.lit(snapshots * nodes * size).cast("bigint").alias("node_tensor_bytes"), (F.col("edges") * size).alias("edge_tensor_bytes"), pace.alias("seconds")
    )


def edge_mark(seed: int) -> Column:
    """An edge's place in a draw: sixteen digits of the SHA-256 of its key and the seed."""
    return F.substring(F.sha2(F.concat_ws(",", "snapshot_id", "relation_id", "src_index", "dst_index", F.lit(seed)), 256), 1, 16)


def fanout(edge: DataFrame, group: str, keep: int, seed: int = 7) -> DataFrame:
    """At most ``keep`` edges per group, drawn by hash: the best of each partial group first, then of all.

    A salted first round bounds what any task ranks, whatever the size of a group.
    """
    tagged = edge.withColumn("_m", edge_mark(seed)).withColumn("_salt", F.substring("_m", 1, 2))
    keys = ["snapshot_id", "relation_id", group]
    ranked = lambda df, extra: df.withColumn("_r", F.row_number().over(W.partitionBy(*keys, *extra).orderBy("_m", "src_index", "dst_index"))).where(F.col("_r") <= keep).drop("_r")
    return ranked(ranked(tagged, ["_salt"]), []).drop("_m", "_salt")


def split_edges(edge: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """``edge`` with ``masked``: per snapshot round(rate * E) edges, at least one of two or more, chosen by hash order."""
    n = edge.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_n"))
    want = F.when(F.col("_n") >= 2, F.greatest(F.bround(F.col("_n") * F.lit(rate), 0), F.lit(1.0))).otherwise(F.lit(0.0))
    tagged = edge.withColumn("_m", edge_mark(seed + 1)).withColumn("_b", F.substring("_m", 1, 4))
    sums = tagged.groupBy("snapshot_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy("snapshot_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    place = F.row_number().over(W.partitionBy("snapshot_id", "_b").orderBy("_m", "relation_id", "src_index", "dst_index"))
    return (
        tagged.withColumn("_p", place).join(offsets, ["snapshot_id", "_b"]).join(n, "snapshot_id").withColumn("masked", F.col("_p") + F.col("_before") <= want).drop("_m", "_b", "_p", "_before", "_n")
    )


def negatives(edge: DataFrame, nodes: int, per_edge: int = 3, seed: int = 7, tries: int = 16) -> DataFrame:
    """``per_edge`` unobserved targets per edge, without self-loops, each at most once; fewer only where a source has no more free ones.

    Candidates are hashed numbers below ``nodes``, tried in order; observed ones are left out by an anti join.
    Edges whose tries do not suffice are filled from all remaining nodes.
    """
    mark = lambda *c: F.conv(F.substring(F.sha2(F.concat_ws(",", *c, F.lit(seed)), 256), 1, 15), 16, 10).cast("bigint")
    draw = lambda i: (mark("snapshot_id", "relation_id", "src_index", "dst_index", i.cast("string")) % nodes).cast("int")
    c = edge.select("snapshot_id", "relation_id", "src_index", "dst_index", F.explode(F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(i.alias("try"), draw(i).alias("neg")))).alias("c"))
    c = c.select("snapshot_id", "relation_id", "src_index", "dst_index", "c.*").where("neg <> src_index")
    seen = edge.select("snapshot_id", "relation_id", "src_index", F.col("dst_index").alias("neg")).distinct()
    free = c.join(seen, ["snapshot_id", "relation_id", "src_index", "neg"], "left_anti").groupBy("snapshot_id", "relation_id", "src_index", "dst_index", "neg").agg(F.min("try").alias("try"))
    keys = ["snapshot_id", "relation_id", "src_index", "dst_index"]
    kept = free.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("try", "neg"))), 1, per_edge).alias("n"))
    drawn = kept.select(*keys, F.explode("n").alias("n")).select(*keys, F.col("n.neg").alias("negative"))
    # edges still short take from all free targets of their source, in the order of hashes
    source = ["snapshot_id", "relation_id", "src_index"]
    short = edge.select(*keys).distinct().join(kept, keys, "left").select(*keys, F.coalesce(F.transform("n", lambda x: x["neg"]), F.array().cast("array<int>")).alias("had")).where(F.size("had") < per_edge)
    every = short.select(*source).distinct().select(*source, F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("neg")).where("neg <> src_index")
    more = short.join(every.join(seen, [*source, "neg"], "left_anti"), source).where(~F.array_contains("had", F.col("neg")))
    order = W.partitionBy(*keys).orderBy(mark(*keys, "neg"), "neg")
    filled = more.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_edge).where(F.col("_r") <= per_edge - F.size("had"))
    return drawn.unionByName(filled.select(*keys, F.col("neg").alias("negative")))
