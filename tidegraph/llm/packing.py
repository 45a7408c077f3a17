"""Filling containers of fixed capacity with texts (problem 8).

Bound-certified repacking. Items are spread over groups of bounded size, each
group is packed by best-fit decreasing, and lower bounds from dual feasible
functions say how many containers a group, and all items of a kind, need at
least. A kind that meets its bound is certified and done; of the others,
groups with a gap give up their containers that are not full, and all groups
those with much room, exchange these items pairwise and pack them again,
keeping the better of the old and the new packing, until the bound is met or a round gains nothing.
The result depends on the items only, not on the order of their rows.

A text is cut only if it exceeds the capacity: into full containers and one rest
that is packed like any other item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.session import ship, written

#: Items a group holds on average; a task packs one group.
GROUP_ITEMS = 20_000
#: Containers filled to less than this share are given up for an exchange even in groups that meet their bound.
LOOSE = 0.98
MAX_KINDS = 1_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item; every size is at most ``capacity``.

    Open containers are kept by what is left in them, and the free amounts in
    use are bits of one integer, so the tightest fit is its lowest bit from the
    size upwards. Equal sizes go in the order given.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    rests = 0
    opened = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fitting = rests >> s
        if fitting:
            rest = s + (fitting & -fitting).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                rests &= ~(1 << rest)
        else:
            rest, b = capacity, opened
            opened += 1
        out[i] = b
        by_rest[rest - s].append(b)
        rests |= 1 << (rest - s)
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None, functions: int = 20) -> int:
    """Least number of containers by dual feasible functions, in whole numbers.

    The volume bound, the functions that round (k + 1) x down to multiples of 1/k,
    and those that raise items above 1 - e to 1 and drop those below e, for every e.
    ``counts`` says how many items there are of each size, one if it is missing.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(count, sizes, 1 if counts is None else counts)
    count[0] = 0
    s = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * s).sum()) // capacity)
    for k in range(1, functions + 1):
        scaled = (k + 1) * s
        value = np.where(scaled % capacity == 0, s * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    below = np.concatenate([[0], np.cumsum(count)])  # items smaller than a size
    volume = np.concatenate([[0], np.cumsum(count * s)])
    e = np.arange(1, capacity // 2 + 1)
    large = int(count.sum()) - below[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    return max(best, int((-(-(large * capacity + middle) // capacity)).max(initial=0)))


def items(docs: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """One row per container kind and piece of each text: kind, capacity, key, piece, first_token, size."""
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("c")).distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    if not kinds:
        return docs.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).cast("bigint").alias("capacity"), F.col(key), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("size"))
    each = F.explode(F.array(*[F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.c).cast("bigint").alias("capacity")) for r in kinds])).alias("k")
    rows = docs.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"), each).select(key, "n", "k.*")
    last = F.greatest(F.floor((F.col("n") - 1) / F.col("capacity")), F.lit(0)).cast("int")
    rows = rows.select("container_kind", "capacity", key, "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    return rows.select("container_kind", "capacity", key, "piece", first.alias("first_token"), F.least(F.col("n") - first, F.col("capacity")).alias("size"))


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Packs one group; containers that were already there (old) stay if the new packing needs as many.

    Rows come in any order, so they are sorted by size, hash of the key and piece first; rows that agree in all of these are alike.
    """
    pdf = pdf.sort_values(["size", "mark", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    capacity = int(pdf["capacity"].iat[0])
    sizes = pdf["size"].to_numpy(dtype=np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    old = pdf["container_id"]
    better = not old.notna().all() or used < old.nunique()
    if better:
        prefix = f"{pdf['container_kind'].iat[0]}-{int(pdf['round'].iat[0])}-{int(pdf['grp'].iat[0])}-"
        pdf["container_id"] = [f"{prefix}{b}" for b in bins]
        fill = np.bincount(bins, weights=sizes, minlength=used)[bins].astype(np.int64) if used else sizes
    else:
        used = int(old.nunique())
        fill = pdf.groupby("container_id")["size"].transform("sum").to_numpy(dtype=np.int64)
    pdf["fill"] = fill
    pdf["gap"] = used - lower_bound(sizes, capacity)
    return pdf


def pack(item: DataFrame, key: str = "doc_id", group_items: int = GROUP_ITEMS, rounds: int | None = None) -> DataFrame:
    """``item`` rows with ``container_id`` and ``fill`` (of their container).

    Groups are drawn by hash, so each has about ``group_items`` items whatever the
    number of items; a kind's containers are never shared between groups. Rows with
    equal keys are packed one by one, size 0 goes where there is room. In round r the groups
    that differ in bit r - 1 of their number meet, so after as many rounds as the number of groups has bits
    all of them have met, each time with little more than one loose container a group. ``rounds`` stops
    earlier, to see what the exchange is worth.
    """
    ship(item.sparkSession)
    # sizes come from a tokenizer, so they are written once and read for the count and for the packing
    sized = written(item, "sizes")
    parts = max(1, -(-sized.count() // group_items))
    mark = F.xxhash64(F.col(key), "piece", F.lit(8))
    made = "mark bigint, grp bigint, round int, container_id string, fill bigint, gap bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema), made])
    rows = sized.withColumn("mark", mark).withColumns({"grp": F.pmod(F.col("mark"), F.lit(parts)).cast("bigint"), "round": F.lit(0), "container_id": F.lit(None).cast("string"), "fill": F.lit(0).cast("bigint"), "gap": F.lit(0).cast("bigint")})
    names = rows.columns
    packed = written(rows.groupBy("container_kind", "grp").applyInPandas(_pack_group, schema), "packed")
    done = packed.limit(0).select(names)
    before: dict[str, int] = {}
    r = 0
    while 2**r < parts and (rounds is None or r < rounds):
        now = {c.container_kind: c for c in certificate(done.unionByName(packed.select(names))).collect()}
        # a kind is open while it misses its bound and its last round gained something
        open_kinds = [k for k, c in now.items() if c.containers > c.least_containers and c.containers < before.get(k, c.containers + 1)]
        if not open_kinds:
            break
        before = {k: c.containers for k, c in now.items()}
        r += 1
        slack = (F.col("fill") < F.col("capacity")) & ((F.col("gap") > 0) | (F.col("fill") < F.col("capacity") * LOOSE))
        free = F.coalesce(F.col("container_kind").isin(open_kinds), F.lit(False)) & slack
        done = done.unionByName(packed.where(~free).select(names))
        # two groups meet; the distance between them doubles each round
        meet = F.col("grp") - F.pmod(F.floor(F.col("grp") / F.lit(2 ** (r - 1))), F.lit(2)) * F.lit(2 ** (r - 1))
        again = packed.where(free).withColumns({"grp": meet.cast("bigint"), "round": F.lit(r)}).select(names)
        packed = written(again.groupBy("container_kind", "grp").applyInPandas(_pack_group, schema), "packed")
    return done.unionByName(packed.select(names)).select(*item.columns, "container_id", "fill")


def certificate(packed: DataFrame) -> DataFrame:
    """Per kind: containers, least_containers (a lower bound over all items), items, tokens and filled (their share).

    The bound comes from a histogram of sizes, one row per size, so its input
    does not grow with the number of texts.
    """
    ship(packed.sparkSession)
    sizes = packed.groupBy("container_kind", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iat[0])
        least = lower_bound(pdf["size"].to_numpy(), capacity, pdf["n"].to_numpy())
        return pd.DataFrame({"container_kind": [pdf["container_kind"].iat[0]], "least_containers": [least]})

    least = sizes.groupBy("container_kind").applyInPandas(bound, "container_kind string, least_containers bigint")
    used = packed.groupBy("container_kind", "capacity", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    totals = used.groupBy("container_kind", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("items"), F.sum("s").alias("tokens"))
    return totals.join(least, "container_kind").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
