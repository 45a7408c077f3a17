"""Schemas that drift between files (problem 2).

Every cell is read as a tagged value (its JSON type and its text), so a column
is the union of the types it ever held, and nothing is lost by a guess. From
the cells follow

* the profile of each file: columns, their order, and the alternatives of each with their numbers;
* the changes of each file against the one before it in its feed;
* one table with the contract's columns and types, in which values of another type
  stay in typed branches beside it;
* a report of the alternatives per column and per path inside of nested values.

A row keeps its cells as one array. Profiles have a row per file and column and come from counts; rows
meet what is known of their file by one join, and only the few columns that vanished or
appeared are compared by post.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.session import bounded, ship, written

FILE = ["feed_id", "file_seq", "source_file"]
#: Share of the compared cells that must be equal for a rename, in tenths.
SAME_TENTHS = 6
#: Most files whose names are broadcast to the rows; beyond that they meet by a shuffle.
BROADCAST_FILES = 20_000
_POST = r"^[0-9]{15,20}$"


def read_rows(raw: DataFrame) -> DataFrame:
    """Rows with their ``cells``: of each JSON key (of a key given twice both), in order, name, text (NULL for null), type and shape.

    type is string, integer, fraction, boolean, object or array, NULL for null; shape the nested type of
    objects and arrays. Rows whose record_json is NULL, no JSON or no object have NULL cells.
    """
    j = F.col("record_json")
    # both maps hold the keys in the order of the text, so the cells need no look-up by key
    maps = raw.select(*FILE, "source_row_number", F.xxhash64(j).alias("row_hash"), F.from_json(j, "map<string,string>").alias("t"), F.from_json(j, "map<string,variant>").alias("v"))
    tagged = maps.select(*FILE, "source_row_number", "row_hash", F.map_keys("t").alias("names"), F.map_values("t").alias("texts"), F.transform(F.map_values("v"), lambda v: F.schema_of_variant(v)).alias("tags"))

    def cell(c: Column) -> Column:
        text, tag = c["texts"], c["tags"]
        nested = tag.startswith("OBJECT") | tag.startswith("ARRAY")
        kind = (
            F.when(text.isNull() | (tag == "VOID"), F.lit(None).cast("string"))
            .when(tag == "STRING", "string")
            .when(tag == "BOOLEAN", "boolean")
            .when(tag.startswith("OBJECT"), "object")
            .when(tag.startswith("ARRAY"), "array")
            .when(text.rlike(r"[.eE]"), "fraction")
            .otherwise("integer")
        )
        return F.struct(c["names"].alias("name"), text.alias("text"), kind.alias("type"), F.when(nested, tag).alias("shape"))

    return tagged.select(*FILE, "source_row_number", "row_hash", F.transform(F.arrays_zip("names", "texts", "tags"), cell).alias("cells"))


def profiles(row: DataFrame) -> DataFrame:
    """One row per file and column: place, alternatives (type and values of each, most first), rows, id_like.

    A row that leaves keys out shows too small places, so the largest place a key
    has in any row is its place in the file. ``type`` is the first alternative, the type of most
    values; of equally many the first by name.
    """
    cell = row.select(*FILE, F.posexplode("cells").alias("place", "c"))
    counted = cell.groupBy(*FILE, F.col("c.name").alias("name"), F.col("c.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.max("place").alias("place"), F.count_if(F.col("c.text").rlike(_POST)).alias("ids")
    )
    union = F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("n"), "type"))))
    one = counted.groupBy(*FILE, "name").agg(F.max("place").alias("place"), F.transform(union, lambda a: F.struct(a["type"].alias("type"), (-a["n"]).alias("values"))).alias("alternatives"), F.sum("ids").alias("id_like"))
    return one.withColumns({"type": F.get("alternatives", F.lit(0))["type"], "rows": F.aggregate("alternatives", F.lit(0).cast("bigint"), lambda s, a: s + a["values"])})


def read_once(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and profiles as written tables: both are used several times, the texts are parsed once."""
    row = written(read_rows(raw), "rows")
    return row, written(profiles(row), "profiles")


def successions(row: DataFrame) -> DataFrame:
    """One row per file that has a file before it in its feed: the file and prev_seq, prev_file.

    Files of the same feed and number go by name.
    """
    files = row.select(*FILE).where("feed_id is not null and file_seq is not null").distinct()
    order = W.partitionBy("feed_id").orderBy("file_seq", "source_file")
    return files.withColumns({"prev_seq": F.lag("file_seq").over(order), "prev_file": F.lag("source_file").over(order)}).where("prev_file is not null")


def _held_values(row: DataFrame, profile: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked columns (file, name) the smallest text per post: file, post, name, text.

    A row's post is the value of its file's column of ids of 15 to 20 digits; rows without one are left out.
    """
    own = (
        profile.where(F.col("id_like") * 2 > F.col("rows"))
        .groupBy(*FILE)
        .agg(F.min(F.struct((-F.col("id_like")).alias("n"), "place", "name"))["name"].alias("key"))
    )
    wanted = asked.groupBy(*FILE).agg(F.collect_set("name").alias("asked")).join(own, FILE)
    met = row.select(*FILE, "cells").join(bounded(wanted, BROADCAST_FILES), FILE)
    post = F.get(F.filter("cells", lambda c: (c["name"] == F.col("key")) & c["text"].rlike(_POST)), F.lit(0))["text"]
    picked = F.filter("cells", lambda c: F.array_contains("asked", c["name"]))
    cell = met.select(*FILE, post.alias("post"), F.explode(picked).alias("c")).where("post is not null")
    return cell.groupBy(*FILE, "post", F.col("c.name").alias("name")).agg(F.min("c.text").alias("text"))


def column_links(row: DataFrame, profile: DataFrame) -> DataFrame:
    """For each file with a predecessor: its columns and those of the predecessor, linked.

    Columns: the file, prev_file, prev_name and name (NULL on either side if there is no
    partner), renamed (the partner has another name), and place and type on both sides.
    """
    steps = successions(row)
    own = profile.select(*FILE, "name", "place", "type")
    now = steps.select("feed_id", "file_seq", "source_file", "prev_seq", "prev_file").join(own, FILE)
    before = steps.select(
        *FILE, F.col("prev_seq"), F.col("prev_file")
    ).join(own.select("feed_id", F.col("file_seq").alias("prev_seq"), F.col("source_file").alias("prev_file"), "name", F.col("place").alias("prev_place"), F.col("type").alias("prev_type")), ["feed_id", "prev_seq", "prev_file"])
    # small, and used from here on in many ways
    both = written(now.join(before, [*FILE, "prev_seq", "prev_file", "name"], "full").select(*FILE, "prev_seq", "prev_file", "name", "place", "type", "prev_place", "prev_type"), "columns")
    same = both.where("place is not null and prev_place is not null")
    gone = both.where("place is null").select(*FILE, "prev_seq", "prev_file", F.col("name").alias("prev_name"), "prev_place", "prev_type")
    new = both.where("prev_place is null").select(*FILE, "name", "place", "type")

    # only a file that lost columns and has new ones can have renamed any
    open_files = gone.select(*FILE).distinct().join(new.select(*FILE).distinct(), FILE)
    lost_names = gone.join(open_files, FILE, "left_semi").select("feed_id", F.col("prev_seq").alias("file_seq"), F.col("prev_file").alias("source_file"), F.col("prev_name").alias("name"))
    new_names = new.join(open_files, FILE, "left_semi").select(*FILE, "name")
    held = written(_held_values(row, profile, lost_names.union(new_names).distinct()), "held")
    by_post = ["feed_id", "file_seq", "source_file", "post"]
    held_new = held.join(new_names, [*FILE, "name"])
    held_old = gone.select(*FILE, "prev_seq", "prev_file", "prev_name").join(
        held.select("feed_id", F.col("file_seq").alias("prev_seq"), F.col("source_file").alias("prev_file"), "post", F.col("name").alias("prev_name"), F.col("text").alias("prev_text")), ["feed_id", "prev_seq", "prev_file", "prev_name"]
    )
    score = (
        held_old.join(held_new, by_post)
        .groupBy(*FILE, "prev_name", "name")
        .agg(F.count_if(F.col("text") == F.col("prev_text")).alias("equal"), F.count_if(F.col("text").isNotNull() | F.col("prev_text").isNotNull()).alias("compared"))
        .where((F.col("equal") > 0) & (F.col("equal") * 10 >= F.col("compared") * SAME_TENTHS))
    )
    rank = [F.desc(F.col("equal") / F.col("compared")), F.desc("equal")]
    mutual = (
        score.withColumns(
            {
                "a": F.row_number().over(W.partitionBy(*FILE, "prev_name").orderBy(*rank, "name")),
                "b": F.row_number().over(W.partitionBy(*FILE, "name").orderBy(*rank, "prev_name")),
            }
        )
        .where("a = 1 and b = 1")
        .select(*FILE, "prev_name", "name")
    )
    moved = mutual.join(gone, [*FILE, "prev_name"]).join(new, [*FILE, "name"])
    shape = lambda df, prev_name, name, renamed: df.select(*FILE, "prev_seq", "prev_file", prev_name.alias("prev_name"), name.alias("name"), renamed.alias("renamed"), "prev_place", "place", "prev_type", "type")
    nothing = lambda kind: F.lit(None).cast(kind)
    lost = gone.join(mutual, [*FILE, "prev_name"], "left_anti").withColumns({"place": nothing("int"), "type": nothing("string")})
    fresh = new.join(mutual, [*FILE, "name"], "left_anti").withColumns({"prev_place": nothing("int"), "prev_type": nothing("string")}).join(steps, FILE)
    return (
        shape(same, F.col("name"), F.col("name"), F.lit(False))
        .unionByName(shape(moved, F.col("prev_name"), F.col("name"), F.lit(True)))
        .unionByName(shape(lost, F.col("prev_name"), nothing("string"), F.lit(False)))
        .unionByName(shape(fresh, nothing("string"), F.col("name"), F.lit(False)))
    )


def changes(raw: DataFrame) -> DataFrame:
    """source_file, change_type, column_name of every change against the file before.

    removed, added, renamed, retyped (a type on both sides, another one than before)
    and reordered (column_name '*'). Rows read twice change nothing.
    """
    row, profile = read_once(raw)
    links = written(column_links(row, profile), "links")
    paired = F.col("name").isNotNull() & F.col("prev_name").isNotNull()
    change = F.filter(
        F.array(
            F.when(F.col("name").isNull(), F.struct(F.lit("removed").alias("change_type"), F.col("prev_name").alias("column_name"))),
            F.when(F.col("prev_name").isNull(), F.struct(F.lit("added").alias("change_type"), F.col("name").alias("column_name"))),
            F.when(F.col("renamed"), F.struct(F.lit("renamed").alias("change_type"), F.col("name").alias("column_name"))),
            F.when(paired & (F.col("type") != F.col("prev_type")), F.struct(F.lit("retyped").alias("change_type"), F.col("name").alias("column_name"))),
        ),
        lambda c: c.isNotNull(),
    )
    per_column = links.select("source_file", F.explode(change).alias("c")).select("source_file", "c.*")
    order = lambda place: F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("name").alias("n")))), lambda x: x["n"])
    reordered = (
        links.where(paired)
        .groupBy(*FILE)
        .agg(order("prev_place").alias("before"), order("place").alias("now"))
        .where(F.col("before") != F.col("now"))
        .select("source_file", F.lit("reordered").alias("change_type"), F.lit("*").alias("column_name"))
    )
    return per_column.unionByName(reordered)


def canonical_names(links: DataFrame, profile: DataFrame, contract: DataFrame, rounds: int = 40) -> DataFrame:
    """The one name of each column of each file: feed_id, source_file, name, canonical.

    Links to the column of the file before are followed to their first file by
    doubling the step each round, so chains of any length take few rounds. The
    name there, compared without case and punctuation, is the contract's column or a
    column of its own. Of several columns of one file that come to one name, the one called so has it, else
    the first by place; the others keep the names they have in the file.
    """
    node = lambda file, name: F.concat_ws("\x1f", "feed_id", file, name)
    step = links.where("name is not null").select(
        "feed_id", "source_file", "name", node("source_file", "name").alias("node"), F.when(F.col("prev_name").isNotNull(), node("prev_file", "prev_name")).alias("up"), F.coalesce("prev_name", "name").alias("root")
    )
    first = profile.select("feed_id", "source_file", "name").join(step, ["feed_id", "source_file", "name"], "left_anti")
    nodes = step.unionByName(first.select("*", node("source_file", "name").alias("node"), F.lit(None).cast("string").alias("up"), F.col("name").alias("root")))
    nodes = written(nodes, "columns")
    for _ in range(rounds):
        above = nodes.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"))
        nodes = written(
            nodes.join(above, "up", "left").select("feed_id", "source_file", "name", "node", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root")), "columns"
        )
        if not nodes.where("up is not null").limit(1).count():
            break
    else:
        raise RuntimeError(f"column names did not settle in {rounds} rounds")
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    known = contract.select(plain(F.col("column_name")).alias("key"), F.col("column_name").alias("kept")).groupBy("key").agg(F.min("kept").alias("kept"))
    named = nodes.withColumn("key", plain(F.col("root"))).join(known, "key", "left").withColumn("canonical", F.coalesce("kept", "root"))
    placed = named.join(profile.select("feed_id", "source_file", "name", "place"), ["feed_id", "source_file", "name"])
    first = F.row_number().over(W.partitionBy("feed_id", "source_file", "canonical").orderBy((F.col("name") != F.col("canonical")).cast("int"), "place", "name")) == 1
    return placed.withColumn("_first", first).select("feed_id", "source_file", "name", F.when(F.col("_first"), F.col("canonical")).otherwise(F.col("name")).alias("canonical"))


_SQL_TYPES = {"string": "string", "integer": "bigint", "fraction": "double", "boolean": "boolean", "object": "string", "array": "string"}
#: The typed branches: JSON type and the type its values are held in. Objects and arrays stay JSON text.
BRANCHES = {"string": "string", "integer": "decimal(38,0)", "fraction": "double", "boolean": "boolean", "object": "string", "array": "string"}


def _names_of_files(raw: DataFrame, contract: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows, and per file a map of its column names to the one name of each."""
    row, profile = read_once(raw)
    names = canonical_names(written(column_links(row, profile), "links"), profile, contract)
    return row, names.groupBy("feed_id", "source_file").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("_names"))


def _named_cells(row: DataFrame, names: DataFrame) -> DataFrame:
    """``row`` with the one name of each cell's column as ``name`` and the file's own one as ``own``; no shuffle of rows while the files are few."""
    looked = bounded(names.select(F.col("feed_id").alias("_feed"), F.col("source_file").alias("_file"), "_names"), BROADCAST_FILES)
    joined = row.join(looked, F.col("feed_id").eqNullSafe(F.col("_feed")) & F.col("source_file").eqNullSafe(F.col("_file")), "left")
    return joined.withColumn(
        "cells",
        F.transform("cells", lambda c: F.struct(F.coalesce(F.try_element_at("_names", c["name"]), c["name"]).alias("name"), c["name"].alias("own"), c["text"].alias("text"), c["type"].alias("type"))),
    ).drop("_feed", "_file", "_names")


def _typed(text: Column, kind: str) -> Column:
    """A text as a value of a JSON type, NULL where it cannot be one; whole numbers written as fractions are whole."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")) if _SQL_TYPES[kind] == "bigint" else text.try_cast(_SQL_TYPES[kind])


def unify(raw: DataFrame, contract: DataFrame) -> DataFrame:
    """All rows in one table: file, row number, the contract's columns with one type each, ``branches`` and ``extras``.

    A row read twice, with the same number and content, comes out once; rows that hold no JSON object do not come
    out. A value converts to the contract's type where its text allows it. Values of another JSON type also stay as what
    they were in ``branches``, a struct with one map of columns to values for each type, so a
    conflict is a typed branch beside the canonical value. Columns outside the contract, and further values
    of one column in one row, are in ``extras``: the file's own name to all its texts. Nothing is dropped.
    """
    wanted = [(r.column_name, r.json_type) for r in contract.select("column_name", "json_type", "column_position").distinct().orderBy("column_position").limit(10_000).collect()]
    row, names = _names_of_files(raw, contract)
    once = row.where("cells is not null").groupBy(*FILE, "source_row_number", "row_hash").agg(F.any_value("cells").alias("cells"))
    named = _named_cells(once, names)
    types = dict(wanted)
    of = lambda c: F.filter("cells", lambda x: x["name"] == c)
    # the first value a row has for a column is the column's; what comes after it is extra
    chosen = named.withColumn("_own", F.array(*[F.coalesce(F.get(F.filter(of(c), lambda x: x["text"].isNotNull()), F.lit(0)), F.get(of(c), F.lit(0))) for c in types]))
    other = F.filter("cells", lambda x: x["text"].isNotNull() & ~F.exists("_own", lambda o: F.coalesce((o["own"] == x["own"]) & (o["text"] == x["text"]), F.lit(False))))
    expected = F.create_map(*[x for c, t in wanted for x in (F.lit(c), F.lit(t))])
    strays = F.filter("_own", lambda o: o["text"].isNotNull() & (o["type"] != F.try_element_at(expected, o["name"])))

    def branch(kind: str) -> Column:
        entries = F.transform(F.filter("_strays", lambda o: o["type"] == kind), lambda o: F.struct(o["name"].alias("key"), o["text"].try_cast(BRANCHES[kind]).alias("value")))
        return F.map_from_entries(entries).alias(kind)

    texts = lambda k: F.transform(F.filter("_other", lambda x: x["own"] == k), lambda x: x["text"])
    keys = F.array_distinct(F.transform("_other", lambda x: x["own"]))
    extras = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), texts(k).alias("value"))))
    values = [_typed(F.get("_own", F.lit(i))["text"], t).alias(c) for i, (c, t) in enumerate(wanted)]
    ready = chosen.withColumns({"_other": other, "_strays": strays})
    return ready.select(*FILE, "source_row_number", *values, F.struct(*[branch(k) for k in BRANCHES]).alias("branches"), extras.alias("extras"))


def sheet(raw: DataFrame, contract: DataFrame, columns: list[str]) -> DataFrame:
    """``raw`` with the values of these columns of the contract as text, whatever each file calls them.

    Every row of ``raw`` comes out once, also repeated ones and those that hold no JSON object. Of
    several values of one column the first is taken, as in ``unify``.
    """
    _, names = _names_of_files(raw, contract)
    looked = bounded(names.select(F.col("feed_id").alias("_feed"), F.col("source_file").alias("_file"), "_names"), BROADCAST_FILES)
    read = raw.withColumn("_cells", F.map_entries(F.from_json("record_json", "map<string,string>")))
    joined = read.join(looked, F.col("feed_id").eqNullSafe(F.col("_feed")) & F.col("source_file").eqNullSafe(F.col("_file")), "left")
    held = lambda c: F.get(F.filter("_cells", lambda e: (F.coalesce(F.try_element_at("_names", e["key"]), e["key"]) == c) & e["value"].isNotNull()), F.lit(0))["value"]
    return joined.withColumns({c: held(c) for c in columns}).drop("_cells", "_feed", "_file", "_names")


def nested_paths(shape: str) -> list[tuple[str, str]]:
    """The paths inside of a nested type as Spark writes it, with the JSON type at each: .key for objects, [] for arrays."""
    out: list[tuple[str, str]] = []

    def kind(tag: str) -> str:
        if tag.startswith("DECIMAL"):
            return "integer" if tag.rstrip(")").endswith(",0") else "fraction"
        return {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "fraction", "FLOAT": "fraction", "VOID": "null"}.get(tag, "mixed")

    def read(at: int, path: str) -> int:
        """Reads one type from ``at``; where it ends."""
        if shape.startswith("OBJECT<", at):
            out.append((path, "object"))
            at += len("OBJECT<")
            while shape[at] != ">":
                if shape[at] == "`":
                    end = shape.index("`: ", at + 1)
                    name, at = shape[at + 1 : end].replace("``", "`"), end + 3
                else:
                    end = shape.index(": ", at)
                    name, at = shape[at:end], end + 2
                at = read(at, f"{path}.{name}")
                at += 2 if shape.startswith(", ", at) else 0
            return at + 1
        if shape.startswith("ARRAY<", at):
            out.append((path, "array"))
            return read(at + len("ARRAY<"), f"{path}[]") + 1
        end, depth = at, 0
        while end < len(shape) and (depth or shape[end] not in ",>"):
            depth += {"(": 1, ")": -1}.get(shape[end], 0)
            end += 1
        out.append((path, kind(shape[at:end])))
        return end

    read(0, "")
    return out[1:]  # the first is the value itself


def _inner(shapes: DataFrame) -> DataFrame:
    """file, name and shape with counts n to one row per path inside: file, name, path, type, n."""
    ship(shapes.sparkSession)

    @F.arrow_udf("array<struct<path:string,type:string>>")
    def paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"path": p, "type": t} for p, t in nested_paths(s)] for s in batch.to_pylist()], pa.list_(pa.struct([("path", pa.string()), ("type", pa.string())])))

    return shapes.select(*FILE, "name", "n", F.explode(paths(F.col("shape"))).alias("p")).select(*FILE, "name", "p.path", "p.type", "n")


def alternatives(raw: DataFrame, contract: DataFrame) -> DataFrame:
    """The union of types per path: feed_id, canonical, type, values, files, first_seq (where the alternative appears).

    ``canonical`` is the one name of a column, for values inside of objects and arrays followed by
    their path ('user.id', 'tags[]'); types inside of which different rows disagree have one row each.
    """
    row, profile = read_once(raw)
    names = canonical_names(written(column_links(row, profile), "links"), profile, contract)
    top = profile.select(*FILE, "name", F.lit("").alias("path"), F.explode("alternatives").alias("a")).select(*FILE, "name", "path", "a.type", F.col("a.values").alias("n"))
    cell = row.select(*FILE, F.explode(F.filter("cells", lambda c: c["shape"].isNotNull())).alias("c"))
    shapes = cell.groupBy(*FILE, F.col("c.name").alias("name"), F.col("c.shape").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return (
        top.unionByName(_inner(shapes))
        .join(names, ["feed_id", "source_file", "name"])
        .groupBy("feed_id", F.concat("canonical", "path").alias("canonical"), "type")
        .agg(F.sum("n").alias("values"), F.count_distinct("source_file").alias("files"), F.min("file_seq").alias("first_seq"))
    )
