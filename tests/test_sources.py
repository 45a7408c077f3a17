import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import pooling, profile, selection, validate
from tidegraph.sources import files, sinks
from tidegraph.sources.workbook import WorkbookSource, rows, sheet_names
from tidegraph.streaming import ingest


def workbook(path, sheet, table):
    """A small workbook with shared strings, written by hand."""
    strings, cells = [], []
    for i, row in enumerate(table, 1):
        out = ""
        for j, v in enumerate(row):
            if v is None:
                continue
            ref = f"{chr(65 + j)}{i}"
            if isinstance(v, str):
                out += f'<c r="{ref}" t="s"><v>{len(strings)}</v></c>'
                strings.append(v)
            else:
                out += f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f'<row r="{i}">{out}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_workbook_source(spark, tmp_path):
    for n in (1, 2):
        workbook(tmp_path / f"b{n}.xlsx", "tweets", [["id", "text", "likes"], ["1", f"a{n}", 5], ["2", None, 6]])
    assert sheet_names(str(tmp_path / "b1.xlsx")) == ["tweets"]
    assert list(rows(str(tmp_path / "b1.xlsx"), "tweets", 2)) == [(1, ["id", "text", "likes"]), (3, ["2", None, "6"])]
    spark.dataSource.register(WorkbookSource)
    df = spark.read.format("workbook").option("sheet", "tweets").option("columns", "id,text").load(str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got[0] == ("1", "a1", "b1.xlsx", "tweets", 2) and len(got) == 4 and ("2", None, "b2.xlsx", "tweets", 3) in got
    with pytest.raises(Exception, match="missing columns"):
        spark.read.format("workbook").option("sheet", "tweets").option("columns", "id,nothing").load(str(tmp_path)).collect()


def test_files_and_cache(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n in (2, 10):
        (src / f"p{n}.txt").write_text("x" * n)
    s = files.build_source(str(src))
    assert [f["name"] for f in s.list_files()] == ["p2.txt", "p10.txt"]
    assert files.listing(spark, str(src)).count() == 2
    cache, calls = files.Cache(tmp_path / "c"), []
    for _ in range(2):
        cache.get("p2.txt", 2, lambda to: (calls.append(1), s.fetch("p2.txt", to)))
    assert len(calls) == 1 and json.loads((tmp_path / "c/index.json").read_text())["p2.txt"]["size"] == 2
    for bad in ("/etc/passwd", "../x"):
        with pytest.raises(ValueError):
            files.safe_path(tmp_path, bad)
    with pytest.raises(NotImplementedError):
        files.build_source("ftp://host/x")


def test_insert_ignore_and_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([("k1", "b", 2), ("k1", "a", 9), ("k2", "a", 1)], "signature string, source_file string, source_row_number bigint")
    sinks.insert_ignore(a, p, ["signature"], ["source_file", "source_row_number"])
    sinks.insert_ignore(a.withColumn("source_file", F.lit("0")), p, ["signature"], ["source_file", "source_row_number"])
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("k1", "a", 9), ("k2", "a", 1)]
    new = spark.createDataFrame([("k2", "z", 5)], a.schema)
    sinks.upsert(new, p, str(tmp_path / "u"), ["signature"], "source_row_number")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("k1", "a", 9), ("k2", "z", 5)]


def test_edge_partitions_prune(spark, tmp_path):
    e = spark.createDataFrame([(s, r, 0, 1, 1, 0.69) for s in range(3) for r in range(2)], "snapshot_id int, relation_id int, src_index int, dst_index int, count_raw bigint, weight_log1p double")
    sinks.write_edges(e, str(tmp_path / "e"))
    back = files.canonical_edges(spark, str(tmp_path / "e"))
    assert back.count() == 6 and "PartitionFilters: [isnotnull(snapshot" in back.where("snapshot_id = 1")._jdf.queryExecution().executedPlan().toString()


def test_sealed_reports(tmp_path):
    m = sinks.seal({"calendar": {"rows": 3}}, tmp_path / "r", "cfg")
    assert sinks.verify(tmp_path / "r") == [] and m["scientific_hash"] == sinks.seal({"calendar": {"rows": 3}}, tmp_path / "r2", "cfg")["scientific_hash"]
    (tmp_path / "r/calendar.json").write_text("{}")
    assert sinks.verify(tmp_path / "r") == ["calendar has changed"]
    for bad in ({"text": 1}, {"a": "x@y.org"}, {"a": "/home/u/f"}, {"a": "z" * 300}):
        with pytest.raises(ValueError):
            sinks.seal({"r": bad}, tmp_path / "x", "c")


def test_stream_goes_on_after_new_files(spark, tmp_path):
    src, out = tmp_path / "s", tmp_path / "o"
    make = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(str(src))
    make(0, 10)
    schema = spark.read.parquet(str(src)).schema
    run = lambda: ingest.ingest(spark, str(src), schema, str(out / "rows"), str(out / "cp"), files_per_batch=1)
    assert run() == 1 and run() == 0
    make(10, 25)
    make(25, 30)
    assert run() == 2
    assert sorted(r.id for r in ingest.committed(spark, str(out / "rows")).collect()) == list(range(30))
    assert ingest.assess(out / "rows", 3) == "completed" and ingest.assess(out / "rows", 4) == "incomplete" and ingest.assess(tmp_path / "no", 1) == "absent"
    (out / "rows/batch_id=1/_SUCCESS").unlink()
    assert ingest.quarantine(out / "rows", out / "aside") == ["batch_id=1"]
    ingest.guard(out, "a")
    ingest.guard(out, "a")
    with pytest.raises(ValueError):
        ingest.guard(out, "b")


def test_selection_edge_cases(spark):
    assert selection.shard_bounds(10, 3) == [(0, 0, 3), (1, 3, 6), (2, 6, 10)]
    texts = spark.createDataFrame([("good",), (None,), ("",), ("\u00a0\t",)], "t string")
    assert [r[0] for r in texts.select(selection.exclusion(F.col("t"))).collect()] == [None, "null_text", "empty_text", "whitespace_only_text"]
    report = spark.createDataFrame([("d", "exact_duplicate", 2, "a.xlsx", 9, "a.xlsx:9;b.xlsx:2"), ("e", "exact_duplicate", 3, "a", 1, "a:1;b:2"), ("f", "exact_duplicate", 2, "b", 2, "a:1;b:2")], "tweet_id string, duplicate_type string, occurrence_count bigint, canonical_source_file string, canonical_source_row_number bigint, source_locations string")
    assert [tuple(r) for r in selection.canonical_locations(report).collect()] == [("d", "a.xlsx", 9)]


def test_negatives_are_unobserved(spark):
    e = spark.createDataFrame([(0, 0, s, t, 1, 0.69) for s in range(4) for t in range(5) if s != t], "snapshot_id int, relation_id int, src_index int, dst_index int, count_raw bigint, weight_log1p double")
    seen = {(r.src_index, r.dst_index) for r in e.collect()}
    got = selection.negatives(e, 8).collect()
    assert got and all((r.src_index, r.negative) not in seen and r.src_index != r.negative for r in got)
    assert len({tuple(r) for r in got}) == len(got)


def test_pooling_zeros(spark):
    u = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (2, 3, [2.0, 2.0]), (1, 0, None)], "snapshot_id int, node_index int, embedding array<float>")
    grid = spark.createDataFrame([(s, n) for s in range(3) for n in range(4)], "snapshot_id int, node_index int")
    got = {(r.snapshot_id, r.node_index): r for r in pooling.node_vectors(pooling.mean_pool(u, ["snapshot_id", "node_index"]), grid, 2).collect()}
    assert got[0, 1].vector == [0.5, 0.5] and got[0, 1].valid_count == 2 and not got[1, 0].available and got[1, 0].vector == [0, 0]
    assert abs(float((pooling.mock_vector("ab", 8) ** 2).sum()) - 1) < 1e-5


def test_validators(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 0), ("c", 9)], "account_id string, node_index int")
    assert {(r.problem, r.value) for r in validate.node_violations(nodes, 3).collect()} == {("out_of_bounds", "9"), ("repeated_index", "0")}
    assert not validate.node_map_gate(nodes).first().contiguous
    df = spark.createDataFrame([(True, True, False, True), (True, False, False, True)], "model_active boolean, struct_active boolean, node_text_available boolean, edge_text_available boolean")
    assert validate.activity_violations(df).count() == 1
    a = spark.createDataFrame([("s1",), ("s2",)], "shard_id string")
    b = spark.createDataFrame([("s1",), ("s1",), ("s3",)], "shard_id string")
    assert {tuple(r) for r in validate.shard_violations(a, b).collect()} == {("s1", "repeated"), ("s2", "missing"), ("s3", "unexpected")}
    v = spark.createDataFrame([(1, [1.0], True), (2, [1.0, float("nan")], True), (3, [1.0, 0.0], False), (4, [0.0, 0.0], False)], "k int, v array<double>, on boolean")
    assert {tuple(r) for r in validate.vector_violations(v, "k", "v", 2, "on").collect()} == {(1, "wrong_size"), (2, "not_finite"), (3, "unavailable_not_zero")}
    assert validate.next_status("running", "completed") == "completed"
    with pytest.raises(ValueError):
        validate.next_status("completed", "certified")


def test_profile(spark):
    df = spark.createDataFrame([("1", "u1", "1519862400", "x"), ("2", "u2", "1519862401", None), ("2", "u2", "1519862402", "z"), ("3", None, "1519862403", "y")], "id string, user_id string, created_at string, text string")
    r = profile.key_profile(df, "id", "user_id", "created_at").first()
    assert (r.rows, r.distinct_keys, r.duplicate_rows, r.distinct_users, r.invalid_times) == (4, 3, 1, 2, 0)
    got = {r.column: r for r in profile.column_profile(df).collect()}
    assert got["text"].nulls == 1 and got["id"].type == "integer" and got["id"].distinct_values == 3
    assert profile.column_roles(["id", "user_id", "created_at", "text", "lang"])["timestamp"] == ["created_at"]


def test_written_tables_are_released(spark):
    from tidegraph import session

    session.release(spark)
    t = session.written(spark.range(5), "test")
    path = t.inputFiles()[0]
    assert t.count() == 5 and path.startswith(spark.conf.get("spark.checkpoint.dir")) and session.release(spark) == 1
    assert session.release(spark) == 0
