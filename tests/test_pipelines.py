import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph import pipelines
from tidegraph.__main__ import main
from tidegraph.config import Config
from tidegraph.operators import forward
from tidegraph.plans import core
from tidegraph.sources.sinks import verify
from tidegraph.sources.tables import table


def test_graph_then_embeddings(spark, data, tmp_path):
    out = str(tmp_path / "g")
    nodes = core.nodes(spark, data)
    pipelines.build_graph(core.interactions(spark, data), nodes, out)
    assert pipelines.check_package(spark, out) == [] and verify(f"{out}/reports") == []
    report = json.loads((tmp_path / "g/reports/graph.json").read_text())
    assert sum(report["ladder"].values()) == table(spark, data, "graph_events").count()
    edges = spark.read.parquet(f"{out}/edges").withColumnsRenamed({"snapshot": "snapshot_id", "relation": "relation_id"}).select("snapshot_id", "relation_id", "src_index", "dst_index")
    small = Config(dimension=4, sample_limit=50)
    made = pipelines.build_embeddings(core.plain_records(spark, data), table(spark, data, "duplicate_report"), nodes, edges, spark.read.parquet(f"{out}/events"), str(tmp_path / "e"), small, 60)
    assert "alignment" in made["files"]
    v = spark.read.parquet(str(tmp_path / "e/nodes"))
    assert v.count() == 35 * 4000 and v.where("available and valid_count < 1").count() == 0
    assert pipelines.check_package(spark, str(tmp_path / "none")) != []


def test_records_and_diagnostics(spark, data, tmp_path):
    nodes = core.nodes(spark, data)
    pipelines.normalise_records(core.raw_sheet(spark, data), nodes, str(tmp_path / "r"))
    a = pipelines.run_diagnostics(core.interactions(spark, data), core.plain_records(spark, data), nodes, str(tmp_path / "d1"))
    b = pipelines.run_diagnostics(core.interactions(spark, data).repartition(7), core.plain_records(spark, data).repartition(3), nodes, str(tmp_path / "d2"))
    assert set(a["files"]) == {"calendar", "duplicates", "lengths", "coverage"}
    order = lambda d: json.dumps({n: _sorted(json.loads((tmp_path / d / "reports" / f"{n}.json").read_text())) for n in a["files"]}, sort_keys=True)
    assert order("d1") == order("d2") and b["settings"] == a["settings"]


def _sorted(x):
    if isinstance(x, dict):
        return {k: _sorted(v) for k, v in x.items()}
    return sorted((_sorted(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True)) if isinstance(x, list) else x


def test_bad_node_map_stops(spark, data, tmp_path):
    nodes = core.nodes(spark, data).withColumn("node_index", F.col("node_index") + 1)
    with pytest.raises(ValueError, match="contiguous"):
        pipelines.build_graph(core.interactions(spark, data), nodes, str(tmp_path / "x"))


def test_command_line(spark, data, tmp_path, capsys):
    (tmp_path / "b10.txt").write_text("x")
    (tmp_path / "b9.txt").write_text("xy")
    assert main(["list", str(tmp_path)]) == 0 and capsys.readouterr().out.split() == ["2", "b9.txt", "1", "b10.txt"]
    assert main(["query", "calendar_bins", data, str(tmp_path / "c")]) == 0 and spark.read.parquet(str(tmp_path / "c")).count() == 35
    assert main(["node-map", f"{data}/node_universe.parquet", "account_id", str(tmp_path / "n")]) == 0
    assert spark.read.parquet(str(tmp_path / "n")).join(core.nodes(spark, data), ["account_id", "node_index"]).count() == 4000
    assert main(["discover", f"{data}/calendar_sources.parquet"]) == 0 and "timezone_assumption" in capsys.readouterr().out
    assert main(["check", str(tmp_path / "none")]) == 3


def test_forward_passes_against_numpy(spark):
    rng = np.random.default_rng(0)
    h = {i: rng.normal(size=3) for i in range(4)}
    ws, wn = rng.normal(size=(2, 3)), rng.normal(size=(2, 3))
    nodes = spark.createDataFrame([(0, i, v.tolist()) for i, v in h.items()], "snapshot_id int, node_index int, h array<double>")
    pairs = [(0, 1), (2, 1), (1, 3)]
    edges = spark.createDataFrame([(0, s, t) for s, t in pairs], "snapshot_id int, src_index int, dst_index int")
    got = {r.node_index: np.array(r.h) for r in forward.sage_layer(nodes, edges, ws, wn).collect()}
    for i in h:
        near = [h[s] for s, t in pairs if t == i]
        want = np.maximum(ws @ h[i] + (wn @ np.mean(near, axis=0) if near else 0), 0)
        assert np.allclose(got[i], want)
    w = {k: rng.normal(size=(2, 3 if k[0] == "W" else 2)) for k in ("W_z", "U_z", "W_r", "U_r", "W_n", "U_n")}
    seq = spark.createDataFrame([(t, 0, h[t].tolist(), t != 1) for t in range(3)], "snapshot_id int, node_index int, h array<double>, active boolean")
    s = {r.snapshot_id: r.s for r in forward.gru(seq, w, 2).collect()}
    assert s[0] == s[1] != s[2]
    r = spark.range(1).select(forward.edge_gate(F.array(F.lit(1.0)), [2.0], -2.0).alias("g"), forward.link_logit(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)), [1, 0.5]).alias("l")).first()
    assert r.g == 0.5 and r.l == 7.0
