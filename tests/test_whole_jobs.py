"""Jobs done on the whole of their input."""

import json
from datetime import datetime

import pytest

RAW = "feed_id string, file_seq int, source_file string, source_sheet string, source_row_number bigint, received_at timestamp, record_json string"


def test_sheet_follows_renames(spark, tmp_path):
    from tidegraph.plans import core

    post = lambda i: str(10**17 + i)
    first = [("f", 1, "a", "s", i, datetime(2020, 1, 1), json.dumps({"id": post(i), "text": f"t{i}", "likes": i})) for i in range(5)]
    later = [("f", 2, "b", "s", i, datetime(2020, 1, 2), json.dumps({"statusId": post(i), "body": f"t{i}", "likes": i})) for i in range(6)]
    odd = [("f", 2, "b", "s", 7, datetime(2020, 1, 2), "no json"), later[0]]
    spark.createDataFrame(first + later + odd, RAW).write.parquet(f"{tmp_path}/dataset_b_raw.parquet")
    contract = [("x", n, c, "integer" if c == "likes" else "string") for n, c in enumerate(("id", "created_at", "user", "text", "likes"), 1)]
    spark.createDataFrame(contract, "family_sig string, column_position int, column_name string, json_type string").write.parquet(f"{tmp_path}/schema_registry.parquet")
    got = sorted((r.source_file, r.source_row_number, r.id, r.text, r.likes) for r in core.unified_sheet(spark, str(tmp_path)).where("source_row_number < 7").collect())
    want = [("a", i, post(i), f"t{i}", str(i)) for i in range(5)] + [("b", 0, post(0), "t0", "0")] + [("b", i, post(i), f"t{i}", str(i)) for i in range(6)]
    assert got == want
    odd = core.unified_sheet(spark, str(tmp_path)).where("source_row_number = 7").collect()
    assert len(odd) == 1 and odd[0].id is None and odd[0].text is None


def test_sheet_keeps_what_has_plain_names(spark, data):
    from tidegraph.plans import core

    rows = lambda df: sorted(map(str, df.select("source_file", "source_row_number", "id", "text").collect()))
    plain, unified = core.raw_sheet(spark, data), core.unified_sheet(spark, data)
    assert plain.count() == unified.count()
    held = rows(plain.where("id is not null and text is not null"))
    assert not set(held) - set(rows(unified))


def test_profile_has_every_column(spark, data):
    from tidegraph.plans import core

    got = core.profile_columns(spark, data).select("column").collect()
    assert sorted(r.column for r in got) == sorted(spark.read.parquet(f"{data}/normalized_records.parquet").columns)


def test_empty_quarters_of_the_whole_table(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    from tidegraph.functions import times
    from tidegraph.plans import core

    every = core.interactions
    monkeypatch.setattr(core, "interactions", lambda s, d: every(s, d).where(times.snapshot(F.col("created")).isin(3, 6)))
    got = {r.snapshot_id: r.position for r in core.empty_quarters(spark, data).collect()}
    assert got == {i: "leading" if i < 3 else "internal" if i < 6 else "trailing" for i in range(35) if i not in (3, 6)}
    monkeypatch.setattr(core, "interactions", lambda s, d: every(s, d).where("false"))
    assert [r.position for r in core.empty_quarters(spark, data).collect()] == ["leading"] * 35


def test_model_queries_use_every_relation_and_feature(spark, data, monkeypatch):
    from tidegraph.config import FEATURES
    from tidegraph.plans import vectors

    assert sorted(r.feature for r in vectors.robust_scaler_fit(spark, data).collect()) == sorted(FEATURES)
    assert set(vectors.robust_scaled(spark, data).columns) == {"snapshot_id", "node_index", *FEATURES}
    every = vectors.edges_of
    monkeypatch.setattr(vectors, "edges_of", lambda s, d: every(s, d).where("relation_id = 3"))
    got = vectors.relation_fusion(spark, data)
    assert got.count() > 0 and got.where("fused < 1").count() == 0


def test_negatives_are_filled_where_few_targets_are_free(spark):
    from tidegraph.operators import selection

    e = spark.createDataFrame([(0, 0, 0, t) for t in range(1, 996)] + [(0, 0, 1, t) for t in range(2, 999)], "snapshot_id int, relation_id int, src_index int, dst_index int")
    got = selection.negatives(e, 1000).collect()
    per_edge = {}
    for r in got:
        per_edge.setdefault((r.src_index, r.dst_index), []).append(r.negative)
    assert all(len(set(per_edge[0, t])) == len(per_edge[0, t]) == 3 and set(per_edge[0, t]) <= {996, 997, 998, 999} for t in range(1, 996))
    assert all(sorted(per_edge[1, t]) == [0, 999] for t in range(2, 999))


def test_semantic_loss_takes_odd_ids_too(spark, tmp_path):
    from tidegraph.plans import vectors

    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vectors.semantic_loss(spark, str(tmp_path)).first().loss == pytest.approx(0.254644, abs=1e-5)
