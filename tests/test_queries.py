"""Every registered query against its SQL, or at least run, on the smallest tables."""

import pytest
from compare import database, same

from tidegraph.plans import registry


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, data, db, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], data, db)


def test_unified_holds_every_value(spark, data):
    """The one query without SQL, for its maps: each value of a raw row is a column, a branch or an extra."""
    import json
    from collections import Counter

    raw = {(r.source_file, r.source_row_number, r.record_json) for r in spark.read.parquet(f"{data}/dataset_b_raw.parquet").collect()}
    want, got = Counter(), Counter()
    for file, n, text in raw:
        want[file, n] += sum(v is not None for _, v in json.loads(text, object_pairs_hook=lambda pairs: pairs))
    contract = [r.column_name for r in spark.read.parquet(f"{data}/schema_registry.parquet").select("column_name").distinct().collect()]
    for r in registry.QUERIES["p2_unified"](spark, data).collect():
        row = r.asDict(recursive=True)
        unread = {c for kind in row["branches"].values() for c in kind if row[c] is None}
        got[r.source_file, r.source_row_number] += sum(row[c] is not None for c in contract) + len(unread) + sum(len(v) for v in row["extras"].values())
    assert got == want
    assert set(registry.QUERIES) - set(registry.SQL) == {"p2_unified"} | (set(registry.QUERIES) & {"kmeans_clusters"})


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
