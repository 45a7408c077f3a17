"""Command line: python -m tidegraph COMMAND ...; every command works on tables in Parquet.

    list FOLDER                        files with size, in natural order
    discover TABLE...                  columns, roles, types of tables
    node-map TABLE COLUMN OUT          account ids to dense indices
    graph DATA OUT                     events, edges, features with gates
    records DATA OUT                   normalised records with accounting
    diagnostics DATA OUT               four sealed reports
    embeddings DATA GRAPH OUT [LIMIT]  units, vectors, pooled and aligned
    check GRAPH                        what is wrong with a published graph
    query NAME DATA OUT                a registered query to Parquet
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidegraph import pipelines
from tidegraph.config import DEFAULT, load_config
from tidegraph.operators import graph
from tidegraph.plans import core, registry
from tidegraph.sources.files import build_source, canonical_edges
from tidegraph.sources.sinks import write_table
from tidegraph.sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", help="settings in JSON or YAML")
    c = p.add_subparsers(dest="command", required=True)
    for name, args in {"list": ["folder"], "node-map": ["table", "column", "out"], "graph": ["data", "out"], "records": ["data", "out"], "diagnostics": ["data", "out"], "check": ["graph"], "query": ["name", "data", "out"]}.items():
        s = c.add_parser(name)
        for a in args:
            s.add_argument(a)
    s = c.add_parser("discover")
    s.add_argument("table", nargs="+")
    s = c.add_parser("embeddings")
    for a in ("data", "graph", "out"):
        s.add_argument(a)
    s.add_argument("limit", nargs="?", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load_config(a.config) if a.config else DEFAULT
    if a.command == "list":
        for f in build_source(a.folder).list_files():
            print(f["size"], f["name"])
        return 0
    spark = SparkSession.builder.appName("tidegraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done: object = None
    if a.command == "discover":
        done = pipelines.discover({t: spark.read.parquet(t) for t in a.table})
    elif a.command == "node-map":
        write_table(graph.node_map(spark.read.parquet(a.table), a.column), a.out)
    elif a.command == "graph":
        done = pipelines.build_graph(core.interactions(spark, a.data), core.nodes(spark, a.data), a.out, config)
    elif a.command == "records":
        done = pipelines.normalise_records(core.unified_sheet(spark, a.data), core.nodes(spark, a.data), a.out, config)
    elif a.command == "diagnostics":
        done = pipelines.run_diagnostics(core.interactions(spark, a.data), core.plain_records(spark, a.data), core.nodes(spark, a.data), a.out, config)
    elif a.command == "embeddings":
        edges = canonical_edges(spark, f"{a.graph}/edges").select("snapshot_id", "relation_id", "src_index", "dst_index")
        done = pipelines.build_embeddings(core.plain_records(spark, a.data), table(spark, a.data, "duplicate_report"), core.nodes(spark, a.data), edges, spark.read.parquet(f"{a.graph}/events"), a.out, config, a.limit)
    elif a.command == "check":
        problems = pipelines.check_package(spark, a.graph, config)
        print("\n".join(problems) or "nothing is wrong")
        return 3 if problems else 0
    elif a.command == "query":
        write_table(registry.QUERIES[a.name](spark, a.data), a.out)
    if done is not None:
        print(json.dumps(done, indent=1, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
